"""Sources: workbooks, landing folders and stand-in tables."""
