"""gridquill: a Spark-native engine for spreadsheet-style document retrieval."""
