"""Structured Streaming: progress events and continuous ingestion."""
