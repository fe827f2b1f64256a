"""Incremental indexing and event streams with Structured Streaming."""
