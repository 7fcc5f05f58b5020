"""Incremental forms of the batch operators, by Structured Streaming."""
