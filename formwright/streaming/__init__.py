"""Structured Streaming forms of document scoring and run metrics."""
