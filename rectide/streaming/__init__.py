"""Structured Streaming variants of the incremental log operators."""
