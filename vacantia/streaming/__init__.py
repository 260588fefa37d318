"""Structured Streaming: incremental collection."""
