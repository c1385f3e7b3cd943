"""Structured Streaming twins of the windowed aggregates (an extension)."""
