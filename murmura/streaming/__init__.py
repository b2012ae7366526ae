"""Structured Streaming forms of windowed counts, deduplication and keyed state."""
