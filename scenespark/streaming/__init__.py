"""Structured Streaming over the append-only result log."""
