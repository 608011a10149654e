"""The per-line operators on Structured Streaming."""
