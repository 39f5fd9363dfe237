"""Structured Streaming jobs over the interaction log."""
