"""Structured Streaming versions of the change-data operators."""
