"""Structured Streaming jobs reusing the batch transforms."""
