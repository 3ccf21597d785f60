"""Structured Streaming jobs over the same expressions as the batch operators."""
