"""Operators of a training-data pipeline: cleaning, deduplication, tokens, packing and vector search."""
