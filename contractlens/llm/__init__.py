"""Operators for training-data pipelines: extraction, filtering, deduplication, mixing, tokens."""
