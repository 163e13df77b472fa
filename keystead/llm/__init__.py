"""Operators for training-data pipelines: deduplication, filtering, extraction, packing, scoring."""
