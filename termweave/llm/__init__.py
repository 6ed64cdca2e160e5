"""Operators for training-data pipelines: packing, filtering, deduplication, archives, models."""
