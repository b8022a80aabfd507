"""Operators for large training-data pipelines: scanning, filtering, deduplication, mixing, sharding, scoring."""
