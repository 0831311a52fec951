"""Operators for preparing training data: deduplication, filtering, mixing, sharding."""
