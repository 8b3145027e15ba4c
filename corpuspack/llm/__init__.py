"""Operators for preparing training data: duplicates, quality, mixing, sharding, encoding."""
