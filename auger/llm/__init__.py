"""Operators for training-data preparation (packing, scoring, near-duplicates, sharding, ...)."""
