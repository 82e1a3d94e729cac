"""Operators of a training-data pipeline: archives, tokenising, deduplication, scoring, mixing, sharding."""
