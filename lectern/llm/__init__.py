"""Operators of a training-data pipeline: quality, deduplication, packing, archives, privacy."""
