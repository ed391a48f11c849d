"""Operators of a training-data pipeline: scoring, filtering, near-duplicate removal, packing."""
