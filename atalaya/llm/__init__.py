"""Operators of a training-data pipeline: packing, tokenizing, near duplicates, filters."""
