"""Operators for training-data pipelines: tokens, near duplicates, filters, search, extraction."""
