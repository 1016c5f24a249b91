"""Operators for training-data pipelines: cleaning, matching, searching and encoding of texts."""
