"""Operators of a large-scale training-data pipeline: archives, deduplication, quality, language, mixing."""
