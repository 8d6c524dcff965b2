"""Operators for large training corpora: search, filtering, deduplication, mixing and tokens."""
