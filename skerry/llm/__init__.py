"""Operators for preparing training data: packing, search, deduplication, extraction, filtering, tokenizing."""
