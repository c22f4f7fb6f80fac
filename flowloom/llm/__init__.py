"""Operators for preparing training data: extraction, filtering, deduplication, mixing."""
