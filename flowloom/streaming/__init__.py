"""Incremental refresh of the estate tables."""
