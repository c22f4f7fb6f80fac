"""Relational and graph operators over the estate tables."""
