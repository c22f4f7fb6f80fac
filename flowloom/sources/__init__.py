"""Readers and writers: workflow YAML, SARIF reports, Parquet tables."""
