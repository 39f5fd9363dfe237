"""Readers and writers of raw files and of the layered Parquet store."""
