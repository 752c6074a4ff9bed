"""Readers of annotated text, and corpora stored as Parquet."""
