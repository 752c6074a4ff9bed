"""Corvane: pattern search and corpus statistics over annotated text, as Spark plans."""

__version__ = "0.1.0"
