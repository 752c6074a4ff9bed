"""Operators over corpora: search and display, statistics, vocabulary, result cache."""
