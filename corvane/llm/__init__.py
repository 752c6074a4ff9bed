"""Operators for preparing language-model training data.

Nothing outside this package imports it. Each module holds one operator with a general
interface, and the thin query that applies it to a driver table.
"""
