"""Literals, tokens and names as Spark columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.lang import Literal, Token

REVERSED = "_reversed"


def column_name(feature: str) -> str:
    """Features have a prefix in tables, so none can clash with a structural column."""
    return f"f_{feature}"


def full_match(value: Column, pattern: str, mode: str = "chars") -> Column:
    """Whether the pattern matches the whole value, which must not be empty. ``bytes`` matches UTF-8
    bytes rather than characters."""
    if mode == "bytes":
        value = F.decode(F.encode(value, "UTF-8"), "ISO-8859-1")
        pattern = pattern.encode().decode("latin-1")
    return (value != "") & value.rlike(rf"\A(?d:{pattern})\z")


def literal(x: Literal, value: Column, mode: str = "chars") -> Column:
    """Two-valued on values that aren't null."""
    test = {
        "exact": lambda: value == x.value,
        "prefix": lambda: value.startswith(x.value),
        "suffix": lambda: value.endswith(x.value),
        "regex": lambda: full_match(value, x.value, mode),
    }[x.kind]()
    return ~test if x.negative else test


def token(t: Token, value: Callable[[str], Column], mode: str = "chars") -> Column | None:
    """The predicate of one token; None for the wildcard. ``value`` gives the column of a feature."""
    alternatives = []
    for alt in t.alternatives:
        test = None
        for x in alt:
            one = literal(x, value(x.feature), mode)
            test = one if test is None else test & one
        alternatives.append(test)
    out = None
    for a in alternatives:
        out = a if out is None else out | a
    return out


def reverse(value: Column) -> Column:
    """Reversed by code point."""
    return F.reverse(value)


def base_feature(feature: str) -> str:
    return feature.removesuffix(REVERSED)


def is_reversed(feature: str) -> bool:
    return feature.endswith(REVERSED)
