"""The pattern language: parser and syntax tree.

A pattern is one or more bracketed tokens; each token is an OR of ANDs of literals. Values are
classified once: letters and digits only are exact, ``x.*`` is a prefix, ``.*x`` a suffix, and
anything else a regular expression for the whole value.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import PySparkException

FEATURE = re.compile(r"[a-z_][a-z_0-9]*")
ATOM = re.compile(r'\s*([|&]?)\s*(\w+)\s*(!?)\s*(=|contains\b)\s*"([^"]+)"')
TOKEN = re.compile(r"\s*\[(.*?)\]", re.DOTALL)


class QueryError(ValueError):
    """A pattern, or a name in it, that can't be used."""


def feature_name(name: str) -> str:
    """Lower-cased and checked."""
    low = name.lower()
    if not FEATURE.fullmatch(low):
        raise QueryError(f"not a feature name: {name!r}")
    return low


def check_regex(value: str) -> None:
    """QueryError if Spark can't run a regular expression. Where no session runs, Python's own is asked."""
    context = SparkContext._active_spark_context
    try:
        if context is None:
            re.compile(value)
        else:
            context._jvm.java.util.regex.Pattern.compile(value)
    except (re.error, Py4JJavaError, PySparkException) as e:
        raise QueryError(f"not a regular expression: {value!r}") from e


@dataclass(frozen=True, order=True)
class Literal:
    feature: str
    kind: str  # exact, prefix, suffix or regex
    value: str
    negative: bool = False

    @classmethod
    def of(cls, feature: str, value: str, negative: bool = False) -> Literal:
        value = value.strip()
        if value.isalnum():
            return cls(feature, "exact", value, negative)
        if value.endswith(".*") and value[:-2].isalnum():
            return cls(feature, "prefix", value[:-2], negative)
        if value.startswith(".*") and value[2:].isalnum():
            return cls(feature, "suffix", value[2:], negative)
        check_regex(value)
        return cls(feature, "regex", value, negative)

    def __str__(self) -> str:
        shown = {"prefix": f"{self.value}.*", "suffix": f".*{self.value}"}.get(self.kind, self.value)
        return f'{self.feature}{"!" if self.negative else ""}="{shown}"'


@dataclass(frozen=True)
class Token:
    """Alternatives, each a conjunction; no alternative at all is the wildcard ``[]``."""

    alternatives: tuple[tuple[Literal, ...], ...] = ()

    @property
    def literals(self) -> tuple[Literal, ...]:
        return tuple(x for alt in self.alternatives for x in alt)

    def groups(self) -> list[tuple[Literal, ...]]:
        """The same as a conjunction of disjunctions."""
        out: list[tuple[Literal, ...]] = [()]
        if not self.alternatives:
            return []
        for alt in self.alternatives:
            out = [(*g, x) for g in out for x in alt]
        return out

    def __str__(self) -> str:
        return "[" + " | ".join(" & ".join(map(str, a)) for a in self.alternatives) + "]"


@dataclass(frozen=True)
class Query:
    tokens: tuple[Token, ...]
    sentence_breaks: bool = True

    @property
    def length(self) -> int:
        return len(self.tokens)

    @property
    def features(self) -> list[str]:
        """Features of the literals, in order of their first use."""
        return list(dict.fromkeys(x.feature for t in self.tokens for x in t.literals))

    @property
    def literals(self) -> list[tuple[int, Literal]]:
        """Literals with their offsets."""
        return [(k, x) for k, t in enumerate(self.tokens) for x in t.literals]

    @property
    def positive(self) -> list[tuple[int, Literal]]:
        return [(k, x) for k, x in self.literals if not x.negative]

    @property
    def negative(self) -> list[tuple[int, Literal]]:
        return [(k, x) for k, x in self.literals if x.negative]

    @property
    def min_offset(self) -> int:
        return min((k for k, _ in self.literals), default=0)

    @property
    def max_offset(self) -> int:
        return max((k for k, _ in self.literals), default=0)

    def is_negative(self) -> bool:
        """Whether no group of literals is purely positive."""
        groups = [g for t in self.tokens for g in t.groups()]
        return all(any(x.negative for x in g) for g in groups)

    def expand(self) -> list[Query]:
        """Plain conjunctions whose union is this query."""
        out: list[tuple[Token, ...]] = [()]
        for t in self.tokens:
            out = [(*q, Token((alt,) if alt else ())) for q in out for alt in (t.alternatives or ((),))]
        return [Query(q, self.sentence_breaks) for q in out]

    def subsumed_by(self, other: Query) -> bool:
        """Whether every literal of this conjunction, at its place, is one of ``other``."""
        mine = {(k, x) for k, t in enumerate(self.tokens) for x in t.literals}
        return mine <= {(k, x) for k, t in enumerate(other.tokens) for x in t.literals}

    def contains_disjunction(self) -> bool:
        return any(len(t.alternatives) > 1 for t in self.tokens)

    def contains_prefix(self) -> bool:
        return any(x.kind == "prefix" for t in self.tokens for x in t.literals)

    def __str__(self) -> str:
        return " ".join(map(str, self.tokens))


def parse(text: str, sentence_breaks: bool = True, allow_negative: bool = False) -> Query:
    """Parses a pattern; QueryError if it isn't one, or has only negative literals."""
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _token(text, at)
        if m is None:
            raise QueryError(f"not a pattern: {text!r}")
        token, at = m
        tokens.append(token)
    if not tokens:
        raise QueryError("empty pattern")
    query = Query(tuple(tokens), sentence_breaks)
    if not allow_negative and query.is_negative():
        raise QueryError(f"no positive literal in {text!r}")
    return query


def _token(text: str, at: int) -> tuple[Token, int] | None:
    m = re.compile(r"\s*\[").match(text, at)
    if not m:
        return None
    at, alternatives = m.end(), []
    while m := ATOM.match(text, at):
        literal = Literal.of(feature_name(m[2]), m[5], m[3] == "!")
        if m[1] == "|" or not alternatives:
            alternatives.append([])
        alternatives[-1].append(literal)
        at = m.end()
    m = re.compile(r"\s*\]\s*").match(text, at)
    return (Token(tuple(map(tuple, alternatives))), m.end()) if m else None
