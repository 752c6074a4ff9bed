"""Patterns to hits: (sent, at) for every start position, without repeats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import predicates
from corvane.functions.predicates import column_name
from corvane.lang import Query
from corvane.plans import indexes
from corvane.sources.corpus import Corpus


def by_arrays(corpus: Corpus, query: Query, mode: str = "chars") -> DataFrame:
    """Within sentences, by array functions over the sentence table."""
    n = query.length
    rows = corpus.sentences.where(F.col("n") >= n)  # also keeps the sequence from counting down

    def fits(i: Column) -> Column:
        out = F.lit(True)
        for k, t in enumerate(query.tokens):
            test = predicates.token(t, lambda f, k=k: F.get(F.col(column_name(f)), i + k), mode)
            out = out if test is None else out & test
        return out

    starts = F.filter(F.sequence(F.lit(0), F.col("n") - n), fits)
    found = rows.select("sent", "sent_start", F.explode(starts).alias("k"))
    return found.select("sent", (F.col("sent_start") + F.col("k")).alias("at"))


def across_arrays(corpus: Corpus, query: Query, mode: str = "chars") -> DataFrame:
    """Over sentence breaks: what lies within a sentence by its arrays. Of any other start each sentence tells how
    many of the pattern's tokens fit at its own positions, if all that lie there do; a start is a hit if all tokens
    are told. Only starts next to a break meet."""
    n = query.length
    inside = by_arrays(corpus, query, mode)
    if n == 1:
        return inside
    size, asked = F.col("n"), [k for k, t in enumerate(query.tokens) if t.alternatives]

    def here(i: Column, k: int) -> Column:
        return (i + k >= 0) & (i + k < size)

    def fits(i: Column) -> Column:
        out = F.lit(False)
        for k in asked:
            out = out | here(i, k)
        if 0 not in asked:  # its own sentence is that of the hit
            out = out | here(i, 0)
        for k in asked:
            out = out & (~here(i, k) | predicates.token(query.tokens[k], lambda f, k=k: F.get(F.col(column_name(f)), i + k), mode))
        return out

    starts = F.concat(F.sequence(F.lit(1 - n), F.lit(-1)), F.sequence(F.greatest(size - n + 1, F.lit(0)), size - 1))
    parts = corpus.sentences.where("n > 0").select("sent", "sent_start", "n", F.explode(F.filter(starts, fits)).alias("k"))
    told = reduce(lambda a, b: a + b, (here(F.col("k"), j).cast("int") for j in asked))
    parts = parts.select((F.col("sent_start") + F.col("k")).alias("at"), F.when(F.col("k") >= 0, F.col("sent")).alias("sent"), told.alias("told"))
    met = parts.where(F.col("at").between(0, len(corpus) - n)).groupBy("at").agg(F.max("sent").alias("sent"), F.sum("told").alias("told"))
    return inside.union(met.where(F.col("told") == len(asked)).select("sent", "at"))


def by_window(corpus: Corpus, query: Query, mode: str = "chars") -> DataFrame:
    """Within sentences, by looking ahead in the token table."""
    w = W.partitionBy("sent").orderBy("at")
    rows = corpus.tokens
    ahead: dict[tuple[str, int], Column] = {}
    for k, t in enumerate(query.tokens):
        for x in t.literals:
            ahead[x.feature, k] = F.lead(column_name(x.feature), k).over(w)
    rows = rows.select("sent", "at", F.lead("at", query.length - 1).over(w).alias("last"), *(c.alias(f"{f}@{k}") for (f, k), c in ahead.items()))
    rows = rows.where("last is not null")
    for k, t in enumerate(query.tokens):
        test = predicates.token(t, lambda f, k=k: F.col(f"`{f}@{k}`"), mode)
        rows = rows if test is None else rows.where(test)
    return rows.select("sent", "at")


def by_joins(corpus: Corpus, query: Query, mode: str = "chars") -> DataFrame:
    """By position: the rarest token's rows, then a semi-join for each further token of the pattern. Indexes
    tell how often values occur; without them exact values are taken for rare and negative ones for frequent."""
    key = ["sent", "at"] if query.sentence_breaks else ["at"]
    parts: list[tuple[int, int, DataFrame]] = []  # (kind, occurrences, starts)
    for k, t in enumerate(query.tokens):
        if t.alternatives:
            test = predicates.token(t, lambda f: F.col(column_name(f)), mode)
            rows = corpus.tokens.where(test).select("sent", (F.col("at") - k).alias("at"))
            exact = any(all(any(x.kind == "exact" and not x.negative for x in g) for g in [alt]) for alt in t.alternatives)
            worst = all(all(x.negative for x in alt) for alt in t.alternatives)
            known = [indexes.occurrences(corpus, x) for x in t.literals] if corpus.indexes and len(t.alternatives) == 1 else []
            known = [n for n in known if n is not None]
            kind = 0 if known else 1 if exact and len(t.alternatives) == 1 else 3 if worst else 2
            parts.append((kind, min(known, default=0), rows))
    parts.sort(key=lambda p: p[:2])
    out = parts[0][2] if parts else corpus.tokens.select("sent", "at")
    for _, _, rows in parts[1:]:
        out = out.join(rows, key, "left_semi")
    out = out.where(F.col("at").between(0, len(corpus) - query.length))
    if query.sentence_breaks and query.length > 1 and (query.tokens[-1].alternatives == () or len([t for t in query.tokens if t.alternatives]) < 2):
        # trailing wildcards: the last position must lie in the same sentence
        last = corpus.tokens.select("sent", (F.col("at") - (query.length - 1)).alias("at"))
        out = last.join(out, key, "left_semi")
    if not query.sentence_breaks:
        # the sentence of the start, whichever token of the pattern was scanned first
        out = corpus.tokens.select("sent", "at").join(out.select("at"), "at", "left_semi")
    elif query.tokens[0].alternatives == ():
        out = corpus.tokens.select("sent", "at").join(out, key, "left_semi")
    return out.select("sent", "at")


def find(corpus: Corpus, query: Query, plan: str | None = None, mode: str = "chars") -> DataFrame:
    """Hits by the plan named, or the one that suits: indexes that cover the query, else a scan."""
    corpus.check(query.features)
    if plan is None:
        if (rows := indexes.covering(corpus, query)) is not None:
            return rows
        plan = "arrays"
    if plan != "joins" and not query.sentence_breaks:
        return across_arrays(corpus, query, mode)
    return {"arrays": by_arrays, "window": by_window, "joins": by_joins}[plan](corpus, query, mode)
