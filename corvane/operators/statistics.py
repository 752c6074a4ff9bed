"""Frequency statistics: hits grouped by the values over their whole span."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.predicates import column_name
from corvane.lang import Query
from corvane.plans.hits import find
from corvane.sources.corpus import Corpus
from corvane.sources.order import rank


def sample(found: DataFrame, total: int, sampling: int) -> DataFrame:
    """Every step-th hit by position; the step is 1 + hits // sampling."""
    if sampling <= 0 or total // sampling == 0:
        return found
    step = 1 + total // sampling
    return rank(found, "at", "rank").where(F.col("rank") % step == 0).drop("rank")


def values(corpus: Corpus, query: Query, found: DataFrame, group_by: list[str]) -> DataFrame:
    """at and value, an array of one array of strings for each feature, over the span of each hit."""
    corpus.check(group_by)
    n = query.length
    cols = [column_name(f) for f in group_by]
    rows = corpus.sentences.select("sent", "sent_start", *cols).join(found.select("sent", "at"), "sent")
    spans = [F.slice(c, (F.col("at") - F.col("sent_start") + 1).cast("int"), n) for c in cols]
    rows = rows.select("at", F.array(*spans).alias("value"))
    if query.sentence_breaks or n == 1:
        return rows
    # the rest of a hit that goes over a break lies among the first tokens of later sentences
    short = rows.where(F.size(F.col("value")[0]) < n)
    rest = short.select("at", F.explode(F.sequence(F.size(F.col("value")[0]), F.lit(n - 1))).alias("k")).withColumn("place", F.col("at") + F.col("k"))
    heads = corpus.tokens.where(F.col("i") < n - 1).select(F.col("at").alias("place"), *cols)
    rest = rest.join(heads, "place").groupBy("at").agg(F.array_sort(F.collect_list(F.struct("k", *cols))).alias("t"))
    whole = short.join(rest, "at").select("at", F.array(*(F.concat(F.col("value")[j], F.col(f"t.{c}")) for j, c in enumerate(cols))).alias("value"))
    return rows.where(F.size(F.col("value")[0]) == n).union(whole)


def groups(corpus: Corpus, query: Query, group_by: list[str], sampling: int = 0, plan: str | None = None, found: DataFrame | None = None) -> tuple[DataFrame, dict[str, int]]:
    """Counts and first positions of the groups of one corpus; hits, sampled hits and size."""
    found = (find(corpus, query, plan) if found is None else found).select("sent", "at")
    total = found.count() if sampling > 0 else -1
    drawn = sample(found, total, sampling) if sampling > 0 else found
    rows = values(corpus, query, drawn, group_by).groupBy("value").agg(F.count("*").alias("absolute"), F.min("at").alias("first_at"))
    if total < 0:
        total = sampled = found.count()
    else:
        sampled = -(-total // (1 + total // sampling)) if total // sampling else total
    return rows, {"total": total, "sampled": sampled, "size": len(corpus)}


def relative(absolute, sums: dict[str, int]):
    """Hits per million tokens, scaled up by the sampling; 0 where nothing was found."""
    if not sums["sampled"] or not sums["size"]:
        return F.lit(0.0)
    return F.lit(1e6) * absolute * sums["total"] / sums["sampled"] / sums["size"]


def top(rows: DataFrame, num: int) -> DataFrame:
    """Largest first, ties by first occurrence; ``num`` of 0 or less: all."""
    rows = rows.orderBy(F.desc("absolute"), "corpus_no", "first_at")
    return rows.limit(num) if num > 0 else rows


def count(corpora: list[Corpus], query: Query, group_by: list[str], num: int = 10, sampling: int = 0, finder: Callable[[Corpus], DataFrame] | None = None) -> dict:
    """Rows and sums of each corpus and of all together; combined groups come from all rows. ``finder``
    may take hits of a corpus from elsewhere, such as the cache."""
    parts, sums = [], []
    for k, c in enumerate(corpora):
        rows, s = groups(c, query, group_by, sampling, found=finder(c) if finder else None)
        parts.append(rows.withColumn("corpus_no", F.lit(k)).withColumn("corpus", F.lit(c.name)).withColumn("relative", relative(F.col("absolute"), s)))
        sums.append(s)
    every = reduce(DataFrame.unionByName, parts)
    both = {k: sum(s[k] for s in sums) for k in ("total", "sampled", "size")}
    first = F.min(F.struct("corpus_no", "first_at")).alias("first")
    combined = every.groupBy("value").agg(F.sum("absolute").alias("absolute"), first)
    combined = combined.select("value", "absolute", "first.corpus_no", "first.first_at").withColumn("relative", relative(F.col("absolute"), both))
    return {"corpora": dict(zip((c.name for c in corpora), parts, strict=True)), "sums": dict(zip((c.name for c in corpora), sums, strict=True)), "combined": combined, "combined_sums": both, "all": every, "num": num}


def pivot(every: DataFrame, names: list[str]) -> DataFrame:
    """Groups by corpora, with a total."""
    out = every.groupBy("value").pivot("corpus", names).agg(F.sum("absolute"))
    filled = [F.coalesce(F.col(f"`{n}`"), F.lit(0)).alias(n) for n in names]
    return out.select("value", *filled).withColumn("total", reduce(lambda a, b: a + b, (F.col(f"`{n}`") for n in names)))


def sums_row(sums: dict[str, int]) -> dict:
    total, sampled, size = sums["total"], sums["sampled"], sums["size"]
    """Sums as they are reported: ``absolute`` counts the hits that were drawn."""
    return {"absolute": sampled, "total-hits": total, "sampled-hits": sampled, "corpus-size": size, "relative": 1e6 * total / size if size else 0.0}
