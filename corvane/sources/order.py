"""Running sums and ranks without a window over everything.

Rows are summed within buckets; the buckets' totals, a row for each bucket, are summed in order, by
buckets of buckets where there are many; a join brings the sum of all earlier buckets back. Only a small
table meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MOST = 1 << 18  # buckets whose sums, of a few numbers each, are broadcast


def few(df: DataFrame, bucket: list[str]) -> bool:
    """Whether the buckets are few enough that their sums can be broadcast."""
    return df.select(*bucket).distinct().limit(MOST + 1).count() <= MOST


def running_sums(df: DataFrame, bucket: list[str], order: list[str | Column], values: dict[str, Column], coarse: Column | None = None, source: DataFrame | None = None, broadcast: bool = False) -> DataFrame:
    """Adds for each name the sum of its value over all rows before each row, in order of ``bucket`` and then
    ``order``. ``coarse``: buckets of buckets, ascending with them, whose totals are few; without it the
    totals of the buckets themselves are summed in one task. ``source``: the same rows before a shuffle, from
    which totals are had without it. ``broadcast``: the buckets are few, so rows stay where they are."""
    inner = W.partitionBy(*bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    parts = {n: f"__part_{n}" for n in values}
    rows = df.withColumns({parts[n]: v for n, v in values.items()})
    totals = (rows if source is None else source.withColumns({parts[n]: v for n, v in values.items()})).groupBy(*bucket).agg(*(F.sum(c).alias(c) for c in parts.values()))
    sums = {f"__base_{n}": F.col(c) for n, c in parts.items()}
    if coarse is None:
        before = W.orderBy(*bucket).rowsBetween(W.unboundedPreceding, W.currentRow)
        bases = totals.withColumns({b: F.sum(c).over(before) - c for b, c in sums.items()})
    else:
        bases = running_sums(totals.withColumn("__coarse", coarse), ["__coarse"], bucket, sums, broadcast=broadcast)
    bases = bases.select(*(F.col(b).alias(f"__b{k}") for k, b in enumerate(bucket)), *sums)
    rows = rows.withColumns({c: F.sum(c).over(inner) - F.col(c) for c in parts.values()})
    on = None
    for k, b in enumerate(bucket):
        same = F.col(b).eqNullSafe(F.col(f"__b{k}"))
        on = same if on is None else on & same
    rows = rows.join(F.broadcast(bases) if broadcast else bases, on).withColumns({n: (F.col(c) + F.col(f"__base_{n}")).cast("long") for n, c in parts.items()})
    return rows.drop(*parts.values(), *sums, *(f"__b{k}" for k in range(len(bucket))))


def running_sum(df: DataFrame, bucket: list[str], order: list[str | Column], value: Column, name: str) -> DataFrame:
    """``running_sums`` of one value."""
    return running_sums(df, bucket, order, {name: value})


def rank(df: DataFrame, key: str, name: str, width: int = 1 << 20) -> DataFrame:
    """Adds the 0-based rank by an integer key, bucketed by ranges of ``width``."""
    return running_sum(df.withColumn("__bucket", F.floor(F.col(key) / width)), ["__bucket"], [key], F.lit(1), name).drop("__bucket")
