"""Vocabularies and corpus totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.predicates import column_name
from corvane.sources.corpus import Corpus
from corvane.sources.order import running_sum


def vocabulary(corpus: Corpus, features: list[str] | None = None) -> DataFrame:
    """feature, symbol, value, freq: values in byte order, symbol 0 always the empty value. Values are
    ranked within buckets of their first characters, so no task sees a whole vocabulary."""
    parts = []
    for f in features or corpus.features:
        seen = frequency(corpus, f)
        rows = seen.union(seen.sparkSession.createDataFrame([("", 0)], "value string, freq long")).groupBy("value").agg(F.sum("freq").alias("freq"))
        rows = running_sum(rows.withColumn("head", F.substring("value", 1, 3)), ["head"], ["value"], F.lit(1), "symbol")
        parts.append(rows.select(F.lit(f).alias("feature"), "symbol", "value", "freq"))
    return reduce(DataFrame.union, parts)


def frequency(corpus: Corpus, feature: str) -> DataFrame:
    corpus.check([feature])
    return corpus.sentences.select(F.explode(column_name(feature)).alias("value")).groupBy("value").agg(F.count("*").alias("freq"))


def info(corpora: list[Corpus]) -> DataFrame:
    """Tokens and sentences of each corpus."""
    parts = [c.sentences.agg(F.lit(c.name).alias("corpus"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_tokens"), F.count("*").alias("n_sentences")) for c in corpora]
    return reduce(DataFrame.union, parts)


def sanity(corpus: Corpus) -> dict[str, int]:
    """Violations by the vocabularies of a corpus: symbols that aren't 0, 1, 2, ... in the order of values, and
    tokens that no value counts."""
    rows = vocabulary(corpus)
    each = rows.groupBy("feature").agg(F.count("*").alias("n"), F.countDistinct("symbol", "value").alias("m"), F.max("symbol").alias("last"), F.sum("freq").alias("tokens")).collect()
    later = rows.alias("a").join(rows.alias("b"), (F.col("a.feature") == F.col("b.feature")) & (F.col("a.symbol") + 1 == F.col("b.symbol"))).where("a.value >= b.value").count()
    gaps = sum((r["n"] != r["last"] + 1) + (r["n"] != r["m"]) for r in each)
    return {"wrong_symbols": int(gaps + later), "uncounted_tokens": int(sum(abs(len(corpus) - r["tokens"]) for r in each))}
