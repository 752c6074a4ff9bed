"""Appending whole sentences to a corpus from a stream.

Each micro-batch is numbered after what the corpus holds and appended as its own folder; a batch that
is run again after a failure overwrites that folder, so sentences are added once.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.functions.predicates import column_name
from corvane.sources.corpus import Corpus, exists, from_sentences, number, tokens_of


def append(spark: SparkSession, path: str, features: list[str], batch: DataFrame, batch_id: int) -> None:
    """``batch``: a key column ``part``, ``line`` and an array of strings for each feature."""
    base = f"{path.rstrip('/')}/sentences"
    before = spark.read.parquet(base).where(F.col("batch") < batch_id) if exists(spark, base) else None
    n, m = (0, 0) if before is None else before.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    rows = number(batch, ["part"], ["line"], features)
    rows = rows.withColumn("sent", F.col("sent") + m).withColumn("sent_start", F.col("sent_start") + n)
    rows, _ = from_sentences("", rows, features)
    rows.write.mode("overwrite").parquet(f"{base}/batch={batch_id}")


def start(stream: DataFrame, path: str, features: list[str], checkpoint: str) -> StreamingQuery:
    """Runs until what is available is ingested."""
    spark = stream.sparkSession
    query = stream.writeStream.foreachBatch(lambda df, k: append(spark, path, features, df, k))
    return query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def opened(spark: SparkSession, path: str, name: str, features: list[str]) -> Corpus:
    """The corpus as ingested so far; its fingerprint tells how far, so cached results of less aren't used."""
    rows = spark.read.parquet(f"{path.rstrip('/')}/sentences")
    n, m, mark = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.bit_xor(F.xxhash64(*sorted(rows.columns)))).first()
    rows = rows.drop("batch")
    names = [*features, *(["s"] if column_name("s") in rows.columns else [])]
    out = Corpus(name, tokens_of(rows, names), rows, names, hashlib.sha256(repr((path, names, n, m, mark)).encode()).hexdigest()[:16])
    out.size = (int(n), int(m))
    return out
