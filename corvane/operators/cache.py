"""Results kept as Parquet, found by a hash of what they depend on, trimmed by last use."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from corvane.lang import Query
from corvane.plans.hits import find
from corvane.sources.corpus import Corpus, exists, hadoop


def key(corpus: Corpus, query: Query, mode: str = "chars") -> str:
    """The corpus as built, the pattern, and how it is read."""
    text = repr((corpus.name, corpus.fingerprint, query.tokens, query.sentence_breaks, mode))
    return hashlib.sha256(text.encode()).hexdigest()


def cached(spark: SparkSession, folder: str, corpus: Corpus, query: Query, mode: str = "chars") -> DataFrame:
    """Hits from the cache, or found and put there."""
    path = f"{folder.rstrip('/')}/{key(corpus, query, mode)}.hits"
    if not exists(spark, f"{path}/_SUCCESS"):
        find(corpus, query, mode=mode).select("sent", "at").write.mode("overwrite").parquet(path)
    fs, p = hadoop(spark, f"{path}/_used")
    fs.create(p, True).close()  # its time is that of the last use, in any store
    return spark.read.parquet(path)


def trim(spark: SparkSession, folder: str, max_mb: float = 100) -> list[str]:
    """Deletes the results used longest ago until the rest fits; returns their names."""
    fs, p = hadoop(spark, folder)
    if not fs.exists(p):
        return []
    found = []
    for s in fs.listStatus(p):
        if (name := s.getPath().getName()).endswith(".hits"):
            _, used = hadoop(spark, f"{s.getPath()}/_used")
            when = fs.getFileStatus(used).getModificationTime() if fs.exists(used) else s.getModificationTime()
            found.append((when, name, fs.getContentSummary(s.getPath()).getLength(), s.getPath()))
    total, gone = sum(x[2] for x in found), []
    for _, name, size, path in sorted(found, key=lambda x: x[:2]):
        if total <= max_mb * 1e6:
            break
        fs.delete(path, True)
        total -= size
        gone.append(name)
    return gone
