"""Corpora: a token table, and the same tokens as a row of arrays for each sentence.

``sentences``: sent, sent_start, n, and an array for each feature, so a query reads only the features that
it names and never shuffles. It is sorted by position: row groups can be skipped, and a sentence is never
split. ``tokens``: at (position from 0), sent (sentence from 1), sent_start, i (place in the sentence), and a
column ``f_<feature>`` for each feature; these rows are taken from the arrays as they are read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.predicates import REVERSED, column_name, reverse
from corvane.lang import QueryError, feature_name
from corvane.sources.order import few, running_sums

SENTENCE = "s"
GROUP_BYTES = 8 << 20  # of a row group of sentences, the least that a task can read


@dataclass
class Corpus:
    """A named corpus; ``features`` in order, the first is the default one."""

    name: str
    tokens: DataFrame
    sentences: DataFrame
    features: list[str]
    fingerprint: str = ""
    indexes: dict[str, DataFrame] = field(default_factory=dict)

    @cached_property
    def size(self) -> tuple[int, int]:
        """Tokens and sentences."""
        row = self.sentences.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        return int(row[0]), int(row[1])

    def __len__(self) -> int:
        return self.size[0]

    @property
    def default_feature(self) -> str:
        return self.features[0]

    def check(self, features: list[str]) -> None:
        for f in features:
            if f not in self.features:
                raise QueryError(f"no feature {f!r} in corpus {self.name!r}; it has {', '.join(self.features)}")


def from_sentences(name: str, sentences: DataFrame, features: list[str], reversed_features: bool = False, sentence_feature: bool = True) -> tuple[DataFrame, list[str]]:
    """Adds the derived features to a table of sentences (sent, sent_start, n, arrays)."""
    for f in features:
        feature_name(f)
    out, names = sentences, list(features)
    if reversed_features:
        for f in features:
            out = out.withColumn(column_name(f + REVERSED), F.transform(column_name(f), reverse))
            names.append(f + REVERSED)
    if sentence_feature and SENTENCE not in names:
        out = out.withColumn(column_name(SENTENCE), F.transform(F.sequence(F.lit(1), F.col("n")), lambda k: F.when(k == 1, SENTENCE).otherwise("")))
        names.append(SENTENCE)
    return out, names


def with_reversed(corpus: Corpus) -> Corpus:
    """The corpus with each feature also backwards: columns of its tables, computed as they are read."""
    plain = [f for f in corpus.features if f != SENTENCE]
    names = [f + REVERSED for f in plain]
    rows = corpus.sentences.withColumns({column_name(f + REVERSED): F.transform(column_name(f), reverse) for f in plain})
    tokens = corpus.tokens.withColumns({column_name(f + REVERSED): reverse(F.col(column_name(f))) for f in plain})
    out = Corpus(corpus.name, tokens, rows, [*plain, *names, *corpus.features[len(plain) :]], f"{corpus.fingerprint}+reversed")
    out.size = corpus.size
    return out


def tokens_of(sentences: DataFrame, features: list[str]) -> DataFrame:
    """A row for each token. Features that nobody asks for are not read."""
    cols = [column_name(f) for f in features]
    out = sentences.where("n > 0").select("sent", "sent_start", *cols, F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    return out.select((F.col("sent_start") + F.col("i")).alias("at"), "sent", "sent_start", "i", *(F.get(F.col(c), F.col("i")).alias(c) for c in cols))


def number(rows: DataFrame, bucket: list[str], order: list[str], features: list[str], lines: Callable[[DataFrame], DataFrame] | None = None, arrays: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Sentences (arrays of one length, not empty) with numbers and start positions, dealt by ranges of buckets
    and in order. Only ``rows`` are shuffled, once: ``lines`` makes the lines of a row, each with its size ``n``,
    and ``arrays`` their features, which take many times the room of the text, when they are in their place."""
    lines = lines or (lambda df: df.withColumn("n", F.size(column_name(features[0]))))
    coarse = F.floor(F.col(bucket[0]) / 4096) if dict(rows.dtypes)[bucket[0]] in ("int", "bigint") else None
    there, here = (lines(df).where("n > 0") for df in (rows.repartitionByRange(*bucket), rows))
    out = running_sums(there, bucket, order, {"sent_start": F.col("n"), "sent0": F.lit(1)}, coarse, here, few(rows, bucket))
    out = arrays(out) if arrays else out
    return out.select((F.col("sent0") + 1).alias("sent"), "sent_start", "n", *(column_name(f) for f in features))


def store(spark: SparkSession, path: str, name: str, sentences: DataFrame, features: list[str], **options: bool) -> Corpus:
    """Writes a corpus under ``path``, its sentences as ``number`` deals them, and opens it."""
    rows, names = from_sentences(name, sentences, features, **options)
    base = f"{path.rstrip('/')}/{name}.corpus"
    rows.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", GROUP_BYTES).parquet(f"{base}/sentences")
    kept = spark.read.parquet(f"{base}/sentences")
    total = kept.agg(F.sum("n").alias("n"), F.count("*").alias("m"), F.bit_xor(F.xxhash64(*kept.columns)).alias("x")).first()
    mark = hashlib.sha256(json.dumps([name, names, total["n"], total["m"], total["x"]]).encode()).hexdigest()[:16]
    meta = [(name, names, int(total["n"] or 0), int(total["m"]), mark)]
    spark.createDataFrame(meta, "name string, features array<string>, n_tokens long, n_sentences long, fingerprint string").coalesce(1).write.mode("overwrite").json(f"{base}/info")
    return open_corpus(spark, path, name)


def open_corpus(spark: SparkSession, path: str, name: str) -> Corpus:
    """FileNotFoundError if there is no such corpus."""
    base = f"{path.rstrip('/')}/{name.removesuffix('.corpus')}.corpus"
    if not exists(spark, f"{base}/info"):
        raise FileNotFoundError(f"no corpus {name!r} in {path}")
    info = spark.read.json(f"{base}/info").first()
    rows, names = spark.read.parquet(f"{base}/sentences"), list(info["features"])
    out = Corpus(info["name"], tokens_of(rows, names), rows, names, info["fingerprint"])
    out.size = (info["n_tokens"], info["n_sentences"])
    for template in children(spark, f"{base}/indexes"):
        out.indexes[template] = spark.read.parquet(f"{base}/indexes/{template}")
    return out


def hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    fs, p = hadoop(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def list_corpora(spark: SparkSession, path: str) -> list[str]:
    return [x.removesuffix(".corpus") for x in children(spark, path) if x.endswith(".corpus")]


def violations(corpus: Corpus) -> DataFrame:
    """A row of counts. Different positions are counted as bits of words of 64 positions, so what is kept and
    shuffled is a row for each word."""
    t = corpus.tokens
    cols = [column_name(f) for f in corpus.features]
    words = t.groupBy(F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("seen"),
        F.count("*").alias("n"),
        F.max("at").alias("last"),
        F.count_if(F.col("at") != F.col("sent_start") + F.col("i")).alias("wrong"),
        F.count_if(F.greatest(*(F.col(c).isNull().cast("int") for c in cols), F.lit(0)) > 0).alias("nulls"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return words.agg(
        (total("n") - total(F.bit_count("seen"))).alias("repeated_positions"),
        (F.coalesce(F.max("last"), F.lit(-1)) + 1 - total("n")).alias("missing_positions"),
        total("wrong").alias("wrong_starts"),
        total("nulls").alias("null_values"),
    )


def sanity(corpus: Corpus) -> dict[str, int]:
    """Violations of the invariants of a corpus; all are 0 in a sound one."""
    return {k: int(v) for k, v in violations(corpus).first().asDict().items()}
