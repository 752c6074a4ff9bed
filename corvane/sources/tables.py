"""The driver tables as corpora. Each is built once for a session and folder, then read from Parquet."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.predicates import column_name as c
from corvane.sources.corpus import Corpus, number, store, with_reversed

_BUILT: dict[tuple, Corpus] = {}
WIDTH = 4096  # documents a bucket of the running sums


def shape(word: F.Column) -> F.Column:
    return F.when(word.rlike("^[0-9]+$"), "NUM").when(word.rlike("^[A-Z]"), "CAP").when(word.rlike("[.,;:!?]$"), "END").otherwise("LOW")


def words(line: F.Column) -> F.Column:
    return F.filter(F.split(line, " "), lambda x: x != "")


def split_lines(df: DataFrame) -> DataFrame:
    """A row for each line of ``text``, with its number of words."""
    rows = df.select(*(x for x in df.columns if x != "text"), F.posexplode(F.split("text", "\n")).alias("line", "value"))
    return rows.withColumn("n", F.size(words(F.col("value"))))


def with_lemma(rows: DataFrame) -> DataFrame:
    return rows.withColumn(c("word"), words(F.col("value"))).withColumn(c("lemma"), F.transform(c("word"), F.lower))


def constant(name: str) -> F.Column:
    """A column of a line for each of its words; null is empty."""
    return F.transform(c("word"), lambda _: F.coalesce(F.col(name), F.lit("")))


def docs_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.floor(F.col("doc_id") / WIDTH).alias("part"), "doc_id", "text", "lang")

    def arrays(rows: DataFrame) -> DataFrame:
        return with_lemma(rows).withColumn(c("pos"), F.transform(c("word"), shape)).withColumn(c("lang"), constant("lang"))

    features = ["word", "lemma", "pos", "lang"]
    return number(docs, ["part"], ["doc_id", "line"], features, split_lines, arrays), features


def chat_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.floor(F.col("conv_id") / WIDTH).alias("part"), "conv_id", "turn", "role", "text")
    features = ["word", "lemma", "role"]
    return number(turns, ["part"], ["conv_id", "turn", "line"], features, split_lines, lambda rows: with_lemma(rows).withColumn(c("role"), constant("role"))), features


def event_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.floor(F.col("user_id") / WIDTH).alias("part"), "user_id", "ts", "event_id", "event_type")

    def lines(rows: DataFrame) -> DataFrame:
        rows = rows.groupBy("part", "user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("e"), F.count("*").cast("int").alias("n"))
        return rows.select("part", "user_id", F.col("e.event_type").alias(c("word")), "n")

    def arrays(rows: DataFrame) -> DataFrame:
        return rows.withColumn(c("user"), F.transform(c("word"), lambda _: F.col("user_id").cast("string")))

    return number(events, ["part"], ["user_id"], ["word", "user"], lines, arrays), ["word", "user"]


def order_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    keys = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.floor(F.col("l_orderkey") / WIDTH).alias("part"), "l_orderkey", *keys, "l_returnflag", "l_linestatus")

    def lines(rows: DataFrame) -> DataFrame:
        rows = rows.groupBy("part", "l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*keys, "l_returnflag", "l_linestatus"))).alias("o"), F.count("*").cast("int").alias("n"))
        return rows.select("part", "l_orderkey", F.col("o.l_returnflag").alias(c("word")), F.col("o.l_linestatus").alias(c("status")), "n")

    return number(items, ["part"], ["l_orderkey"], ["word", "status"], lines), ["word", "status"]


KINDS = {"docs": docs_lines, "chat": chat_lines, "events": event_lines, "orders": order_lines}


def root(spark: SparkSession) -> str:
    """Where built corpora go: the shared folder of the cluster, or one of our own on a single machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return path or "file://" + tempfile.mkdtemp(prefix="corvane-")


def corpus(spark: SparkSession, sf_dir: str, name: str = "docs", reversed_features: bool = False) -> Corpus:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _BUILT:
        lines, features = KINDS[name](spark, sf_dir)
        _BUILT[key] = store(spark, f"{root(spark)}/corpora-{uuid.uuid4().hex}", name, lines, features)
    return with_reversed(_BUILT[key]) if reversed_features else _BUILT[key]
