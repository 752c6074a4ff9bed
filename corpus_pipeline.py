"""A training corpus from raw documents: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import decontamination, near_dedup, packing, quality_rules, suffix_dedup
from corvane.llm.shared import table, written


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. Texts without words go; ids, and columns but the text, are not read;
    repeated rows are judged alike, so all of them stay or go."""
    return quality_rules.keep(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id. Each row is a document: rows with
    one id, or none, stay if their texts aren't near copies; so do all texts without words."""
    return near_dedup.keep(spark, docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier text has; documents with nothing left go. Rows without an id come
    first, rows with one id in the order of their texts; null texts stay as they are."""
    return suffix_dedup.remove(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts stay, with any id or none."""
    return decontamination.clean(spark, docs, decontamination.benchmark_of(table(spark, sf_dir, "benchmark")))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 4096 tokens. A null or empty text is its end id."""
    return packing.pack(spark, docs)


STAGES = [
    ("quality_rules", rules),
    ("near_dedup", near_copies),
    ("suffix_dedup", passages),
    ("decontamination", benchmark),
    ("packing", sequences),
]

#: Signatures, suffix arrays and retrieval can't be put as SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one returns is written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
