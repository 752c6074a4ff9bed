"""TSV and CoNLL-U readers.

Lines keep their order by file, start of the split they are in, and order within it; sentence numbers
are running sums of separator flags over that order. ``.gz`` and ``.bz2`` are read by Spark itself;
``.xz`` has no codec there, so such a file is unpacked by one task in blocks.
"""

from __future__ import annotations

import lzma
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.predicates import column_name
from corvane.lang import QueryError, feature_name
from corvane.sources.order import running_sum

COMPRESSED = (".gz", ".bz2", ".xz")
BUCKET = 1 << 16
CONLLU = "id form lemma upos xpos feats head deprel deps misc".split()


def uncompressed_suffix(path: str) -> str:
    """The suffix below that of a compressed file."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    for c in COMPRESSED:
        name = name.removesuffix(c)
    return name[name.rfind(".") :] if "." in name else ""


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value, and file, block and row, whose order is that of the lines."""
    if path.endswith(".xz"):

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for name, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    row, rest, reader = 0, b"", lzma.open(pa.BufferReader(body.as_buffer()))
                    while block := reader.read(1 << 22):
                        *full, rest = (rest + block).split(b"\n")
                        yield _batch(name, row, full)
                        row += len(full)
                    if rest:
                        yield _batch(name, row, [rest])

        files = spark.read.format("binaryFile").load(path).select("path", "content")
        return files.mapInArrow(unpack, "file string, block long, row long, value string")
    text = spark.read.text(path)
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def _batch(name: str, row: int, values: list[bytes]) -> pa.RecordBatch:
    n = len(values)
    return pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array([0] * n, pa.int64()), pa.array(range(row, row + n), pa.int64()), pa.array([v.decode() for v in values], pa.string())], names=["file", "block", "row", "value"])


def strip(c) -> F.Column:
    """Without white space at either end, as Python's strip of ASCII text."""
    return F.regexp_replace(c, r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$", "")


def header_line(rows: DataFrame) -> str:
    first = rows.orderBy("file", "block", "row").select("value").first()
    if first is None:
        raise QueryError("an empty file has no header")
    return first[0]


def sentences(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """(file, block, row, arrays of features) in order, and the features; the suffix picks the reader."""
    suffix = uncompressed_suffix(path)
    if suffix in (".csv", ".tsv"):
        return read_tsv(spark, path)
    if suffix in (".conllu", ".conllup"):
        return read_conllu(spark, path)
    raise QueryError(f"unknown file suffix: {suffix!r}")


def read_tsv(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """TAB separated, header first; a line that starts with ``# `` ends a sentence; blank lines are
    ignored, short rows padded, long rows an error."""
    rows = lines(spark, path)
    head = header_line(rows)
    names = [feature_name(x) for x in head.strip().split("\t")]
    rows = running_sum(rows, ["file", "block"], ["row"], F.lit(1), "line").where("line > 0").withColumn("value", strip(F.col("value")))
    rows = rows.withColumn("flag", (F.col("value").startswith("# ") | (F.col("value") == "#")).cast("int"))
    return _grouped(rows.where("value != ''"), names, exact=False), names


def read_conllu(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """A blank line ends a sentence; comments and rows whose id isn't alphanumeric go; a first line
    ``# global.columns = ...`` names the columns."""
    rows = lines(spark, path)
    m = re.fullmatch(r"#\s*global\.columns\s*=\s*((?:[A-Z:]+\s+)+[A-Z:]+)\s*", header_line(rows).strip())
    names = [feature_name(x.lower().replace(":", "_")) for x in m[1].split()] if m else list(CONLLU)
    rows = rows.withColumn("value", strip(F.col("value")))
    rows = running_sum(rows, ["file", "block"], ["row"], F.lit(1), "line")
    rows = rows.where(~F.col("value").startswith("#")).withColumn("flag", (F.col("value") == "").cast("int"))
    if "id" in names:
        at = names.index("id")
        rows = rows.where((F.col("flag") == 1) | F.get(F.split("value", "\t"), F.lit(at)).rlike(r"^[\p{L}\p{N}]+$"))
    return _grouped(rows, names, exact=True), names


def _grouped(rows: DataFrame, names: list[str], exact: bool) -> DataFrame:
    rows = running_sum(rows, ["file", "block"], ["row"], F.col("flag"), "before")
    cells = F.split("value", "\t")
    wrong = F.size(cells) != len(names) if exact else F.size(cells) > len(names)
    cells = F.when(wrong, F.raise_error(F.concat(F.lit("wrong number of columns: "), F.col("value")))).otherwise(cells)
    values = [F.coalesce(strip(F.get("cells", F.lit(k))), F.lit("")).alias(column_name(f)) for k, f in enumerate(names)]
    tokens = rows.where("flag = 0").select("before", "line", cells.alias("cells")).select("before", "line", F.struct("line", *values).alias("t"))
    # array_sort of (line, ...) keeps the order of a sentence, whichever task read its lines
    out = tokens.groupBy("before").agg(F.array_sort(F.collect_list("t")).alias("t"))
    # buckets for the running sums that number sentences
    return out.select(F.floor(F.col("before") / BUCKET).alias("part"), F.col("before").alias("line"), *(F.col(f"t.{column_name(f)}").alias(column_name(f)) for f in names))
