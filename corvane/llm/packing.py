"""Best-two-fit packing of documents into sequences (operator 6).

Texts are encoded, an end id is appended, and only documents of over 4096 ids are cut. What follows
needs lengths alone, and there are at most 4096 of them: the driver plans from a histogram. A bin is
filled greedily with the longest piece that fits; then its smallest piece gives way to two unpacked
pieces that fit the expanded gap more tightly, if there are such, until none does better. A bin is
planned once for as many copies as the histogram holds, so the plan has a few rows for each length
however many documents there are. Pieces take their places by their rank among pieces of their length;
ranks come from counts by (length, bucket of the piece's hash). A length of n pieces has n / ``BUCKET``
buckets, or the square root of n if that is less: a length that a third of all pieces share is ranked by
many tasks, and so few counts are summed in a row.

Defined results. Null or empty text: one piece of the end id. Rows with a null doc_id are packed like
others. Repeated rows: pieces are told apart by a number within (doc_id, piece), so each is packed once.
Empty table: empty result. Other columns are not read. A very long text is encoded whole.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm.pieces import ids
from corvane.llm.shared import small_batches, table, written
from corvane.llm.vec import release

CAPACITY = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
RESULT = PIECES + ", sequence_id long, offset long"
BUCKET = 500


def cut_pieces(df: DataFrame, id_col: str, text_col: str, capacity: int, vocabulary: str, end_id: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(ids.cache_clear)
        of, end = ids(vocabulary), np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows: list[tuple] = []
            docs = iter(b.column(0).to_pylist())
            for got, bound in of.of_column(b.column(1)):
                raw = memoryview(got.tobytes())
                for x, y in zip(bound.tolist(), bound[1:].tolist(), strict=False):
                    doc, n = next(docs), y - x + 1
                    for k, at in enumerate(range(0, n, capacity)):
                        m = min(capacity, n - at)
                        crc = zlib.crc32(raw[4 * (x + at) : 4 * min(x + at + m, y)])
                        rows.append((doc, k, at, m, zlib.crc32(end, crc) if at + m == n else crc))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text")).mapInArrow(run, PIECES)


def fill(lengths: list[int], count: np.ndarray, capacity: int) -> list[int]:
    """The lengths of one bin, from those with a count (ascending)."""
    gap, used, got = capacity, Counter(), []
    at = len(lengths)
    while (at := bisect.bisect_right(lengths, gap, 0, at)) > 0:
        x = lengths[at - 1]
        many = min(gap // x, int(count[x]) - used[x])
        if many > 0:
            got += [x] * many
            used[x] += many
            gap -= many * x
        at -= 1
    while gap:
        small = got[-1]
        room = gap + small
        free = np.array([x for x in lengths[: bisect.bisect_right(lengths, room)] if count[x] > used[x]])
        if not len(free):
            break
        left = count[free] - np.array([used[x] for x in free.tolist()])
        mate = np.searchsorted(free, room - free, "right") - 1
        mate = np.minimum(mate, np.arange(len(free)))
        mate -= (mate == np.arange(len(free))) & (left < 2)
        total = np.where(mate >= 0, free + free[np.maximum(mate, 0)], 0)
        best = int(total.argmax())
        if total[best] <= small:
            break
        pair = [int(free[best]), int(free[mate[best]])]
        got.pop()
        used[small] -= 1
        used.update(pair)
        got = sorted([*got, *pair], reverse=True)
        gap = room - sum(pair)
    return got


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length, by rank: (first rank, first sequence, pieces a sequence, offset)."""
    count = np.zeros(capacity + 1, np.int64)
    for x, n in histogram.items():
        count[x] = n
    taken, sequence = Counter(), 0
    out: dict[int, list[tuple[int, int, int, int]]] = {x: [] for x in histogram}
    lengths = sorted(histogram)
    while lengths:
        bin_ = Counter(fill(lengths, count, capacity))
        copies = min(int(count[x]) // n for x, n in bin_.items())
        offset = 0
        for x in sorted(bin_, reverse=True):
            n = bin_[x]
            out[x].append((taken[x], sequence, n, offset))
            taken[x] += n * copies
            count[x] -= n * copies
            offset += n * x
            if not count[x]:
                lengths.remove(x)
        sequence += copies
    return out


def pack(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = "word_bpe_49k.json", end_id: int = 1) -> DataFrame:
    """A row for each piece, with its sequence and its place there."""
    small_batches(spark)
    pieces = written(spark, cut_pieces(df, id_col, text_col, capacity, vocabulary, end_id), "pieces")
    histogram = dict(pieces.groupBy("length").count().collect())  # capacity rows at most
    places = {x: np.array(rows, np.int64) for x, rows in plan(histogram, capacity).items()}
    buckets = [(x, -(-n // max(BUCKET, math.isqrt(n)))) for x, n in histogram.items()]
    known = F.broadcast(spark.createDataFrame(buckets, "length long, buckets long"))  # capacity rows at most
    spread = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.col("buckets"))
    pieces = pieces.join(known, "length").withColumn("bucket", spread)
    base = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    base = base.select("length", "bucket", (F.sum("n").over(W.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("base"))
    rank = F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = pieces.withColumn("rank", rank).join(base, ["length", "bucket"]).select(*(x.split()[0] for x in PIECES.split(", ")), (F.col("rank") + F.col("base")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(group):
                    x, r = int(length[group[0]]), rank[group]
                    p = places[x][np.searchsorted(places[x][:, 0], r, "right") - 1]
                    sequence[group] = p[:, 1] + (r - p[:, 0]) // p[:, 2]
                    offset[group] = p[:, 3] + (r - p[:, 0]) % p[:, 2] * x
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=[x.split()[0] for x in RESULT.split(", ")])

    return ranked.mapInArrow(run, RESULT)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, table(spark, sf_dir, "documents"))
