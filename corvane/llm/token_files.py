"""Token ids in patched frame-of-reference (PFOR) files (operator 2).

Ids go in blocks of 256. A block keeps its minimum, a bit width and the low bits of each difference
from the minimum; the width is the one of the percentiles of the differences that needs the fewest
bytes, and values beyond it are kept whole in an exception list (place and difference). A shard, of
about a million ids, begins with the minima, widths, exception counts and byte starts of its blocks,
so any range of ids can be read by unpacking only its blocks. Shards are binary values of Parquet rows
with the ids and lengths of their documents: Spark commits, splits and reads such files in any store,
and a shard that is lost with its executor is written again by its task.

Documents are dealt out by ranges of doc_id and sorted, so files are in ascending order; the position
of a document is the sum of the totals of the parts before its own (one number for each partition),
and its place in its part.

Defined results. Null or empty text: the end id alone. Null doc_id: first, as a row with a null id.
Repeated rows: one row each. Empty table: empty result. Other columns are not read. Very long texts
are encoded whole and make a shard of their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.pieces import ids
from corvane.llm.shared import small_batches, table, written
from corvane.llm.vec import release

BLOCK = 256
SHARD = 1 << 20
MAGIC = b"PFOR1\0\0\0"
PERCENTILES = (100, 98, 95, 90, 80, 70, 50)
FILES = "part int, first_in_part long, n_tokens long, doc_ids binary, doc_null boolean, lengths binary, body binary"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def bit_width(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1]


def encode(values: np.ndarray) -> bytes:
    """A shard of unsigned 32-bit values."""
    n = len(values)
    blocks = -(-n // BLOCK)
    padded = np.empty(blocks * BLOCK, np.uint32)
    padded[:n] = values
    padded[n:] = values[-1] if n else 0
    grid = padded.reshape(blocks, BLOCK)
    low = grid.min(axis=1, initial=2**32 - 1) if blocks else np.zeros(0, np.uint32)
    grid = grid - low[:, None]
    bits = np.sort(bit_width(grid), axis=1)
    best, width = np.full(blocks, 1 << 30), np.zeros(blocks, np.int64)
    for p in PERCENTILES:
        w = bits[:, BLOCK * p // 100 - 1]
        cost = w * (BLOCK // 8) + 5 * (bits > w[:, None]).sum(axis=1)
        width = np.where(cost < best, w, width)
        best = np.minimum(cost, best)
    limit = (np.uint64(1) << width.astype(np.uint64))[:, None]
    over = grid >= limit
    count = over.sum(axis=1)
    starts = np.zeros(blocks + 1, np.int64)
    np.cumsum(width * (BLOCK // 8) + 5 * count, out=starts[1:])
    body = np.zeros(starts[-1], np.uint8)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            for i in range(0, len(rows), 256):
                r = rows[i : i + 256]
                flat = ((grid[r][:, :, None] >> np.arange(w, dtype=np.uint32)) & np.uint32(1)).astype(np.uint8)
                packed = np.packbits(flat.reshape(len(r), -1), axis=1, bitorder="little")
                body[starts[r][:, None] + np.arange(packed.shape[1])] = packed
    block, place = np.nonzero(over)
    if len(block):
        rank = np.arange(len(block)) - (np.cumsum(count) - count)[block]
        at = starts[block] + width[block] * (BLOCK // 8)
        body[at + rank] = place
        extra = grid[block, place].astype("<u4").view(np.uint8).reshape(-1, 4)
        body[(at + count[block] + 4 * rank)[:, None] + np.arange(4)] = extra
    head = MAGIC + np.array([n, blocks], "<u8").tobytes()
    return b"".join([head, starts.astype("<u8").tobytes(), low.astype("<u4").tobytes(), count.astype("<u2").tobytes(), width.astype("<u1").tobytes(), body.tobytes()])


def decode(shard: bytes, begin: int = 0, end: int | None = None) -> np.ndarray:
    """The values from ``begin`` to ``end`` of a shard; only their blocks are unpacked."""
    if shard[:8] != MAGIC:
        raise ValueError("not a shard of token ids")
    n, blocks = (int(x) for x in np.frombuffer(shard, "<u8", 2, 8))
    end = n if end is None else min(end, n)
    if end <= begin:
        return np.zeros(0, np.uint32)
    at = 24
    starts = np.frombuffer(shard, "<u8", blocks + 1, at).astype(np.int64)
    low = np.frombuffer(shard, "<u4", blocks, at := at + 8 * (blocks + 1))
    count = np.frombuffer(shard, "<u2", blocks, at := at + 4 * blocks).astype(np.int64)
    width = np.frombuffer(shard, "<u1", blocks, at := at + 2 * blocks).astype(np.int64)
    body = np.frombuffer(shard, np.uint8, offset=at + blocks)
    first, last = begin // BLOCK, -(-end // BLOCK)
    out = np.zeros((last - first, BLOCK), np.uint32)
    mine = np.arange(first, last)
    for w in np.unique(width[mine]):
        if w:
            rows = mine[width[mine] == w]
            for i in range(0, len(rows), 256):
                r = rows[i : i + 256]
                flat = np.unpackbits(body[starts[r][:, None] + np.arange(w * BLOCK // 8)], axis=1, bitorder="little").reshape(len(r), BLOCK, w)
                value = np.zeros((len(r), BLOCK), np.uint32)
                for k in range(int(w)):
                    value |= flat[:, :, k].astype(np.uint32) << np.uint32(k)
                out[r - first] = value
    block = np.repeat(mine, count[mine])
    if len(block):
        rank = np.arange(len(block)) - (np.cumsum(count[mine]) - count[mine])[block - first]
        spot = starts[block] + width[block] * (BLOCK // 8)
        extra = np.ascontiguousarray(body[(spot + count[block] + 4 * rank)[:, None] + np.arange(4)]).view("<u4")[:, 0]
        out[block - first, body[spot + rank]] = extra
    out += low[mine][:, None]
    return out.reshape(-1)[begin - first * BLOCK : end - first * BLOCK]


def write(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    """Encodes ``df`` and writes its files to the shared folder; returns them as read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(ids.cache_clear)
        of, end = ids(vocabulary), np.array([end_id], "<u4")
        part, done = TaskContext.get().partitionId(), 0
        docs, lengths, parts, size = [], [], [], 0

        def shard() -> pa.RecordBatch:
            row = {"part": part, "first_in_part": done, "n_tokens": size, "doc_ids": np.array([d or 0 for d in docs], "<i8").tobytes(), "doc_null": docs[0] is None, "lengths": np.array(lengths, "<i8").tobytes(), "body": encode(np.concatenate(parts))}
            return pa.RecordBatch.from_arrays([pa.array([row[f.split()[0]]], t) for f, t in zip(FILES.split(", "), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.binary(), pa.binary()), strict=True)], names=[f.split()[0] for f in FILES.split(", ")])

        for b in batches:
            names = iter(b.column(0).to_pylist())
            for got, bound in of.of_column(b.column(1)):
                for x, y in zip(bound.tolist(), bound[1:].tolist(), strict=False):
                    doc, n = next(names), y - x + 1
                    if docs and (size + n > SHARD or (docs[-1] is None) != (doc is None)):
                        yield shard()
                        done += size
                        docs, lengths, parts, size = [], [], [], 0
                    docs.append(doc)
                    lengths.append(n)
                    parts += (got[x:y], end)
                    size += n
        if docs:
            yield shard()

    small_batches(spark)
    docs = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    return written(spark, docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, FILES), "token_files")


def read(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Documents of token files: position, length and checksum of their ids."""
    totals = sorted(tuple(r) for r in files.groupBy("part").agg(F.sum("n_tokens")).collect())  # a row for each partition
    bases, base = [], 0
    for part, n in totals:
        bases.append((part, base))
        base += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                docs, lengths = np.frombuffer(r["doc_ids"], "<i8"), np.frombuffer(r["lengths"], "<i8")
                raw = memoryview(decode(r["body"]).astype("<u4").tobytes())
                ends = np.cumsum(lengths)
                begins = ends - lengths
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, mask=np.full(len(docs), r["doc_null"])), pa.array(begins + r["first_in_part"] + r["base"]), pa.array(lengths), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    known = spark.createDataFrame(bases, "part int, base long")
    return files.join(F.broadcast(known), "part").select("doc_ids", "doc_null", "lengths", "body", "first_in_part", "base").mapInArrow(run, RESULT)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, write(spark, table(spark, sf_dir, "documents")))
