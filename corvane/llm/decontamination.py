"""Benchmark decontamination by latent semantic retrieval (operator 1).

The benchmark is the query set, all documents are searched. Words are compared without case and
punctuation; only words of the benchmark matter, since any other word neither adds to the product with
an item nor to a common subsequence. So each text becomes an array of term numbers once, in a table.

1. Term statistics over all passages (blocks of 64 words) of all documents, and at once the range
   finder of a randomised singular value decomposition (SVD) of the TF-IDF matrix: each task sums
   TF' TF G for a random G, so what meets is a row of ``RANK`` numbers for each benchmark term.
2. With its orthonormal basis Q and the inverse document frequencies, each task sums the small
   matrix of (TF-IDF Q)'(TF-IDF Q); its eigenvectors turn Q into the leading right singular vectors,
   each divided by its singular value, so that frequent words don't outweigh telling ones.
3. Windows of about an item's length (the power of two at or above it, every quarter of it) are
   projected by differences of running sums and compared with the items of that length by cosine.
4. Candidates with too few words of the item for step 5 go, by table lookups over all of them at once.
5. The others are checked exactly: the longest common subsequence (LCS) of item and window, widened by
   half its length to both sides, must hold ``LCS_SHARE`` of the item's words; and of the answer, the
   last fifth of the item unless a column gives it, ``ANSWER_SHARE``. Insertions, deletions, and exchanged
   words leave these intact.

A benchmark is searched in parts of at most ``MOST_BYTES`` bytes and ``MOST_TERMS`` different words (one item
at least), one part after another: what is broadcast is bounded by 4 x ``RANK`` bytes a term of a part. Nothing
of the documents comes to the driver but RANK numbers a term and a RANK x RANK matrix.

Defined results. Null or empty text, or item: no match. Null doc_id: matches with a null id. Rows with
one doc_id: one result row a matched item. Empty documents or benchmark: empty result, everything
clean. Other columns are not read by ``matches``, and pass through ``clean``. Very long texts are searched
whole, in overlapping parts of about 16,000 words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.shared import small_batches, table, written
from corvane.llm.vec import column_bytes, hash_spans, release, slices, word_spans

PASSAGE, RANK, COSINE = 64, 64, 0.4
LCS_SHARE, ANSWER_SHARE = 0.6, 0.5
MOST_BYTES, MOST_TERMS, GROUP = 8 << 20, 200_000, 1 << 14
ENCODED = "doc_id long, terms binary"
RESULT = "doc_id long, item_id long, lcs_share double, answer_share double, start_word long, end_word long"

FOLD = np.full(256, 32, np.uint8)
FOLD[128:] = np.arange(128, 256)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    FOLD[_c] = _c
FOLD[65:91] = np.arange(97, 123)


def folded(data: np.ndarray) -> np.ndarray:
    """Lower case and spaces for punctuation, byte by byte; also the capitals of Latin-1."""
    out = np.frombuffer(bytearray(data).translate(FOLD.tobytes()), np.uint8)
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    then = data[after]
    out[after[(then >= 0x80) & (then <= 0x9E) & (then != 0x97)]] += 0x20
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    flat = folded(data)
    starts, ends, row = word_spans(flat, offsets)
    return hash_spans(flat, starts, ends), row


class Benchmark:
    """The items as arrays of term numbers (from 1; 0 is any other word)."""

    def __init__(self, ids: list, texts: list[str | None], answers: list[str | None] | None = None):
        words = [word_hashes(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))[0] for t in texts]
        self.vocabulary = np.unique(np.concatenate([*words, np.zeros(0, np.uint64)]))
        # the term of a hash by its last bits; -1 where several terms have them
        self.mask = np.uint64((1 << min(20, max(16, len(self.vocabulary).bit_length() + 4))) - 1)
        self.spot = np.zeros(int(self.mask) + 1, np.int32)
        last = (self.vocabulary & self.mask).astype(np.int64)
        self.spot[last] = np.where(np.bincount(last, minlength=1)[last] > 1, -1, np.arange(1, len(last) + 1))
        self.items = []
        for i, w in enumerate(words):
            if len(w):
                seq = self.terms(w)
                said = (answers[i] if answers else None) or ""
                own = self.terms(word_hashes(np.frombuffer(said.encode(), np.uint8), np.array([0, len(said.encode())]))[0]) if said else seq[-max(1, len(seq) // 5) :]
                self.items.append((ids[i], seq.tolist(), own.tolist()))
        self.size = len(self.vocabulary) + 1

    def terms(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int32)
        term = self.spot[h & self.mask]
        maybe = np.flatnonzero(term)
        term, h = term[maybe], h[maybe]
        several = np.flatnonzero(term < 0)
        term[several] = np.minimum(np.searchsorted(self.vocabulary, h[several]) + 1, len(self.vocabulary))
        ok = self.vocabulary[term - 1] == h
        out[maybe[ok]] = term[ok]
        return out

    def rows(self, text: pa.Array) -> list[np.ndarray]:
        """Term numbers of each text."""
        data, offsets = column_bytes(text)
        out: list[np.ndarray] = []
        for i, j in slices(offsets):
            h, row = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            t = self.terms(h)
            out += np.split(t, np.searchsorted(row, np.arange(1, j - i)))
        return out


def passages(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Term and passage of each benchmark word, and the number of passages."""
    term, place, base = [], [], 0
    for t in texts:
        at = np.flatnonzero(t)
        term.append(t[at])
        place.append(at // PASSAGE + base)
        base += -(-len(t) // PASSAGE)
    empty = np.zeros(0, np.int64)
    return np.concatenate([*term, empty]).astype(np.int64), np.concatenate([*place, empty]), base


def sums(rows: np.ndarray, which: np.ndarray, begin: np.ndarray, most: int = 2048) -> np.ndarray:
    """Sums of ``rows[which]`` over the runs that start at ``begin``, a few thousand at a time: these
    stay in the processor's cache."""
    out = np.empty((len(begin), rows.shape[1]), rows.dtype)
    ends = np.append(begin[1:], len(which))
    i = 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(ends, begin[i] + most, "right")))
        out[i:j] = np.add.reduceat(rows.take(which[begin[i] : ends[j - 1]], axis=0), begin[i:j] - begin[i], axis=0)
        i = j
    return out


def project(term: np.ndarray, place: np.ndarray, n: int, basis: np.ndarray) -> np.ndarray:
    """Sums of basis rows of the terms of each passage (places ascend)."""
    out = np.zeros((n, basis.shape[1]), np.float32)
    begin = np.flatnonzero(np.diff(place, prepend=-1))
    out[place[begin]] = sums(basis, term, begin)
    return out


def grouped(texts: Iterator[np.ndarray], most: int = 1 << 17) -> Iterator[list[np.ndarray]]:
    """Texts in groups of about ``most`` words."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size > most:
            yield group
            group, size = [], 0
    if group:
        yield group


def step_sums(rows: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Sums of ``rows`` over the columns of ``which``: whole rows are copied and added, which is what numpy does fast."""
    out = rows.take(which[:, 0], axis=0)
    for k in range(1, which.shape[1]):
        out += rows.take(which[:, k], axis=0)
    return out


def popcount(flags: np.ndarray) -> np.ndarray:
    """How many are true in each row; their number is a power of two, 8 at least."""
    bits = np.packbits(flags, axis=1)
    return np.bitwise_count(bits.view(f"u{min(8, bits.shape[1])}")).sum(axis=1, dtype=np.int64)


class Retrieval:
    """Term vectors of the latent space, and the items in it by window length."""

    def __init__(self, bench: Benchmark, vectors: np.ndarray):
        self.bench, self.vectors = bench, vectors.astype(np.float32)
        by: dict[int, list[int]] = defaultdict(list)
        for k, (_, seq, _) in enumerate(bench.items):
            by[1 << max(3, (len(seq) - 1).bit_length())].append(k)
        self.lengths = {}
        for length, which in by.items():
            v = np.stack([self.vectors[bench.items[k][1]].sum(axis=0) for k in which])
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
            self.lengths[length] = np.array(which), v
        # how often an item has a word: a table while it is small, else sorted keys
        self.least = np.array([int(np.ceil(LCS_SHARE * len(seq))) for _, seq, _ in bench.items], np.int64)
        every = np.concatenate([np.array(seq, np.int64) + k * bench.size for k, (_, seq, _) in enumerate(bench.items)])
        self.keys, self.times = np.unique(every, return_counts=True)

    @cached_property
    def table(self) -> np.ndarray | None:
        """How often each item has each term, if that is small; made by the worker that needs it."""
        if len(self.bench.items) * self.bench.size > 1 << 25:
            return None
        out = np.zeros((len(self.bench.items), self.bench.size), np.uint16)
        out.reshape(-1)[self.keys] = self.times
        return out

    @cached_property
    def has(self) -> np.ndarray | None:
        """Whether each item has each term, item after item: a small part of ``table``, which caches hold."""
        return None if self.table is None else (self.table > 0).reshape(-1)

    def often(self, item: np.ndarray, term: np.ndarray) -> np.ndarray:
        """How often items have terms."""
        if self.table is not None:
            return self.table.reshape(-1).take(item * self.bench.size + term)
        key = item * self.bench.size + term
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (term > 0), self.times[at], 0)

    def enough(self, item: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Whether windows share enough words with items for the LCS: counts first, then with multiplicity."""
        if self.has is None:
            own = self.often(item[:, None], near) > 0
        else:
            own = self.has.take(near + (item * self.bench.size)[:, None])
        out = popcount(own) >= self.least[item]
        spot = np.flatnonzero(out)
        words = np.sort(near[spot].astype(np.int32), axis=1)
        place = np.arange(words.shape[1], dtype=np.int32)
        new = np.ones(words.shape, bool)
        new[:, 1:] = words[:, 1:] != words[:, :-1]
        nth = place - np.maximum.accumulate(np.where(new, place, 0), axis=1)
        out[spot] = popcount(nth < self.often(item[spot, None], words)) >= self.least[item[spot]]
        return out

    def candidates(self, texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """Texts, items, first words and length of windows with a high cosine and enough words of the item."""
        longest, step = max(self.lengths), min(self.lengths) // 4
        # between texts stand words outside the vocabulary, in multiples of the longest step: a window with half
        # its length to both sides is a run of ``whole`` that has words of one text only
        many_words = np.array([len(t) for t in texts])
        size = -(-np.maximum(many_words + longest // 4 * 3, longest // 2 * 3) // (longest // 4)) * (longest // 4)
        edge = longest // 2 + np.concatenate([[0], np.cumsum(size)])
        whole = np.zeros(edge[-1], np.int64)
        for t, e in zip(texts, edge.tolist(), strict=False):
            whole[e : e + len(t)] = t
        # sums over steps; those of longer steps come from shorter ones, and a window is four of them
        parts = np.concatenate([step_sums(self.vectors, whole[i : i + 2048].reshape(-1, step)) for i in range(0, len(whole), 2048)])
        for length, (which, items) in sorted(self.lengths.items()):
            while step < length // 4:
                parts, step = parts[: len(parts) // 2 * 2 : 2] + parts[1::2], 2 * step
            many = np.maximum(-(-(many_words - length) // step), 0) + 1  # the last window reaches the end
            text = np.repeat(np.arange(len(texts)), many)
            starts = edge[text] + step * (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many))
            v = (parts[:-3] + parts[1:-2] + parts[2:-1] + parts[3:])[starts // step]
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
            near = np.lib.stride_tricks.sliding_window_view(whole, 2 * length)
            few = max(1, (1 << 17) // (2 * length))
            for k in range(0, len(items), 4096):
                w, i = np.nonzero(v @ items[k : k + 4096].T >= COSINE)
                for x in range(0, len(w), few):
                    win, item = w[x : x + few], which[k + i[x : x + few]]
                    ok = self.enough(item, near[starts[win] - length // 2])
                    yield text[win][ok], item[ok], (starts[win] - edge[text[win]])[ok], length

    def search(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, float, float, int, int]]:
        """Text, item, shares and window of the best match of each pair."""
        lap = 2 * max(self.lengths)
        parts = [(n, at) for n, t in enumerate(texts) if t.any() for at in range(0, max(1, len(t) - lap), GROUP)]
        done = 0
        for group in grouped((texts[n][at : at + GROUP + lap] for n, at in parts), GROUP):
            best: dict[tuple[int, int], tuple] = {}
            for where, items, firsts, length in self.candidates(group):
                for n, k, at in zip(where.tolist(), items.tolist(), firsts.tolist(), strict=True):
                    item_id, seq, answer = self.bench.items[k]
                    if (n, k) in best and best[n, k][0] >= 1.0:
                        continue
                    a, b = max(0, at - length // 2), min(len(group[n]), at + length + length // 2)
                    window = group[n][a:b]
                    window = window[self.often(np.full(len(window), k), window) > 0].tolist()
                    share = lcs(seq, window) / len(seq)
                    if share < LCS_SHARE or (n, k) in best and best[n, k][0] >= share:
                        continue
                    said = lcs(answer, window) / len(answer)
                    if said >= ANSWER_SHARE:
                        best[n, k] = share, said, a, b
            for (n, k), (share, said, a, b) in best.items():
                text, at = parts[done + n]
                yield text, self.bench.items[k][0], share, said, at + a, at + b
            done += len(group)


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence: one bit for each word of ``a``."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & masks.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def fit(spark: SparkSession, encoded: DataFrame, bench: Benchmark, rank: int = RANK, seed: int = 11) -> Retrieval:
    """The randomised SVD over all passages."""
    size = bench.size
    rank = max(1, min(rank, size // 4))  # fewer dimensions than terms, else nothing is latent
    probe = np.random.default_rng(seed).standard_normal((size, rank)).astype(np.float32)
    held = spark.sparkContext.broadcast(probe)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        total, often, n = np.zeros((size, rank)), np.zeros(size, np.int64), 0
        for group in grouped(np.frombuffer(t.as_py(), np.int32) for b in batches for t in b.column(0)):
            term, place, many = passages(group)
            n += many
            if not len(term):
                continue
            z = project(term, place, many, held.value)
            order = np.argsort(term.astype(np.uint16) if size <= 1 << 16 else term, kind="stable")
            term, place = term[order], place[order]
            begin = np.flatnonzero(np.diff(term, prepend=-1))
            total[term[begin]] += sums(z, place, begin)
            # a term counts once in a passage; its places ascend
            often += np.bincount(term[(np.diff(term, prepend=-1) != 0) | (np.diff(place, prepend=-1) != 0)], minlength=size)
        seen = np.flatnonzero(often)
        often[0], seen = n, np.concatenate([[0], seen])
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(often[seen]), pa.array(list(total[seen]), pa.list_(pa.float64()))], names=["term", "n", "v"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list] = {}
        for b in batches:
            for term, n, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                v = np.asarray(v.values)
                old = got.setdefault(term, [0, np.zeros(len(v))])
                old[0] += n
                old[1] += v
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(list(got)), pa.array([x[0] for x in got.values()]), pa.array([x[1] for x in got.values()], pa.list_(pa.float64()))], names=["term", "n", "v"])

    kind = "term long, n long, v array<double>"
    rows = encoded.select("terms").mapInArrow(first, kind).repartition("term").mapInArrow(summed, kind).toArrow()
    often, total = np.zeros(size), np.zeros((size, rank))
    for term, n, v in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2), strict=True):
        often[term], total[term] = n, np.asarray(v.values)
    idf = np.log((often[0] + 1) / (often + 1)) + 1
    idf[0] = 0
    basis, _ = np.linalg.qr(idf[:, None] * total)
    step = spark.sparkContext.broadcast((idf[:, None] * basis).astype(np.float32))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        small = np.zeros((rank, rank))
        for group in grouped(np.frombuffer(t.as_py(), np.int32) for b in batches for t in b.column(0)):
            z = project(*passages(group), step.value)
            small += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rank)), pa.array(list(small), pa.list_(pa.float64()))], names=["term", "v"])

    rows = encoded.select("terms").mapInArrow(second, "term long, v array<double>").groupBy("term").agg(*(F.sum(F.col("v")[k]).alias(f"v{k}") for k in range(rank))).orderBy("term").collect()
    small = np.array([r[1:] for r in rows], float).reshape(-1, rank) if rows else np.eye(rank)
    value, turn = np.linalg.eigh(small) if small.shape == (rank, rank) else (np.ones(rank), np.eye(rank))
    real = value > max(value[-1], 1e-9) * 1e-6  # fewer than the rank where passages are few; the rest is rounding
    vectors = idf[:, None] * (basis @ (turn[:, real] / np.sqrt(value[real]))) if real.any() else np.zeros((size, 1))
    vectors[0] = 0
    return Retrieval(bench, vectors)


def encode(spark: SparkSession, df: DataFrame, bench: Benchmark, id_col: str, text_col: str) -> DataFrame:
    small_batches(spark)
    held = spark.sparkContext.broadcast(bench)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.tobytes() for t in held.value.rows(b.column(1))], pa.binary())], names=["doc_id", "terms"])

    return written(spark, df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text")).mapInArrow(run, ENCODED), "terms")


def benchmark_of(items: DataFrame, id_col: str = "item_id", text_col: str = "text", answer_col: str | None = None) -> list[Benchmark]:
    """The parts of a benchmark, each collected by itself."""
    text = F.coalesce(items[text_col].cast("string"), F.lit(""))
    cols = items.select(items[id_col].alias("id"), text.alias("text"), (items[answer_col] if answer_col else F.lit(None)).cast("string").alias("answer"))
    size = cols.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + size // (MOST_BYTES // 2)  # by hash, so half full at most on average
    dealt = cols.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(parts)))
    out: list[Benchmark] = []
    for k in range(parts):
        out += divided([tuple(r)[:3] for r in dealt.where(F.col("part") == k).collect()])
    return out


def divided(rows: list[tuple]) -> list[Benchmark]:
    """Items (id, text, answer) as one part, or in halves while they have too many terms."""
    bench = Benchmark(*map(list, zip(*rows, strict=True))) if rows else None
    if bench is None or not bench.items:
        return []
    if bench.size <= MOST_TERMS or len(rows) == 1:
        return [bench]
    return divided(rows[: len(rows) // 2]) + divided(rows[len(rows) // 2 :])


def matches(spark: SparkSession, df: DataFrame, parts: list[Benchmark], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document and item that it holds."""
    out = [part_matches(spark, df, bench, id_col, text_col) for bench in parts if bench.items]
    return reduce(DataFrame.union, out) if out else spark.createDataFrame([], RESULT)


def part_matches(spark: SparkSession, df: DataFrame, bench: Benchmark, id_col: str, text_col: str) -> DataFrame:
    encoded = encode(spark, df, bench, id_col, text_col)
    held = spark.sparkContext.broadcast(fit(spark, encoded, bench))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            found = list(held.value.search([np.frombuffer(t.as_py(), np.int32) for t in b.column(1)]))
            if found:
                n, *rest = (list(c) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(n)), *map(pa.array, rest)], names=[x.split()[0] for x in RESULT.split(", ")])

    best = F.max(F.struct("lcs_share", "answer_share", "start_word", "end_word")).alias("best")
    return encoded.mapInArrow(run, RESULT).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def clean(spark: SparkSession, df: DataFrame, parts: list[Benchmark], text_col: str = "text") -> DataFrame:
    """The rows without any item, with all columns."""
    for bench in parts:
        if bench.items:
            df = part_clean(spark, df, bench, text_col)
    return df


def part_clean(spark: SparkSession, df: DataFrame, bench: Benchmark, text_col: str) -> DataFrame:
    encoded = encode(spark, df.select(F.lit(0).alias("doc_id"), df[text_col].alias("text")), bench, "doc_id", "text")
    held = spark.sparkContext.broadcast(fit(spark, encoded, bench))
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            dirty = {n for n, *_ in held.value.search(held.value.bench.rows(b.column(at)))}
            yield b.filter(pa.array([i not in dirty for i in range(b.num_rows)], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = benchmark_of(table(spark, sf_dir, "benchmark"))
    return matches(spark, table(spark, sf_dir, "documents"), bench)
