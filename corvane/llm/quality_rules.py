"""Quality rules with suffix-array repetition (operator 10).

Words are ``[^\\x20\\x09-\\x0D]+``. Besides simple counts, each document gets a suffix array over
its words, built by prefix doubling for a whole batch of documents at once. Only suffixes whose
first three words come again in the document take part: no other suffix can have a neighbour with
a longest common prefix (LCP) of three words or more. Neighbours in suffix order give the LCP
array; the longest repeat that starts at a suffix is the larger of its two LCPs, which is the
depth of the deepest LCP interval that holds it. The union of these spans is the union of all
maximal repeated substrings of ``min_repeat`` words or more.

Defined results. Null or empty text: no words, every count 0, base_failed, not kept. Null doc_id:
kept as a row with a null id. Repeated rows: one result row each. Empty table: empty result.
Columns of other names, or with the names of result columns, are ignored by ``score`` and pass
through ``keep`` unchanged. Very long texts are processed whole, in time n log n of their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corvane.llm.shared import small_batches, table
from corvane.llm.vec import classes, column_bytes, hash_spans, mix, release, row_sums, slices, word_spans

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
U = np.uint64
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, repeat_fraction double, longest_repeat long, kept boolean"
)
MIN_REPEAT = 8
MAX_COVERED = 0.5
MAX_LONGEST = 0.35


def repeats(h: np.ndarray, doc: np.ndarray, min_repeat: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words with hashes ``h`` in documents ``doc`` (ascending): the words in windows of three that
    come twice in their document, the words in repeats of ``min_repeat`` or more, and at each word the
    length of the longest repeat that starts there."""
    n = len(h)
    in3, covered, longest = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64), np.zeros(n, np.int64)
    if n < 4:
        return in3[:n] > 0, covered[:n] > 0, longest
    whole = doc[2:] == doc[:-2]
    tri = mix(mix(mix(h[:-2]) + h[1:-1]) + h[2:] + mix(doc[2:].astype(np.uint64)))
    at = np.flatnonzero(whole)
    order, first, number = classes(tri[at])
    twice = np.bincount(number)[number] > 1 if len(number) else np.zeros(0, bool)
    # suffixes that can have a long enough neighbour, in the order of their first three words
    sa, rank0 = at[order[twice]], number[twice]
    np.add.at(in3, sa, 1)
    np.subtract.at(in3, sa + 3, 1)
    in3 = np.cumsum(in3)[:n] > 0
    if not len(sa):
        return in3, covered[:n] > 0, longest
    ranks = np.full(n + 1, -1, np.int64)
    ranks[:n] -= np.arange(n)  # every other suffix has a class of its own
    ranks[sa] = rank0
    levels, k = [(3, ranks)], 3
    while True:
        rank = ranks[sa]
        tied = np.zeros(len(sa), bool)
        same = rank[1:] == rank[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        if not tied.any():
            break
        spot = np.flatnonzero(tied)
        part = sa[spot]
        nxt = part + k
        # past the end of its document a suffix is shorter than any other: a class of its own
        inside = (nxt < n) & (doc[np.minimum(nxt, n - 1)] == doc[part])
        second = np.where(inside, ranks[np.minimum(nxt, n)], -1 - part)
        order, first, number = classes(rank[spot], second)
        sa[spot] = part[order]
        ranks = ranks.copy()
        ranks[part[order]] = spot[np.flatnonzero(first)][number] + n  # above the numbers of other classes
        other = np.flatnonzero(~tied)
        ranks[sa[other]] = other + n
        k *= 2
        levels.append((k, ranks))
    a, b = sa[:-1], sa[1:]
    lcp = np.zeros(len(a), np.int64)
    for k, r in reversed(levels):
        x, y = np.minimum(a + lcp, n), np.minimum(b + lcp, n)
        lcp += k * ((r[x] == r[y]) & (x < n) & (y < n))
    for _ in range(2):
        x, y = a + lcp, b + lcp
        ok = (x < n) & (y < n) & (lcp > 0)
        x, y = np.minimum(x, n - 1), np.minimum(y, n - 1)
        lcp += ok & (h[x] == h[y]) & (doc[x] == doc[a]) & (doc[y] == doc[b]) & (doc[a] == doc[b])
    np.maximum.at(longest, a, lcp)
    np.maximum.at(longest, b, lcp)
    long = np.flatnonzero(longest >= min_repeat)
    np.add.at(covered, long, 1)
    np.subtract.at(covered, long + longest[long], 1)
    return in3, np.cumsum(covered)[:n] > 0, longest


def measure(text: pa.Array, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST) -> dict[str, np.ndarray]:
    """The result columns for a column of texts, but for the id."""
    data, offsets = column_bytes(text)
    parts = [_measure(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], min_repeat) for i, j in slices(offsets)]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered", "longest_repeat")
    out = dict(zip(names, (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 7, strict=True))
    words = out["n_words"]
    out["base_failed"] = (words < 50) | (100 * out["n_repeat_words"] > 50 * words)
    out["repeat_fraction"] = out.pop("covered") / np.maximum(words, 1)
    out["kept"] = ~out["base_failed"] & (out["repeat_fraction"] <= max_covered) & (out["longest_repeat"] <= max_longest * words)
    return out


def _measure(data: np.ndarray, offsets: np.ndarray, min_repeat: int) -> tuple[np.ndarray, ...]:
    rows = len(offsets) - 1
    starts, ends, doc = word_spans(data, offsets)
    h = hash_spans(data, starts, ends)
    bounds = np.searchsorted(doc, np.arange(rows + 1))
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] = 1
    inside[ends] -= 1
    chars = row_sums((np.cumsum(inside[:-1]) > 0) & ((data & 0xC0) != 0x80), offsets)
    in3, covered, longest = repeats(h, doc, min_repeat)
    top = np.zeros(rows, np.int64)
    np.maximum.at(top, doc, longest)
    return (
        np.diff(bounds), chars, row_sums(SYMBOLS[data], offsets), _dup_lines(data, offsets, starts),
        row_sums(in3, bounds), row_sums(covered, bounds), top,
    )


def _dup_lines(data: np.ndarray, offsets: np.ndarray, words: np.ndarray) -> np.ndarray:
    rows = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([offsets[1:], breaks]))
    full = ends > starts
    starts, ends = starts[full], ends[full]
    has = np.searchsorted(words, ends) > np.searchsorted(words, starts)
    starts, ends = starts[has], ends[has]
    row = np.searchsorted(offsets, starts, "right") - 1
    order, first, _ = classes(row, hash_spans(data, starts, ends))
    return np.bincount(row[order][~first], minlength=rows)


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: float) -> DataFrame:
    """A row of counts and the verdict for each row of ``df``."""

    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            m = measure(b.column(1), **limits)
            order = [x.split()[0] for x in SCHEMA.split(", ")][1:]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(m[k]) for k in order)], names=["doc_id", *order])

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col]).mapInArrow(run, SCHEMA)


def keep(df: DataFrame, text_col: str = "text", **limits: float) -> DataFrame:
    """The rows of ``df`` that pass, with all their columns."""
    at = df.columns.index(text_col)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            yield b.filter(pa.array(measure(b.column(at), **limits)["kept"]))

    return df.mapInArrow(run, df.schema)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
