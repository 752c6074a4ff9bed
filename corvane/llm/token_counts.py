"""Token counts by heap-and-linked-list byte-pair merging (operator 8).

Only a count is needed, so no identifiers are produced: the symbols of a pre-token form a linked
list, a heap holds its adjacent pairs by merge rank, and each pop of a live pair joins two
symbols. The count is the number of initial symbols less the number of merges. Whole texts are cut
into segments that don't affect each other (see ``pieces``); a segment is counted once, and the counts
of a text's segments are added up.

Defined results. Null or empty text: 0 bytes, 0 tokens, not over the limit. Null doc_id: a row with
a null id. Repeated rows: one row each. Empty table: empty result. Other columns are not read. A
very long text is counted whole, and one pre-token of n bytes costs n log n.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame, SparkSession

from corvane.llm.pieces import GPT, SPACED, WHOLE, Segments, Table, loose
from corvane.llm.shared import small_batches, table
from corvane.llm.vec import KEPT, release

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
VOCABULARY = "byte_bpe_50k.json"
TOKEN_LIMIT = 512


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = (b for b in range(256) if b not in plain)
    extra = {b: chr(256 + i) for i, b in enumerate(odd)}
    return [extra.get(b) or chr(b) for b in range(256)]


class Merges(Segments):
    """Counts tokens of a byte-level vocabulary. The value of a segment is its count."""

    def __init__(self, name: str = VOCABULARY):
        super().__init__(name)
        if not self.spaced:
            raise ValueError(f"not a byte-level vocabulary that keeps spaces: {name}")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in self.spec["model"]["merges"]]
        symbols = {c: i for i, c in enumerate(byte_alphabet())}
        self.rank: dict[int, int] = {}  # of a pair of symbols
        self.joined: list[int] = []  # the symbol that a merge makes
        for i, (a, b) in enumerate(merges):
            self.joined.append(symbols.setdefault(a + b, len(symbols)))
            self.rank.setdefault(symbols[a] << 32 | symbols[b], i)
        del self.spec
        self.cut = regex.compile("|".join(map(regex.escape, self.added))) if self.added else None
        self.pattern = regex.compile(GPT)
        self.table = Table(self.learn)

    def of_word(self, word: str) -> int:
        """Initial symbols less merges."""
        sym = list(word.encode())
        n = len(sym)
        rank, joined = self.rank.get, self.joined
        heap = [r << 32 | i for i in range(n - 1) if (r := rank(sym[i] << 32 | sym[i + 1])) is not None]
        if not heap:
            return n
        heapify(heap)
        nxt, prev, count = list(range(1, n + 1)), list(range(-1, n - 1)), n
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFF
            j = nxt[i]
            # an entry is live while its place still holds a pair of its rank
            if sym[i] < 0 or j >= n or rank(sym[i] << 32 | sym[j]) != top >> 32:
                continue
            sym[i] = s = joined[top >> 32]
            sym[j] = -1
            nxt[i] = k = nxt[j]
            count -= 1
            if k < n:
                prev[k] = i
                if (r := rank(s << 32 | sym[k])) is not None:
                    heappush(heap, r << 32 | i)
            if (h := prev[i]) >= 0 and (r := rank(sym[h] << 32 | s)) is not None:
                heappush(heap, r << 32 | h)
        return count

    def of_text(self, text: str) -> int:
        """Tokens of a text by the pattern of the vocabulary; a string of an added token is one."""
        parts = self.cut.split(text) if self.cut else [text]
        return len(parts) - 1 + sum(self.of_word(w) for p in parts for w in self.pattern.findall(p))

    def learn(self, kinds: list[int], bodies: list[bytes]) -> np.ndarray:
        texts = [b.decode() for b in bodies]
        return np.array([WHOLE if k <= SPACED and loose(t) else sum(map(self.of_text, self.parts(k, t))) for k, t in zip(kinds, texts, strict=True)], np.int64)

    def of_column(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; null is empty."""
        out = [np.zeros(0, np.int64)]
        held = 0
        for f in self.found(self.table, texts):
            total = np.zeros(len(f.values) + 1, np.int64)
            np.cumsum(f.values, out=total[1:])
            n = np.diff(total[f.bounds])
            for k, text in f.odd.items():
                n[k] = self.of_text(text)
            n[0] += held
            first = np.flatnonzero(f.begins)
            n = np.add.reduceat(n, first if f.begins[0] else np.append(0, first))
            held = int(n[-1]) if f.more else 0
            out.append(n[: len(n) - f.more])
        return np.concatenate(out)

    def __call__(self, text: str | None) -> int:
        return int(self.of_column(pa.array([text], pa.string()))[0])


@lru_cache(maxsize=1)
def merges(name: str) -> Merges:
    return Merges(name)


KEPT.append(merges.cache_clear)


def count(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, limit: int = TOKEN_LIMIT) -> DataFrame:
    """Bytes and tokens of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(merges.cache_clear)
        of = merges(vocabulary)
        for b in batches:
            texts = b.column(1)
            n = of.of_column(texts)
            size = pa.compute.binary_length(texts).fill_null(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    small_batches(df.sparkSession)
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(table(spark, sf_dir, "documents"))
