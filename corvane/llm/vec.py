"""Array helpers shared by the operators: Arrow text to bytes, words and rolling hashes.

Hashes are polynomials modulo 2**64 over random byte values, finished by a bit mixer. With a
running sum of ``value * M**i``, the hash of any span is one subtraction and one product, so
spans of different lengths cost the same.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.default_rng(20240917)
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
MULT = U(0x9E3779B97F4A7C15)
MULT_INV = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS: dict[str, np.ndarray] = {}
WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True


#: Of the C library, where it has it.
TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)

#: Clears what an operator keeps in a worker process from task to task.
KEPT: list[Callable[[], None]] = []


def release(own: Callable[[], None] | None = None) -> None:
    """Python workers serve one task after another: the next one frees what other operators have kept, and
    gives memory that is free back to the system."""
    for clear in KEPT:
        if clear is not own:
            clear()
    pa.default_memory_pool().release_unused()
    if TRIM is not None:
        TRIM(0)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MULT**i and MULT**-i for i < n."""
    if len(_POWERS.get("up", ())) < n:
        m = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            for name, base in (("up", MULT), ("down", MULT_INV)):
                p = np.full(m, base, np.uint64)
                p[0] = 1
                _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


class Spans:
    """Hashes of spans of one byte array."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE[data] * up[: len(data)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, step: int = 1 << 21) -> np.ndarray:
    """Hashes of spans with ascending starts, some megabytes of a long text at a time."""
    if len(data) <= step:
        return Spans(data).hash(start, end)
    out, i = np.empty(len(start), np.uint64), 0
    while i < len(start):
        base = int(start[i])
        j = int(np.searchsorted(start, base + step))
        out[i:j] = Spans(data[base : int(end[i:j].max())]).hash(start[i:j] - base, end[i:j] - base)
        i = j
    return out


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = 1 << 20, rows: int = 1 << 15) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes and ``rows`` rows at most, one row at least: bounds the working
    arrays, and numbers of rows within them fit 16 bits."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, i + rows, n)
        yield i, j
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and the row of each; rows don't join."""
    black = ~WHITE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = black[:-1]
    starts = np.flatnonzero(black & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = black[1:]
    ends = np.flatnonzero(black & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def row_sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` in each row."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def classes(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by the keys (first is primary), and for the ordered rows: first of its class, class number."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    first = np.ones(len(order), bool)
    if len(order):
        same = np.ones(len(order) - 1, bool)
        for k in keys:
            k = k[order]
            same &= k[1:] == k[:-1]
        first[1:] = ~same
    return order, first, np.cumsum(first) - 1
