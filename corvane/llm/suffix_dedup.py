"""Removal of repeated passages with longest-previous-factor arrays (operator 9).

A byte goes if it lies in a string of ``LENGTH`` (100) bytes that also starts earlier: in a document
with a smaller id, or earlier in the same one. A longest-previous-factor (LPF) array tells this: in
suffix order the nearest suffixes with smaller positions are the best earlier matches, and a suffix
whose LPF is 100 or more starts a repeated string. One suffix array of a whole corpus does not fit
anywhere, so suffixes are first dealt into groups such that equal 100-byte strings always meet:

1. Of the 69 grams of 32 bytes in a 100-byte window, the one with the smallest hash is its anchor.
   Neighbouring windows mostly share an anchor, so a text falls into runs of about 35 windows. Equal
   windows have equal anchors. As a preparation, some megabytes of text drop the runs that repeat within
   them, byte for byte, and pass on the first of each: a passage in a third of all rows goes on once.
2. Anchors with one run are done: nothing else can be equal to its windows. Of the others, runs that are
   equal as a whole to an earlier one are dropped too, by a cryptographic digest of their bytes
   (BLAKE2b, 96 bits, within an anchor), and anchors that then have one run left are done.
3. An anchor with more than ``GROUP`` runs, such as one in a common line, is mostly surrounded by other text
   each time. Its runs are cut into parts of ``SHARE`` (9) windows by the place of the anchor in them; equal
   windows have equal ones. The windows of a part share ``CORE`` (92) bytes, whose hash takes the anchor's
   place in step 2 for them. Most cores come once, and only numbers were shuffled for those.
4. Runs and parts of the rest, where texts begin to differ, fetch their bytes and meet by anchor or core. If
   more than ``GROUP`` have a core, they are dealt to several groups, by the content of each window, and in two
   rounds: first with a part of the documents each, then the windows without an earlier match there. So a group
   has about ``GROUP`` rows of one string, or of all, however often a passage or a line comes.
5. A group, or several at once, gets its suffix array (prefix doubling by 8, 16, 32 and 64 bytes, to 100;
   ties by position), for each window the previous and next smaller position in suffix order, the
   longest common prefixes with both, and from these its LPF. Windows with an LPF of 100 go.

Other hashes only decide who meets. The text is shuffled once, by id; the joins and
step 1 read that exchange. Ranges that steps 1 and 2 remove wait by id for those of step 5. Tasks read their groups in order, and hold those that they work on.

Defined results. Null or empty text: nothing removed. Each row is a document: rows with equal ids count
in the order of their texts, so of repeated rows the first is left whole; rows without an id come first.
Empty table: empty result. Other columns, whatever their names, are not read by ``spans``; ``remove``
passes them through. Texts under 100 bytes lose nothing. Very long texts are processed whole, in pieces
of a quarter of a megabyte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corvane.llm.shared import irregular, small_batches, table, unused, written
from corvane.llm.vec import Spans, classes, column_bytes, mix, release, slices

LENGTH, GRAM, GROUP = 100, 32, 2000
WINDOW = LENGTH - GRAM + 1
WIDEST = WINDOW + LENGTH - 1  # bytes of a run
SHARE = 9  # windows of a part
CORE = LENGTH - SHARE + 1
PIECE, SLAB, PART = 1 << 18, 1 << 19, 8 << 20  # bytes worked on at once: a text, runs of groups, texts of one task
U = np.uint64
# at: first window << 8 | windows. A row with an end is a removed range of windows.
RUN = "fp long, d1 long, d2 int, doc long, at long, end long"
EDGE = "fp long, doc long, at long, end long, groups long"
ROW = "fp long, then long, doc long, at long, end long, body binary"
RANGE = "doc long, at long, end long"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchor hash, content hash, row, first window and number of windows of each run."""
    out = []
    row = 0
    n = len(offsets) - 1
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1)
        if last == row + 1 and offsets[last] - offsets[row] > 2 * PIECE:
            # a long text in pieces that share LENGTH - 1 bytes, so that each window is in one piece
            for at in range(int(offsets[row]), int(offsets[last]) - LENGTH + 1, PIECE):
                end = min(at + PIECE + LENGTH - 1, int(offsets[last]))
                fp, h, r, start, anchor, many = _runs(data[at:end], np.array([0, end - at]))
                out.append((fp, h, r + row, start + (at - offsets[row]), anchor, many))
        else:
            fp, h, r, start, many = _runs(data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row])
            out.append((fp, h, r + row, start, many))
        row = last
    if not out:
        return tuple(np.zeros(0, t) for t in ("u8", "u8", "i8", "i8", "i8"))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    n = len(data) - GRAM + 1
    windows = len(data) - LENGTH + 1
    if windows < 1:
        return tuple(np.zeros(0, t) for t in ("u8", "u8", "i8", "i8", "i8"))
    spans = Spans(data)
    grams = mix((spans.sums[GRAM:] - spans.sums[:-GRAM]) * spans.down[:n])
    value, index, width = grams, np.arange(n, dtype=np.int32), 1
    while width < WINDOW:
        step = min(width, WINDOW - width)
        right = value[step:] < value[:-step]
        value, index = np.where(right, value[step:], value[:-step]), np.where(right, index[step:], index[:-step])
        width += step
    # windows that lie within one row
    valid = np.zeros(len(data) + 1, np.int8)
    size = np.diff(offsets)
    big = np.flatnonzero(size >= LENGTH)
    np.add.at(valid, offsets[big], 1)
    np.add.at(valid, offsets[big + 1] - LENGTH + 1, -1)
    valid = np.cumsum(valid[:windows], dtype=np.int8) > 0
    new = np.ones(windows, bool)
    new[1:] = (index[1:] != index[:-1]) | ~valid[:-1]
    heads = offsets[big]
    new[heads[heads < windows]] = True
    starts = np.flatnonzero(new & valid)
    stop = np.zeros(windows + 1, bool)
    stop[:-1] = new | ~valid
    stop[-1] = True
    stops = np.flatnonzero(stop)
    ends = stops[np.searchsorted(stops, starts, "right")]
    anchor = index[starts].astype(np.int64)
    row = np.searchsorted(offsets, starts, "right") - 1
    content = spans.hash(starts, ends + (LENGTH - 1))
    return grams[anchor], content, row, starts - offsets[row], ends - starts


def removed_rows(doc: np.ndarray, start: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of windows, joined where they touch."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], (start + many)[order]
    if not len(doc):
        return doc, start, stop
    new = np.ones(len(doc), bool)
    reach = stop.copy()
    # ranges of one document don't nest here: each window is in one run
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return doc[first], start[first], np.maximum.reduceat(stop, first)


def batch(names: str, **columns) -> pa.RecordBatch:
    """A batch with columns of these names and types; missing ones are null."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    cols = []
    for name, kind in (x.split() for x in names.split(", ")):
        c = columns.get(name)
        if c is None:
            c = pa.nulls(len(columns["doc"]), kinds[kind])
        elif isinstance(c, np.ndarray):
            c = pa.array(np.ascontiguousarray(c).view(np.int64) if c.dtype == np.uint64 else c, kinds[kind])
        cols.append(c)
    return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in names.split(", ")])


def equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes from ``a`` and from ``b`` on are the same, ``size`` each."""
    rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(WIDEST, np.uint8)]), WIDEST)
    out = np.ones(len(a), bool)
    for i in range(0, len(a), 1 << 14):
        x = slice(i, i + (1 << 14))
        differ = rows[a[x]] != rows[b[x]]
        out[x] = np.where(differ.any(axis=1), differ.argmax(axis=1) >= size[x], True)
    return out


def repeats(data: np.ndarray, keys: list[np.ndarray], doc: np.ndarray, start: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which spans of ``data`` (from ``place``) have the keys and the bytes of an earlier one (by document and start)."""
    order = np.lexsort((start, doc, *keys))
    same = np.zeros(len(order), bool)
    if len(order):
        same[1:] = np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in (*keys, size)])
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    spot = np.flatnonzero(same)
    out = np.zeros(len(order), bool)
    out[order[spot]] = equal(data, place[order[first[spot]]], place[order[spot]], size[order[spot]])
    return out


def find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1, over some megabytes at a time."""
    release()
    for b in batches:
        data, offsets = column_bytes(b.column(1))
        ids = b.column(0).to_numpy(zero_copy_only=False)
        for i, j in slices(offsets, PART):
            yield from _found(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ids[i:j])


def _found(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    fp, h, row, start, many = runs(data, offsets)
    doc = ids[row]
    later = repeats(data, [fp, h], doc, start, offsets[row] + start, many + LENGTH - 1)
    first = np.flatnonzero(~later)
    if len(first):
        place, raw = offsets[row[first]] + start[first], data.tobytes()
        d = digests(raw, place, many[first] + LENGTH - 1)
        yield batch(RUN, fp=fp[first], d1=d["d1"], d2=d["d2"], doc=doc[first], at=(start << 8 | many)[first])
    if later.any():
        d, s, e = removed_rows(doc[later], start[later], many[later])
        yield batch(RUN, fp=mix(d.astype(np.uint64)), doc=d, at=s << 8, end=e)


def digests(raw: bytes, place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Two numbers for the bytes of each span."""
    out = b"".join(hashlib.blake2b(raw[x:y], digest_size=12).digest() for x, y in zip(place.tolist(), (place + size).tolist(), strict=True))
    return np.frombuffer(out, np.dtype([("d1", "<i8"), ("d2", "<i4")]))


def by_anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2 over rows in the order of anchor, digest and position, with the number of rows of the anchor. Rows
    out: removed ranges, and the runs of anchors that have different ones. One row is held between batches."""
    release()
    last, held, opened = None, None, None  # the row before; the only run of its anchor so far; an anchor with several
    for b in batches:
        gone = b.column("end").is_valid().to_numpy(zero_copy_only=False)
        if gone.any():
            some = b.filter(pa.array(gone))
            yield batch(EDGE, **{c: some.column(c) for c in ("doc", "at", "end")})
            b = b.filter(pa.array(~gone))
        if not b.num_rows:
            continue
        fp, d1, d2, doc, at, n = (b.column(c).to_numpy() for c in ("fp", "d1", "d2", "doc", "at", "n"))
        same = np.zeros(len(fp), bool)
        same[1:] = (fp[1:] == fp[:-1]) & (d1[1:] == d1[:-1]) & (d2[1:] == d2[:-1])
        same[0] = last == (fp[0], d1[0], d2[0])
        last = fp[-1], d1[-1], d2[-1]
        if same.any():
            d, s, e = removed_rows(doc[same], at[same] >> 8, at[same] & 0xFF)
            yield batch(EDGE, doc=d, at=s << 8, end=e)
        rows = np.stack([fp, doc, at, -(-n // GROUP)])[:, ~same]
        if held is not None:
            rows = np.concatenate([held, rows], axis=1)
        if not rows.shape[1]:
            continue
        begin = np.flatnonzero(np.diff(rows[0], prepend=~rows[0, 0]))
        size = np.diff(np.append(begin, rows.shape[1]))
        several = size > 1
        several[0] |= opened is not None and opened == rows[0, 0]
        held = None if several[-1] else rows[:, -1:]
        opened = rows[0, -1] if several[-1] else None
        pick = np.repeat(several, size)
        if pick.any():
            fp, doc, at, groups = rows[:, pick]
            yield batch(EDGE, fp=fp, doc=doc, at=at, groups=groups)


def listed(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Bytes of the documents (doc, text, rows) of a batch; and of each of their rows anchor, document, first
    window, number of windows, place in the bytes and groups."""
    data, offsets = column_bytes(b.column(1))
    ids = b.column(0).to_numpy(zero_copy_only=False)
    lists = b.column(2)
    flat = lists.flatten()
    fp, at, groups = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("fp", "at", "groups"))
    row = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
    return data, fp, ids[row], at >> 8, at & 0xFF, offsets[row] + (at >> 8), groups


def cut_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3: documents with their runs of anchors with several groups. Rows out: their parts."""
    release()
    for b in batches:
        data, fp, doc, start, many, place, _ = listed(b)
        raw = data.tobytes()
        for i in range(0, len(fp), 4000):
            x = slice(i, i + 4000)
            key, which, first, size = parts(data, fp[x], many[x], place[x])
            d = digests(raw, place[x][which] + first, size + LENGTH - 1)
            yield batch(RUN, fp=key, d1=d["d1"], d2=d["d2"], doc=doc[x][which], at=(start[x][which] + first) << 8 | size)


def parts(data: np.ndarray, fp: np.ndarray, many: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hash of anchor, place and core, run, first window within it and number of windows of each part of runs."""
    size = many + LENGTH - 1
    body = np.frombuffer(bodies(data, place, size).buffers()[2], np.uint8)
    begin = np.cumsum(size) - size
    spans = Spans(body)
    n = len(body) - GRAM + 1
    grams = mix((spans.sums[GRAM:] - spans.sums[:-GRAM]) * spans.down[:n])
    run = np.repeat(np.arange(len(fp)), size)[:n]
    hit = np.flatnonzero(grams == fp.view(np.uint64)[run])
    anchor = hit[np.searchsorted(run[hit], np.arange(len(fp)))]  # the first in its run, as in all of the run's windows
    which, step = np.repeat(np.arange(len(fp)), many), steps(many)
    before = (anchor - begin)[which] - step  # bytes of the window before its anchor
    new = np.ones(len(which), bool)
    new[1:] = (which[1:] != which[:-1]) | (before[1:] // SHARE != before[:-1] // SHARE)
    at = np.flatnonzero(new)
    which, share = which[at], before[at] // SHARE
    core = anchor[which] - share * SHARE
    key = mix(fp.view(np.uint64)[which] ^ mix(spans.hash(core, core + CORE) + share.astype(np.uint64)))
    return key, which, step[at], np.diff(np.append(at, len(new)))


def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 4: documents with their runs and parts. Rows out: these with their bytes, and the windows of those
    with several groups, with the group of the second round."""
    release()
    for b in batches:
        data, fp, doc, start, many, place, groups = listed(b)
        plain = np.flatnonzero(groups == 1)
        for i in range(0, len(plain), 2000):
            p = plain[i : i + 2000]
            yield batch(ROW, fp=fp[p], doc=doc[p], at=start[p] << 8 | many[p], body=bodies(data, place[p], many[p] + LENGTH - 1))
        crowd = np.flatnonzero(groups > 1)
        for i in range(0, len(crowd), 50):
            p = crowd[i : i + 50]
            which, step = np.repeat(p, many[p]), steps(many[p])
            at_, d, w = place[which] + step, doc[which], start[which] + step
            whole = bodies(data, at_, np.full(len(at_), LENGTH))
            flat, last = np.frombuffer(whole.buffers()[2], np.uint8), np.arange(1, len(at_) + 1) * LENGTH
            h = Spans(flat).hash(last - LENGTH, last)
            n = groups[which].astype(np.uint64)
            then = mix(fp[which].view(np.uint64) ^ mix(h % n))
            first = mix(then + mix(d.astype(np.uint64)) % n)
            yield batch(ROW, fp=first, then=then, doc=d, at=w << 8 | 1, body=whole)


def steps(many: np.ndarray) -> np.ndarray:
    """0, 1, ... below each number."""
    return np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)


def bodies(data: np.ndarray, place: np.ndarray, size: np.ndarray) -> pa.Array:
    """Bytes of spans as an array of binary values."""
    ends = np.cumsum(size)
    flat = data[np.repeat(place - ends + size, size) + np.arange(ends[-1])]
    return pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(flat)])


def nearest_smaller(p: np.ndarray) -> np.ndarray:
    """For each place of ``p`` (distinct numbers) the nearest one before it with a smaller number; -1 if none."""
    low = [p]
    while 2 << (len(low) - 1) <= len(p):
        half = 1 << (len(low) - 1)
        low.append(np.minimum(low[-1][:-half], low[-1][half:]))  # minima of 2, 4, 8, ... numbers
    at = np.arange(len(p))  # everything from here up to the place itself is larger
    for k in range(len(low) - 1, -1, -1):
        to = at - (1 << k)
        on = to >= 0
        on[on] = low[k][to[on]] > p[on]
        at = np.where(on, to, at)
    return at - 1


def lpf_array(text: np.ndarray, windows: np.ndarray, position: np.ndarray) -> np.ndarray:
    """The longest common prefix, up to 100 bytes, of each window (start in ``text``) with any window of a
    smaller position (distinct numbers)."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(128, np.uint8)])
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << U(8) | padded[i : i + n].astype(np.uint64)
    ranks = []
    size = 8
    while size <= 64:
        order, _, number = classes(key)
        rank = np.full(n + 128, -1, np.int64)
        rank[order] = number
        ranks.append((size, rank))
        key = (rank[:n] * (n + 2) + rank[size : size + n] + 1).view(np.uint64)
        size *= 2
    whole = rank[windows] * (n + 2) + rank[windows + LENGTH - 64] + 1  # 64 bytes from the start and up to the end
    order = np.lexsort((position, whole))  # the suffix array of the windows; ties by position
    p, at = position[order], windows[order]
    before, after = nearest_smaller(p), len(p) - 1 - nearest_smaller(p[::-1])[::-1]
    out = np.zeros(len(p), np.int64)
    for other in (before, np.where(after < len(p), after, -1)):
        has = np.flatnonzero(other >= 0)
        a, b = at[has], at[other[has]]
        common = np.zeros(len(has), np.int64)
        for size, rank in reversed(ranks):
            same = rank[a + common] == rank[b + common]
            common += size * same
        ahead = np.arange(8)
        near = padded[np.minimum(a + common, n)[:, None] + ahead] == padded[np.minimum(b + common, n)[:, None] + ahead]
        common += np.where(near.all(axis=1), 8, near.argmin(axis=1))
        out[has] = np.maximum(out[has], np.minimum(common, LENGTH))
    lpf = np.empty(len(p), np.int64)
    lpf[order] = out
    return lpf


def by_suffix(last: bool):
    """Step 5 over rows in the order of their groups. Rows out: removed ranges, and if this isn't the last
    round windows that come to a second one."""

    def solved(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        gone = rows.column("end").is_valid().to_numpy()
        doc, at = (rows.column(c).to_numpy() for c in ("doc", "at"))
        if gone.any():
            yield out(doc[gone], at[gone] >> 8, rows.column("end").fill_null(0).to_numpy()[gone])
        if gone.all():
            return
        body = rows.column("body").combine_chunks().filter(pa.array(~gone))
        doc, at = doc[~gone], at[~gone]
        many, start = at & 0xFF, at >> 8
        _, offsets, data = body.buffers()
        bounds = np.frombuffer(offsets, np.int32)[body.offset : body.offset + len(body) + 1]
        text = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
        which, step = np.repeat(np.arange(len(doc)), many), steps(many)
        d, w = doc[which], start[which] + step
        position = np.empty(len(d), np.int64)
        position[np.lexsort((w, d))] = np.arange(len(d))
        hit = lpf_array(text, (bounds[:-1] - bounds[0])[which] + step, position) >= LENGTH
        if hit.any():
            yield out(*removed_rows(d[hit], w[hit], np.ones(int(hit.sum()), np.int64)))
        if not last:
            then = rows.column("then").combine_chunks().filter(pa.array(~gone))
            again = then.is_valid().to_numpy(zero_copy_only=False)
            again[again] = ~hit[(np.cumsum(many) - many)[again]]  # such a row is one window
            if again.any():
                pick = pa.array(again)
                yield batch(ROW, fp=then.filter(pick), doc=doc[again], at=at[again], body=body.filter(pick))

    def out(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
        if last:
            return batch(RANGE, doc=doc, at=start, end=end)
        return batch(ROW, fp=mix(doc.astype(np.uint64)), doc=doc, at=start << 8, end=end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size > SLAB:
                rows = pa.Table.from_batches(held)
                fp = rows.column("fp").to_numpy()
                edges = np.flatnonzero(fp[1:] != fp[:-1]) + 1
                if not len(edges):
                    continue
                begin, mean = 0, max(1, len(fp) * SLAB // size)
                while begin + mean < edges[-1]:  # groups are not cut
                    stop = int(edges[np.searchsorted(edges, begin + mean)])
                    yield from solved(rows.slice(begin, stop - begin))
                    begin = stop
                rest = rows.slice(begin).combine_chunks()
                held, size = rest.to_batches(), rest.nbytes
        if held:
            yield from solved(pa.Table.from_batches(held))

    return run


def covered(at: np.ndarray, end: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Removed byte spans of a text of ``size`` bytes, from ranges of window starts."""
    if not len(at):
        return []
    order = np.argsort(at, kind="stable")
    s, e = at[order], np.minimum(end[order] + LENGTH - 1, size)
    reach = np.maximum.accumulate(e)
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return list(zip(s[first].tolist(), np.maximum.reduceat(e, first).tolist(), strict=True))


def cut(text: bytes, out: list[tuple[int, int]]) -> bytes:
    """``text`` without the spans."""
    begin, parts = 0, []
    for s, e in out:
        parts.append(text[begin:s])
        begin = e
    parts.append(text[begin:])
    return b"".join(parts)


def each(b: pa.RecordBatch, text: int, lists: int) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    """Bytes and removed spans of each row of a batch."""
    data, offsets = column_bytes(b.column(text))
    col = b.column(lists)
    bounds = col.offsets.to_numpy()
    at, end = (col.values.field(k).to_numpy(zero_copy_only=False) for k in ("at", "end"))
    none = col.is_null().to_numpy(zero_copy_only=False)
    for i in range(len(col)):
        body = data[offsets[i] : offsets[i + 1]].tobytes()
        x, y = (0, 0) if none[i] else (bounds[i], bounds[i + 1])
        yield body, covered(at[x:y], end[x:y], len(body))


def with_ranges(docs: DataFrame) -> DataFrame:
    """doc, text and the removed ranges of windows, of documents (doc, text) with numbers of their own."""
    docs = docs.where("doc is not null").repartition("doc")  # as joins see it, so that all read one exchange
    found = docs.mapInArrow(find_runs, RUN).repartition("fp").sortWithinPartitions("fp", "d1", "d2", "doc", "at")
    found = found.withColumn("n", F.count("*").over(W.partitionBy("fp"))).where("n > 1 or end is not null")
    # by document before they are gathered: lists for each task of step 2 would grow with the number of tasks
    edges = found.mapInArrow(by_anchor, EDGE).repartition("doc")
    lists = edges.groupBy("doc").agg(F.collect_list(F.struct("fp", "at", "end", "groups")).alias("rows"))
    # all take whole lists, so that they read one exchange
    some = lambda f: F.filter("rows", f)
    crowd = lists.select("doc", some(lambda r: r["groups"] > 1).alias("rows")).where(F.size("rows") > 0)
    cores = docs.hint("merge").join(crowd.hint("merge"), "doc").select("doc", "text", "rows").mapInArrow(cut_runs, RUN)
    cores = cores.repartition("fp").sortWithinPartitions("fp", "d1", "d2", "doc", "at")
    cores = cores.withColumn("n", F.count("*").over(W.partitionBy("fp"))).where("n > 1")
    cores = cores.withColumn("n", F.dense_rank().over(W.partitionBy("fp").orderBy("d1", "d2"))).withColumn("n", F.max("n").over(W.partitionBy("fp")).cast("long"))
    cores = cores.mapInArrow(by_anchor, EDGE).repartition("doc").groupBy("doc").agg(F.collect_list(F.struct("fp", "at", "end", "groups")).alias("parts"))
    whole = F.concat(some(lambda r: r["groups"].isNull() | (r["groups"] == 1)), F.coalesce("parts", F.array()))
    lists = lists.hint("merge").join(cores.hint("merge"), "doc", "left").select("doc", whole.alias("rows"))
    left = lists.select("doc", some(lambda r: r["end"].isNull()).alias("rows")).where(F.size("rows") > 0)
    rows = docs.hint("merge").join(left.hint("merge"), "doc").select("doc", "text", "rows").mapInArrow(fetch, ROW)
    for last, kind in ((False, ROW), (True, RANGE)):
        rows = rows.repartition("fp").sortWithinPartitions("fp").mapInArrow(by_suffix(last), kind)
    late = rows.repartition("doc").groupBy("doc").agg(F.collect_list(F.struct("at", "end")).alias("late"))
    early = F.transform(some(lambda r: r["end"].isNotNull()), lambda r: F.struct(F.shiftright(r["at"], 8).alias("at"), r["end"].alias("end")))
    out = lists.hint("merge").join(late.hint("merge"), "doc", "left").select("doc", F.concat(early, F.coalesce("late", F.array())).alias("ranges"))
    out = out.where(F.size("ranges") > 0)
    return docs.hint("merge").join(out.hint("merge"), "doc", "left").select("doc", "text", "ranges")


def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for b in batches:
        rows = [(len(t), sum(y - x for x, y in s), len(s), hashlib.sha256(cut(t, s)).hexdigest()) for t, s in each(b, 1, 2)]
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def numbered(spark: SparkSession, df: DataFrame, id_col: str, text_col: str, key: str) -> DataFrame:
    """``df`` with a number for each row in column ``key``, ascending by id and text: the id itself, if it is one."""
    small_batches(spark)
    number, text = df[id_col].cast("long"), df[text_col].cast("string")
    if not irregular(df.select(number.alias("doc_id"))):
        return df.withColumn(key, number)
    order, body = unused(df, "order"), unused(df, "body")
    rows = df.withColumns({order: number, body: text}).repartitionByRange(order, body).sortWithinPartitions(order, body)
    return written(spark, rows.drop(order, body).withColumn(key, F.monotonically_increasing_id()), "numbered")


def remove(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with repeated passages cut from its texts. Characters of which only a part is left go too;
    a document of which nothing is left is dropped. The text isn't shuffled again for its other columns."""
    key, place = unused(df, "key"), df.columns.index(text_col)
    schema = StructType([StructField(f.name, StringType() if k == place else f.dataType) for k, f in enumerate(df.schema.fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            changed = b.column(1).is_valid().to_numpy(zero_copy_only=False)
            some = b.select([0, 1]).filter(pa.array(changed))
            left = [cut(t, s).decode("utf-8", "ignore") for t, s in each(some, 0, 1)]
            text = pa.compute.replace_with_mask(b.column(0), pa.array(changed), pa.array(left, b.column(0).type))
            stay = ~changed
            stay[changed] = [x != "" for x in left]
            columns = [b.column(k) for k in range(2, b.num_columns)]
            columns.insert(place, text)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names).filter(pa.array(stay))

    rows = numbered(df.sparkSession, df, id_col, text_col, key)
    found = with_ranges(rows.select(rows[key].alias("doc"), rows[text_col].cast("string").alias("text")))
    rest = rows.select(rows[key].alias("doc"), *(rows[c].alias(f"other{k}") for k, c in enumerate(df.columns) if k != place))
    whole = found.hint("merge").join(rest.hint("merge"), "doc").select("text", "ranges", *(c for c in rest.columns if c != "doc"))
    return whole.mapInArrow(run, schema)


def spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes, removed bytes and spans of each document, and a digest of what is left."""
    docs = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    rows = numbered(df.sparkSession, docs, "doc_id", "text", "doc")
    out = with_ranges(rows.select("doc", "text"))
    out = out.mapInArrow(digest, RESULT)
    if not hasattr(rows, "_corvane_path"):
        return out
    names = rows.select("doc", F.col("doc_id").alias("name"))
    return out.withColumnRenamed("doc_id", "doc").join(names, "doc").withColumnRenamed("name", "doc_id").select(*(x.split()[0] for x in RESULT.split(", ")))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(table(spark, sf_dir, "documents"))
