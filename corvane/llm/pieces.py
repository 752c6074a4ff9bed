"""Token ids of whole texts, segment by segment.

A text is cut where no token can cross: at white space, and between a letter and the ASCII character
after it that is none. Equal segments have equal tokens, so each is encoded once by the tokenizers
library and then found in a table. Cutting and finding are array operations over a batch of texts: a
segment of up to 23 bytes is three machine words (its bytes, kind and length, so equal keys are equal
segments), longer ones are keys of a dictionary. What no segment can stand for goes to the library as a
whole text: one with the string of an added token, or with white space beyond ASCII at the edge of a
segment. So does every text of a vocabulary file whose normaliser and pre-tokeniser aren't the ones that
these rules were made for; ``rules`` looks at the file.

A very long text is cut into parts at single spaces, and its parts are encoded one after another. A table
holds ``ENTRIES`` segments and those of one slice more: about 100 MB with its ids, whatever the
corpus. When it is full, those that were asked for again since it was last full stay, half as many at
most, and the others go. An operator frees the tables of others when it begins.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from corvane.llm.vec import KEPT, WHITE, column_bytes, mix, slices

U = np.uint64
ENTRIES, SLICE, CALL = 1 << 20, 1 << 20, 400  # segments of a table; bytes cut at once; segments a call of the library
PLAIN, SPACED, GAP, TAIL = 1, 2, 3, 4  # kinds of segments: a word, one after a space, white space before a word, and at the end
NONE, WHOLE = -1, -2  # values: not known; the text needs the library
WIDE, LONG = 23, 16 << 20  # bytes of a segment in a table; of all longer ones
GPT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

LETTER, OTHER, LOWER = np.zeros(256, bool), np.zeros(256, bool), np.arange(256, dtype=np.uint8)
LETTER[[*range(65, 91), *range(97, 123)]] = True
OTHER[:128] = ~LETTER[:128]
LOWER[65:91] += 32
LATIN = np.zeros(256, bool)  # second bytes of the letters from U+00C0 to U+00FF
LATIN[0x80:0xC0] = True
LATIN[[0x97, 0xB7]] = False
MASKS = np.array([[(1 << 8 * min(max(n - 8 * k, 0), 8)) - 1 for k in range(3)] for n in range(WIDE + 1)], np.uint64)


def find(name: str) -> str:
    """Where the vocabulary file ``name`` is; an absolute path stays as it is."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def rules(spec: dict) -> bool | None:
    """How texts of a tokenizers file are cut: whether a space belongs to the word after it; None if these
    rules aren't made for the file."""
    known = ("lstrip", "rstrip", "single_word", "normalized")
    if spec["model"].get("type") != "BPE" or spec["model"].get("dropout") or any(t.get(k) for t in spec["added_tokens"] for k in known):
        return None
    if any(c.isspace() for t in spec["added_tokens"] for c in t["content"]):
        return None
    first, then = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
    if first is None and then.get("type") == "ByteLevel" and not then.get("add_prefix_space") and then.get("use_regex", True):
        return True
    steps = [{k: v for k, v in s.items() if k != "trim_offsets"} for s in then.get("pretokenizers", ())]
    folds = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    cuts = [
        {"type": "Split", "pattern": {"Regex": WORDS}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False},
    ]
    return False if (first or {}).get("normalizers") == folds and steps == cuts else None


def loose(segment: str) -> bool:
    """Whether a segment may join the white space of its neighbours."""
    return segment[0].isspace() or segment[-1].isspace()


def cut(data: np.ndarray, offsets: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, kinds and rows of the segments of texts, in order."""
    white = WHITE[data]
    head = np.ones(len(data), bool)
    head[1:] = white[1:] != white[:-1]
    ends = LETTER[data]
    ends[1:] |= (data[:-1] == 0xC3) & LATIN[data[1:]]
    head[1:] |= ends[:-1] & OTHER[data[1:]]
    head[offsets[:-1][offsets[:-1] < len(data)]] = True
    start = np.flatnonzero(head)
    end = np.append(start[1:], len(data))
    row = np.searchsorted(offsets, start, "right") - 1
    gap = white[start]
    if not spaced:
        word = ~gap
        return start[word], end[word], np.full(np.count_nonzero(word), PLAIN), row[word]
    last = np.ones(len(start), bool)
    last[:-1] = row[1:] != row[:-1]
    kind = np.where(gap, np.where(last, TAIL, GAP), PLAIN)
    after = np.zeros(len(start), bool)
    after[1:] = gap[:-1] & ~last[:-1] & (data[end[:-1] - 1] == 32)
    kind[after] = SPACED
    keep = (kind != GAP) | (end - start > 1) | (data[start] != 32)
    return start[keep], end[keep], kind[keep], row[keep]


class Table:
    """Values of segments: open addressing over arrays. ``learn`` gives the values of new segments (kinds
    and bytes); ``moved`` the new values of those that stay when the table is cleared out."""

    def __init__(self, learn: Callable[[list[int], list[bytes]], np.ndarray], moved: Callable[[np.ndarray], np.ndarray] = lambda x: x, entries: int | None = None):
        self.learn, self.moved, self.entries = learn, moved, entries or ENTRIES
        self.bits = (2 * max(self.entries, SLICE // 2) - 1).bit_length()
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros((1 << self.bits, 3), np.uint64)
        self.value = np.full(1 << self.bits, NONE, np.int64)
        self.again = np.zeros(1 << self.bits, bool)
        self.long: dict[tuple[int, bytes], int] = {}
        self.many = self.long_bytes = 0

    def turn(self) -> None:
        """Clears the table but for what was asked for again."""
        stay = np.flatnonzero(self.again)[: self.entries // 2]
        key, value = self.key[stay], self.value[stay]
        self.clear()
        self.insert(key, self.moved(value))

    def spot(self, key: np.ndarray) -> np.ndarray:
        return (mix(key[:, 0] ^ mix(key[:, 1] ^ mix(key[:, 2]))) >> U(64 - self.bits)).astype(np.int64)

    def lookup(self, key: np.ndarray) -> np.ndarray:
        out = np.full(len(key), NONE, np.int64)
        spot, todo = self.spot(key), np.arange(len(key))
        while len(todo):
            value, other = self.value[spot], self.key[spot] != key[todo]
            used = value != NONE
            same = used & ~(other[:, 0] | other[:, 1] | other[:, 2])
            out[todo[same]] = value[same]
            self.again[spot[same]] = True
            on = used & ~same
            todo, spot = todo[on], (spot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def insert(self, key: np.ndarray, value: np.ndarray) -> None:
        """Distinct keys that aren't in the table."""
        self.many += len(key)
        spot, todo = self.spot(key), np.arange(len(key))
        while len(todo):
            free = np.flatnonzero(self.value[spot] == NONE)
            mark = -3 - todo[free]
            self.value[spot[free]] = mark  # of several for one place one stays
            won = np.zeros(len(todo), bool)
            won[free] = self.value[spot[free]] == mark
            self.key[spot[won]] = key[todo[won]]
            self.value[spot[won]] = value[todo[won]]
            todo, spot = todo[~won], (spot[~won] + 1) & ((1 << self.bits) - 1)

    def values(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The value of each segment of a slice; they hold until the next call."""
        if self.many > self.entries or self.long_bytes > LONG:
            self.turn()
        size = end - start
        n = np.minimum(size, WIDE)
        padded = np.concatenate([data, np.zeros(24, np.uint8)])
        key = np.lib.stride_tricks.sliding_window_view(padded, 24)[start].view("<u8")
        key &= MASKS[n]
        key[:, 2] |= (kind << 61 | n << 56).astype(np.uint64)
        short = size <= WIDE
        out = self.lookup(key)
        missed = np.flatnonzero((out == NONE) & short)
        order = missed[np.lexsort(key[missed].T)]
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]).any(axis=1)
        first = order[new]
        tall = np.flatnonzero(~short)
        names = [(k, data[s:e].tobytes()) for k, s, e in zip(kind[tall].tolist(), start[tall].tolist(), end[tall].tolist(), strict=True)]
        fresh = list(dict.fromkeys(x for x in names if x not in self.long))
        if len(first) or fresh:
            bodies = [data[s:e].tobytes() for s, e in zip(start[first].tolist(), end[first].tolist(), strict=True)]
            learned = self.learn(kind[first].tolist() + [k for k, _ in fresh], bodies + [x for _, x in fresh])
            self.insert(key[first], learned[: len(first)])
            out[order] = learned[: len(first)][np.cumsum(new) - 1]
            self.long |= zip(fresh, learned[len(first) :].tolist(), strict=True)
            self.long_bytes += sum(len(x) for _, x in fresh)
        out[tall] = [self.long[x] for x in names]
        return out


def parted(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of texts and of parts of very long ones, and which of them begin a text. Between two ASCII
    characters that are no white space, a single space can begin a text of its own."""
    cuts = []
    for k in np.flatnonzero(np.diff(offsets) > 2 * SLICE).tolist():
        at, end = int(offsets[k]) + SLICE, int(offsets[k + 1])
        while at < end - SLICE:
            near = data[at - 1 : at + 1 + SLICE]
            black = ~WHITE[near] & (near < 128)
            here = np.flatnonzero(black[:-2] & (near[1:-1] == 32) & black[2:])
            if len(here):
                cuts.append(at + int(here[0]))
            at += SLICE
    every = np.concatenate([offsets[:-1], np.array(cuts, np.int64)])
    order = np.argsort(every, kind="stable")
    return np.append(every[order], offsets[-1]), order < len(offsets) - 1


@dataclass
class Found:
    """Segments of a slice of texts."""

    begins: np.ndarray  # whether a row begins a text, or goes on with the one before
    more: bool  # whether the last one goes on in the next slice
    values: np.ndarray
    bounds: np.ndarray  # of the rows, among the values
    odd: dict[int, str]  # rows without segments, which need the library


class Segments:
    """Something about each segment of texts, and what makes up for texts that can't be cut."""

    def __init__(self, name: str):
        with open(find(name), encoding="utf-8") as f:
            self.spec = json.load(f)
        self.spaced = rules(self.spec)
        self.added = [t["content"] for t in self.spec["added_tokens"]]

    def parts(self, kind: int, text: str) -> list[str]:
        """What stands in a text for a segment, as the pattern of the vocabulary takes it apart."""
        if kind == GAP:
            return [text[:-1]] if text[-1] == " " else [text[:-1], text[-1]]
        return [" " + text if kind == SPACED else text]

    def whole(self, texts: pa.Array) -> np.ndarray:
        """Texts that aren't cut, as far as that shows before."""
        out = np.full(len(texts), self.spaced is None)
        for a in self.added:
            out |= pa.compute.match_substring(texts, a).fill_null(False).to_numpy(zero_copy_only=False)
        return out

    def found(self, table: Table, texts: pa.Array) -> Iterator[Found]:
        whole = self.whole(texts)
        data, offsets = column_bytes(texts)
        offsets, begins = parted(data, offsets)
        text = np.cumsum(begins) - 1
        for i, j in slices(offsets, SLICE):
            odd = whole[text[i:j]]
            raw, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            value, row = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if not odd.all():
                part = raw if self.spaced else LOWER[raw]
                start, end, kind, row = cut(part, at, self.spaced)
                if odd.any():
                    use = ~odd[row]
                    start, end, kind, row = start[use], end[use], kind[use], row[use]
                value = table.values(part, start, end, kind)
                bad = value == WHOLE
                if bad.any():
                    odd[row[bad]] = True
                    use = ~odd[row]
                    value, row = value[use], row[use]
            more = j < len(begins) and not begins[j]
            yield Found(begins[i:j], more, value, np.searchsorted(row, np.arange(j - i + 1)), {k: raw[at[k] : at[k + 1]].tobytes().decode() for k in np.flatnonzero(odd).tolist()})


@lru_cache(maxsize=4)
def tokenizer(name: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    out = Tokenizer.from_file(find(name))
    out.no_padding()
    out.no_truncation()
    return out


class Ids(Segments):
    """Ids of texts. The value of a segment is the place of its ids in a pool and their number."""

    def __init__(self, name: str):
        super().__init__(name)
        del self.spec
        self.library = tokenizer(name)
        names = [self.library.id_to_token(i) or "" for i in range(self.library.get_vocab_size())]
        self.begins = np.array([x.startswith("\u0120") for x in names])
        self.ends = np.array([x.endswith("</w>") for x in names])
        self.clear()
        self.table = Table(self.learn, self.moved)

    def clear(self) -> None:
        self.pool, self.filled = np.zeros(1 << 16, np.uint16 if len(self.begins) <= 1 << 16 else np.uint32), 0

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def store(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Puts ids into the pool; the values of the segments that they belong to."""
        need = self.filled + len(ids)
        if need > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.filled], np.zeros(max(need, len(self.pool)), self.pool.dtype)])
        self.pool[self.filled : need] = ids
        out = (self.filled + np.cumsum(lengths) - lengths) << 24 | lengths
        self.filled = need
        return out

    def gather(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments, one after another, and the number of each."""
        many, at = values & 0xFFFFFF, values >> 24
        last = np.cumsum(many)
        return self.pool[np.repeat(at - last + many, many) + np.arange(last[-1] if len(last) else 0)], many

    def moved(self, values: np.ndarray) -> np.ndarray:
        known = values >= 0
        ids, many = self.gather(values[known])
        self.clear()
        out = values.copy()
        out[known] = self.store(ids, many)
        return out

    def learn(self, kinds: list[int], bodies: list[bytes]) -> np.ndarray:
        texts = [b.decode() for b in bodies]
        out = np.full(len(texts), WHOLE, np.int64)
        together: dict[int, list[int]] = {PLAIN: [], SPACED: []}
        alone = []
        for i, (k, t) in enumerate(zip(kinds, texts, strict=True)):
            if k > SPACED:
                alone.append(i)
            elif not self.spaced:
                (together[PLAIN] if t.isalpha() else alone).append(i)
            elif not loose(t):
                together[k].append(i)
        for k, which in together.items():
            for x in range(0, len(which), CALL):
                self.call(k, which[x : x + CALL], texts, out, alone)
        for x in range(0, len(alone), CALL):
            which = alone[x : x + CALL]
            got = [[self.encode(p) for p in self.parts(kinds[i], texts[i]) if p] for i in which]
            lists = [np.concatenate([*g, np.zeros(0, np.uint32)]) for g in got]
            out[which] = self.store(np.concatenate(lists), np.array(list(map(len, lists))))
        return out

    def call(self, kind: int, which: list[int], texts: list[str], out: np.ndarray, alone: list[int]) -> None:
        """Encodes many segments in one call of the library, if their ids can be told apart."""
        names = [texts[i] for i in which]
        if not self.spaced:
            ids = self.encode(" ".join(names))
            first = np.append(0, np.flatnonzero(self.ends[ids]) + 1)
        elif kind == SPACED:
            ids = self.encode(" " + " ".join(names))
            first = np.append(np.flatnonzero(self.begins[ids]), len(ids))
        else:
            ids = self.encode("\n".join(names))
            line = self.encode("\n")
            stop = np.flatnonzero(ids == line[0])
            ids = np.delete(ids, stop)
            first = np.concatenate([[0], stop - np.arange(len(stop)), [len(ids)]])
        if len(first) == len(which) + 1 and first[0] == 0 and first[-1] == len(ids):
            out[which] = self.store(ids, np.diff(first))
        else:
            alone += which

    def of_column(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of the texts of a column (null is empty), in order: of many texts at a time, with the bounds of each."""
        held = np.zeros(0, np.uint32)
        for f in self.found(self.table, texts):
            ids, many = self.gather(f.values)
            total = np.zeros(len(many) + 1, np.int64)
            np.cumsum(many, out=total[1:])
            bound = total[f.bounds]
            if f.odd:
                out, sizes, at = [], np.diff(bound), 0
                for k, text in f.odd.items():
                    mine = self.encode(text)
                    out += [ids[at : bound[k]], mine]
                    at, sizes[k] = bound[k], len(mine)
                ids, bound = np.concatenate([*out, ids[at:]]), np.append(0, np.cumsum(sizes))
            if len(held) or not f.begins[0]:
                ids, bound = np.concatenate([held, ids]), bound + len(held)
            starts = bound[:-1][f.begins]
            if not f.begins[0]:
                starts = np.append(0, starts)
            if f.more:
                held, ids, bound = ids[starts[-1] :], ids[: starts[-1]], starts
            else:
                held, bound = held[:0], np.append(starts, bound[-1])
            if len(bound) > 1:
                yield ids.astype("<u4"), bound

    def of_texts(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        for got, bound in self.of_column(pa.array(texts, pa.string())):
            yield from (got[x:y] for x, y in zip(bound.tolist(), bound[1:].tolist(), strict=False))


@lru_cache(maxsize=1)
def ids(name: str) -> Ids:
    """One table for each worker process, which Spark uses for many tasks."""
    return Ids(name)


KEPT.append(ids.cache_clear)
