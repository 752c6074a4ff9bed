"""Plain Python versions of the operators, slow and obvious."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def quality(text, min_repeat=8):
    """Counts of operator 10, with covered words and the longest repeat by trying all windows."""
    w = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    out = {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": dup,
        "n_repeat_words": len(repeated(w, 3)),
        "covered": len(repeated(w, min_repeat)),
    }
    longest = 0
    while repeated(w, longest + 1):
        longest += 1
    out["longest"] = longest
    out["base_failed"] = len(w) < 50 or 100 * out["n_repeat_words"] > 50 * len(w)
    return out


def repeated(w, n):
    """Places of words in windows of ``n`` words that come twice or more."""
    at = defaultdict(list)
    for i in range(len(w) - n + 1):
        at[tuple(w[i : i + n])].append(i)
    return {i + k for places in at.values() if len(places) > 1 for i in places for k in range(n)}


def passages(docs, length=100):
    """Result rows of operator 9 of (doc_id, text), each id once."""
    seen, out = set(), {}
    for doc, text in sorted(docs):
        body = (text or "").encode()
        gone = bytearray(len(body))
        for i in range(len(body) - length + 1):
            s = body[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(s)
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(b for b, g in zip(body, gone, strict=True) if not g)
        out[doc] = (len(body), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def bag(text, n=5):
    w = words(text)
    if not w:
        return Counter()
    return Counter(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def jaccard(a, b):
    shared = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - shared
    return shared / total if total else 0.0


def classes(docs, threshold=0.8):
    """doc_id to the smallest id of its component, over all pairs that share a shingle."""
    bags = {d: bag(t) for d, t in docs}
    parent = {d: d for d in bags}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kinds, holders = {}, defaultdict(list)
    for d, b in sorted(bags.items()):
        if b:
            key = frozenset(b.items())
            if key in kinds:
                parent[d] = kinds[key]
            else:
                kinds[key] = d
                for s in b:
                    holders[s].append(d)
    done = set()
    for group in holders.values():
        for i, x in enumerate(group):
            for y in group[i + 1 :]:
                if (x, y) not in done:
                    done.add((x, y))
                    if jaccard(bags[x], bags[y]) >= threshold:
                        a, b = sorted((find(x), find(y)))
                        parent[b] = a
    return {d: find(d) for d in bags}


def chat(turns):
    """Result rows of operator 3 of (conv_id, turn, role, text)."""
    out = defaultdict(lambda: ["", ""])
    n = Counter()
    for conv, turn, role, text in sorted(turns, key=lambda r: (r[0], r[1])):
        n[conv] += 1
        out[conv][0] += f"{role}\n{text or ''}\n"
        if role == "assistant":
            out[conv][1] += text or ""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {c: (n[c], sha(a), len(b), sha(b)) for c, (a, b) in out.items()}


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]
