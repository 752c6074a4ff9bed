import random

import numpy as np
from brute import passages

from corvane.llm import suffix_dedup as sd


def as_rows(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


def test_agrees_with_brute_force(spark, tiny, docs_of):
    assert as_rows(sd.op9_suffix_dedup(spark, tiny)) == passages(docs_of(tiny))


def random_docs(seed, n):
    """Texts with shared passages, overlapping copies, loops and cuts within characters."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7)))
    pool = [" ".join(word() for _ in range(rng.randint(15, 60))) for _ in range(8)]
    out = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            p = rng.choice(pool) if rng.random() < 0.6 else " ".join(word() for _ in range(20))
            parts.append(p[rng.randint(0, 30) :] if rng.random() < 0.5 else p)
        if rng.random() < 0.15:
            parts.append(rng.choice(["a", "ab", "abcab "]) * rng.randint(30, 150))
        out.append((i * 3 + 1, "".join(parts)))
    return out


def test_overlaps_loops_and_shared_passages(spark):
    for seed in range(3):
        docs = random_docs(seed, 60)
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
        assert as_rows(sd.spans(df)) == passages(docs), seed


def test_anchors_in_several_groups(spark, monkeypatch):
    """The same by window content and in two rounds, as for anchors with very many runs."""
    monkeypatch.setattr(sd, "GROUP", 2)
    monkeypatch.setattr(sd, "PART", 1 << 10)
    monkeypatch.setattr(sd, "SLAB", 1 << 11)
    docs = random_docs(9, 60)
    assert as_rows(sd.spans(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))) == passages(docs)


def test_common_lines_amid_other_text(spark, monkeypatch):
    """Anchors with more than GROUP runs: only parts whose core comes again meet with their bytes."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(3, 9)))
    lines = [("".join(rng.choices("ijklmnop ", k=n))) for n in (60, 95, 99, 140)]
    docs = []
    for i in range(2600):
        before, after = (" ".join(word() for _ in range(14)) for _ in range(2))
        # at times texts go on alike beside the line
        before, after = (before[:-30] + "x" * 30 if i % 5 == 0 else before), ("y" * 45 + after if i % 7 == 0 else after)
        docs.append((i, f"{before}\n{lines[i % 400 if i % 400 in (1, 2, 3) else 0]}\n{after}"))
    for i in range(2600):
        docs.append((2600 + i, f"{word()} {word()} {word()}{lines[1 if i < 2300 else 2 + i % 2]}{word()} {word()}"))
    seen, real = spark.sparkContext.accumulator(0), sd.by_suffix

    def counted(last):
        inner = real(last)

        def run(batches):
            def each():
                for b in batches:
                    seen.add(b.num_rows)
                    yield b

            yield from inner(each())

        return run

    monkeypatch.setattr(sd, "by_suffix", counted)
    assert as_rows(sd.spans(spark.createDataFrame(docs, "doc_id long, text string").repartition(6))) == passages(docs)
    assert 0 < seen.value < 60_000


def test_lpf_array_agrees_with_brute_force():
    rng = random.Random(3)
    for letters in ("a", "ab", "abc", "abcdefgh"):
        text = bytes(rng.choice(letters.encode()) for _ in range(400))
        text = text + text[50:230] + text[:150]
        windows = np.array(sorted(rng.sample(range(len(text) - 99), 200)))
        position = np.array(rng.sample(range(1000), 200))
        got = sd.lpf_array(np.frombuffer(text, np.uint8), windows, position)

        def common(i, j):
            return next((k for k in range(100) if text[i + k] != text[j + k]), 100)

        want = [max((common(w, v) for v, q in zip(windows, position, strict=True) if q < p), default=0) for w, p in zip(windows, position, strict=True)]
        assert got.tolist() == want
        assert 100 in want


def test_nearest_smaller():
    rng = random.Random(5)
    for n in (1, 2, 3, 17, 64, 100):
        p = rng.sample(range(1000), n)
        want = [max((j for j in range(i) if p[j] < p[i]), default=-1) for i in range(n)]
        assert sd.nearest_smaller(np.array(p)).tolist() == want


def test_equal_hashes_are_not_enough():
    """Spans that meet by their keys and differ in a byte are no repeats."""
    data = np.frombuffer(b"x" * 150 + b"x" * 149 + b"y" + b"x" * 150, np.uint8)
    key = np.zeros(3, np.uint64)
    place = np.array([0, 150, 300])
    got = sd.repeats(data, [key, key], np.arange(3), place, place, np.full(3, 150))
    assert got.tolist() == [False, False, True]


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(sd, "PIECE", 1 << 11)
    docs = [(k, " ".join(random.Random(k % 2).choices("alpha beta gamma delta epsilon zeta".split(), k=1500))) for k in range(3)]
    assert as_rows(sd.spans(spark.createDataFrame(docs, "doc_id long, text string"))) == passages(docs)


def test_many_equal_documents(spark):
    text = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(i, text + ("" if i % 2 else f" tail {i}")) for i in range(2000)], "doc_id long, text string").repartition(8)
    rows = as_rows(sd.spans(df))
    assert rows[0][1] == 0
    assert all(rows[i][1] >= len(text) for i in range(1, 2000))


def test_remove_keeps_columns_and_drops_emptied_rows(spark):
    text = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(1, text, 5), (2, text, 6), (3, "before " + text + " after", 7), (4, None, 8), (None, text, 9)], "doc_id long, text string, h long")
    out = {r["doc_id"]: r for r in sd.remove(df).collect()}
    # rows without an id come first
    assert set(out) == {None, 3, 4}
    assert out[None]["text"] == text and out[None]["h"] == 9
    assert out[3]["text"] == "before  after" and out[3]["h"] == 7
    assert out[4]["text"] is None
    plain = {r["doc_id"]: r["text"] for r in sd.remove(df.where("doc_id is not null")).collect()}
    assert plain == {1: text, 3: "before  after", 4: None}


def test_each_row_is_a_document(spark):
    one, two = (" ".join(f"{x}{i}" for i in range(60)) for x in ("word", "other"))
    rows = [(1, one, 1), (2, one, 2), (2, "unlike", 3), (3, "before " + two, 4), (3, two + " after", 5), (3, two + " after", 6), (4, None, 7), (4, two, 8), (None, "x" + one, 9), (None, None, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(3)
    got = {r["n"]: (r["doc_id"], r["text"]) for r in sd.remove(df).collect()}
    # the space before the second text is not in the first: only what repeats goes; of two equal rows one stays
    left = got.pop(5, None) or got.pop(6)
    assert left == (3, " after")
    assert got == {3: (2, "unlike"), 4: (3, "before " + two), 7: (4, None), 9: (None, "x" + one), 10: (None, None)}
    ids = sorted((r["doc_id"] for r in sd.spans(df).collect()), key=lambda x: (x is not None, x))
    assert ids == [None, None, 1, 2, 2, 3, 3, 3, 4, 4]


def test_random_rows_with_repeated_ids(spark):
    docs = [(d % 7, t) for d, t in random_docs(11, 40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in sd.spans(df).collect())
    want = passages(list(enumerate(t for _, t in sorted(docs))))
    assert got == sorted((d, *want[k]) for k, (d, _) in enumerate(sorted(docs)))
