import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from brute import lcs as slow_lcs
from hypothesis import given
from hypothesis import strategies as st

from corvane.llm import decontamination as dc


@given(st.lists(st.integers(0, 5), max_size=30), st.lists(st.integers(0, 5), max_size=30))
def test_lcs(a, b):
    assert dc.lcs(a, b) == slow_lcs(a, b)


@pytest.fixture(scope="module")
def planted(spark):
    """Items in noise: whole, with words dropped, exchanged or put in; and texts with a half of one only."""
    rng = random.Random(3)
    common = [f"word{i}" for i in range(300)]
    items = [(k, " ".join(rng.choice(common) if rng.random() < 0.5 else f"rare{k}x{j}" for j in range(20 + 3 * k))) for k in range(12)]
    noise = lambda n: " ".join(rng.choice(common) for _ in range(n))
    docs, want = [], set()
    for n in range(60):
        k = n % 12
        w = items[k][1].split()
        kind = n % 5
        if kind == 0:
            said = w
        elif kind == 1:
            said = [x for x in w if rng.random() > 0.1]
        elif kind == 2:
            said = [x if rng.random() > 0.15 else "changed" for x in w]
        elif kind == 3:
            said = [y for x in w for y in ((x, "put") if rng.random() < 0.15 else (x,))]
        else:
            said = w[: len(w) // 3]
        if kind < 4:
            want.add((n, k))
        body = " ".join(said)
        docs.append((n, f"{noise(rng.randint(0, 400))} {body.upper() if n % 2 else body} {noise(rng.randint(0, 400))}"))
    docs += [(100 + n, noise(500)) for n in range(40)]
    return items, docs, want


def test_planted_paraphrases(spark, planted):
    items, docs, want = planted
    bench = dc.benchmark_of(spark.createDataFrame(items, "item_id long, text string"))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {(r["doc_id"], r["item_id"]) for r in dc.matches(spark, df, bench).collect()}
    assert got == want
    kept = {r["doc_id"] for r in dc.clean(spark, df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def slow_matches(docs, items):
    """Every window of every text against every item, in plain Python."""
    out = set()
    for k, item in items:
        a = item.lower().split()
        length = max(8, 1 << (len(a) - 1).bit_length())
        answer = a[-max(1, len(a) // 5) :]
        for d, text in docs:
            w = text.lower().split()
            for at in range(0, max(1, len(w) - length + length // 4 + 1), length // 4):
                window = w[max(0, at - length // 2) : at + length + length // 2]
                if sum((Counter(a) & Counter(window)).values()) >= 0.6 * len(a) and slow_lcs(a, window) >= 0.6 * len(a) and slow_lcs(answer, window) >= 0.5 * len(answer):
                    out.add((d, k))
                    break
    return out


def test_agrees_with_brute_force(spark, planted):
    items, docs, _ = planted
    # also items without their end, which fail by the answer, and short texts
    docs = docs + [(200 + k, " ".join(t.split()[: len(t.split()) * 7 // 10])) for k, t in items] + [(300, "a"), (301, items[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = dc.benchmark_of(spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in dc.matches(spark, df, bench).collect()} == slow_matches(docs, items)


def test_a_benchmark_in_parts_finds_the_same(spark, planted, monkeypatch):
    items, docs, want = planted
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(dc, "MOST_BYTES", 1500)
    monkeypatch.setattr(dc, "MOST_TERMS", 120)
    parts = dc.benchmark_of(rows)
    assert len(parts) > 3 and sorted(i for p in parts for i, _, _ in p.items) == [k for k, _ in items]
    assert all(p.size <= 120 or len(p.items) == 1 for p in parts)
    assert {(r["doc_id"], r["item_id"]) for r in dc.matches(spark, df, parts).collect()} == want
    assert {r["doc_id"] for r in dc.clean(spark, df, parts).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_candidate_search_loses_nothing_that_checking_every_window_finds(spark, small, docs_of, monkeypatch):
    (bench,) = dc.benchmark_of(spark.read.parquet(f"{small}/benchmark.parquet"))
    got = {(r["doc_id"], r["item_id"]) for r in dc.op1_decontamination(spark, small).collect()}
    everything = dc.Retrieval(bench, np.zeros((bench.size, 2)))
    monkeypatch.setattr(dc, "COSINE", -1.0)
    texts = [(d, t) for d, t in docs_of(small) if t]
    found = everything.search([bench.terms(dc.word_hashes(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0]) for _, t in texts])
    want = {(texts[n][0], item) for n, item, *_ in found}
    assert len(want) > 5
    assert want == got


def test_long_text_is_searched_whole(spark):
    item = " ".join(f"item{i}" for i in range(30))
    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(500)}" for _ in range(60_000)) + " " + item
    bench = dc.Benchmark([5], [item])
    rows = dc.matches(spark, spark.createDataFrame([(1, text)], "doc_id long, text string"), [bench]).collect()
    assert [(r["doc_id"], r["item_id"]) for r in rows] == [(1, 5)]
    assert rows[0]["end_word"] == 60_030


def test_answer_check(spark):
    """Two thirds of an item without its answer are no match; with it they are."""
    question, answer = [f"q{i}" for i in range(20)], [f"a{i}" for i in range(5)]
    items = spark.createDataFrame([(1, " ".join(question + answer), " ".join(answer))], "item_id long, text string, answer string")
    bench = dc.benchmark_of(items, answer_col="answer")
    df = spark.createDataFrame([(1, " ".join(question[:17])), (2, " ".join(question[:13] + answer))], "doc_id long, text string")
    assert [r["doc_id"] for r in dc.matches(spark, df, bench).collect()] == [2]


def test_empty_benchmark_and_items(spark):
    df = spark.createDataFrame([(1, "some text"), (2, None), (3, "")], "doc_id long, text string")
    assert dc.matches(spark, df, [dc.Benchmark([], [])]).count() == dc.matches(spark, df, []).count() == 0
    assert dc.clean(spark, df, [dc.Benchmark([1], [""])]).count() == 3
    bench = [dc.Benchmark([1, 2], [None, "some text here to find"])]
    assert dc.matches(spark, df.where("false"), bench).count() == 0
    assert dc.clean(spark, df, bench).count() == 3


def test_candidates_of_long_items_are_checked_in_small_parts():
    """Thousands of windows near an item of 1000 words: what is held at once doesn't grow with its length."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(150)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    bench = dc.Benchmark([1, 2], [prose(1000), prose(12)])
    find = dc.Retrieval(bench, np.random.default_rng(5).standard_normal((bench.size, 8)) + 1)
    texts = [bench.terms(dc.word_hashes(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0]) for t in [prose(16_000)] * 40]
    list(find.candidates(texts[:1]))
    tracemalloc.start()
    try:
        seen = sum(int(np.count_nonzero(item == 0)) for _, item, *_ in find.candidates(texts))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert seen >= 40 * 58  # about all windows have enough of its words
    assert peak < 60 << 20


def test_windows_hold_words_of_their_own_text_only():
    """Halves of an item at the end of one text and at the beginning of the next are no match; short texts are."""
    words = [f"q{i}" for i in range(40)]
    bench = dc.Benchmark([1, 2], [" ".join(words), " ".join(f"z{i}" for i in range(9))])
    find = dc.Retrieval(bench, np.eye(bench.size) * (np.arange(bench.size) > 0))
    term = lambda ws: bench.terms(dc.word_hashes(np.frombuffer(" ".join(ws).encode(), np.uint8), np.array([0, len(" ".join(ws))]))[0])
    texts = [term(["x"] * 50 + words[:20]), term(words[20:] + ["x"] * 50), term(words[10:]), term(["z3"]), term(words)]
    assert [(n, k) for n, k, *_ in find.search(texts)] == [(2, 1), (4, 1)]
