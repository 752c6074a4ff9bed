import random
from collections import Counter

import numpy as np
import pyarrow as pa
from brute import bag, classes, jaccard

from corvane.llm import near_dedup as nd


def as_map(df):
    return {r["doc_id"]: r["class_id"] for r in df.collect()}


def test_agrees_with_brute_force(spark, small, docs_of):
    assert as_map(nd.op7_near_dedup(spark, small)) == classes(docs_of(small))


def signature(counts, m):
    keys = sorted(counts)
    row = np.zeros(len(keys), np.int64)
    return nd.signatures(row, np.array(keys, np.uint64), np.array([counts[k] for k in keys], np.int64), 1, m)[0]


def test_registers_estimate_weighted_jaccard():
    rng = random.Random(4)
    for _ in range(6):
        a = Counter({rng.getrandbits(48): rng.choice([1, 1, 1, 2, 3, 7, 40]) for _ in range(60)})
        b = Counter({k: max(1, v + rng.choice([-1, 0, 0, 3])) for k, v in a.items() if rng.random() < 0.9})
        m = 4096
        share = np.mean(signature(a, m) == signature(b, m))
        true = jaccard(a, b)
        assert abs(share - true) < 4.5 * (true * (1 - true) / m) ** 0.5 + 1e-3


def near_copies(seed, groups, size):
    """Groups of copies with some words changed, some pairs just above and below the threshold."""
    rng = random.Random(seed)
    docs, n = [], 0
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(4000)}" for _ in range(rng.randint(30, 200))]
        for _ in range(rng.randint(1, size)):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = f"new{n}x{rng.randrange(10**6)}"
            docs.append((n, " ".join(w)))
            n += 1
    rng.shuffle(docs)
    return docs


def test_near_copies_of_all_degrees(spark):
    for seed in range(2):
        docs = near_copies(seed, 25, 12)
        got = as_map(nd.classes_of(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(6)))
        want = classes(docs)
        wrong = [d for d in want if want[d] != got[d]]
        assert not wrong, (seed, wrong)


def test_large_group_in_blocks(spark, monkeypatch):
    """Buckets cut into blocks find the same links."""
    monkeypatch.setattr(nd, "BLOCK", 7)
    docs = near_copies(5, 4, 60)
    got = as_map(nd.classes_of(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(4)))
    assert got == classes(docs)


def test_chains_link_documents_that_are_not_similar_themselves(spark):
    w = [f"w{i}" for i in range(100)]
    docs = [(10 + k, " ".join(w[3 * k : 3 * k + 70])) for k in range(9)]
    got = as_map(nd.classes_of(spark, spark.createDataFrame(docs, "doc_id long, text string")))
    assert got == classes(docs)
    assert set(got.values()) == {10}


def test_counts_matter(spark):
    """Multisets, not sets: the same shingles in other numbers are another document."""
    line = " ".join(f"w{i}" for i in range(12)) + " "
    docs = [(1, line * 2), (2, line * 30)]
    assert len(bag(docs[0][1]).keys() ^ bag(docs[1][1]).keys()) == 0
    assert as_map(nd.classes_of(spark, spark.createDataFrame(docs, "doc_id long, text string"))) == {1: 1, 2: 2}


def test_keep_returns_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(2, text, "x"), (1, text + " end", "y"), (3, "other", "z"), (3, "another", "z"), (4, None, "n"), (None, text, "q")], "doc_id long, text string, rep string")
    out = sorted((r["doc_id"], r["rep"]) for r in nd.keep(spark, df).collect())
    assert out == [(1, "y"), (3, "z"), (3, "z"), (4, "n")]


def test_ids_with_several_texts_lose_no_group(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(50)) for x in "abcd")
    rows = [(7, a), (8, a + " end"), (3, b), (7, b), (20, c), (20, "x"), (21, c), (30, d), (None, a), (None, "alone"), (None, "alone"), (None, " "), (None, None)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, key string").repartition(3)
    out = nd.classes_of(spark, df).collect()
    assert {r["doc_id"]: r["class_id"] for r in out if r["doc_id"]} == {3: 3, 7: 3, 8: 3, 20: 20, 21: 20, 30: 30}
    assert sorted(str(r["class_id"]) for r in out if r["doc_id"] is None) == ["3", "None", "None", "None", "None"]
    out = nd.keep(spark, df)
    assert out.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert got == sorted([(7, a), (3, b), (20, c), (20, "x"), (30, d), (None, "alone"), (None, " "), (None, None)], key=str)


def test_each_text_of_an_id_is_compared(spark):
    """Near copies of a text that isn't the smallest of its id."""
    a, b = (" ".join(f"{x}{i}" for i in range(50)) for x in "ab")
    df = spark.createDataFrame([(1, a), (1, b), (2, b + " end")], "doc_id long, text string")
    assert as_map(nd.classes_of(spark, df)) == {1: 1, 2: 1}
    assert sorted((r["doc_id"], r["text"]) for r in nd.keep(spark, df).collect()) == [(1, a), (1, b)]


def test_batches_of_many_short_texts():
    """More rows in an Arrow batch than 16 bits count: no document gets the shingles of another."""
    n = 100_000
    texts = pa.array([f"w{k % 50_000}" for k in range(n)], pa.string())
    got = pa.Table.from_batches(nd.signed(iter([pa.RecordBatch.from_arrays([pa.array(range(n)), texts], names=["doc_id", "text"])])))
    assert got.column("doc_id").to_pylist() == list(range(n))
    c1 = got.column("c1").to_numpy()
    assert (c1[:50_000] == c1[50_000:]).all() and len(set(c1.tolist())) == 50_000
    assert got.column("n").to_pylist() == [1] * n
