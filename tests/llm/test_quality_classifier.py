import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from corvane.llm import quality_classifier as qc


def area(labels, scores):
    """Chance that a document labelled 1 scores above one labelled 0."""
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(scores))
    rank[order] = np.arange(1, len(scores) + 1)
    good = labels == 1
    return (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    t = pq.read_table(f"{sf}/labels.parquet").to_pydict()
    labels = dict(zip(t["doc_id"], t["quality"], strict=True))
    rows = qc.op4_quality_classifier(spark, sf).collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [(labels[r["doc_id"]], r["score"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    y, s = np.array([x[0] for x in held]), np.array([x[1] for x in held])
    assert len(y) > 500
    assert area(y, s) > 0.9
    assert np.mean((s >= 0.5) == y) > 0.85


def test_labels_of_held_out_rows_change_nothing(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - quality else quality end as quality")
    one, two = qc.train(docs, labels), qc.train(docs, flipped)
    assert np.array_equal(one[0], two[0]) and one[1] == two[1]


def test_scores_depend_on_the_text_alone(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = qc.train(docs, spark.read.parquet(f"{small}/labels.parquet"))
    text = docs.first()["text"]
    df = spark.createDataFrame([(1, text, "en"), (2, text, "xx"), (3, None, "a"), (4, "", "b"), (5, " \n", "c"), (None, "odd", "d")], "doc_id long, text string, score string")
    got = {r["doc_id"]: r["score"] for r in qc.score(df, model).collect()}
    assert got[1] == got[2]
    assert got[3] == got[4] == got[5]


def test_one_class_or_no_label(spark):
    docs = spark.createDataFrame([(k, f"text number {k}") for k in range(30)], "doc_id long, text string")
    one = spark.createDataFrame([(k, 1) for k in range(30)], "doc_id long, quality long")
    assert {r["predicted"] for r in qc.score(docs, qc.train(docs, one)).collect()} == {1}
    none = one.where("false")
    assert {r["score"] for r in qc.score(docs, qc.train(docs, none)).collect()} == {0.5}


def test_training_agrees_with_slow_descent(monkeypatch):
    """The same steps in plain loops over features and documents."""
    for name, value in (("BUCKETS", 64), ("EPOCHS", 3), ("BATCH", 4), ("WIDTH", 3)):
        monkeypatch.setattr(qc, name, value)
    rng = random.Random(8)
    texts = [" ".join(rng.choices(("good", "fine", "bad", "poor", "é"), k=rng.randint(1, 9))) for _ in range(14)]
    labels = np.array([k % 3 > 0 for k in range(14)], np.int64)
    got, bias = qc.fit(pa.array(texts, pa.string()), labels)
    share = []
    for t in texts:
        b, _ = qc.features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
        share.append({int(k): n / len(b) for k, n in Counter(b.tolist()).items()})
    draw = np.random.default_rng(7)
    vectors = (draw.uniform(-1, 1, (64, 3)) / 3).tolist()
    out = (draw.uniform(-1, 1, (3, 2)) / 3).tolist()
    base, done, steps = [0.0, 0.0], 0, 3 * 4
    for _ in range(3):
        order = draw.permutation(14).tolist()
        for at in range(0, 14, 4):
            docs = order[at : at + 4]
            rate = qc.RATE * (1 - done / steps)
            errors, means = [], []
            for d in docs:
                mean = [sum(w * vectors[b][k] for b, w in share[d].items()) for k in range(3)]
                logit = [sum(mean[k] * out[k][c] for k in range(3)) + base[c] for c in range(2)]
                p = [math.exp(x) / sum(map(math.exp, logit)) for x in logit]
                errors.append([p[c] - (labels[d] == c) for c in range(2)])
                means.append(mean)
            push = [[sum(e[c] * out[k][c] for c in range(2)) for k in range(3)] for e in errors]
            for k in range(3):
                for c in range(2):
                    out[k][c] -= rate * sum(m[k] * e[c] for m, e in zip(means, errors, strict=True))
            for c in range(2):
                base[c] -= rate * sum(e[c] for e in errors) / len(docs)
            for d, move in zip(docs, push, strict=True):
                for b, w in share[d].items():
                    for k in range(3):
                        vectors[b][k] -= rate * w * move[k] * qc.SPARSE
            done += 1
    want = [sum(v[k] * (out[k][1] - out[k][0]) for k in range(3)) for v in vectors]
    assert np.allclose(got, want, atol=2e-3)
    assert abs(bias - (base[1] - base[0])) < 2e-3


def test_word_grams_are_features_and_stay_within_texts():
    def of(*texts):
        sizes = np.cumsum([0, *(len(t) for t in texts)])
        b, r = qc.features(np.frombuffer("".join(texts).encode(), np.uint8), sizes)
        return [Counter(b[r == k].tolist()) for k in range(len(texts))]

    one, two = of("ab cd ef", "ef cd ab")
    assert one != two and sum(one.values()) == sum(two.values())
    assert of("ab cd", "ef") == of("ab cd") + of("ef")
