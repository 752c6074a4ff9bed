"""A quality classifier on supervised subword embeddings (operator 4).

Features of a document are its words, its word 2- and 3-grams, and the character 3-, 4- and 5-grams of
its words with their boundaries, hashed to ``BUCKETS`` learned vectors; the document vector is their
average and a softmax gives the two classes. Vectors and output weights are trained on the driver by
stochastic gradient descent in numpy, on a bounded sample: at most ``MOST_ROWS`` labelled documents
(those with the smallest hashes of their ids), whole. Scoring covers every whole text: the average of
vectors times the output weights is the average of one number for each bucket, so the trained model is
an array of ``BUCKETS`` floats and a bias.

Labels are read only where crc32(doc_id as text) mod 3 is not 1; scores depend on the text alone.

Defined results. Null or empty text, and text of white space only: the model's bias alone. Null doc_id:
a row with a null id, not held out. Repeated rows: one row each. Empty table: empty result; without any
label, or labels of one class, the score is the share of label 1 with one row of each class added (0.5
without labels). Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.shared import small_batches, table
from corvane.llm.vec import WHITE, column_bytes, hash_spans, mix, release, slices, word_spans

BUCKETS, WIDTH, GRAMS, WORD_GRAMS = 1 << 17, 8, (3, 4, 5), (2, 3)
MOST_ROWS, EPOCHS, RATE, BATCH = 4000, 6, 0.25, 32
RESULT = "doc_id long, held_out boolean, score double, predicted int"


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of each feature of each text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    white = WHITE[data]
    flat = np.where(white, np.uint8(32), data)
    starts, ends, row = word_spans(data, offsets)
    words = hash_spans(data, starts, ends)
    buckets, rows = [words & np.uint64(BUCKETS - 1)], [row]
    gram = words
    for n in WORD_GRAMS:  # one word longer than the last
        gram = mix(gram[: len(words) - n + 1] * np.uint64(3) + words[n - 1 :])
        one = row[: len(gram)] == row[n - 1 :]
        buckets.append(gram[one] & np.uint64(BUCKETS - 1))
        rows.append(row[: len(gram)][one])
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    lead_row = np.searchsorted(offsets, lead, "right") - 1
    gap = np.concatenate([[0], np.cumsum(white[lead])])
    for n in GRAMS:
        if len(lead) < n:
            continue
        first, last = np.arange(len(lead) - n + 1), np.arange(n - 1, len(lead))
        inner = gap[last] - gap[first + 1]  # white space only at the ends, as a boundary
        ok = (inner == 0) & (lead_row[first] == lead_row[last])
        first, last = first[ok], last[ok]
        stop = np.append(lead[1:], len(data))[last]
        buckets.append((hash_spans(flat, lead[first], stop) + np.uint64(n)) & np.uint64(BUCKETS - 1))
        rows.append(lead_row[first])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(rows)


def fit(texts: pa.Array, labels: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """A score for each bucket and a bias."""
    n = len(labels)
    if not n or labels.min() == labels.max():
        share = (labels.sum() + 1) / (n + 2)
        return np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share)))
    data, offsets = column_bytes(texts)
    buckets, counts, sizes = [], [], []
    for i, j in slices(offsets):
        b, r = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        key, many = np.unique(r * BUCKETS + b, return_counts=True)
        buckets.append((key % BUCKETS).astype(np.int32))
        total = np.bincount(r, minlength=j - i)
        counts.append((many / total[key // BUCKETS]).astype(np.float32))
        sizes.append(np.bincount(key // BUCKETS, minlength=j - i))
    bucket, share, size = map(np.concatenate, (buckets, counts, sizes))
    begin = np.concatenate([[0], np.cumsum(size)])
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (BUCKETS, WIDTH)).astype(np.float32) / WIDTH
    out = rng.uniform(-1, 1, (WIDTH, 2)).astype(np.float32) / WIDTH
    bias = np.zeros(2, np.float32)
    target = np.eye(2, dtype=np.float32)[labels]
    steps, done = EPOCHS * -(-n // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            docs = order[at : at + BATCH]
            where = np.concatenate([np.arange(begin[d], begin[d + 1]) for d in docs])
            owner = np.repeat(np.arange(len(docs)), size[docs])
            b, w = bucket[where], share[where]
            mean = np.zeros((len(docs), WIDTH), np.float32)
            for k in range(WIDTH):
                mean[:, k] = np.bincount(owner, w * vectors[b, k], len(docs))
            logit = mean @ out + bias
            p = np.exp(logit - logit.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            error = p - target[docs]
            rate = RATE * (1 - done / steps)
            push = error @ out.T  # before the output weights move
            out -= rate * mean.T @ error
            bias -= rate * error.mean(axis=0)
            np.subtract.at(vectors, b, rate * w[:, None] * push[owner] * SPARSE)
            done += 1
    turn = out[:, 1] - out[:, 0]
    return vectors @ turn, float(bias[1] - bias[0])


SPARSE = 20.0  # a bucket's share of a document is small: its vector moves by larger steps


def logits(text: pa.Array, scores: np.ndarray, bias: float) -> np.ndarray:
    data, offsets = column_bytes(text)
    out = np.full(len(text), bias)
    for i, j in slices(offsets):
        b, r = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        n = np.bincount(r, minlength=j - i)
        out[i:j] += np.bincount(r, scores[b], j - i) / np.maximum(n, 1)
    return out


def score(df: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Probability of label 1 of each text."""
    scores, bias = model
    # a broadcast of BUCKETS floats, whatever the input
    held = df.sparkSession.sparkContext.broadcast(scores.astype(np.float32))

    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            p = 1 / (1 + np.exp(-logits(b.column(2), held.value, bias)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    key = df[id_col].cast("long")
    return df.select(key.alias("doc_id"), F.coalesce(held_out(key), F.lit(False)).alias("held_out"), df[text_col].cast("string").alias("text")).mapInArrow(run, RESULT)


def held_out(key) -> F.Column:
    return F.crc32(key.cast("string")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> tuple[np.ndarray, float]:
    """Fits the model on labelled documents that aren't held out."""
    known = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = known.join(docs.select("doc_id", "text"), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label")).toArrow()
    rows = rows.take(np.argsort(rows.column("doc_id").to_numpy(), kind="stable"))
    return fit(rows.column("text").combine_chunks(), rows.column("label").to_numpy().astype(np.int64))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")))
