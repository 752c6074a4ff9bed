import random
import sys
from pathlib import Path

import pytest
from brute import classes, passages, quality
from test_tokens import check_packed

from corvane.llm import suffix_dedup as sd

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as cp  # noqa: E402


@pytest.fixture(scope="module")
def steps(spark, tiny):
    """Rows after each stage, by its name."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    out = {"documents": docs.collect()}
    for name, stage in cp.STAGES:
        docs = cp.written(spark, stage(spark, docs, tiny), name)
        out[name] = docs.collect()
    return out


def test_rules_drop_what_brute_force_drops(steps):
    kept = {r["doc_id"] for r in steps["quality_rules"]}
    for r in steps["documents"]:
        if len(r["text"] or "") < 12_000:
            q = quality(r["text"])
            ok = not q["base_failed"] and q["covered"] <= 0.5 * q["n_words"] and (q["longest"] < 8 or q["longest"] <= 0.35 * q["n_words"])
            assert ok == (r["doc_id"] in kept)
    assert len(kept) > 0.6 * len(steps["documents"])


def test_one_of_each_group_stays(steps):
    docs = [(r["doc_id"], r["text"]) for r in steps["quality_rules"]]
    assert {r["doc_id"] for r in steps["near_dedup"]} == set(classes(docs).values())


def test_repeated_passages_go(steps):
    docs = [(r["doc_id"], r["text"]) for r in steps["near_dedup"]]
    left = {r["doc_id"]: len((r["text"] or "").encode()) for r in steps["suffix_dedup"]}
    for doc, (size, gone, spans, _) in passages(docs).items():
        # characters cut through go as a whole
        assert size - gone - 6 * spans <= left.get(doc, 0) <= size - gone


def test_benchmark_documents_go_and_the_rest_stays(spark, steps, tiny):
    from corvane.llm import decontamination as dc

    before = {r["doc_id"] for r in steps["suffix_dedup"]}
    after = {r["doc_id"] for r in steps["decontamination"]}
    bench = dc.benchmark_of(spark.read.parquet(f"{tiny}/benchmark.parquet"))
    df = spark.createDataFrame([(r["doc_id"], r["text"]) for r in steps["suffix_dedup"]], "doc_id long, text string")
    hit = {r["doc_id"] for r in dc.matches(spark, df, bench).collect()}
    assert after == before - hit
    assert len(after) > 0.9 * len(before)


def test_sequences_hold_all_that_is_left(steps):
    bins, least = check_packed(steps["packing"], [(r["doc_id"], r["text"]) for r in steps["decontamination"]])
    assert bins <= least * 1.02 + 1


def test_run_is_the_stages_in_a_row(spark, steps, tiny):
    key = lambda rows: sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows)
    assert key(cp.run(spark, tiny).collect()) == key(steps["packing"])


def test_common_line_does_not_send_every_window(spark, tiny, monkeypatch):
    """The stage suffix_dedup over more texts with one line than a group holds; what is around it differs."""
    rng = random.Random(5)
    prose = lambda: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(14))
    line = "".join(rng.choices("ijklmnop ", k=60))
    docs = [(i, f"{prose()}\n{line}\n{prose()}") for i in range(6000)]
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
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, cp.passages(spark, df, tiny).collect())) == docs
    assert seen.value < 12_000
