import pyarrow as pa
from brute import quality
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm.quality_rules import keep, measure, op10_quality_rules


def expect(row, text):
    want = quality(text)
    for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"):
        assert row[k] == want[k], (k, text)
    assert round(row["repeat_fraction"] * max(row["n_words"], 1)) == want["covered"]
    if want["longest"] >= 3:
        assert row["longest_repeat"] == want["longest"]
    assert row["kept"] == (not want["base_failed"] and row["repeat_fraction"] <= 0.5 and row["longest_repeat"] <= 0.35 * row["n_words"])


def test_agrees_with_brute_force(spark, tiny, docs_of):
    texts = dict(docs_of(tiny))
    rows = op10_quality_rules(spark, tiny).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        if len(texts[r["doc_id"]] or "") < 12_000:
            expect(r.asDict(), texts[r["doc_id"]])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t#é  ", max_size=300), min_size=1, max_size=4))
def test_small_alphabets(texts):
    got = measure(pa.array(texts))
    for i, t in enumerate(texts):
        expect({k: v[i].item() for k, v in got.items()}, t)


def test_long_repeats_fail_and_clean_texts_stay(spark):
    prose = " ".join(f"w{i}" for i in range(400))
    block = " ".join(f"x{i}" for i in range(60))
    looped = " ".join([prose[:200]] + [f"{block} y{i}" for i in range(4)])
    df = spark.createDataFrame([(1, prose, "a"), (2, looped, "b"), (3, None, "c"), (4, "", "d"), (5, "tick " * 20_000, "e")], "doc_id long, text string, kept string")
    out = keep(df).collect()
    assert [r["doc_id"] for r in out] == [1]
    assert out[0]["kept"] == "a"


def test_long_text():
    text = " ".join(f"w{i % 50_021}" for i in range(200_000))
    got = measure(pa.array([text]))
    assert got["n_words"][0] == 200_000
    assert got["longest_repeat"][0] == 200_000 - 50_021
