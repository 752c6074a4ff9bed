"""Nulls, empty and repeated rows, empty tables and clashing columns: the results that docstrings define."""

import pytest

from corvane.llm import chat_format, near_dedup, packing, quality_classifier, quality_rules, suffix_dedup, token_counts, token_files, url_filters
from corvane.llm import decontamination as dc

PROSE = " ".join(f"word{i}" for i in range(80))
ROWS = [(1, PROSE), (1, PROSE), (2, None), (3, ""), (4, " \n\t "), (None, PROSE), (None, None), (5, PROSE + " more"), (6, "<|endoftext|>"), (7, "one two")]
EXTRA = "fp h doc at row bucket base terms body rank piece length class_id rep n key id item_id score held_out chunk __id __first part value".split()


def table(spark, rows=ROWS):
    """Documents with columns that have the names of working and result columns."""
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in EXTRA))


BENCH = [dc.Benchmark([9], [PROSE])]
SCORERS = {
    "matches": lambda s, d: dc.matches(s, d, BENCH),
    "token_files": lambda s, d: token_files.read(s, token_files.write(s, d)),
    "classifier": lambda s, d: quality_classifier.score(d, quality_classifier.fit(d.select("text").toArrow().column(0).combine_chunks(), __import__("numpy").zeros(d.count(), int))),
    "packing": packing.pack,
    "near_dedup": near_dedup.classes_of,
    "counts": lambda s, d: token_counts.count(d),
    "suffix": lambda s, d: suffix_dedup.spans(d),
    "rules": lambda s, d: quality_rules.score(d),
}
#: ids of the result rows, in order
ALL = [None, None, 1, 1, 2, 3, 4, 5, 6, 7]
IDS = {
    "matches": [None, 1, 5], "token_files": ALL, "classifier": ALL, "packing": ALL, "near_dedup": [None, None, 1, 2, 3, 4, 5, 6, 7],
    "counts": ALL, "suffix": ALL, "rules": ALL,
}


@pytest.mark.parametrize("name", SCORERS)
def test_odd_rows(spark, name):
    rows = SCORERS[name](spark, table(spark)).collect()
    assert sorted((r["doc_id"] for r in rows), key=lambda x: (x is not None, x)) == IDS[name]


@pytest.mark.parametrize("name", SCORERS)
def test_empty_table(spark, name):
    assert SCORERS[name](spark, table(spark).where("false")).count() == 0


def test_repeated_rows_and_nulls_in_results(spark):
    files = token_files.read(spark, token_files.write(spark, table(spark))).collect()
    assert [r["n_tokens"] for r in files if r["doc_id"] in (2, 3)] == [1, 1]
    assert sum(r["n_tokens"] for r in files) == max(r["start"] + r["n_tokens"] for r in files)
    near = {r["doc_id"]: r["class_id"] for r in near_dedup.classes_of(spark, table(spark)).collect()}
    assert {d: c for d, c in near.items() if d} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1, 6: 6, 7: 7}
    suffix = sorted((r["doc_id"] or 0, r["n_removed"]) for r in suffix_dedup.spans(table(spark)).collect())
    size = len(PROSE)
    assert suffix == [(0, 0), (0, 0), (1, size), (1, size), (2, 0), (3, 0), (4, 0), (5, size), (6, 0), (7, 0)]


STAGES = {
    "rules": lambda s, d: quality_rules.keep(d),
    "near_dedup": near_dedup.keep,
    "suffix": lambda s, d: suffix_dedup.remove(d),
    "clean": lambda s, d: dc.clean(s, d, [dc.Benchmark([9], ["nothing like it at all in here"])]),
}
KEPT = {"rules": [None, 1, 1, 5], "near_dedup": [None, 1, 2, 3, 4, 6, 7], "suffix": [None, None, 2, 3, 4, 5, 6, 7], "clean": ALL}


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns(spark, name):
    df = table(spark)
    out = STAGES[name](spark, df)
    assert out.columns == df.columns
    rows = out.collect()
    assert sorted((r["doc_id"] for r in rows), key=lambda x: (x is not None, x)) == KEPT[name]
    assert all([r[c] for c in EXTRA] == EXTRA for r in rows)
    assert STAGES[name](spark, df.where("false")).count() == 0


def test_chat_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "x"), (None, 1, "assistant", "y"), (2, 1, "assistant", ""), (2, 1, "assistant", "z" * 100_000)]
    df = spark.createDataFrame([(*r, "c", "f") for r in rows], "conv_id long, turn long, role string, text string, chunk string, formatted string")
    got = {r["conv_id"]: r for r in chat_format.read(chat_format.write(spark, df)).collect()}
    assert {c: r["n_turns"] for c, r in got.items()} == {1: 3, None: 1, 2: 2}
    assert got[2]["loss_chars"] == 100_000 and got[None]["loss_chars"] == 1
    assert chat_format.read(chat_format.write(spark, df.where("false"))).count() == 0


def test_urls_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "r"), (1, None, "r"), (None, "http://a.org/" + "x" * 100_000, "r"), (2, "", "r")], "page_id long, url string, rule string")
    rows = url_filters.judge(df).collect()
    assert len(rows) == 4
    assert {r["rule"] for r in rows if r["page_id"] is None} == {"org/"}
    assert url_filters.judge(df.where("false")).count() == 0
