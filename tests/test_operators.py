import time
from collections import Counter

import pytest
from fixtures import tsv, words

from corvane.cli import build_corpus
from corvane.lang import QueryError, parse
from corvane.operators import cache, statistics, vocabulary
from corvane.plans import indexes
from corvane.streaming import ingest


def test_vocabulary(spark, tmp_path):
    c = words(spark, tmp_path, "v", "b å a b Z pa på | a")
    rows = {r["value"]: (r["symbol"], r["freq"]) for r in vocabulary.vocabulary(c, ["word"]).collect()}
    assert rows == {"": (0, 0), "Z": (1, 1), "a": (2, 2), "b": (3, 2), "pa": (4, 1), "på": (5, 1), "å": (6, 1)}
    assert vocabulary.info([c]).collect()[0][1:] == (8, 2)


def test_groups_over_the_whole_span(spark, tmp_path):
    c = words(spark, tmp_path, "g", "a x a y a x | a z x a")
    out = statistics.count([c], parse('[word="a"] []'), ["word"])
    rows = [(r["value"], r["absolute"]) for r in statistics.top(out["corpora"]["g"], 0).collect()]
    assert rows == [([["a", "x"]], 2), ([["a", "y"]], 1), ([["a", "z"]], 1)]
    r = statistics.top(out["combined"], 1).first()
    assert r["relative"] == pytest.approx(1e6 * 2 / 10)
    across = statistics.count([c], parse('[word="x"] []', sentence_breaks=False), ["word"])
    assert Counter({tuple(r["value"][0]): r["absolute"] for r in across["combined"].collect()}) == {("x", "a"): 3}


def test_sampling_takes_every_step(spark, tmp_path):
    c = words(spark, tmp_path, "s", " ".join(f"a{k}" for k in range(20)))
    for sampling, step in ((20, 2), (21, 1), (7, 3), (0, 1)):
        out = statistics.count([c], parse('[word="a.*"]'), ["word"], sampling=sampling)
        got = sorted(r["value"][0][0] for r in out["corpora"]["s"].collect())
        assert got == sorted(f"a{k}" for k in range(0, 20, step)), sampling
        assert out["sums"]["s"] == {"total": 20, "sampled": -(-20 // step), "size": 20}
    assert statistics.sums_row({"total": 20, "sampled": 7, "size": 20})["absolute"] == 7


def test_nothing_found(spark, tmp_path):
    c = words(spark, tmp_path, "n", "a b")
    out = statistics.count([c], parse('[word="q"]'), ["word"], sampling=5)
    assert out["combined"].count() == 0 and statistics.sums_row(out["combined_sums"])["relative"] == 0


def test_pivot(spark, tmp_path):
    one, two = words(spark, tmp_path, "one", "a b a"), words(spark, tmp_path, "two", "b b c")
    out = statistics.count([one, two], parse('[word=".*"]'), ["word"])
    rows = {r["value"][0][0]: (r["one"], r["two"], r["total"]) for r in statistics.pivot(out["all"], ["one", "two"]).collect()}
    assert rows == {"a": (2, 0, 2), "b": (1, 2, 3), "c": (0, 1, 1)}


def test_templates():
    t = indexes.Template.parse("pos:0+pos:1+s:1#s")
    assert str(t) == "pos:0+pos:1+s:1#s" and t.shown() == '[?pos][?pos|s≠"s"]' and t.max_offset == 1
    made = [str(x) for x in indexes.templates(["word", "pos", "s", "word_reversed"], 2)]
    assert made[:4] == ["s:0", "word:0", "pos:0", "word_reversed:0"]
    assert len(made) == 4 + 2 * 4 and "pos:0+word:2+s:1#s+s:2#s" in made
    for bad in ("", "pos", "pos:1", "a:0+b:1+c:2"):
        with pytest.raises(QueryError):
            indexes.Template.parse(bad)
    assert indexes.literal_of("pos:2#X", 1)[0] == 3


def test_postings(spark, tmp_path):
    rows = [("a", "X"), ("b", ""), ("a", "X"), None, ("a", "Y"), ("b", "X")]
    c = build_corpus(spark, f"file://{tmp_path}", tsv(tmp_path / "i.tsv", ["word", "pos"], rows))
    pairs = lambda t, m=0: sorted(tuple(r) for r in indexes.postings(c, indexes.Template.parse(t), m).drop("sent").collect())
    assert pairs("pos:0") == [("X", 0), ("X", 2), ("X", 4), ("Y", 3)]
    assert pairs("word:0+word:1+s:1#s") == [("a", "b", 0), ("a", "b", 3), ("b", "a", 1)]
    assert pairs("word:0+word:1") == [("a", "a", 2), ("a", "b", 0), ("a", "b", 3), ("b", "a", 1)]
    assert pairs("word:0+pos:1+s:1#s") == [("a", "X", 3), ("b", "X", 1)]
    assert pairs("word:0+pos:1+s:1#s", 3) == [("a", "X", 3)]
    assert pairs("word:0+pos:1+s:1#s", 4) == []
    built = indexes.build(spark, f"file://{tmp_path}", c, indexes.Template.parse("word:0"))
    assert indexes.summary(built).where("v1 = 'a'").first()[1:] == (3, 0, 3)
    assert {(r["sent"], r["at"]) for r in built.collect()} == {(1, 0), (1, 1), (1, 2), (2, 3), (2, 4)}
    value = lambda t, k: indexes.value_at(c, indexes.Template.parse(t), k)
    assert [value("word:0+word:1+s:1#s", k) for k in range(5)] == [("a", "b"), ("b", "a"), None, ("a", "b"), None]
    assert value("word:0+word:1", 2) == ("a", "a") and value("pos:0", 1) is None
    assert indexes.sanity(c) == {"word@0": {"missing_rows": 0, "extra_rows": 0}}
    c.indexes["word@0"] = built.where("at > 0").union(built.where("at = 4").limit(1)).withMetadata("at", {"min_frequency": 0})
    assert indexes.sanity(c) == {"word@0": {"missing_rows": 1, "extra_rows": 1}}
    assert vocabulary.sanity(c) == {"wrong_symbols": 0, "uncounted_tokens": 0}


def test_cache(spark, tmp_path):
    c = words(spark, tmp_path, "k", "a b a")
    folder = f"file://{tmp_path}/cache"
    q = parse('[word="a"]')
    for _ in range(2):
        assert sorted(r["at"] for r in cache.cached(spark, folder, c, q).collect()) == [0, 2]
    cache.cached(spark, folder, c, parse('[word="b"]'))
    assert cache.key(c, q) != cache.key(c, parse('[word="a"]', sentence_breaks=False))
    assert cache.trim(spark, folder, 100) == []
    assert len(cache.trim(spark, folder, 0)) == 2
    assert cache.trim(spark, f"{folder}/none") == []


def test_what_was_used_last_stays(spark, tmp_path):
    c = words(spark, tmp_path, "u", "a b a")
    folder = f"file://{tmp_path}/used"
    one, two = parse('[word="a"]'), parse('[word="b"]')
    for q in (one, two, one):
        cache.cached(spark, folder, c, q)
        time.sleep(0.05)
    assert cache.trim(spark, folder, 0.001)[0] == cache.key(c, two) + ".hits"


def test_streaming_ingest(spark, tmp_path):
    source, kind = tmp_path / "in", "part long, line long, f_word array<string>"
    spark.createDataFrame([(0, 0, ["a", "b"]), (0, 1, ["c"])], kind).coalesce(1).write.parquet(f"{source}/one")
    stream = lambda: spark.readStream.schema(kind).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(source))
    where = f"file://{tmp_path}/stream"
    ingest.start(stream(), where, ["word"], f"{tmp_path}/mark").awaitTermination()
    spark.createDataFrame([(0, 0, ["d", "a"])], kind).coalesce(1).write.parquet(f"{source}/two")
    ingest.start(stream(), where, ["word"], f"{tmp_path}/mark").awaitTermination()
    c = ingest.opened(spark, where, "live", ["word"])
    assert [(r["at"], r["sent"], r["f_word"]) for r in c.tokens.orderBy("at").collect()] == [(0, 1, "a"), (1, 1, "b"), (2, 2, "c"), (3, 3, "d"), (4, 3, "a")]


def test_cached_results_of_less_are_not_used(spark, tmp_path):
    source, kind = tmp_path / "in", "part long, line long, f_word array<string>"
    where, folder = f"file://{tmp_path}/stream", f"file://{tmp_path}/cache"
    found = []
    for k in range(2):
        spark.createDataFrame([(0, k, ["a"])], kind).coalesce(1).write.parquet(f"{source}/{k}")
        stream = spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(str(source))
        ingest.start(stream, where, ["word"], f"{tmp_path}/mark").awaitTermination()
        c = ingest.opened(spark, where, "live", ["word"])
        found.append(sorted(r["at"] for r in cache.cached(spark, folder, c, parse('[word="a"]')).collect()))
    assert found == [[0], [0, 1]]
