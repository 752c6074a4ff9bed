"""What is shuffled as tables grow: plans with broadcasts by size switched off."""

from contextlib import contextmanager
from dataclasses import replace

import pytest

from corvane import catalog_queries as cq
from corvane.lang import parse
from corvane.operators import statistics
from corvane.plans import hits, indexes
from corvane.sources.corpus import Corpus, sanity, tokens_of, violations
from corvane.sources.tables import KINDS, corpus


@contextmanager
def large(spark):
    """Every table counts as too large to broadcast, unless the code says that it isn't."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield lambda df: df._jdf.queryExecution().executedPlan().toString()
    spark.conf.set(key, before)


@pytest.fixture
def hand_made(spark):
    """Sentences of one to three tokens."""
    rows = [["the"], ["a", "the"], ["a"], ["x"], ["the", "a", "the"], ["b", "a", "x"], ["the"]]
    starts = [sum(map(len, rows[:k])) for k in range(len(rows))]
    sentences = spark.createDataFrame([(k + 1, s, len(r), r) for k, (s, r) in enumerate(zip(starts, rows, strict=True))], "sent long, sent_start long, n int, f_word array<string>")
    out = Corpus("hand", tokens_of(sentences, ["word"]), sentences, ["word"])
    return out, [w for r in rows for w in r], [k + 1 for k, r in enumerate(rows) for _ in r]


@pytest.mark.parametrize("name", ["docs", "events", "orders"])
def test_f3_f5_rows_are_shuffled_once_before_they_become_arrays(spark, tiny, name):
    with large(spark) as plan_of:
        plan = plan_of(KINDS[name](spark, tiny)[0])
    assert "SortMergeJoin" not in plan and plan.count("Exchange rangepartitioning") == 1


def test_f2_turns_are_shuffled_once_before_they_become_arrays(spark, tiny):
    with large(spark) as plan_of:
        plan = plan_of(KINDS["chat"](spark, tiny)[0])
    assert "SortMergeJoin" not in plan and plan.count("Exchange rangepartitioning") == 1


def test_f3_f5_stored_in_order_each_token_once(spark, tiny):
    c = corpus(spark, tiny)
    assert not any(sanity(c).values())
    for part in c.sentences.select("sent").rdd.glom().collect():
        assert [r[0] for r in part] == sorted(r[0] for r in part)


def test_f1_index_is_built_without_a_shuffle(spark, tiny):
    c = replace(corpus(spark, tiny), indexes={})
    with large(spark) as plan_of:
        assert "Exchange" not in plan_of(indexes.ordered(c, indexes.Template.parse("lemma:0+word:1+s:1#s")))


@pytest.mark.parametrize("text", ['[word="the"] [word="a"]', '[word="the"] [] [word="a"]', '[] [word="a"] []', '[word!="x"] [word="the"] [] []'])
def test_f4_over_breaks_only_starts_next_to_a_break_meet(spark, hand_made, text):
    c, words, sents = hand_made
    query = parse(text, False)
    want = [k for k in range(len(words) - query.length + 1) if all(not t.alternatives or (words[k + j] == t.literals[0].value) != t.literals[0].negative for j, t in enumerate(query.tokens))]
    found = hits.find(c, query)
    assert sorted(map(tuple, found.collect())) == [(sents[k], k) for k in want]
    rows = statistics.values(c, query, found, ["word"]).collect()
    assert sorted((r["at"], r["value"][0]) for r in rows) == [(k, words[k : k + query.length]) for k in want]
    with large(spark) as plan_of:
        assert "SortMergeJoin" not in plan_of(found)


@pytest.mark.parametrize("d", [1, 2, 4])
def test_f4_pairs_over_breaks(spark, hand_made, d):
    c, words, sents = hand_made
    got = indexes.postings(c, indexes.Template.parse(f"word:0+word:{d}")).collect()
    assert sorted((r["v1"], r["v2"], r["sent"], r["at"]) for r in got) == sorted((words[k], words[k + d], sents[k], k) for k in range(len(words) - d))


def test_f6_positions_are_counted_by_words_of_64(spark, hand_made):
    c, words, _ = hand_made
    with large(spark) as plan_of:
        assert "distinct" not in plan_of(violations(c)).lower()
    assert not any(sanity(c).values())
    more = replace(c, tokens=c.tokens.union(c.tokens.where("at in (3, 5)")).where("at != 7").replace("b", None))
    assert sanity(more) == {"repeated_positions": 2, "missing_positions": -1, "wrong_starts": 0, "null_values": 1}


def test_f7_pairs_are_not_shuffled_to_find_the_frequent(spark, tiny):
    t = indexes.Template.parse("word:0+word:1+s:1#s")
    with large(spark) as plan_of:
        assert "SortMergeJoin" not in plan_of(indexes.postings(corpus(spark, tiny), t, min_frequency=50))
    assert cq.binary_min_frequency(spark, tiny).where("n < 1").isEmpty()
