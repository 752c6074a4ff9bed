import random
import re

import pytest
from fixtures import tsv, words

from corvane.cli import build_corpus, build_indexes
from corvane.lang import QueryError, parse
from corvane.operators import search
from corvane.plans import indexes
from corvane.plans.hits import find
from corvane.sources.corpus import open_corpus


def at(corpus, text, plan=None, mode="chars", **options):
    rows = find(corpus, parse(text, **options), plan, mode).collect()
    got = sorted(r["at"] for r in rows)
    assert len(set(got)) == len(got)
    return got


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return tmp_path_factory.mktemp("corpora")


def test_each_word_at_its_place(spark, folder):
    rows = [("This", "PRON"), ("is", "AUX"), ("a", "DET"), ("test", "NOUN")]
    c = build_corpus(spark, f"file://{folder}", tsv(folder / "basic.tsv", ["word", "pos"], rows))
    for k, (w, p) in enumerate(rows):
        assert at(c, f'[word="{w}"]') == [k] == at(c, f'[pos="{p}" & word="{w}"]')
    assert at(c, '[word="this"]') == []
    assert c.size == (4, 1)


def test_needle(spark, folder):
    c = words(spark, folder, "needle", " ".join([*"0123456789", *["needle"] * 4, *"0123456789"]))
    assert at(c, '[word="needle"] [word="needle"] [word="needle"] [word="needle"]') == [10]
    assert at(c, '[word="needle"] [word="needle"]') == [10, 11, 12]


@pytest.mark.parametrize(
    ("text", "query", "want"),
    [
        ("aba abba abbba b abbbba", '[word="a.*"] [word="b"]', [2]),
        ("a aa aaa ba b", '[word=".*a"]', [0, 1, 2, 3]),
        ("a aa aaa ab b", '[word="a.*"]', [0, 1, 2, 3]),
        ("aa aaa aba ab b", '[word="a.*a"]', [0, 1, 2]),
        ("a b c d e", '[word=".*"]', [0, 1, 2, 3, 4]),
        ("ma de de ax bca da a a exas", '[word="d.*"] [word="a.*"]', [2, 5]),
        ("a b | c d | e", '[word="b"] [word="c"]', []),
        ("a b | c d | e", '[word="d"] []', []),
        ("a b | c d | e", '[word="c"] []', [2]),
        ("a b | c d | e", '[] [word="d"]', [2]),
        ("a b | c d | e", '[s="s" & word!="a"]', [2, 4]),
    ],
)
def test_affixes_and_sentences(spark, tmp_path, text, query, want):
    c = words(spark, tmp_path, "affix", text)
    for plan in (None, "arrays", "window", "joins"):
        assert at(c, query, plan) == want, plan


def test_regex_modes(spark, folder):
    c = words(spark, folder, "modes", "pa på påå p.")
    assert at(c, '[word="p."]') == [0, 1, 3]
    assert at(c, '[word="p."]', mode="bytes") == [0, 3]
    assert at(c, '[word="p.."]', mode="bytes") == [1]


def slow(rows, text, breaks):
    """Hits of a pattern over (word, tag, sentence), token by token."""
    q = parse(text, breaks)
    test = {"exact": str.__eq__, "prefix": str.startswith, "suffix": str.endswith, "regex": lambda v, p: v != "" and re.fullmatch(p, v) is not None}
    out = []
    for i in range(len(rows) - q.length + 1):
        span = rows[i : i + q.length]
        if breaks and span[0][2] != span[-1][2]:
            continue
        ok = True
        for (w, p, _), t in zip(span, q.tokens, strict=True):
            value = {"word": w, "pos": p}
            alts = [all(test[x.kind](value[x.feature], x.value) != x.negative for x in a) for a in t.alternatives]
            ok &= not alts or any(alts)
        if ok:
            out.append(i)
    return out


QUERIES = [
    '[word="ab"] [pos="X"]', '[word="a.*"] [] [word=".*b"]', '[word="ab" | pos="Y"] [word!="ab"]', '[pos!="X"] [word="b.*" & pos!="Y" | word="aa"]',
    '[] [] [word="ab"]', '[word="ab"] [] []', '[word="[ab]+b"] [pos="X|Y"]', '[word="ab"] [word="ab"] [word="ab"]', '[] [word="ab"] [pos!="X"] []',
]


@pytest.fixture(scope="module")
def random_corpus(spark, folder):
    rng = random.Random(5)
    rows, lines = [], []
    for s in range(60):
        lines.append(None)
        for _ in range(rng.randint(1, 7)):
            w, p = "".join(rng.choices("ab", k=rng.randint(1, 3))), rng.choice("XYZ")
            rows.append((w, p, s))
            lines.append((w, p))
    c = build_corpus(spark, f"file://{folder}", tsv(folder / "random.tsv", ["word", "pos"], lines))
    return c, rows


@pytest.mark.parametrize("breaks", [True, False])
def test_all_plans_agree_with_token_by_token(random_corpus, breaks):
    c, rows = random_corpus
    for q in QUERIES:
        want = slow(rows, q, breaks)
        for plan in ("arrays", "window", "joins"):
            assert at(c, q, plan, sentence_breaks=breaks) == want, (q, plan)


def test_indexes_change_nothing(spark, folder, random_corpus):
    c, rows = random_corpus
    build_indexes(spark, f"file://{folder}", c, ["word", "pos"])
    try:
        assert indexes.covering(c, parse('[word="ab"] [pos="X"]')) is not None
        assert indexes.covering(c, parse('[word="ab"] [] [pos="X"]')) is not None
        assert indexes.covering(c, parse('[word="ab"] [pos="X"] [word="b.*"]')) is not None
        for q in ('[word="ab"] []', '[] [word="ab"]', '[word="ab" | word="b"]', '[word="ab"] [pos!="X"]', '[word="a.b"]', '[word="ab" & pos="X"]'):
            assert indexes.covering(c, parse(q)) is None
        plan = indexes.covering(c, parse('[word="ab"] [pos="X"]'))._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "f_word" not in plan
        for breaks in (True, False):
            for q in QUERIES:
                assert at(c, q, sentence_breaks=breaks) == slow(rows, q, breaks) == at(c, q, "joins", sentence_breaks=breaks), (q, breaks)
    finally:
        c.indexes.clear()


def test_an_index_of_frequent_values_changes_nothing(spark, folder):
    lines = ["a b", "a b", "a b", "b a", "rare b", "a ab", "a bc", "rare a", "x b a"]
    words(spark, folder, "often", "|".join(lines))
    c = open_corpus(spark, f"file://{folder}", "often")
    build_indexes(spark, f"file://{folder}", c, ["word"], min_frequency=3)
    c = open_corpus(spark, f"file://{folder}", "often")
    pair = indexes.Template.parse("word:0+word:1+s:1#s")
    assert indexes.frequency_of(c.indexes["word@0+word@1+s@1#s"]) == 3
    assert {tuple(r) for r in c.indexes["word@0+word@1+s@1#s"].select("v1", "v2").collect()} == {("a", "b"), ("b", "a")}
    for q in ('[word="rare"] [word="b"]', '[word="rare"] [word="a"]', '[word="a"] [word="b.*"]', '[word="a"] [word="a.*"]', '[word="a"] [word="b"]', '[word="x"] [] [word="a"]', '[word="b"] [word="b"]'):
        for breaks in (True, False):
            want = at(c, q, "joins", sentence_breaks=breaks)
            assert at(c, q, sentence_breaks=breaks) == want, (q, breaks)
        assert at(c, q, "joins") == at(c, q, "arrays") == at(c, q), q
    assert at(c, '[word="rare"] [word="b"]') == [8]
    assert at(c, '[word="a"] [word="b.*"]') == [0, 2, 4, 12]
    only = lambda t: open_corpus(spark, f"file://{folder}", "often").indexes[t]
    c.indexes = {str(pair).replace(":", "@"): only("word@0+word@1+s@1#s")}
    covered = lambda q: indexes.covering(c, parse(q)) is not None
    assert covered('[word="a"] [word="b"]')
    assert not covered('[word="rare"] [word="b"]') and not covered('[word="a"] [word="b.*"]')
    # an index stored without its minimal frequency may lack any pair
    c.indexes = {k: v.select("v1", "v2", "sent", (v["at"] + 0).alias("at")) for k, v in c.indexes.items()}
    assert not covered('[word="a"] [word="b"]') and at(c, '[word="a"] [word="b"]') == [0, 2, 4]


def test_pages_run_over_corpora(spark, folder):
    one, two = words(spark, folder, "pageone", "x a x a x"), words(spark, folder, "pagetwo", "a x a x a")
    found = search.hits([one, two], parse('[word="x"]'))
    assert search.counts(found, [one, two]) == {"pageone": 3, "pagetwo": 2}
    got = lambda **k: [(r["corpus"], r["at"]) for r in search.page(found, **k).collect()]
    assert got(start=1, num=3) == [("pageone", 2), ("pageone", 4), ("pagetwo", 1)]
    assert got(start=2, end=3) == [("pageone", 4), ("pagetwo", 1)]
    assert got(start=0, end=-1, num=2) == [("pageone", 0), ("pageone", 2)]
    assert got(start=9) == []


def test_kwic_rows(spark, folder):
    rows = [("This", "PRON"), ("is", "AUX"), None, ("A", "DET"), ("test", "NOUN"), (".", "PUNCT")]
    c = build_corpus(spark, f"file://{folder}", tsv(folder / "lines.tsv", ["word", "pos"], rows))
    (r,) = search.kwic([c], parse('[pos="DET"] []')).collect()
    assert (r["corpus"], r["sentence"], tuple(r["match"])) == ("lines", 2, (0, 2, 2))
    assert r["tokens"] == [{"word": w, "pos": p} for w, p in rows[3:]]
    assert search.line(r) == "[2:2] { A/DET test/NOUN } ./PUNCT"
    (r,) = search.kwic([c], parse('[word="is"]'), show=["pos"]).collect()
    assert r["tokens"] == [{"word": "This", "pos": "PRON"}, {"word": "is", "pos": "AUX"}]
    assert search.context(c, 2) == "A test ."
    assert search.context(c, 2, before=1, match=(2, 2)) == "This is\n{ A test } ."
    assert search.context(c, 1, "pos", after=5, match=(1, 1)) == "PRON { AUX }\nDET NOUN PUNCT"
    found = search.hits([c], parse('[word=".*"]'))
    assert search.preview(found, 3) == "{0, 1, 2, ...}" and search.preview(found, 5) == "{0, 1, 2, 3, 4}"
    with pytest.raises(QueryError):
        search.kwic([c], parse('[word="is"]'), show=["lemma"])
    with pytest.raises(QueryError):
        find(c, parse('[lemma="is"]'))
    assert [r["sent"] for r in search.in_sentences(c, parse('[pos!="DET"] [word="."]')).collect()] == [2]
