import re

import duckdb
import pytest

from corvane.llm import url_filters as uf


def test_agrees_with_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{small}/pages.parquet'")
    want = con.execute(uf.ORACLE).df().sort_values("page_id").reset_index(drop=True)
    got = uf.op5_url_filters(spark, small).toPandas().sort_values("page_id").reset_index(drop=True)
    assert got.astype(object).where(got.notna(), None).equals(want[list(got.columns)].astype(object).where(want.notna(), None)[list(got.columns)])


CASES = [
    ("http://a.org/x", "a.org", "/x", "org/", "allow"),
    ("HTTPS://Sub.Example.ORG/es/9?q#f", "sub.example.org", "/es/9", "example.org/es/", "block"),
    ("http://example.org/en/17", "example.org", "/en/17", "example.org/en/1", "block"),
    ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("http://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"),
    ("http://x.com/de/1", "x.com", "/de/1", "com/de/", "block"),
    ("http://x.com/fr/casino/", "x.com", "/fr/casino/", "com/fr/", "allow"),
    ("http://x.com/en/casino/", "x.com", "/en/casino/", None, "block"),
    ("http://x.com/en/casinos/", "x.com", "/en/casinos/", None, "allow"),
    ("http://spam-shop.net", "spam-shop.net", "", None, "block"),
    ("http://x.org?casino", "x.org", "", None, "block"),
    ("no scheme casino", "", "", None, "block"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("://", "", "", None, "allow"),
    ("http://x.net/a://b/c", "x.net", "/a://b/c", None, "allow"),
    ("http://É.org/Straße", "É.org", "/Straße", "org/", "allow"),
]


def test_hosts_paths_rules_and_patterns(spark):
    df = spark.createDataFrame([(k, c[0], "x") for k, c in enumerate(CASES)], "page_id long, url string, host string")
    for r in uf.judge(df).collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == CASES[r["page_id"]][1:], CASES[r["page_id"]][0]


LINES = (
    "! a comment", "[list]", "", "page##.banner", "||dd.ee^", "|http://a.*b^", "/q|", "b-c^$match-case", "/A/b$match-case", "/b-c[xy]/", "/^HTTP:..B/$match-case",
    "^a^*^b^", "@@||dd.ee^*ee", "||b.net^$third-party", "a.net/AB^$important", "*", "%41",
)
URLS = [f"{s}://{x}/{y}/{z}" for s in ("http", "HTTPS") for x in ("a.net", "w.b.net", "dd.ee", "xdd.ee") for y in ("a", "A", "b-c", "B-Cx", "dd", "AB") for z in ("b", "ee", "q", "q%41")]


@pytest.mark.parametrize("lines", [[x] for x in LINES] + [LINES, [x for x in LINES if x != "*"]])
@pytest.mark.parametrize("most", [0, 2000])
def test_index_finds_what_trying_every_rule_finds(spark, monkeypatch, lines, most):
    """The map in the plan and the joined table both."""
    monkeypatch.setattr(uf, "MOST", most)
    df = spark.createDataFrame([*enumerate(URLS), (None, None), (-1, "")], "page_id long, url string").coalesce(1)
    con = duckdb.connect()
    con.register("pages", df.toPandas())
    want = con.execute(uf.oracle(patterns=lines)).fetchall()
    key = lambda r: (r[0] is not None, r)
    got = [tuple(r) for r in uf.judge(df, patterns=lines).collect()]
    assert sorted(got, key=key) == sorted(((None if x[0] is None or x[0] != x[0] else int(x[0]), *x[1:]) for x in want), key=key)


@pytest.mark.parametrize(
    ("line", "url", "fits"),
    [
        ("||site.net^", "https://a.site.net/x", True), ("||site.net^", "https://asite.net/x", False), ("||site.net^", "http://site.net", True),
        ("||site.net^", "http://x.org/?u=//site.net/", False), ("|https://", "https://x", True), ("|https://", "http://x?https://", False), ("swf|", "http://x/a.swf", True),
        ("swf|", "http://x/a.swf?", False), ("/ad^", "http://x/ad?1", True), ("/ad^", "http://x/ad-1", False), ("/AD^$match-case", "http://x/ad", False), ("/ad[0-9]+/", "http://x/AD77", True),
    ],
)
def test_syntax_of_filter_lists(line, url, fits):
    p = uf.compiled(line)
    assert bool(re.search(p.regex, url if p.exact else url.lower())) == fits
    assert not fits or set(p.tokens) <= set(re.split("[^a-z0-9]+", url.lower()))


def test_a_hundred_thousand_rules(spark):
    lines = [f"||site{k}.net^" for k in range(100_000)] + ["@@||site7.net^ok^", "/odd[0-9]{3}/"]
    urls = [f"http://{w}site{k}.net/{p}" for k in (1, 7, 99_999, 100_000, 100_007) for w in ("", "www.", "x") for p in ("", "ok/", "odd123")] * 2
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(4)
    hosts = {f"site{k}.net" for k in range(100_000)}

    def slow(url):
        labels = url.split("/")[2].split(".")
        block = any(".".join(labels[i:]) in hosts for i in range(len(labels))) or "odd123" in url
        return "allow" if not block or labels[-2] == "site7" and "/ok/" in url else "block"

    out = uf.judge(df, patterns=lines, rules=())
    assert {r["page_id"]: r["verdict"] for r in out.collect()} == {k: slow(u) for k, u in enumerate(urls)}
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_many_host_rules(spark, monkeypatch):
    df = spark.createDataFrame([(k, c[0], "x") for k, c in enumerate(CASES)], "page_id long, url string, host string")
    monkeypatch.setattr(uf, "MOST", 0)
    for r in uf.judge(df).collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == CASES[r["page_id"]][1:], CASES[r["page_id"]][0]


def test_patterns_are_filed_under_their_rarest_token(spark):
    df = spark.createDataFrame([("http://a/dd",), ("http://a/ee",), ("http://dd/x",)], "url string")
    filed = lambda *lines: {t: len(ps) for t, ps in uf.rarest(df, [uf.compiled(x) for x in lines]).items()}
    assert filed("^dd^ee^", "^a^dd^") == {"ee": 1, "a": 1}
    assert filed("*a*", "/x/") == {"": 2}


def test_no_python_on_the_path(spark, small):
    plan = uf.op5_url_filters(spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
