"""URL filters: host and path rules, then pattern rules found by their rarest literal token (operator 5).

Pattern rules are lines of the syntax that public filter lists share: ``||`` is the begin of a host or of
one of its labels, ``|`` an end of the URL, ``*`` any characters, ``^`` a separator (anything but a letter,
a digit, ``_``, ``-``, ``.`` or ``%``, or the end), ``/.../`` a regular expression, ``@@`` an exception, and
``!`` a comment; all else is literal, without regard to ASCII case. Of options after ``$``, ``match-case``
is kept, and those of ``ALWAYS`` change nothing; a rule with any other option needs to know who asks for the
URL, and isn't used, nor are rules for parts of pages.

A literal run of letters and digits whose two neighbours can't be letters or digits is a token: a URL that
matches must have it among its own tokens. Each rule is filed under the one of its tokens that is rarest in
the URLs at hand, or under the empty token, which every URL has, if it has none. A URL's tokens fetch
candidate rules, and only those run their regular expressions. An exception that fits beats all other rules.

All is DataFrame expressions. Up to ``MOST`` rules are a map in the plan: URLs stay in their partitions and
nothing is shuffled; the only job before is a count of the rules' tokens. More rules are a table, joined by
token with the distinct URLs; Spark broadcasts it if its size allows, else both sides are shuffled.

Defined results. Null URL, or one without ``://``: empty host and path, no rule; a null URL is allowed,
any other still goes to the pattern rules. Of equally long host and path rules the smallest by text
wins. Null page_id, repeated rows: one row each. Empty table: empty result. Other columns are not read.
"""

from __future__ import annotations

import re
import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.shared import table

RULES = (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
    ("allow", "com/fr/"), ("block", "com/de/"),
)
PATTERNS = (
    "||casino.", "||casino-", "^casino^", "||free-bets.", "||poker.", "^poker^", "||adult.", "||adult-", "||xxx.",
    "||cheap-pills.", "^viagra^", "||spam-", "||ads-track.", "||ads.*^banner^", "||doubleclick.", "||malware.",
    "||phishing.", "@@||example.org^*^help^",
)
MOST = 2000
ALWAYS = ("important", "all", "document", "doc")
PARTS = {"*": r"[\s\S]*", "^": r"(?:[^a-z0-9_.%-]|$)"}
EXACT = {"*": r"[\s\S]*", "^": r"(?:[^A-Za-z0-9_.%-]|$)"}
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*\.)?"


@dataclass(frozen=True)
class Pattern:
    """A pattern rule: its regular expression is tried on the URL itself if ``exact``, else in lower case."""

    verdict: str
    regex: str
    exact: bool
    tokens: tuple[str, ...]


def compiled(line: str) -> Pattern | None:
    """A line of a filter list; None if it is no rule for URLs."""
    line = line.strip()
    if not line or line[0] in "![" or "##" in line or "#@#" in line:
        return None
    verdict, body = ("allow", line[2:]) if line.startswith("@@") else ("block", line)
    exact = False
    at = body.rfind("$")
    if at > 0 and re.fullmatch(r"[\w~,=|.-]+", body[at + 1 :]):
        options = body[at + 1 :].split(",")
        if set(options) - {"match-case", *ALWAYS}:
            return None
        exact, body = "match-case" in options, body[:at]
    if len(body) > 2 and body[0] == body[-1] == "/":
        return Pattern(verdict, ("" if exact else "(?i)") + body[1:-1], True, ())
    body = body if exact else "".join(c.lower() if c in string.ascii_uppercase else c for c in body)
    first = 2 if body.startswith("||") else 1 if body.startswith("|") else 0
    last = len(body) - (len(body) > first and body.endswith("|"))
    middle, parts = body[first:last], EXACT if exact else PARTS
    regex = ("", "^", HOST)[first] + "".join(parts.get(c) or re.escape(c) for c in middle) + ("$" if last < len(body) else "")
    # ends of the pattern are no boundaries, unless they are anchors
    edged = ("." if first else "*") + middle.lower() + ("." if last < len(body) else "*")
    tokens = re.findall(r"(?<=[^a-z0-9*])([a-z0-9]+)(?=[^a-z0-9*])", edged)
    return Pattern(verdict, regex, exact, tuple(dict.fromkeys(tokens)))


def lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.split(lower(url), "[^a-z0-9]+"))


def rarest(urls: DataFrame, patterns: Sequence[Pattern]) -> dict[str, list[Pattern]]:
    """Patterns by the token they are filed under; under the empty one those that have none."""
    wanted = sorted({t for p in patterns for t in p.tokens})
    seen = urls.select(F.explode(F.array_intersect(url_tokens(F.col("url")), F.array(*map(F.lit, wanted)))).alias("token")) if wanted else None
    often = dict(seen.groupBy("token").count().collect()) if seen is not None else {}
    out: dict[str, list[Pattern]] = {}
    for p in patterns:
        out.setdefault(min(p.tokens, key=lambda t: (often.get(t, 0), t), default=""), []).append(p)
    return out


def index_table(urls: DataFrame, patterns: Sequence[Pattern]) -> DataFrame:
    """The same as a table, for many patterns."""
    rows = [(k, p.regex, p.exact, p.verdict, list(p.tokens) or [""]) for k, p in enumerate(patterns)]
    rules = urls.sparkSession.createDataFrame(rows, "k long, regex string, exact boolean, verdict string, tokens array<string>")
    tokens = rules.select("k", F.explode("tokens").alias("token"))
    often = urls.select(F.explode(url_tokens(F.col("url"))).alias("token")).groupBy("token").count()
    counted = tokens.join(often.join(tokens.select("token").distinct(), "token", "left_semi"), "token", "left")
    best = counted.groupBy("k").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    return rules.join(best, "k").select("token", "regex", "exact", "verdict")


def by_patterns(df: DataFrame, patterns: Sequence[Pattern]) -> DataFrame:
    """Adds whether block rules and exceptions fit: ``blocked``, ``excepted``."""
    if len(patterns) <= MOST:
        filed = {t: [(p.regex, "true" if p.exact else "", p.verdict) for p in ps] for t, ps in rarest(df, patterns).items()}
        index = literal("regex:string,exact:string,verdict:string", filed)
        tokens = F.array_union(url_tokens(F.col("url")), F.array(F.lit("")))
        found = F.flatten(F.filter(F.transform(tokens, lambda t: F.try_element_at(index, t)), lambda x: x.isNotNull()))
        some = lambda verdict: F.exists(found, lambda r: (r["verdict"] == verdict) & F.rlike(F.when(r["exact"] == "true", F.col("url")).otherwise(F.col("lowered")), r["regex"]))
        return df.withColumns({"blocked": some("block"), "excepted": some("allow")})
    urls = df.select("url", "lowered").where("url is not null").distinct()
    dealt = urls.withColumn("token", F.explode(F.array_union(url_tokens(F.col("url")), F.array(F.lit("")))))
    index = index_table(df, patterns)
    hits = dealt.join(index, "token").where(F.rlike(F.when(F.col("exact"), F.col("url")).otherwise(F.col("lowered")), F.col("regex")))
    hits = hits.groupBy("url").agg(F.max(F.col("verdict") == "block").alias("blocked"), F.max(F.col("verdict") == "allow").alias("excepted"))
    return df.join(hits, "url", "left")


def by_host(df: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Adds ``best``: rule and verdict of the longest host and path rule that fits."""
    rows = [(h.lower(), slash + path, rule, verdict) for verdict, rule in rules for h, slash, path in [rule.partition("/")]]
    labels = F.split("host", r"\.")
    # a host and the domains above it
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    if len(rows) <= MOST:
        of: dict[str, list[tuple]] = {}
        for h, *rest in rows:
            of.setdefault(h, []).append(tuple(rest))
        known = literal("path:string,rule:string,verdict:string", of)
        fit = F.filter(F.flatten(F.filter(F.transform(domains, lambda d: F.try_element_at(known, d)), lambda x: x.isNotNull())), lambda r: F.startswith(F.col("path"), r["path"]))
        # longest first, then by text
        ranked = F.transform(fit, lambda r: F.struct((-F.length(r["rule"])).alias("n"), r["rule"].alias("rule"), r["verdict"].alias("verdict")))
        return df.withColumn("best", F.get(F.array_sort(ranked), F.lit(0)))
    known = df.sparkSession.createDataFrame(rows, "domain string, begin string, rule string, verdict string")
    places = df.select("host", "path").distinct().withColumn("domain", F.explode(domains))
    fit = places.join(known, "domain").where(F.startswith("path", "begin"))
    best = fit.groupBy("host", "path").agg(F.min(F.struct((-F.length("rule")).alias("n"), "rule", "verdict")).alias("best"))
    return df.join(best, ["host", "path"], "left")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def literal(kind: str, values: dict[str, list[tuple]]) -> Column:
    """A map literal from strings to arrays of structs of strings."""
    if not values:
        return F.from_json(F.lit("{}"), f"map<string,array<struct<{kind}>>>")
    names = [x.split(":")[0] for x in kind.split(",")]
    row = lambda v: F.struct(*(F.lit(x).alias(n) for x, n in zip(v, names, strict=True)))
    return F.create_map(*(x for k, rows in values.items() for x in (F.lit(k), F.array(*map(row, rows)))))


def judge(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES, patterns: Sequence[str] = PATTERNS) -> DataFrame:
    """Host, path, rule and verdict of each URL. ``patterns``: lines of filter lists."""
    url = df[url_col].cast("string")
    host, path = host_and_path(url)
    out = df.select(df[id_col].alias("page_id"), url.alias("url"), lower(url).alias("lowered"), host.alias("host"), path.alias("path"))
    out = by_patterns(by_host(out, rules), [p for p in map(compiled, patterns) if p])
    method = F.when(F.coalesce("blocked", F.lit(False)) & ~F.coalesce("excepted", F.lit(False)), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), method).alias("verdict"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def oracle(rules: Sequence[tuple[str, str]] = RULES, patterns: Sequence[str] = PATTERNS) -> str:
    """DuckDB SQL that tries every rule on every URL."""
    upper = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(r.partition('/')[0])}, {quote('/' + r.partition('/')[2])}, {quote(r)}, {quote(v)})" for v, r in rules)
    some = lambda verdict: " OR ".join(["false", *(f"regexp_matches({'url' if p.exact else 'lowered'}, {quote(p.regex)})" for p in map(compiled, patterns) if p and p.verdict == verdict)])
    return f"""
WITH rest AS (
  SELECT page_id, url, translate(url, {upper}) AS lowered,
    CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS r FROM pages),
cut AS (SELECT *, regexp_extract(r, '^[^/?#]*') AS h FROM rest),
parts AS (SELECT page_id, url, lowered, translate(h, {upper}) AS host, regexp_extract(substr(r, length(h) + 1), '^[^?#]*') AS path FROM cut),
rules(rh, rp, rule, verdict) AS (VALUES {values}),
keyed AS (SELECT row_number() OVER () AS k, * FROM parts),
fits AS (
  SELECT k, rule, verdict, row_number() OVER (PARTITION BY k ORDER BY length(rule) DESC, rule) AS n
  FROM keyed JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule,
  coalesce(verdict, CASE WHEN ({some("block")}) AND NOT ({some("allow")}) THEN 'block' ELSE 'allow' END) AS verdict
FROM keyed LEFT JOIN (SELECT * FROM fits WHERE n = 1) f USING (k)
"""


ORACLE = oracle()
