"""Queries over the driver tables, one for each operator of the engine, and the SQL they are held against."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.predicates import column_name
from corvane.lang import parse
from corvane.operators import cache, search, statistics, vocabulary
from corvane.plans import hits as plans
from corvane.plans import indexes
from corvane.sources import readers
from corvane.sources.corpus import Corpus, number, sanity, store
from corvane.sources.tables import KINDS, corpus, root
from corvane.streaming import ingest

#: pattern, options, and the predicate of each token in SQL over aliases t0, t1, ...
PATTERNS: dict[str, tuple[str, dict, list[str]]] = {
    "exact_one": ('[lemma="the"]', {}, ["t0.lemma = 'the'"]),
    "exact_no_match": ('[lemma="qqqq"]', {}, ["t0.lemma = 'qqqq'"]),
    "contains": ('[lemma contains "the"] [pos !contains "LOW"]', {}, ["t0.lemma = 'the'", "t1.pos <> 'LOW'"]),
    "seq_two": ('[lemma="the"] [word="a.*"]', {}, ["t0.lemma = 'the'", "starts_with(t1.word, 'a')"]),
    "seq_three": ('[lemma="the"] [word="a.*"] [pos="LOW"]', {}, ["t0.lemma = 'the'", "starts_with(t1.word, 'a')", "t2.pos = 'LOW'"]),
    "seq_four": ('[pos="CAP"] [lemma="the"] [] [pos="END"]', {}, ["t0.pos = 'CAP'", "t1.lemma = 'the'", "true", "t3.pos = 'END'"]),
    "prefix": ('[word="an.*"]', {}, ["starts_with(t0.word, 'an')"]),
    "suffix": ('[word=".*tion"]', {}, ["ends_with(t0.word, 'tion')"]),
    "regex": ('[word=".*tion.*"]', {}, ["regexp_full_match(t0.word, '.*tion.*')"]),
    "regex_any": ('[word=".*"] [lemma="the"]', {}, ["t0.word <> ''", "t1.lemma = 'the'"]),
    "regex_classes": ('[word="[A-Z][a-z]+[.,]"]', {}, ["regexp_full_match(t0.word, '[A-Z][a-z]+[.,]')"]),
    "affix_pair": ('[word="an.*"] [word=".*tion"]', {}, ["starts_with(t0.word, 'an')", "ends_with(t1.word, 'tion')"]),
    "negation_same": ('[lemma="a.*" & word!="A.*"]', {}, ["starts_with(t0.lemma, 'a') AND NOT starts_with(t0.word, 'A')"]),
    "negation_next": ('[lemma="the"] [pos!="LOW"]', {}, ["t0.lemma = 'the'", "t1.pos <> 'LOW'"]),
    "negation_first": ('[pos!="LOW"] [lemma="the"]', {}, ["t0.pos <> 'LOW'", "t1.lemma = 'the'"]),
    "or_token": ('[lemma="the" | lemma="of"]', {}, ["t0.lemma = 'the' OR t0.lemma = 'of'"]),
    "or_regex": ('[lemma="the|of"]', {}, ["t0.lemma IN ('the', 'of')"]),
    "or_pair": ('[lemma="the" | lemma="of"] [pos="END" | word="a.*"]', {}, ["t0.lemma = 'the' OR t0.lemma = 'of'", "t1.pos = 'END' OR starts_with(t1.word, 'a')"]),
    "and_or_precedence": ('[lemma="the" & pos="CAP" | lemma="of"]', {}, ["(t0.lemma = 'the' AND t0.pos = 'CAP') OR t0.lemma = 'of'"]),
    "juxtaposed_and": ('[lemma="the" pos="CAP"]', {}, ["t0.lemma = 'the' AND t0.pos = 'CAP'"]),
    "wildcard_gap": ('[lemma="the"] [] [lemma="of"]', {}, ["t0.lemma = 'the'", "true", "t2.lemma = 'of'"]),
    "wildcard_tail": ('[lemma="the"] [] []', {}, ["t0.lemma = 'the'", "true", "true"]),
    "wildcard_head": ('[] [lemma="the"]', {}, ["true", "t1.lemma = 'the'"]),
    "sentence_start": ('[s="s" & lemma="the"]', {}, ["t0.i = 0 AND t0.lemma = 'the'"]),
    "no_sentence_breaks": ('[lemma="the"] [word="a.*"]', {"sentence_breaks": False}, ["t0.lemma = 'the'", "starts_with(t1.word, 'a')"]),
    "no_sentence_breaks_tail": ('[pos="END"] [] [lemma="the"] []', {"sentence_breaks": False}, ["t0.pos = 'END'", "true", "t2.lemma = 'the'", "true"]),
    "plan_window": ('[lemma="the"] [] [pos!="LOW"]', {"plan": "window"}, ["t0.lemma = 'the'", "true", "t2.pos <> 'LOW'"]),
    "plan_joins": ('[lemma="the"] [] [pos!="LOW"]', {"plan": "joins"}, ["t0.lemma = 'the'", "true", "t2.pos <> 'LOW'"]),
}

# Not materialised: DuckDB never ends a join of such a table with itself below an outer LIMIT.
TOKENS = """
WITH l AS (
  SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
w AS (
  SELECT doc_id, lang, line_no, unnest(regexp_extract_all(line, '[^ ]+')) AS word,
    generate_subscripts(regexp_extract_all(line, '[^ ]+'), 1) AS k FROM l),
tok AS NOT MATERIALIZED (
  SELECT row_number() OVER (ORDER BY doc_id, line_no, k) - 1 AS at,
    dense_rank() OVER (ORDER BY doc_id, line_no) AS sent, k - 1 AS i, word, lower(word) AS lemma,
    CASE WHEN regexp_matches(word, '^[0-9]+$') THEN 'NUM' WHEN regexp_matches(word, '^[A-Z]') THEN 'CAP'
      WHEN regexp_matches(word, '[.,;:!?]$') THEN 'END' ELSE 'LOW' END AS pos, coalesce(lang, '') AS lang FROM w)"""
CHAT = """
, cl AS (
  SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM conversations),
cw AS (
  SELECT conv_id, turn, role, line_no, unnest(regexp_extract_all(line, '[^ ]+')) AS word,
    generate_subscripts(regexp_extract_all(line, '[^ ]+'), 1) AS k FROM cl),
chat AS NOT MATERIALIZED (
  SELECT row_number() OVER (ORDER BY conv_id, turn, line_no, k) - 1 AS at,
    dense_rank() OVER (ORDER BY conv_id, turn, line_no) AS sent, word, lower(word) AS lemma, role FROM cw)"""
EVENTS = """
WITH tok AS NOT MATERIALIZED (
  SELECT row_number() OVER (ORDER BY user_id, ts, event_id) - 1 AS at, dense_rank() OVER (ORDER BY user_id) AS sent,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, event_type AS word, user_id::VARCHAR AS "user" FROM events)"""
ORDERS = """
WITH tok AS NOT MATERIALIZED (
  SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) - 1 AS at,
    dense_rank() OVER (ORDER BY l_orderkey) AS sent, l_returnflag AS word, l_linestatus AS status FROM lineitem)"""


def hits_sql(preds: list[str], breaks: bool = True, table: str = "tok", base: str = TOKENS) -> str:
    joins = "".join(f" JOIN {table} t{k} ON t{k}.at = t0.at + {k}" + (f" AND t{k}.sent = t0.sent" if breaks else "") for k in range(1, len(preds)))
    return f"{base} SELECT t0.sent AS sent, t0.at AS at FROM {table} t0{joins} WHERE " + " AND ".join(f"({p})" for p in preds)


def pattern_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    text, options, _ = PATTERNS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        query = parse(text, options.get("sentence_breaks", True))
        return plans.find(corpus(spark, sf_dir), query, options.get("plan"))

    return run


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def corpus_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return longs(c.tokens.select("at", "sent", "i", *(F.col(column_name(f)).alias(f) for f in ("word", "lemma", "pos", "lang"))), "at", "sent", "i")


def vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.vocabulary(corpus(spark, sf_dir), ["word", "pos"])


def corpus_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.info([corpus(spark, sf_dir), corpus(spark, sf_dir, "chat")])


def flat_kwic(rows: DataFrame) -> DataFrame:
    return rows.select("corpus", F.col("match.start").cast("long").alias("start"), F.col("match.end").cast("long").alias("end"), F.col("match.position").alias("position"), "sentence", F.array_join(F.transform("tokens", lambda t: t["word"]), " ").alias("words"))


def kwic_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_kwic(search.kwic([corpus(spark, sf_dir)], parse('[lemma="the"] [word="a.*"]'), start=10, num=20))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kwic_page(spark, sf_dir)


def multi_corpus_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = [corpus(spark, sf_dir), corpus(spark, sf_dir, "chat")]
    found = search.hits(both, parse('[lemma="the"] [lemma="the" | lemma="of" | lemma="and"]'))
    n = search.counts(found, both)["docs"]
    return search.page(found, start=max(0, n - 5), num=12).select("corpus", "sent", "at")


def hit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = [corpus(spark, sf_dir), corpus(spark, sf_dir, "chat")]
    return search.hits(both, parse('[lemma="the"] [word="a.*"]')).groupBy("corpus").agg(F.count("*").alias("hits"))


def in_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(search.in_sentences(corpus(spark, sf_dir), parse('[lemma="the"] [word="a.*"]')), "sent")


def reversed_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.find(corpus(spark, sf_dir, "docs", True), parse('[word_reversed="noit.*"]'))


def union_of_conjunctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    out = None
    for q in parse(PATTERNS["or_pair"][0]).expand():
        one = plans.find(c, q)
        out = one if out is None else out.union(one)
    return out.distinct()


def group_rows(df: DataFrame) -> DataFrame:
    words = F.concat_ws(" ", F.transform(F.col("value")[0], lambda x: x))
    return df.select(words.alias("value"), "absolute", F.round("relative", 6).alias("relative"))


def count_by_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    out = statistics.count([c], parse('[lemma="the"] [word="a.*"]'), ["word"])
    return group_rows(statistics.top(out["corpora"]["docs"], 20))


def count_across_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    out = statistics.count([c], parse('[lemma="the"] [word="a.*"]', sentence_breaks=False), ["pos"])
    return group_rows(out["corpora"]["docs"])


def count_two_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    out = statistics.count([c], parse('[lemma="the"] [word="a.*"]'), ["pos", "lang"])["combined"]
    return out.select(F.array_join(F.col("value")[0], " ").alias("pos"), F.array_join(F.col("value")[1], " ").alias("lang"), "absolute")


def count_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    out = statistics.count([c], parse('[lemma="the"] [word="a.*"]'), ["pos"], sampling=100)
    return group_rows(out["corpora"]["docs"])


def count_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = [corpus(spark, sf_dir), corpus(spark, sf_dir, "chat")]
    return group_rows(statistics.top(statistics.count(both, parse('[lemma="the"] []'), ["lemma"])["combined"], 25))


def count_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = [corpus(spark, sf_dir), corpus(spark, sf_dir, "chat")]
    rows = statistics.pivot(statistics.count(both, parse('[lemma="the"] []'), ["lemma"])["all"], ["docs", "chat"])
    return rows.select(F.array_join(F.col("value")[0], " ").alias("value"), "docs", "chat", "total")


def group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = [corpus(spark, sf_dir), corpus(spark, sf_dir, "chat")]
    return statistics.count(both, parse('[lemma="the"] []'), ["lemma"])["combined"].agg(F.count("*").alias("groups"))


def postings_unary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.summary(indexes.postings(corpus(spark, sf_dir), indexes.Template.parse("lemma:0")))


PAIR = "lemma:0+pos:2+s:1#s+s:2#s"


def postings_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.summary(indexes.postings(corpus(spark, sf_dir), indexes.Template.parse(PAIR)))


def postings_across_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.summary(indexes.postings(corpus(spark, sf_dir), indexes.Template.parse("lemma:0+pos:1")))


def binary_min_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = indexes.Template.parse("word:0+word:1+s:1#s")
    return indexes.summary(indexes.postings(corpus(spark, sf_dir), t, min_frequency=50))


_INDEXED: dict[tuple, Corpus] = {}


def indexed(spark: SparkSession, sf_dir: str) -> Corpus:
    """The corpus of documents with a stored index of pairs, built once for a session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXED:
        c = replace(corpus(spark, sf_dir), indexes={})
        indexes.build(spark, shared_path(spark, "indexes"), c, indexes.Template.parse("lemma:0+word:1+s:1#s"))
        _INDEXED[key] = c
    return _INDEXED[key]


def index_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answered from the index alone."""
    return plans.find(indexed(spark, sf_dir), parse(PATTERNS["seq_two"][0]))


def events_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir, "events")
    first, last = "view", "purchase"
    return plans.find(c, parse(f'[word="{first}"] [] [word="{last}"]'))


def orders_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.find(corpus(spark, sf_dir, "orders"), parse('[word="R" & status="F"] [] [word!="R" | status="O"]'))


def regex_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A character that UTF-8 writes in two bytes is matched by two dots."""
    return plans.find(corpus(spark, sf_dir), parse('[word="d.."]'), mode="bytes")


def event_tokens(c) -> DataFrame:
    return longs(c.tokens.select("at", "sent", "i", F.col("f_word").alias("word"), F.col("f_user").alias("user")), "at", "sent", "i")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def through_file(spark: SparkSession, sf_dir: str, suffix: str, head: str, line, gap: str, before: bool) -> DataFrame:
    """The events corpus written as text in many part files, and read by the reader of the suffix."""
    t = corpus(spark, sf_dir, "events").tokens
    rows = t.select("sent", F.col("i").cast("int").alias("i"), line.alias("value"))
    ends = t.where("i = 0").select("sent", F.lit(-1 if before else 1 << 30).alias("i"), F.lit(gap).alias("value"))
    rows = rows.union(ends).union(spark.createDataFrame([(-1, 0, head)], "sent long, i int, value string"))
    path = shared_path(spark, "events") + suffix
    rows.repartitionByRange(8, "sent", "i").sortWithinPartitions("sent", "i").select("value").write.text(path)
    lines, features = readers.sentences(spark, path)
    return event_tokens(store(spark, shared_path(spark, "read"), "events", number(lines, ["part"], ["line"], features), features))


def reader_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through_file(spark, sf_dir, ".tsv", "word\tuser", F.concat_ws("\t", "f_word", "f_user"), "# ", True)


def reader_conllu(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws("\t", (F.col("i") + 1).cast("string"), "f_word", "f_user")
    return through_file(spark, sf_dir, ".conllup", "# global.columns = ID WORD USER", line, "", False)


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events corpus ingested from a stream of files."""
    lines, features = KINDS["events"](spark, sf_dir)
    rows = lines.select(F.floor(F.col("sent") / 4096).alias("part"), F.col("sent").alias("line"), *map(column_name, features))
    source, target = shared_path(spark, "stream"), shared_path(spark, "ingested")
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    ingest.start(stream, target, features, shared_path(spark, "offsets")).awaitTermination()
    return event_tokens(ingest.opened(spark, target, "events", features))


def cached_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found once, then read from the cache."""
    c, query, folder = corpus(spark, sf_dir), parse(PATTERNS["seq_two"][0]), shared_path(spark, "cache")
    cache.cached(spark, folder, c, query)
    return cache.cached(spark, folder, c, query)


def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index written beside its corpus, and a probe of it."""
    c = replace(corpus(spark, sf_dir, "events"), indexes={})
    t = indexes.Template.parse("word:0+word:1+s:1#s")
    indexes.build(spark, shared_path(spark, "indexes"), c, t)
    return indexes.probe(c, t, [*parse('[word="view"]').tokens[0].literals, *parse('[word="c.*"]').tokens[0].literals]).select("at")


def sanity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of the invariants of stored corpora."""
    rows = [(n, *sanity(corpus(spark, sf_dir, n)).values()) for n in ("docs", "events")]
    return spark.createDataFrame(rows, "corpus string, repeated_positions long, missing_positions long, wrong_starts long, null_values long")


GROUPS = f"""{TOKENS},
hit AS (SELECT t0.at, t0.word || ' ' || t1.word AS value, t0.pos || ' ' || t1.pos AS tags, t0.lang || ' ' || t1.lang AS langs FROM tok t0 JOIN tok t1 ON t1.at = t0.at + 1 AND t1.sent = t0.sent
  WHERE t0.lemma = 'the' AND starts_with(t1.word, 'a')),
n AS (SELECT count(*) AS size FROM tok)"""
BOTH = f"""{TOKENS}{CHAT},
hit AS (
  SELECT 'docs' AS corpus, 0 AS c, a.at, a.lemma || ' ' || b.lemma AS value FROM tok a JOIN tok b ON b.at = a.at + 1 AND b.sent = a.sent WHERE a.lemma = 'the'
  UNION ALL SELECT 'chat', 1, a.at, a.lemma || ' ' || b.lemma FROM chat a JOIN chat b ON b.at = a.at + 1 AND b.sent = a.sent WHERE a.lemma = 'the'),
n AS (SELECT (SELECT count(*) FROM tok) + (SELECT count(*) FROM chat) AS size)"""
SPARKLED = "round(1e6 * count(*) / any_value(size), 6)"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: pattern_query(name) for name in PATTERNS}
QUERIES |= {
    f.__name__: f
    for f in (
        corpus_tokens, vocab, corpus_info, kwic_page, multi_corpus_page, hit_counts, in_sentences, reversed_feature,
        union_of_conjunctions, count_by_word, count_across_breaks, count_two_features, count_sampled, count_combined,
        count_pivot, group_count, postings_unary, postings_binary, postings_across_breaks, binary_min_frequency, index_probe, events_funnel,
        orders_pattern, regex_bytes, reader_tsv, reader_conllu, stream_ingest, cached_hits, index_build, sanity_checks,
    )
}

ORACLE_SQL: dict[str, str] = {name: hits_sql(preds, options.get("sentence_breaks", True)) for name, (_, options, preds) in PATTERNS.items()}
ORACLE_SQL |= {
    "corpus_tokens": f"{TOKENS} SELECT at, sent, i, word, lemma, pos, lang FROM tok",
    "vocab": f"""{TOKENS}, v AS (
  SELECT 'word' AS feature, word AS value, 1 AS n FROM tok UNION ALL SELECT 'pos', pos, 1 FROM tok
  UNION ALL VALUES ('word', '', 0), ('pos', '', 0)),
f AS (SELECT feature, value, sum(n)::BIGINT AS freq FROM v GROUP BY 1, 2)
SELECT feature, dense_rank() OVER (PARTITION BY feature ORDER BY value) - 1 AS symbol, value, freq FROM f""",
    "corpus_info": f"{TOKENS}{CHAT} SELECT 'docs' AS corpus, count(*) AS n_tokens, max(sent) AS n_sentences FROM tok UNION ALL SELECT 'chat', count(*), max(sent) FROM chat",
    "kwic_page": f"""{TOKENS}, hit AS (SELECT t0.sent, t0.at, t0.i FROM tok t0 JOIN tok t1 ON t1.at = t0.at + 1 AND t1.sent = t0.sent
  WHERE t0.lemma = 'the' AND starts_with(t1.word, 'a') ORDER BY t0.at LIMIT 20 OFFSET 10)
SELECT 'docs' AS corpus, i::BIGINT AS start, (i + 2)::BIGINT AS "end", at AS position, sent AS sentence,
  (SELECT string_agg(word, ' ' ORDER BY i) FROM tok t WHERE t.sent = hit.sent) AS words FROM hit""",
    "multi_corpus_page": f"""{TOKENS}{CHAT}, hit AS (
  SELECT 'docs' AS corpus, 0 AS c, a.sent, a.at FROM tok a JOIN tok b ON b.at = a.at + 1 AND b.sent = a.sent WHERE a.lemma = 'the' AND b.lemma IN ('the', 'of', 'and')
  UNION ALL SELECT 'chat', 1, a.sent, a.at FROM chat a JOIN chat b ON b.at = a.at + 1 AND b.sent = a.sent WHERE a.lemma = 'the' AND b.lemma IN ('the', 'of', 'and')),
r AS (SELECT *, row_number() OVER (ORDER BY c, at) - 1 AS n, greatest(0, (SELECT count(*) FROM hit WHERE c = 0) - 5) AS low FROM hit)
SELECT corpus, sent, at FROM r WHERE n BETWEEN low AND low + 11""",
    "hit_counts": f"""{TOKENS}{CHAT}, hit AS (
  SELECT 'docs' AS corpus FROM tok a JOIN tok b ON b.at = a.at + 1 AND b.sent = a.sent WHERE a.lemma = 'the' AND starts_with(b.word, 'a')
  UNION ALL SELECT 'chat' FROM chat a JOIN chat b ON b.at = a.at + 1 AND b.sent = a.sent WHERE a.lemma = 'the' AND starts_with(b.word, 'a'))
SELECT corpus, count(*) AS hits FROM hit GROUP BY 1""",
    "in_sentences": f"{TOKENS} SELECT DISTINCT a.sent AS sent FROM tok a JOIN tok b ON b.at = a.at + 1 AND b.sent = a.sent WHERE a.lemma = 'the' AND starts_with(b.word, 'a')",
    "reversed_feature": hits_sql(["starts_with(reverse(t0.word), 'noit')"]),
    "union_of_conjunctions": hits_sql(PATTERNS["or_pair"][2]),
    "count_by_word": f"{GROUPS} SELECT value, count(*) AS absolute, {SPARKLED} AS relative FROM hit, n GROUP BY value ORDER BY count(*) DESC, min(at) LIMIT 20",
    "count_across_breaks": f"""{TOKENS}, n AS (SELECT count(*) AS size FROM tok)
SELECT t0.pos || ' ' || t1.pos AS value, count(*) AS absolute, {SPARKLED} AS relative FROM tok t0 JOIN tok t1 ON t1.at = t0.at + 1, n
WHERE t0.lemma = 'the' AND starts_with(t1.word, 'a') GROUP BY 1""",
    "count_two_features": f"{GROUPS} SELECT tags AS pos, langs AS lang, count(*) AS absolute FROM hit GROUP BY 1, 2",
    "count_sampled": f"""{GROUPS}, r AS (SELECT *, row_number() OVER (ORDER BY at) - 1 AS k, count(*) OVER () AS total FROM hit),
d AS (SELECT *, count(*) OVER () AS sampled FROM r WHERE k % (CASE WHEN total // 100 = 0 THEN 1 ELSE 1 + total // 100 END) = 0)
SELECT tags AS value, count(*) AS absolute, round(1e6 * count(*) * any_value(total) / any_value(sampled) / any_value(size), 6) AS relative FROM d, n GROUP BY 1""",
    "count_combined": f"{BOTH} SELECT value, count(*) AS absolute, {SPARKLED} AS relative FROM hit, n GROUP BY value ORDER BY count(*) DESC, min(struct_pack(c := c, at := at)) LIMIT 25",
    "count_pivot": f"{BOTH} SELECT value, count(*) FILTER (c = 0) AS docs, count(*) FILTER (c = 1) AS chat, count(*) AS total FROM hit GROUP BY value",
    "group_count": f"{BOTH} SELECT count(DISTINCT value) AS groups FROM hit",
    "postings_unary": f"{TOKENS} SELECT lemma AS v1, count(*) AS n, min(at) AS first_at, max(at) AS last_at FROM tok GROUP BY 1",
    "postings_binary": f"{TOKENS} SELECT a.lemma AS v1, b.pos AS v2, count(*) AS n, min(a.at) AS first_at, max(a.at) AS last_at FROM tok a JOIN tok b ON b.at = a.at + 2 AND b.sent = a.sent GROUP BY 1, 2",
    "postings_across_breaks": f"{TOKENS} SELECT a.lemma AS v1, b.pos AS v2, count(*) AS n, min(a.at) AS first_at, max(a.at) AS last_at FROM tok a JOIN tok b ON b.at = a.at + 1 GROUP BY 1, 2",
    "binary_min_frequency": f"""{TOKENS}, often AS (SELECT word FROM tok GROUP BY 1 HAVING count(*) >= 50)
SELECT a.word AS v1, b.word AS v2, count(*) AS n, min(a.at) AS first_at, max(a.at) AS last_at FROM tok a JOIN tok b ON b.at = a.at + 1 AND b.sent = a.sent
WHERE a.word IN (FROM often) AND b.word IN (FROM often) GROUP BY 1, 2""",
    "index_probe": hits_sql(PATTERNS["seq_two"][2]),
    "events_funnel": hits_sql(["t0.word = 'view'", "true", "t2.word = 'purchase'"], base=EVENTS),
    "orders_pattern": hits_sql(["t0.word = 'R' AND t0.status = 'F'", "true", "t2.word <> 'R' OR t2.status = 'O'"], base=ORDERS),
    "regex_bytes": hits_sql(["starts_with(t0.word, 'd') AND strlen(t0.word) = 3"]),
    **dict.fromkeys(("reader_tsv", "reader_conllu", "stream_ingest"), f"{EVENTS} SELECT at, sent, i, word, \"user\" FROM tok"),
    "cached_hits": hits_sql(PATTERNS["seq_two"][2]),
    "index_build": f"{EVENTS} SELECT a.at AS at FROM tok a JOIN tok b ON b.at = a.at + 1 AND b.sent = a.sent WHERE a.word = 'view' AND starts_with(b.word, 'c')",
    "sanity_checks": "SELECT unnest(['docs', 'events']) AS corpus, 0::BIGINT AS repeated_positions, 0::BIGINT AS missing_positions, 0::BIGINT AS wrong_starts, 0::BIGINT AS null_values",
}
# ``at`` is a keyword of DuckDB
ORACLE_SQL = {k: re.sub(r"(?<![\w.])at\b", '"at"', v) for k, v in ORACLE_SQL.items()}
