"""Search: hits over several corpora, pages, keyword-in-context lines."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.predicates import base_feature, column_name
from corvane.lang import Query, QueryError
from corvane.plans.hits import find
from corvane.sources.corpus import SENTENCE, Corpus


def hits(corpora: list[Corpus], query: Query, plan: str | None = None, mode: str = "chars", finder: Callable[[Corpus], DataFrame] | None = None) -> DataFrame:
    """corpus_no, corpus, sent, at: in every corpus, in the order given. ``finder`` may take hits of a
    corpus from elsewhere, such as the cache."""
    finder = finder or (lambda c: find(c, query, plan, mode))
    parts = [finder(c).select(F.lit(k).alias("corpus_no"), F.lit(c.name).alias("corpus"), F.col("sent").cast("long").alias("sent"), F.col("at").cast("long").alias("at")) for k, c in enumerate(corpora)]
    return reduce(DataFrame.union, parts)


def page(found: DataFrame, start: int = 0, num: int = 10, end: int | None = None) -> DataFrame:
    """Rows ``start`` to ``end`` inclusive, over the corpora in a row; without ``end``, ``num`` rows."""
    start = max(0, start)
    if end is None or end <= 0:
        end = start + num - 1
    return found.orderBy("corpus_no", "at").offset(start).limit(max(0, end - start + 1))


def shown_features(corpus: Corpus, query: Query, show: list[str] | None = None) -> list[str]:
    """``word`` first, then the features asked for, or those of the pattern in the order of the corpus."""
    if show:
        corpus.check(show)
        names = list(show)
    else:
        used = {base_feature(f) for f in query.features}
        names = [f for f in corpus.features if f in used and (f != SENTENCE or not query.sentence_breaks)]
    if "word" in corpus.features:
        names = ["word", *(f for f in names if f != "word")]
    return list(dict.fromkeys(names))


def as_map(names: list[str]):
    """A token's values by feature."""
    return lambda t: F.create_map(*(x for f in names for x in (F.lit(f), t[column_name(f)])))


def kwic(corpora: list[Corpus], query: Query, start: int = 0, num: int = 10, end: int | None = None, show: list[str] | None = None, plan: str | None = None, found: DataFrame | None = None) -> DataFrame:
    """A row for each hit of a page (of ``found``, if given): corpus, match (start, end, position), sentence, tokens (feature to
    value). The page is a limit, so its side of the join is bounded and broadcast; tokens become maps only
    after the join, in the sentences of the page."""
    rows = page(hits(corpora, query, plan) if found is None else found, start, num, end)
    parts = []
    for k, c in enumerate(corpora):
        names = shown_features(c, query, show)
        cols = list(map(column_name, names))
        mine = F.broadcast(rows.where(F.col("corpus_no") == k))
        shown = mine.join(c.sentences.select(F.col("sent").cast("long").alias("sent"), "sent_start", *cols), "sent")
        parts.append(shown.withColumn("tokens", F.transform(F.arrays_zip(*cols), as_map(names))).drop(*cols))
    out = reduce(DataFrame.unionByName, parts)
    begin = (F.col("at") - F.col("sent_start")).cast("int")
    match = F.struct(begin.alias("start"), (begin + query.length).cast("int").alias("end"), F.col("at").alias("position"))
    return out.orderBy("corpus_no", "at").select("corpus", match.alias("match"), F.col("sent").alias("sentence"), "tokens")


def line(row) -> str:
    """One keyword-in-context line as text."""
    out = []
    for i, t in enumerate(row["tokens"]):
        if i == row["match"]["start"]:
            out.append("{")
        out.append("/".join(t.values()))
        if i == row["match"]["end"] - 1:
            out.append("}")
    return f"[{row['sentence']}:{row['match']['position']}] " + " ".join(out)


def counts(found: DataFrame, corpora: list[Corpus]) -> dict[str, int]:
    """Hits of each corpus; also of those without any."""
    got = dict(found.groupBy("corpus_no").count().collect())
    return {c.name: int(got.get(k, 0)) for k, c in enumerate(corpora)}


def in_sentences(corpus: Corpus, query: Query) -> DataFrame:
    """Sentences with a hit."""
    return find(corpus, query).select("sent").distinct()


def preview(found: DataFrame, num: int = 10) -> str:
    """The first positions of a result, as text."""
    rows = [r["at"] for r in found.select("at").orderBy("at").limit(num + 1).collect()]
    return "{" + ", ".join(map(str, rows[:num])) + (", ...}" if len(rows) > num else "}")


def context(corpus: Corpus, sent: int, feature: str | None = None, before: int = 0, after: int = 0, match: tuple[int, int] | None = None) -> str:
    """A sentence as text, with sentences before and after it on lines of their own. ``match``: first position
    and length of a match, which gets marks."""
    column = column_name(feature or corpus.default_feature)
    rows = corpus.sentences.where(F.col("sent").between(sent - before, sent + after)).select("sent", "sent_start", column).orderBy("sent").collect()
    if all(r["sent"] != sent for r in rows):
        raise QueryError(f"no sentence {sent} in corpus {corpus.name!r}")
    out = []
    for r in rows:
        words = list(r[column])
        if match and r["sent_start"] <= match[0] < r["sent_start"] + len(words):
            first = match[0] - r["sent_start"]
            last = min(first + match[1], len(words)) - 1
            words[first] = "{ " + words[first]
            words[last] += " }"
        out.append(" ".join(words))
    return "\n".join(out)
