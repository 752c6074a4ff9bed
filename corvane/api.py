"""What the command line and the HTTP service return: plain dictionaries, pages and tables as text."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from corvane.lang import QueryError, parse
from corvane.operators import cache, search, statistics
from corvane.plans.hits import find
from corvane.plans.indexes import Template
from corvane.sources.corpus import Corpus, list_corpora, open_corpus

TOTAL = "∑"
LOG = logging.getLogger("corvane")


class Engine:
    """Corpora below a folder, each opened once, and optionally a folder for cached results."""

    def __init__(self, spark: SparkSession, base_dir: str, cache_dir: str | None = None):
        self.spark, self.base_dir, self.cache_dir = spark, base_dir, cache_dir
        self.open: dict[str, Corpus] = {}

    def corpora(self, names: str | list[str]) -> list[Corpus]:
        names = names.split(",") if isinstance(names, str) else names
        out = []
        for n in (n.strip() for n in names):
            if n not in self.open:
                self.open[n] = open_corpus(self.spark, self.base_dir, n)
            out.append(self.open[n])
        return out

    @contextmanager
    def finder(self, query, plan: str | None) -> Iterator[Callable[[Corpus], DataFrame]]:
        """Hits of a corpus, from the cache of results if there is one. They are searched once for all that a
        request does with them, and given up with it."""
        held: list[DataFrame] = []

        def hits(c: Corpus) -> DataFrame:
            began = time.time()
            rows = find(c, query, plan) if plan or not self.cache_dir else cache.cached(self.spark, self.cache_dir, c, query)
            held.append(rows.select("sent", "at").persist())
            LOG.info("planned %s in %s: %.2f s", query, c.name, time.time() - began)
            return held[-1]

        try:
            yield hits
        finally:
            for rows in held:
                rows.unpersist()

    def info(self) -> dict:
        from corvane import __version__

        return {"corpora": list_corpora(self.spark, self.base_dir), "version": __version__}

    def corpus_info(self, names: str | list[str]) -> dict:
        found = {}
        for c in self.corpora(names):
            tokens, sentences = c.size
            found[c.name] = {
                "attrs": {"p": list(c.features), "s": [], "a": []},
                "info": {"Name": c.name, "Charset": "UTF-8", "Size": tokens, "Sentences": sentences, "Indexes": [Template.parse(t.replace("@", ":")).shown() for t in c.indexes]},
            }
        sizes = [x["info"] for x in found.values()]
        return {"corpora": found, "total_size": sum(x["Size"] for x in sizes), "total_sentences": sum(x["Sentences"] for x in sizes)}

    def parsed(self, text: str, sentence_breaks: bool):
        """None for what isn't a pattern: such a query finds nothing."""
        try:
            return parse(text, sentence_breaks)
        except QueryError:
            return None

    def query(self, names: str | list[str], text: str, start: int = 0, num: int = 10, end: int | None = None, show: str = "", sentence_breaks: bool = True, plan: str | None = None) -> dict:
        """Hits of each corpus and a page of keyword-in-context rows."""
        began = time.time()
        corpora, query = self.corpora(names), self.parsed(text, sentence_breaks)
        hits, rows = {}, []
        if query is not None:
            wanted = [f.strip() for f in show.split(",")] if show else None
            with self.finder(query, plan) as finder:
                found = search.hits(corpora, query, plan, finder=finder)
                hits = search.counts(found, corpora)
                LOG.info("hits: %s", hits)
                if LOG.isEnabledFor(logging.DEBUG):
                    LOG.debug("first positions: %s", search.preview(found))
                rows = [r.asDict(recursive=True) for r in search.kwic(corpora, query, start, num, end, wanted, plan, found).collect()]
            LOG.info("page of %d rows: %.2f s in all", len(rows), time.time() - began)
        return {"time": time.time() - began, "hits": sum(hits.values()), "corpus_hits": hits, "corpus_order": list(hits), "start": start, "end": start + len(rows), "kwic": rows}

    def count(self, names: str | list[str], text: str, group_by: str = "word", num: int = 10, sampling: int = 100_000, sentence_breaks: bool = True, plan: str | None = None) -> dict:
        """Groups of the matched values, for each corpus and for all together."""
        began = time.time()
        corpora, query = self.corpora(names), self.parsed(text, sentence_breaks)
        features = [f.strip() for f in group_by.split(",")]
        if query is None:
            return {"time": time.time() - began, "count": 0, "corpora": {}, "combined": {"rows": [], "sums": statistics.sums_row({"total": 0, "sampled": 0, "size": 0})}}

        def rows(df: DataFrame) -> list[dict]:
            return [{"value": dict(zip(features, map(list, r["value"]), strict=True)), "absolute": r["absolute"], "relative": r["relative"]} for r in statistics.top(df, num).collect()]

        with self.finder(query, plan) as finder:
            out = statistics.count(corpora, query, features, num, sampling, finder)
            LOG.info("sums: %s", out["sums"])
            each = {n: {"rows": rows(df), "sums": statistics.sums_row(out["sums"][n])} for n, df in out["corpora"].items()}
            combined = {"rows": rows(out["combined"]), "sums": statistics.sums_row(out["combined_sums"])}
            many = out["combined"].count()
        LOG.info("%d groups: %.2f s in all", many, time.time() - began)
        return {"time": time.time() - began, "count": many, "corpora": each, "combined": combined}


def kwic_text(result: dict) -> str:
    """Numbered lines of a page."""
    if not result["kwic"]:
        return f"{result['hits']} search results."
    head = f"{result['hits']} search results. Showing n:o {result['start']}-{result['end']}:"
    return "\n".join([head, *(f"{n}. {search.line(r)}" for n, r in enumerate(result["kwic"], result["start"]))])


def count_text(result: dict, show: str = "relative", num: int = 10) -> str:
    """A table of groups by corpora, the sums of all first."""
    columns = [(TOTAL, result["combined"]), *result["corpora"].items()]
    table: dict[str, list[float]] = {TOTAL: [c["sums"][show] for _, c in columns]}
    for k, (_, c) in enumerate(columns):
        for r in c["rows"]:
            name = " / ".join(" ".join(v) for v in r["value"].values())
            table.setdefault(name, [0] * len(columns))[k] = r[show]
    names = sorted(table, key=lambda n: -table[n][0])[: num + 1 if num > 0 else None]
    wide = 1 + max(len(n) for n in [*names, "Sampling"])
    cell = max(10, 2 + max(len(n) for n, _ in columns))
    drawn = [c["sums"]["sampled-hits"] / max(1, c["sums"]["total-hits"]) for _, c in columns]
    out = [f"{'Corpus':{wide}} | " + " |".join(f"{n:>{cell}}" for n, _ in columns), f"{'Sampling':{wide}} | " + " |".join(f"{x:>{cell}.1%}" for x in drawn)]
    out.append("-" * wide + "-+-" + "-+-".join("-" * cell for _ in columns))
    digits = 0 if show == "absolute" else 1
    return "\n".join(out + [f"{n:<{wide}} | " + " |".join(f"{x:>{cell}.{digits}f}" for x in table[n]) for n in names])
