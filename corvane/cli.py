"""Command line: build, search, count, inspect, time-queries, trim-cache, serve."""

from __future__ import annotations

import argparse
import json
import logging
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.api import Engine, count_text, kwic_text
from corvane.operators import vocabulary
from corvane.operators.cache import trim
from corvane.plans import indexes
from corvane.sources import readers
from corvane.sources.corpus import Corpus, exists, hadoop, number, open_corpus, sanity, store


LOG = logging.getLogger("corvane")


def session() -> SparkSession:
    return SparkSession.builder.appName("corvane").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def name_of(path: str) -> str:
    """``docs`` for ``data/docs.tsv.gz``."""
    return path.rstrip("/").rsplit("/", 1)[-1].split(".")[0]


def build_corpus(spark: SparkSession, base_dir: str, path: str, reversed_features: bool = False, sentence_feature: bool = True) -> Corpus:
    lines, features = readers.sentences(spark, path)
    LOG.info("building %s with the features %s", name_of(path), ", ".join(features))
    return store(spark, base_dir, name_of(path), number(lines, ["part"], ["line"], features), features, reversed_features=reversed_features, sentence_feature=sentence_feature)


def build_indexes(spark: SparkSession, base_dir: str, corpus: Corpus, features: list[str] | None = None, templates: list[str] | None = None, max_dist: int = 2, min_frequency: int = 0, sentence_breaks: bool = True, force: bool = False) -> list[str]:
    """Builds the templates named, or those of the features; returns what was built anew."""
    if features:
        corpus.check(features)
    wanted = [indexes.Template.parse(t) for t in templates] if templates else indexes.templates(features or corpus.features, max_dist, sentence_breaks)
    if features and "s" in corpus.features and not templates and "s" not in features:
        wanted.insert(0, indexes.Template((("s", 0),)))
    built = []
    for t in wanted:
        old = corpus.indexes.get(str(t).replace(":", "@"))
        if force or old is None or indexes.frequency_of(old) is None:
            began = time.time()
            indexes.build(spark, base_dir, corpus, t, min_frequency)
            LOG.info("index %s: %.1f s", t, time.time() - began)
            built.append(str(t))
    return built


def inspect(df: DataFrame, rows: list[int] | None = None, at: str = "at") -> list[dict]:
    """Some rows of a stored table: those asked for, else the first."""
    df = df.where(F.col(at).isin(rows)) if rows else df.limit(10)
    return [r.asDict(recursive=True) for r in df.collect()]


def query_lines(spark: SparkSession, paths: list[str]) -> list[str]:
    """Queries of files, one a line; comments and blank lines go."""
    out = []
    for p in paths:
        lines = readers.lines(spark, p)
        out += [q for r in lines.orderBy("file", "block", "row").select("value").collect() if (q := r[0].strip()) and not q.startswith("#")]
    return out


def time_queries(engine: Engine, corpus: str, queries: list[str]):
    """A record of hits and seconds, or of the error, for each query."""
    for n, q in enumerate(queries, 1):
        try:
            began = time.time()
            got = engine.query(corpus, q, num=0)
            yield {"n": n, "query": q, "hits": got["hits"], "time": time.time() - began}
        except Exception as e:  # a failing query is a result here
            yield {"n": n, "query": q, "error": repr(e)}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corvane", description="Search and statistics over annotated corpora")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=text)
        p.add_argument("--base-dir", "-d", default="corpora", help="folder of corpora")
        p.add_argument("--verbose", "-v", action="store_true", help="tell what is done, and how long it takes")
        p.add_argument("--debug", action="store_true", help="tell more")
        p.add_argument("--log-file", default=None, help="where to tell it, in place of standard error")
        return p

    def searching(p: argparse.ArgumentParser) -> None:
        p.add_argument("--corpus", "-c", nargs="+", required=True)
        p.add_argument("--query", "-q", required=True)
        p.add_argument("--num", "-n", type=int, default=10)
        p.add_argument("--cache-dir", default=None)
        p.add_argument("--no-cache", action="store_true")
        p.add_argument("--no-binary", action="store_true", help="don't use indexes")
        p.add_argument("--no-sentence-breaks", action="store_true")
        for flag in ("--filter", "--internal-merge"):
            p.add_argument(flag, action="store_true", help="accepted; hits are always exact")

    p = command("search", "keyword in context")
    searching(p)
    p.add_argument("--print", choices=("kwic", "json", "count"), default="kwic")
    p.add_argument("--start", type=int, default=0)
    p.add_argument("--end", type=int, default=None)
    p.add_argument("--show", default="")

    p = command("count", "frequency statistics")
    searching(p)
    p.add_argument("--group-by", "-g", default="word")
    p.add_argument("--absolute", action="store_true")
    p.add_argument("--json", action="store_true")
    p.add_argument("--sampling", "--max", type=int, default=100_000)

    p = command("build", "build a corpus and its indexes")
    p.add_argument("--corpus", "-c", required=True, help="a file (builds the corpus) or the name of a corpus")
    p.add_argument("--clean", action="store_true", help="delete the corpus first")
    p.add_argument("--force", "-f", action="store_true", help="build anew what exists")
    p.add_argument("--corpus-index", "-i", action="store_true", help="the corpus alone, unless features or templates are given")
    p.add_argument("--features", "-F", nargs="+")
    p.add_argument("--templates", "-t", nargs="+")
    p.add_argument("--max-dist", type=int, default=2)
    p.add_argument("--min-frequency", type=int, default=0)
    p.add_argument("--no-sentence-breaks", action="store_true")
    p.add_argument("--no-sentence-feature", action="store_true")
    p.add_argument("--reversed-features", action="store_true")
    p.add_argument("--sanity-check", action="store_true")
    for flag in ("--bigset-limit", "--sorter", "--cutoff"):
        p.add_argument(flag, default=None, help="accepted; Spark sorts and stores")
    p.add_argument("--keep-tmpfiles", action="store_true", help="accepted; there are none")

    p = command("inspect", "rows of a corpus")
    p.add_argument("--corpus", "-c", required=True)
    p.add_argument("--index", help="a template, in place of the tokens")
    p.add_argument("rows", nargs="*", type=int)

    p = command("time-queries", "time the queries of files")
    p.add_argument("queries", nargs="+")
    p.add_argument("--corpus", "-c", required=True)

    p = command("trim-cache", "delete cached results used longest ago")
    p.add_argument("--cache-dir", required=True)
    p.add_argument("--max-size", type=float, default=100, help="MB")
    p.add_argument("--quiet", action="store_true")

    p = command("serve", "HTTP service")
    p.add_argument("--cache-dir", default=None)
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=8000)
    return top


def logs(args: argparse.Namespace) -> None:
    """Sets up the log of this run."""
    handler = logging.FileHandler(args.log_file, encoding="utf-8") if args.log_file else logging.StreamHandler()
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    for old in list(LOG.handlers):
        LOG.removeHandler(old)
        old.close()
    LOG.addHandler(handler)
    LOG.setLevel(logging.DEBUG if args.debug else logging.INFO if args.verbose or args.log_file else logging.WARNING)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    logs(args)
    spark = spark or session()
    show = lambda x: print(json.dumps(x, ensure_ascii=False))
    if args.command in ("search", "count"):
        engine = Engine(spark, args.base_dir, None if args.no_cache else args.cache_dir)
        corpora = [n for c in args.corpus for n in c.split(",")]
        if args.no_binary:
            for c in engine.corpora(corpora):
                c.indexes.clear()
        breaks = not args.no_sentence_breaks
        if args.command == "search":
            out = engine.query(corpora, args.query, args.start, args.num, args.end, args.show, breaks)
            if args.print == "json":
                show(out)
            else:
                print(kwic_text(out if args.print == "kwic" else out | {"kwic": []}))
        else:
            out = engine.count(corpora, args.query, args.group_by, args.num, args.sampling, breaks)
            if args.json:
                show(out)
            else:
                print(count_text(out, "absolute" if args.absolute else "relative", args.num))
    elif args.command == "build":
        name = name_of(args.corpus)
        base = f"{args.base_dir.rstrip('/')}/{name}.corpus"
        if args.clean and exists(spark, base):
            fs, p = hadoop(spark, base)
            fs.delete(p, True)
        if readers.uncompressed_suffix(args.corpus) in (".csv", ".tsv", ".conllu", ".conllup") and (args.force or not exists(spark, base)):
            build_corpus(spark, args.base_dir, args.corpus, args.reversed_features, not args.no_sentence_feature)
        corpus = open_corpus(spark, args.base_dir, name)
        if args.features or args.templates or not args.corpus_index:
            for t in build_indexes(spark, args.base_dir, corpus, args.features, args.templates, args.max_dist, args.min_frequency, not args.no_sentence_breaks, args.force):
                print(f"built {t}")
        if args.sanity_check:
            bad = {"tokens": sanity(corpus), "vocabularies": vocabulary.sanity(corpus)} | indexes.sanity(corpus)
            show(bad)
            return int(any(n for part in bad.values() for n in part.values()))
    elif args.command == "inspect":
        corpus = open_corpus(spark, args.base_dir, args.corpus)
        df = corpus.indexes[args.index.replace(":", "@")] if args.index else corpus.tokens
        for r in inspect(df, args.rows):
            show(r)
    elif args.command == "time-queries":
        for r in time_queries(Engine(spark, args.base_dir), args.corpus, query_lines(spark, args.queries)):
            show(r)
    elif args.command == "trim-cache":
        for n in trim(spark, args.cache_dir, args.max_size):
            LOG.info("deleted %s", n)
            if not args.quiet:
                print(f"deleted {n}")
    elif args.command == "serve":
        from corvane.service import server

        with server(Engine(spark, args.base_dir, args.cache_dir), args.host, args.port) as s:
            print(f"http://{args.host}:{s.server_port}/", file=sys.stderr)
            s.serve_forever()
    return 0
