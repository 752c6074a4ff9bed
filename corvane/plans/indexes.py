"""Index tables: templates, building, probing.

A template names one or two features at offsets, the first at 0, and negative literals between them:
``pos:0+pos:1+s:1#s``. Its table has a row for each position: the values v1 (and v2), the sentence and
``at``. Each file has the rows of some sentences, sorted by key, so of each a probe reads the pages whose
bounds hold its key. A
query is answered from indexes only if they cover all its literals: then nothing else is read. Values are
never empty. With a minimal frequency, a pair is kept only if both its values are that frequent; the
frequency is kept in the metadata of ``at``, so it is stored with the table. Such an index is probed only
for two exact values that it holds: then both are frequent, and the index has all their pairs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.predicates import column_name
from corvane.lang import Literal, Query, QueryError, feature_name
from corvane.sources.corpus import GROUP_BYTES, SENTENCE, Corpus
from corvane.sources.order import few

MIN_FREQUENCY = "min_frequency"
PACKED = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"}


@dataclass(frozen=True)
class Guard:
    """A negative literal of a template: the feature at the offset isn't the value."""

    feature: str
    offset: int
    value: str

    def __str__(self) -> str:
        return f"{self.feature}:{self.offset}#{self.value}"


@dataclass(frozen=True)
class Template:
    parts: tuple[tuple[str, int], ...]
    guards: tuple[Guard, ...] = ()

    def __post_init__(self):
        if not 1 <= len(self.parts) <= 2 or min(k for _, k in self.parts) != 0:
            raise QueryError("a template has one or two features, the first at offset 0")

    @property
    def max_offset(self) -> int:
        return max(k for _, k in (*self.parts, *((g.feature, g.offset) for g in self.guards)))

    @classmethod
    def parse(cls, text: str) -> Template:
        parts, guards = [], []
        for item in text.split("+"):
            m = re.fullmatch(r"(\w+):(\d+)(?:#(.+))?", item.strip())
            if not m:
                raise QueryError(f"not a template: {text!r}")
            if m[3] is None:
                parts.append((feature_name(m[1]), int(m[2])))
            else:
                guards.append(Guard(feature_name(m[1]), int(m[2]), m[3]))
        return cls(tuple(parts), tuple(sorted(guards, key=lambda g: (g.offset, g.feature))))

    def __str__(self) -> str:
        return "+".join([*(f"{f}:{k}" for f, k in self.parts), *map(str, self.guards)])

    def shown(self) -> str:
        """As a pattern, for people."""
        out = []
        for k in range(self.max_offset + 1):
            inside = [f"?{f}" for f, o in self.parts if o == k] + [f'{g.feature}≠"{g.value}"' for g in self.guards if g.offset == k]
            out.append("[" + "|".join(inside) + "]")
        return "".join(out)


def literal_of(text: str, offset: int = 0) -> tuple[int, Literal]:
    """``f:o=v`` or ``f:o#v``."""
    m = re.fullmatch(r"(\w+):(\d+)([=#])(.*)", text)
    if not m:
        raise QueryError(f"not a literal: {text!r}")
    return int(m[2]) + offset, Literal.of(feature_name(m[1]), m[4], m[3] == "#")


def templates(features: list[str], max_dist: int = 2, sentence_breaks: bool = True) -> list[Template]:
    """The sentence index, one for each feature, and one for each ordered pair at each distance."""
    plain = [f for f in features if not f.endswith("_reversed") and f != SENTENCE]
    out = [Template(((SENTENCE, 0),))] if SENTENCE in features else []
    out += [Template(((f, 0),)) for f in features if f != SENTENCE]
    for d in range(1, max_dist + 1):
        guards = tuple(Guard(SENTENCE, k, SENTENCE) for k in range(1, d + 1)) if sentence_breaks else ()
        out += [Template(((f, 0), (g, d)), guards) for f in plain for g in plain]
    return out


def postings(corpus: Corpus, template: Template, min_frequency: int = 0) -> DataFrame:
    """v1 (, v2), sent and at with the minimal frequency, unsorted. Sentence guards are what keeps pairs within a sentence row."""
    corpus.check([f for f, _ in template.parts])
    first = template.parts[0][0]
    if len(template.parts) == 1:
        return corpus.tokens.select(F.col(column_name(first)).alias("v1"), "sent", marked(0)).where("v1 != ''")
    second, d = template.parts[1]
    kept = [g for g in template.guards if g.feature != SENTENCE]
    names = [*dict.fromkeys([first, second, *(g.feature for g in kept)])]
    # both values lie in one sentence: its arrays give the pairs without a shuffle
    value = lambda f, k: F.get(F.col(column_name(f)), F.col("i") + k)
    span = max([d, *(g.offset for g in kept)])
    rows = corpus.sentences.where(F.col("n") > span).select("sent", "sent_start", *map(column_name, names), F.explode(F.sequence(F.lit(0), F.col("n") - span - 1)).alias("i"))
    rows = rows.select(value(first, 0).alias("v1"), value(second, d).alias("v2"), "sent", (F.col("sent_start") + F.col("i")).alias("at"), *(value(g.feature, g.offset).alias(f"g{j}") for j, g in enumerate(kept)))
    if not any(g.feature == SENTENCE for g in template.guards) and span:
        # the last tokens of a sentence meet those next to breaks
        near = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: (i < span) | (i >= F.col("n") - span))
        edges = corpus.sentences.where("n > 0").select("sent", "sent_start", "n", *map(column_name, names), F.explode(near).alias("i"))
        edges = edges.select("sent", (F.col("sent_start") + F.col("i")).alias("at"), (F.col("i") >= F.col("n") - span).alias("last"), *(value(f, 0).alias(column_name(f)) for f in names))
        ahead = lambda k, f, name: edges.select((F.col("at") - k).alias("at"), F.col(column_name(f)).alias(name))
        over = edges.where("last").select("sent", "at", F.col(column_name(first)).alias("v1")).join(ahead(d, second, "v2"), "at")
        for j, g in enumerate(kept):
            over = over.join(ahead(g.offset, g.feature, f"g{j}"), "at")
        rows = rows.unionByName(over)
    for j, g in enumerate(kept):
        rows = rows.where(F.col(f"g{j}") != g.value)
    rows = rows.select("v1", "v2", "sent", "at").where("v1 != '' and v2 != ''")
    if min_frequency > 1:
        often = {f: corpus.tokens.groupBy(F.col(column_name(f)).alias("v")).count().where(F.col("count") >= min_frequency).select("v") for f in (first, second)}
        often = {f: F.broadcast(df) if few(df, ["v"]) else df for f, df in often.items()}  # else all pairs are shuffled for each value
        for name, f in (("v1", first), ("v2", second)):
            rows = rows.join(often[f].withColumnRenamed("v", name), name, "left_semi")
    return rows.select("v1", "v2", "sent", marked(min_frequency))


def marked(min_frequency: int) -> Column:
    """``at`` with the minimal frequency of its index (0 if the index is complete)."""
    return F.col("at").alias("at", metadata={MIN_FREQUENCY: min_frequency if min_frequency > 1 else 0})


def frequency_of(index: DataFrame) -> int | None:
    """The minimal frequency of an index; None if it was stored without one, or without sentences, by an
    earlier version: such an index isn't probed."""
    if "sent" not in index.columns:
        return None
    return index.schema["at"].metadata.get(MIN_FREQUENCY, 0 if "v2" not in index.columns else None)


def ordered(corpus: Corpus, template: Template, min_frequency: int = 0) -> DataFrame:
    """Rows of an index as they are stored: those of a task's sentences sorted, nothing shuffled."""
    return postings(corpus, template, min_frequency).sortWithinPartitions("v1", *(["v2"] if len(template.parts) == 2 else []), "at")


def build(spark: SparkSession, path: str, corpus: Corpus, template: Template, min_frequency: int = 0) -> DataFrame:
    """Writes an index beside its corpus, and adds it to the corpus. Sorted values and positions are stored as
    differences, in short pages."""
    rows = ordered(corpus, template, min_frequency)
    name = stored_name(template)  # names with a colon aren't names of folders in every store
    where = f"{path.rstrip('/')}/{corpus.name}.corpus/indexes/{name}"
    split = "spark.sql.files.maxPartitionBytes"
    usual = spark.conf.get(split)
    if usual == "134217728b":  # else the session has a number of its own
        spark.conf.set(split, str(GROUP_BYTES))  # a task sorts what its part of the sentences gives
    try:
        rows.write.mode("overwrite").options(**PACKED).parquet(where)
    finally:
        spark.conf.set(split, usual)
    corpus.indexes[name] = spark.read.parquet(where)
    return corpus.indexes[name]


def summary(rows: DataFrame) -> DataFrame:
    """Count, first and last position of each key; a key may have any number of positions."""
    keys = [c for c in ("v1", "v2") if c in rows.columns]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def test(x: Literal, c) -> F.Column:
    from corvane.functions.predicates import literal

    return literal(x, c)


def probe(corpus: Corpus, template: Template, values: list[Literal], offset: int = 0) -> DataFrame:
    """Sentences and starts of matches of the literals, from the index of their template, shifted by its offset."""
    rows = corpus.indexes[stored_name(template)]
    for name, x in zip(("v1", "v2"), values, strict=False):
        rows = rows.where(test(x, F.col(name)))
    return rows.select("sent", (F.col("at") - offset).alias("at")).where("at >= 0")


def stored_name(template: Template) -> str:
    return str(template).replace(":", "@")


def usable(corpus: Corpus, template: Template, values: list[Literal]) -> bool:
    """Whether the index of a template is stored and has all matches of the literals. An index with a minimal
    frequency has those of two exact values, if any; what it doesn't find is left to the scan."""
    index = corpus.indexes.get(stored_name(template))
    least = None if index is None else frequency_of(index)
    if least is None:
        return False
    return least == 0 or all(x.kind == "exact" for x in values) and bool(probe(corpus, template, values).head(1))


def covering(corpus: Corpus, query: Query) -> DataFrame | None:
    """Hits from indexes alone, if they cover the query: every token has only positive exact values or
    prefixes, the first and last are no wildcards, and pairs that hang together within the sentence have all
    literals. None if they don't."""
    found = query.literals
    if not corpus.indexes or any(len(t.alternatives) > 1 for t in query.tokens):
        return None
    if any(x.negative or x.kind not in ("exact", "prefix") for _, x in found) or {0, query.length - 1} - {k for k, _ in found}:
        return None
    if len(found) == 1:
        t = Template(((found[0][1].feature, 0),))
        return probe(corpus, t, [found[0][1]]) if usable(corpus, t, [found[0][1]]) else None
    parts: list[DataFrame] = []
    covered: set = set()
    together = {k: k for k, _ in found}  # tokens known to lie in one sentence
    for i, (k, x) in enumerate(found):
        for m, y in found[i + 1 :]:
            new = not {(k, x), (m, y)} <= covered or together[k] != together[m]
            guards = tuple(Guard(SENTENCE, j, SENTENCE) for j in range(1, m - k + 1)) if query.sentence_breaks else ()
            t = Template(((x.feature, 0), (y.feature, m - k)), guards) if m > k else None
            if t and new and usable(corpus, t, [x, y]):
                # without sentence breaks the sentence is that of the first token
                part = probe(corpus, t, [x, y], k)
                parts.insert(0 if k == 0 else len(parts), part)
                covered |= {(k, x), (m, y)}
                old, now = together[m], together[k]
                together = {n: now if c == old else c for n, c in together.items()}
    if len(covered) < len(set(found)) or len(set(together.values())) > 1:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p.select("at"), "at", "left_semi")
    return out


def occurrences(corpus: Corpus, x: Literal) -> int | None:
    """How often a value or prefix occurs, if a stored index tells."""
    t = Template(((x.feature, 0),))
    if x.negative or x.kind not in ("exact", "prefix") or not usable(corpus, t, [x]):
        return None
    return probe(corpus, t, [x]).count()


def value_at(corpus: Corpus, template: Template, position: int) -> tuple[str, ...] | None:
    """The values of a template at one position; None where its index has no row."""
    last = position + template.max_offset
    rows = {r["at"]: r for r in corpus.tokens.where(F.col("at").between(position, last)).collect()}
    if len(rows) <= template.max_offset:
        return None
    if any(rows[position + g.offset][column_name(g.feature)] == g.value for g in template.guards):
        return None
    values = tuple(rows[position + k][column_name(f)] for f, k in template.parts)
    return values if all(values) else None


def sanity(corpus: Corpus) -> dict[str, dict[str, int]]:
    """For each index of a corpus the rows that it lacks, and those that don't belong there."""
    out = {}
    for name, index in corpus.indexes.items():
        least = frequency_of(index)
        if least is None:
            out[name] = {"outdated": 1}
            continue
        want, got = postings(corpus, Template.parse(name.replace("@", ":")), least), index.select(*index.columns)
        out[name] = {"missing_rows": want.exceptAll(got).count(), "extra_rows": got.exceptAll(want).count()}
    return out
