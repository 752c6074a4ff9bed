"""Near-duplicate detection with BagMinHash signatures (operator 7).

A document is the multiset of its shingles of five words; similarity is the weighted Jaccard index,
the sum of smaller counts over the sum of larger ones. BagMinHash gives each register of a signature
the first event of Poisson processes over (shingle, level), for the levels below the shingle's count:
two documents agree in a register with a probability that is exactly their similarity. Levels form
dyadic intervals [0, 1), [1, 2), [2, 4), ...: each has one process whose rate is its size, and an
event's place within it, one bit of a hash for each halving, decides whether it lies below the count.
Events come in order of time and only up to a horizon at which all registers are filled nearly always;
a document with an empty register gets a longer one, so signatures are unbiased.

1. Documents with equal multisets (128-bit sums of hashes) form classes; the smallest id stands for one.
2. 25 bands of 5 registers: at similarity 0.8 all bands miss a pair with probability 5e-5.
3. In each bucket all are compared with its smallest id, and links verified on the multisets make
   components. Buckets that still hold several components get a second look: members carry a sketch of
   512 registers of one byte. First each is verified with the member of another component whose sketch
   agrees most; then every pair of components that are still different, one of them not the most
   frequent, whose sketches agree as often as a pair at the threshold does (less 4.5 standard
   deviations). So no pair that shares a bucket stays untested unless it is linked already or, but
   for 3 in a million, not similar; and a bucket of g near copies costs g comparisons of texts, not
   g * g. Large buckets are cut into blocks, and each pair of blocks is a group of its own.
4. Components by alternating large and small stars, with all edges in tables.

Sizes are filtered first (a ratio under the threshold can't reach it); nothing else is left out.

Defined results. A text of one to four words: one shingle of all of them. Null or empty text, or one of
white space only: a class of its own. ``classes_of`` gives a row for each doc_id: where its rows have
different texts, the classes of all of them are one; and a row for each row without a doc_id, whose class
has no id either if none of its documents has one. To ``keep`` each row is a document: of each group of
near copies one row stays, that of the smallest id, then text; rows without an id come last. Empty table:
empty result. Other columns are not read by ``classes_of`` and pass through ``keep``. Very long texts are
processed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.shared import dropped, irregular, small_batches, table, unused, written
from corvane.llm.vec import column_bytes, hash_spans, mix, release, slices, word_spans

U = np.uint64
WORDS, THRESHOLD, BANDS, ROWS = 5, 0.8, 25, 5
REGISTERS = BANDS * ROWS
SKETCH, SIGMAS, BLOCK = 512, 4.5, 2000
SIGNED = "doc_id long, c1 long, c2 long, n long, bands array<long>"


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, 48-bit hash and count of each shingle, ordered by row and hash."""
    starts, ends, row = word_spans(data, offsets)
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = hash_spans(data, starts, ends)
    n = len(h)
    first = np.searchsorted(row, row, "left")
    size = np.searchsorted(row, row, "right") - first
    lead = (np.arange(n) + WORDS <= first + size) | ((size < WORDS) & (np.arange(n) == first))
    lead = np.flatnonzero(lead)
    many = np.minimum(size[lead], WORDS)
    value = np.zeros(len(lead), np.uint64)
    for k in range(WORDS):
        value = np.where(k < many, mix(value * U(3) + h[np.minimum(lead + k, n - 1)]), value)
    key = row[lead].astype(np.uint64) << U(48) | value >> U(16)
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    key = key[at]
    return (key >> U(48)).astype(np.int64), key & U(0xFFFFFFFFFFFF), np.diff(np.append(at, len(new)))


def signatures(row: np.ndarray, shingle: np.ndarray, count: np.ndarray, rows: int, m: int = REGISTERS) -> np.ndarray:
    """For each row the hash of the first event in each of ``m`` registers (0 for rows without shingles)."""
    weight = np.bincount(row, count, rows)
    # one process for each shingle and dyadic interval of levels that begins below its count
    parts = [(row, shingle, count, np.zeros(len(row), np.int64))]
    low = 1
    while len(deep := np.flatnonzero(count > low)):
        parts.append((row[deep], mix(shingle[deep] + U(low)), count[deep], np.full(len(deep), low)))
        low *= 2
    row, seed, count, low = map(np.concatenate, zip(*parts, strict=True))
    size = np.maximum(low, 1)
    best, event = np.full((rows, m), np.inf), np.zeros((rows, m), np.uint64)
    pending = weight > 0
    horizon = m * (np.log(m) + 3) / np.maximum(weight, 1)
    while pending.any():
        spot = np.flatnonzero(pending[row])
        time, k = np.zeros(len(spot)), 0
        while len(spot):
            k += 1
            u = mix(seed[spot] + U(k * 0x9E3779B97F4A7C15 % 2**64))
            time = time - np.log(((u >> U(11)).astype(np.float64) + 1) * 2.0**-53) / size[spot]
            live = time <= horizon[row[spot]]
            spot, time, u = spot[live], time[live], u[live]
            v = mix(u + U(0xD1B54A32D192ED03))
            level = low[spot] + ((v >> U(32)).astype(np.float64) * 2.0**-32 * size[spot]).astype(np.int64)
            hit = np.flatnonzero(level < count[spot])
            r, reg, t = row[spot[hit]], ((v[hit] & U(0xFFFFFFFF)) % U(m)).astype(np.int64), time[hit]
            cell = r * m + reg
            np.minimum.at(best.reshape(-1), cell, t)
            won = np.flatnonzero(best.reshape(-1)[cell] == t)
            event.reshape(-1)[cell[won]] = u[hit[won]]
        pending &= ~np.isfinite(best).all(axis=1)
        horizon = horizon * 2
    return event


def band_keys(events: np.ndarray) -> np.ndarray:
    bands = np.zeros((len(events), BANDS), np.uint64)
    for r in range(ROWS):
        bands = mix(bands + events[:, r::ROWS])
    return mix(bands + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Multiset hash, size and band keys of each text; keys only for the first of each multiset in a task."""
    release()
    seen: set[tuple[int, int]] = set()
    for b in batches:
        data, offsets = column_bytes(b.column(1))
        ids = b.column(0).to_numpy(zero_copy_only=False)
        for i, j in slices(offsets):
            row, key, count = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            bounds = np.searchsorted(row, np.arange(j - i + 1))
            sums = []
            for salt in (1, 2):
                total = np.zeros(len(row) + 1, np.uint64)
                np.cumsum(mix(mix(key + U(salt << 50)) + count.astype(np.uint64)), out=total[1:])
                sums.append(mix(total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
            empty = bounds[1:] == bounds[:-1]
            c1, c2 = np.where(empty, ids[i:j], sums[0]), np.where(empty, 0, sums[1])
            first = np.zeros(j - i, bool)
            for k in np.flatnonzero(~empty):
                if (c := (int(c1[k]), int(c2[k]))) not in seen:
                    seen.add(c)
                    first[k] = True
            use = first[row]
            events = signatures(row[use], key[use], count[use], j - i)[first]
            bands = band_keys(events)
            ends = np.concatenate([[0], np.cumsum(first * BANDS)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bands.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array(c1), pa.array(c2), pa.array(np.bincount(row, count, j - i).astype(np.int64)), lists], names=["doc_id", "c1", "c2", "n", "bands"])


def multisets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes and counts of each text, as bytes."""
    release()
    for b in batches:
        data, offsets = column_bytes(b.column(1))
        for i, j in slices(offsets):
            row, key, count = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            bounds = np.searchsorted(row, np.arange(j - i + 1)).tolist()
            both = [key[x:y].tobytes() + count[x:y].astype("<u4").tobytes() for x, y in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array(both, pa.binary())], names=["id", "bag"])


def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Band keys and sketches of multisets, as bytes."""
    release()
    for b in batches:
        for i in range(0, b.num_rows, 64):
            part = b.slice(i, 64)
            bags = part.column(1).to_pylist()
            n = [len(x) // 12 for x in bags]
            row = np.repeat(np.arange(len(bags)), n)
            key = np.concatenate([np.frombuffer(x, "<u8", k) for x, k in zip(bags, n, strict=True)])
            count = np.concatenate([np.frombuffer(x, "<u4", k, 8 * k) for x, k in zip(bags, n, strict=True)]).astype(np.int64)
            bands = band_keys(signatures(row, key, count, len(bags)))
            fine = (signatures(row, mix(key), count, len(bags), SKETCH) & U(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in bands], pa.binary()), pa.array([x.tobytes() for x in fine], pa.binary())], names=["id", "keys", "sketch"])


def crossed(threshold: float, nearest: bool):
    """Pairs worth verifying of sorted rows (key, lo, hi, block, rep, n, root, major, keys, sketch);
    ``nearest``: for each row only the one whose sketch agrees most."""
    least = SKETCH * threshold - SIGMAS * np.sqrt(SKETCH * threshold * (1 - threshold))

    def pairs(group: pa.Table) -> Iterator[pa.RecordBatch]:
        key, lo, hi, block, rep, n, root, major = (group.column(c).to_numpy() for c in ("key", "lo", "hi", "block", "rep", "n", "root", "major"))
        keys = np.stack([np.frombuffer(x, "<i8") for x in group.column("keys").to_pylist()])
        sketch = np.stack([np.frombuffer(x, np.uint8) for x in group.column("sketch").to_pylist()])
        left = np.flatnonzero(block == lo[0])
        right = np.flatnonzero(block == hi[0])
        for i in range(0, len(left), 256):
            x = left[i : i + 256]
            ok = (root[x][:, None] != root[right]) & ((root[x] != major[0])[:, None] | (root[right] != major[0]))
            if lo[0] == hi[0]:
                ok &= rep[x][:, None] < rep[right]
            ok &= np.minimum(n[x][:, None], n[right]) >= threshold * np.maximum(n[x][:, None], n[right])
            p, q = np.nonzero(ok)
            alike = np.concatenate([np.count_nonzero(sketch[x[p[j : j + (1 << 14)]]] == sketch[right[q[j : j + (1 << 14)]]], axis=1) for j in range(0, len(p), 1 << 14)] or [p])
            p, q, alike = p[alike >= least], q[alike >= least], alike[alike >= least]
            if nearest and len(p):
                order = np.lexsort((alike, p))
                top = order[np.flatnonzero(np.diff(p[order], append=-1))]
                p, q = p[top], q[top]
            for j in range(0, len(p), 1 << 14):
                a, b = x[p[j : j + (1 << 14)]], right[q[j : j + (1 << 14)]]
                if not nearest:  # a pair comes from the first of the buckets that it shares
                    same = keys[a] == keys[b]
                    first = keys[a, same.argmax(axis=1)] == key[0]
                    a, b = a[first], b[first]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(rep[a], rep[b])), pa.array(np.maximum(rep[a], rep[b]))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: list[pa.RecordBatch] = []
        mark = None
        for b in batches:
            at = list(zip(*(b.column(c).to_pylist() for c in ("key", "lo", "hi")), strict=True))
            begin = 0
            for i in range(len(at) + 1):
                if i == len(at) or at[i] != mark:
                    if i > begin:
                        held.append(b.slice(begin, i - begin))
                    if i < len(at):
                        if held:
                            yield from pairs(pa.Table.from_batches(held))
                        held, begin, mark = [], i, at[i]
        if held:
            yield from pairs(pa.Table.from_batches(held))

    return run


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard index of two multisets."""
    na, nb = len(a) // 12, len(b) // 12
    ka, kb = np.frombuffer(a, "<u8", na), np.frombuffer(b, "<u8", nb)
    ca, cb = np.frombuffer(a, "<u4", na, 8 * na), np.frombuffer(b, "<u4", nb, 8 * nb)
    if not na or not nb:
        return 0.0
    at = np.minimum(np.searchsorted(kb, ka), nb - 1)
    both = kb[at] == ka
    shared = int(np.minimum(ca, cb[at])[both].sum())
    return shared / (int(ca.sum()) + int(cb.sum()) - shared)


def verified(edges: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) whose documents are similar enough. The bag of the smaller id, which may have very
    many edges, comes last and isn't shuffled with them; skewed joins can be split."""
    one = bags.select(F.col("id").alias("b"), F.col("bag").alias("bag_b"))
    two = bags.select(F.col("id").alias("a"), F.col("bag").alias("bag_a"))
    pairs = edges.hint("merge").join(one.hint("merge"), "b").hint("merge").join(two.hint("merge"), "a").select("a", "b", "bag_a", "bag_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            ok = [similarity(x.as_py(), y.as_py()) >= threshold for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(id, root) of every id in ``edges`` (a, b), root the smallest id of its component."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both if large else both.where("b < a")
        low = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        hooked = near.where("b > a") if large else near
        out = hooked.hint("merge").join(low.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.union(low.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    state = written(spark, edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", few=True)
    mark = None
    while True:
        nxt = written(spark, star(star(state, True), False), "edges", few=True)
        dropped(spark, state)
        state = nxt
        now = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    return state.select(F.col("a").alias("id"), F.col("b").alias("root")).union(state.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def grouped(spark: SparkSession, docs: DataFrame, threshold: float) -> DataFrame:
    """doc_id and class_id, the smallest doc_id of its group, of documents whose ids have one text each."""
    base = written(spark, docs.mapInArrow(signed, SIGNED), "signed")
    reps = base.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max(F.when(F.size("bands") > 0, F.col("bands"))).alias("bands"))
    reps = written(spark, reps, "classes")
    dealt = reps.where("bands is not null").select("rep", "n", F.explode("bands").alias("key"))
    heads = dealt.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("head"), F.count("*").alias("many")).where("many > 1").select("key", "head")
    buckets = dealt.hint("merge").join(heads.hint("merge"), "key").select("key", "rep", "n", F.col("head.rep").alias("a"), F.col("head.n").alias("head_n"))
    buckets = written(spark, buckets, "buckets")
    close = lambda x, y: F.least(x, y) >= threshold * F.greatest(x, y)
    stars = buckets.where((F.col("rep") != F.col("a")) & close(F.col("n"), F.col("head_n"))).select("a", F.col("rep").alias("b")).distinct()
    ids = buckets.select(F.col("rep").alias("doc_id")).distinct()
    texts = docs.hint("merge").join(ids.hint("merge"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    bags = written(spark, texts.mapInArrow(multisets, "id long, bag binary"), "bags")
    links = written(spark, verified(stars, bags, threshold), "links")
    roots = components(spark, links)
    # buckets that still hold several components: first each member's nearest other component, then all
    tested, fine, held = stars, None, [buckets, bags, links]
    for nearest in (True, False):
        known = buckets.select("key", "rep", "n").hint("merge").join(roots.hint("merge"), buckets["rep"] == roots["id"], "left").select("key", "rep", "n", F.coalesce("root", "rep").alias("root"))
        shares = known.groupBy("key", "root").agg(F.count("*").alias("many"))
        major = shares.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("many").alias("many"), F.max(F.struct("many", "root")).alias("top"))
        major = major.where("kinds > 1").select("key", F.col("top.root").alias("major"), "many")
        open_ = known.hint("merge").join(major.hint("merge"), "key").select("key", "rep", "n", "root", "major", "many")
        open_ = written(spark, open_, "open")
        held.append(open_)
        if fine is None:
            doubtful = bags.hint("merge").join(open_.select(F.col("rep").alias("id")).distinct().hint("merge"), "id", "left_semi")
            fine = written(spark, doubtful.mapInArrow(sketched, "id long, keys binary, sketch binary"), "sketches")
            held.append(fine)
        blocks = F.ceil(F.col("many") / BLOCK).cast("int")
        cells = open_.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cells = cells.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "rep", "n", "root", "major")
        cells = cells.hint("merge").join(fine.hint("merge"), F.col("rep") == F.col("id")).drop("id")
        cells = cells.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
        pairs = cells.mapInArrow(crossed(threshold, nearest), "a long, b long").distinct().hint("merge").join(tested.hint("merge"), ["a", "b"], "left_anti")
        pairs = written(spark, pairs, "pairs", few=True)
        more = written(spark, verified(pairs, bags, threshold), "links")
        held += [pairs, more]
        tested = tested.union(pairs)
        if more.head(1):
            links = links.union(more)
            roots = components(spark, links)
    named = reps.select("c1", "c2", "rep").hint("merge").join(roots.hint("merge"), F.col("rep") == F.col("id"), "left").select("c1", "c2", F.coalesce("root", "rep").alias("class_id"))
    out = base.select("doc_id", "c1", "c2").hint("merge").join(named.hint("merge"), ["c1", "c2"])
    out = written(spark, out.groupBy("doc_id").agg(F.min("class_id").alias("class_id")), "found", few=True)
    for unneeded in (*held, base, reps):
        dropped(spark, unneeded)
    return out


def documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))


def numbered(spark: SparkSession, df: DataFrame, id_col: str, text_col: str, key: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The rows with a number of their own in column ``key``; and key, doc_id, text, class_id of each."""
    rows = written(spark, df.withColumn(key, F.monotonically_increasing_id()), "rows")
    docs = rows.select(F.col(key).alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    classes = grouped(spark, docs.select(F.col("key").alias("doc_id"), "text"), threshold).select(F.col("doc_id").alias("key"), "class_id")
    return rows, docs.hint("merge").join(classes.hint("merge"), "key")


def classes_of(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and class_id, the smallest doc_id of its group of near copies."""
    small_batches(spark)
    docs = documents(df, id_col, text_col)
    if not irregular(docs):
        return grouped(spark, docs, threshold)
    _, found = numbered(spark, docs, "doc_id", "text", "key", threshold)
    found = written(spark, found.select("doc_id", "class_id"), "found")
    # classes that share a document are one, and named by their smallest document
    named = found.where("doc_id is not null").distinct()
    least = named.groupBy("doc_id").agg(F.min("class_id").alias("a"))
    roots = components(spark, named.hint("merge").join(least.hint("merge"), "doc_id").select("a", F.col("class_id").alias("b")).distinct())
    rooted = lambda rows, c: rows.hint("merge").join(roots.hint("merge"), F.col(c) == F.col("id"), "left").select("doc_id", F.coalesce("root", c).alias("root"))
    whole = rooted(least, "a").union(rooted(found.where("doc_id is null"), "class_id"))
    names = whole.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return whole.hint("merge").join(names.hint("merge"), "root").select("doc_id", "class_id")


def keep(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One document of each group, with all columns."""
    small_batches(spark)
    key = unused(df, "key")
    if not irregular(documents(df, id_col, text_col)):
        ids = classes_of(spark, df, id_col, text_col, threshold).where("doc_id = class_id").select(F.col("doc_id").alias(key))
        return df.hint("merge").join(ids.hint("merge"), df[id_col].cast("long") == F.col(key), "left_semi")
    rows, found = numbered(spark, df, id_col, text_col, key, threshold)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text", "key"))["key"].alias(key)
    stay = found.groupBy("class_id").agg(best).select(key)
    return rows.hint("merge").join(stay.hint("merge"), key, "left_semi").select(*df.columns)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes_of(spark, table(spark, sf_dir, "documents"))
