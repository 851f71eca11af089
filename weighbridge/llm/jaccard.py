"""Similarity join of documents on word 5-grams: candidates from MinHash bands, pruned by Bayes'
rule while signatures are compared bit by bit, and verified exactly.

Documents with the same set of shingles form a class and take part once. Signatures that
agree in a band are compared 32 values at a time; a pair is dropped when, after the values seen so
far, the posterior probability (uniform prior) that its similarity reaches the threshold is
below the tolerance. Pairs that survive connect documents to groups; within each group every pair
is verified on the whole shingle sets. Large buckets and groups are cut into blocks, and each
pair of blocks is a piece of work of its own; pairs stay inside it, and only each
member's number of links and a spanning forest of them come out.

A band is missed by a pair at the threshold with probability (1 - 0.8**4)**32 < 1e-7.

Cases: a text with 1 to 4 words is one shingle; null texts and texts without words are copies of
each other and like no other. Words are lower-cased (A-Z) runs without white space. Repeated rows of an id are
copies of each other if their texts agree. Rows without an id come back with no class. Classes are
named by 64 bits of a hash. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import stored
from . import common as c
from .components import components, forest

WORDS = 5
VALUES, BAND, STEP = 128, 4, 32
BANDS = VALUES // BAND
BLOCK = 256
BULK = 1 << 16       # pairs compared at once
_RNG = np.random.Generator(np.random.PCG64(8))
ADD = _RNG.integers(0, 1 << 32, VALUES, dtype=np.uint32)
TIMES = _RNG.integers(0, 1 << 31, VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the windows of WORDS words; one for a shorter text."""
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(c.windows(words, min(WORDS, len(words))) + np.uint64(len(words) if len(words) < WORDS else 0))


def signature(s: np.ndarray) -> bytes:
    """VALUES MinHash values of 16 bits each."""
    low = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    best = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        h = (low[at:at + 2048, None] ^ ADD) * TIMES
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        np.minimum(best, h.min(axis=0), out=best)
    return best.astype(np.uint16).tobytes()


def class_id(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """For each number of values compared, the fewest matches with which a pair goes on:
    P(similarity >= threshold | matches) >= tolerance, from the Beta posterior."""
    out = {}
    for n in range(STEP, VALUES + 1, STEP):
        for m in range(n + 1):
            # P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m)
            tail = sum(math.comb(n + 1, i) * threshold ** i * (1 - threshold) ** (n + 1 - i) for i in range(m + 1))
            if tail >= tolerance:
                out[n] = m
                break
    return out


def surviving(x: np.ndarray, y: np.ndarray, sigs: np.ndarray, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (positions in sigs) that no comparison step drops."""
    matches = np.zeros(len(x), np.int32)
    for n, need in least.items():
        matches += (sigs[x, n - STEP:n] == sigs[y, n - STEP:n]).sum(axis=1, dtype=np.int32)
        on = matches >= need
        x, y, matches = x[on], y[on], matches[on]
        if not len(x):
            break
    return x, y


def describe(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, class, sig): each row's class, and its signature, null without words."""
    hashes = c.WordHash()

    def answer(batch: pa.RecordBatch) -> list:
        ids, sigs = [], []
        for x in c.raw(batch, "text"):
            s = shingles(hashes.of(x.lower().split()))
            ids.append(class_id(s))
            sigs.append(signature(s) if len(s) else None)
        return [pa.array(ids, pa.int64()), pa.array(sigs, pa.binary())]

    return c.add_columns(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "class long, sig binary", answer, extra=["text"])


def blocked(df: DataFrame, group: list[str], size: str, member: str) -> DataFrame:
    """Each member goes to every pair of blocks (lo, hi) of its group that its own block is in."""
    many = F.ceil(F.col(size) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64(member, F.lit(3)), many).cast("int")
    cut = df.withColumn("__many", many).withColumn("own", own)
    pairs = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("__many") - 1)))
    return (pairs.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("other", "__many", size)
            .repartition(*group, "lo", "hi").sortWithinPartitions(*group, "lo", "hi", "own", member))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, put together across batches."""
    rest: list[pa.RecordBatch] = []

    def ident(batch, i):
        return tuple(batch.column(k)[i].as_py() for k in keys)

    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if rest and ident(rest[0], 0) != ident(batch, a):
                yield pa.Table.from_batches(rest)
                rest = []
            rest.append(batch.slice(a, b - a))
    if rest:
        yield pa.Table.from_batches(rest)


def block_pairs(own: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of one block, or all between two."""
    if lo == hi:
        return np.triu_indices(len(own), 1)
    a, b = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
    return np.repeat(a, len(b)), np.tile(b, len(a))


def candidates(sigs: DataFrame, least: dict[int, int]) -> DataFrame:
    """(a, b): edges that connect classes whose signatures collide in a band and survive pruning."""
    one = sigs.where(F.col("sig").isNotNull()).groupBy("class").agg(F.first("sig").alias("sig"))
    one = stored(one, "signatures")
    bands = one.select("class", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.substring("sig", b * (2 * BAND) + 1, 2 * BAND))).alias("band", "__part"))
    bands = bands.select("class", "band", F.xxhash64("band", "__part").alias("bucket"))
    shared = stored(bands.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    # signatures travel only with those that share a bucket
    members = blocked(bands.join(shared, "bucket").join(one, "class"), ["bucket"], "size", "class")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[tuple] = []
        waiting = 0

        def flush():
            ids = np.concatenate([p[0] for p in pending])
            sigs = np.concatenate([p[1] for p in pending])
            shift = np.cumsum([0, *(len(p[0]) for p in pending[:-1])])
            x = np.concatenate([p[2] + s for p, s in zip(pending, shift)])
            y = np.concatenate([p[3] + s for p, s in zip(pending, shift)])
            band = np.concatenate([np.full(len(p[2]), p[4]) for p in pending])
            bands = np.ascontiguousarray(sigs).view(np.uint64)
            names, edges = ids.tolist(), []
            for at in range(0, len(x), BULK):
                xs, ys, bs = x[at:at + BULK], y[at:at + BULK], band[at:at + BULK]
                first = (bands[xs] == bands[ys]).argmax(axis=1) == bs  # a pair belongs to the first band it shares
                xs, ys = surviving(xs[first], ys[first], sigs, least)
                if len(xs):
                    edges += forest(xs.tolist(), ys.tolist(), names)
            pending.clear()
            a, b = zip(*edges) if edges else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for t in runs(batches, ["bucket", "lo", "hi"]):
            if t.num_rows < 2:
                continue
            own = t.column("own").to_numpy()
            x, y = block_pairs(own, t.column("lo")[0].as_py(), t.column("hi")[0].as_py())
            if not len(x):
                continue
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, VALUES)
            pending.append((t.column("class").to_numpy(), sig, x, y, t.column("band")[0].as_py()))
            waiting += len(x)
            if waiting >= BULK:
                yield flush()
                waiting = 0
        if pending:
            yield flush()

    return members.mapInArrow(run, "a long, b long").where("a != b").distinct()


def overlaps(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs x-y of sorted sets."""
    if len(x) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(x.tolist(), y.tolist())], np.int64)
    left, right = np.unique(x), np.unique(y)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    place = np.zeros(len(sets), np.int64)
    place[left] = np.arange(len(left))
    behind = np.zeros(len(sets), np.int64)
    behind[right] = np.arange(len(right))
    common = np.zeros((len(left), len(right)), np.float32)
    by = np.argsort(column, kind="stable")
    column, row = column[by], row[by]
    for at in range(0, len(values), 8192):
        a, b = np.searchsorted(column, [at, at + 8192])
        grid = np.zeros((len(sets), 8192), np.float32)
        grid[row[a:b], column[a:b] - at] = 1
        common += grid[left] @ grid[right].T
    return common[place[x], behind[y]].astype(np.int64)


def verified(docs: DataFrame, wanted: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """(class, links, root): for each class of ``wanted`` (doc_id, class, copies, group, size) and
    piece of work, the documents of other classes it is linked to, and the least class it is
    connected with there."""
    hashes = c.WordHash()

    def make(batch: pa.RecordBatch) -> list:
        sets = [shingles(hashes.of(x.lower().split())) for x in c.raw(batch, "text")]
        own = [len(s) > 0 and class_id(s) == k for s, k in zip(sets, batch.column("class").to_pylist())]
        return [pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(own, pa.bool_())]

    found = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(wanted, "doc_id")
    # an id may stand for several texts: only rows whose text is of the class count, and one of them
    members = c.add_columns(found, "shingles binary, __own boolean", make, extra=["text", "doc_id"]).where("__own").drop("__own")
    work = blocked(members, ["group"], "size", "class")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["group", "lo", "hi"]):
            ids, at = np.unique(t.column("class").to_numpy(), return_index=True)
            if len(ids) < 2:
                continue
            t = t.take(pa.array(at))
            sets = [np.frombuffer(b, np.uint64) for b in t.column("shingles").to_pylist()]
            x, y = block_pairs(t.column("own").to_numpy(), t.column("lo")[0].as_py(), t.column("hi")[0].as_py())
            if not len(x):
                continue
            size = np.array(list(map(len, sets)))
            both = overlaps(sets, x, y)
            # |A and B| >= t |A or B|, in whole numbers of a thousandth
            hit = 1000 * both >= round(1000 * threshold) * (size[x] + size[y] - both)
            x, y = x[hit], y[hit]
            copies = t.column("copies").to_numpy()
            links = np.bincount(x, copies[y], len(ids)) + np.bincount(y, copies[x], len(ids))
            roots = dict(forest(x.tolist(), y.tolist(), ids.tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(list(roots), pa.int64()), pa.array([int(links[np.searchsorted(ids, k)]) for k in roots], pa.int64()),
                                              pa.array(list(roots.values()), pa.int64())], names=["class", "links", "root"])

    return work.mapInArrow(run, "class long, links long, root long")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, tolerance: float = 1e-6) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (the least id that links lead to, itself
    without links), copies (documents with the same shingles) and n_links (documents with a similarity of at
    least ``threshold``, copies included)."""
    return _joined(docs, key, text, threshold, tolerance).drop("class", "root")


def _joined(docs: DataFrame, key: str, text: str, threshold: float, tolerance: float = 1e-6) -> DataFrame:
    """As ``join``, with each row's class and the class that its links lead to."""
    rows = stored(describe(docs, key, text), "classes")
    edges = candidates(rows, least_matches(threshold, tolerance))
    groups = components(edges).select(F.col("id").alias("class"), F.col("root").alias("group"))
    classes = (rows.where(F.col("doc_id").isNotNull()).groupBy("class")
               .agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id")))
    grouped = stored(groups.join(classes, "class"), "groups")
    sizes = grouped.groupBy("group").agg(F.count("*").alias("size")).where("size > 1")
    links = stored(verified(docs, grouped.join(stored(sizes, "sizes"), "group"), key, text, threshold), "links")
    roots = components(links.select(F.col("class").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "class")
    many = links.groupBy("class").agg(F.sum("links").alias("links"))
    inside = stored(many.join(roots, "class").join(classes, "class"), "linked")
    first = stored(inside.groupBy("root").agg(F.min("doc_id").alias("class_id")), "first")
    linked = inside.join(first, "root").select("class", "root", "links", "class_id", "copies")
    copied = classes.where("copies > 1").join(inside.select("class"), "class", "left_anti").withColumn("root", F.col("class"))
    special = stored(linked.unionByName(copied.select("class", "root", F.lit(0).cast("long").alias("links"), F.col("doc_id").alias("class_id"), "copies")), "special")
    one = F.lit(1).cast("long")
    return rows.select("doc_id", "class").join(special, "class", "left").select(
        "doc_id", "class", F.coalesce("root", "class").alias("root"), F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"), F.coalesce("copies", one).alias("copies"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("copies", one) - 1).alias("n_links"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """The document with the least id of each group of linked documents, once. Of an id with several rows each text
    is a document of its own: only rows of the same group leave one, that of the least text. Rows without an id stay."""
    found = stored(_joined(docs, key, text, threshold).where("doc_id is not null").select("doc_id", "class", "root", "class_id"), "joined")
    many = stored(found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__id")), "many")
    gone = found.where(F.col("class_id") != F.col("doc_id")).select(F.col("doc_id").alias("__id")).unionByName(many)
    plain = docs.join(gone, F.col(key) == F.col("__id"), "left_anti")
    first = (found.where(F.col("class_id") == F.col("doc_id")).join(many, F.col("doc_id") == F.col("__id"), "left_semi")
             .groupBy("doc_id", "root").agg(F.min("class").alias("__first")).select(F.col("doc_id").alias("__id"), "__first"))
    hashes = c.WordHash()

    def classes(batch: pa.RecordBatch) -> list:
        return [pa.array([class_id(shingles(hashes.of(x.lower().split()))) for x in c.raw(batch, text)], pa.int64())]

    rows = c.add_columns(docs.join(many, F.col(key) == F.col("__id"), "left_semi"), "__class long", classes)
    rows = rows.join(first, (F.col(key) == F.col("__id")) & (F.col("__class") == F.col("__first")))
    nth = F.row_number().over(Window.partitionBy(key, "__class").orderBy(text))
    return plain.unionByName(rows.withColumn("__nth", nth).where("__nth = 1").select(*docs.columns))
