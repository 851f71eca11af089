"""Reversible line deduplication: sharded cuckoo filters in front of exact reference-count tables.

A line's key is the line without ASCII white space at its ends and with A-Z lower-cased; keys of at
least ``least`` characters count. The store keeps, in a shared folder, a log of references
(key digest, document, +1 or -1), from which reference counts and owners follow exactly, and per shard of keys a cuckoo filter of the keys in use.
Keys that a filter doesn't know are new without a look at the table; the others are looked up.
Deleting documents cancels their references, and keys nobody holds any more leave the filters, so lines
that were dropped for them come back.

Cases: a null or empty text is one empty line; short lines always stay. Rows without an id hold no
references and lose no line. Repeated rows of one id are one document. An empty table inserts
nothing. Other columns pass through; columns named like an output are replaced.
One writer at a time: each change writes new files and then moves the store's version on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import fresh_path, stored
from . import common as c

SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Cuckoo:
    """A cuckoo filter: 16-bit fingerprints in buckets of four, two buckets per key."""

    KICKS = 200

    def __init__(self, table: np.ndarray):
        self.table = table
        self.mask = len(table) - 1

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        return cls(np.zeros((1 << max(4, int(np.ceil(np.log2(max(1, keys) / 3.4)))), 4), np.uint16))

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = h.astype(np.uint64)
        mark = ((h >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.int64)
        one = (h & np.uint64(self.mask)).astype(np.int64)
        return mark, one, one ^ self.jump(mark)

    def jump(self, mark):
        return (mark * 0x5BD1E995 >> 3) & self.mask

    def contains(self, h: np.ndarray) -> np.ndarray:
        mark, one, two = self.places(h)
        return ((self.table[one] == mark[:, None]) | (self.table[two] == mark[:, None])).any(axis=1)

    def add(self, h: np.ndarray) -> np.ndarray:
        """Insert keys; gives the fingerprint places that found no room (empty if all did)."""
        left = []
        table = self.table
        for x, mark, one, two in zip(h.tolist(), *(v.tolist() for v in self.places(h))):
            trail = []
            at = one if 0 in table[one] else two
            for kick in range(self.KICKS):
                free = np.flatnonzero(table[at] == 0)
                if len(free):
                    table[at, free[0]] = mark
                    break
                slot = kick % 4
                trail.append((at, slot))
                mark, table[at, slot] = int(table[at, slot]), mark
                at ^= self.jump(mark)
            else:  # undo, so that nothing already in is lost
                for place, slot in reversed(trail):
                    mark, table[place, slot] = int(table[place, slot]), mark
                left.append(x)
        return np.array(left, np.int64)

    def remove(self, h: np.ndarray) -> np.ndarray:
        """Remove keys that are in; gives a mask of those that were found."""
        found = np.zeros(len(h), bool)
        for i, (mark, *both) in enumerate(zip(*(v.tolist() for v in self.places(h)))):
            for at in both:
                slot = np.flatnonzero(self.table[at] == mark)
                if len(slot):
                    self.table[at, slot[0]] = 0
                    found[i] = True
                    break
        return found


class Shard:
    """The filters of one shard; a new one is added where the last has no room."""

    def __init__(self, blobs: list[bytes]):
        self.filters = [Cuckoo(np.frombuffer(b, np.uint16).reshape(-1, 4).copy()) for b in blobs]

    def contains(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), bool)
        for f in self.filters:
            out |= f.contains(h)
        return out

    def add(self, h: np.ndarray) -> None:
        if self.filters and len(h) < self.filters[-1].table.size // 8:
            h = self.filters[-1].add(h)
        while len(h):
            self.filters.append(Cuckoo.sized(2 * len(h)))
            h = self.filters[-1].add(h)

    def remove(self, h: np.ndarray) -> None:
        for f in self.filters:
            if len(h):
                h = h[~f.remove(h)]

    def blobs(self) -> list[bytes]:
        return [f.table.tobytes() for f in self.filters]


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def digest(key: Column) -> Column:
    return F.unhex(F.md5(key))


def references(docs: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """(key, doc_id): the counted line keys of each document, once per row."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    keys = F.transform(F.filter(F.transform(lines, line_key), lambda k: F.length(k) >= least), digest)
    return docs.where(F.col(key).isNotNull()).select(F.explode(F.array_distinct(keys)).alias("key"), F.col(key).alias("doc_id"))


class LineStore:
    """References and filters in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None, shards: int = 1024, least: int = 10):
        self.spark, self.shards, self.least = spark, shards, least
        self.path = (path or fresh_path(spark, "lines")).rstrip("/")
        self.logs: list[str] = []
        self.filters: str | None = None
        self.version = 0

    # -- parts of the store -------------------------------------------------------------------

    def log(self) -> DataFrame | None:
        return self.spark.read.parquet(*self.logs) if self.logs else None

    def live(self) -> DataFrame:
        """(key, doc_id) references in force: those whose +1 and -1 don't cancel out."""
        if len(self.logs) == 1:  # a first insertion holds each reference once
            return self.log().drop("sign")
        return self.log().groupBy("key", "doc_id").agg(F.sum("sign").alias("s")).where("s > 0").drop("s")

    def counts(self) -> DataFrame:
        """(key, references, owner, last): how many documents hold a line, and the least and
        greatest id among them."""
        return self.live().groupBy("key").agg(F.count("*").alias("references"), F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))

    def _hash(self) -> Column:
        return F.xxhash64("key")

    def _shard(self) -> Column:
        return F.pmod(F.xxhash64("key", F.lit(1)), F.lit(self.shards)).cast("int")

    def _by_shard(self, keys: DataFrame, kind: int) -> DataFrame:
        return keys.select(self._shard().alias("shard"), F.lit(kind).alias("kind"), self._hash().alias("hash"), F.lit(None).cast("binary").alias("blob"))

    def _stored_filters(self) -> DataFrame:
        return self.spark.read.parquet(self.filters).select("shard", F.lit(0).alias("kind"), F.col("part").cast("long").alias("hash"), "blob")

    def _shards(self, keys: DataFrame, kind: int) -> DataFrame:
        rows = self._by_shard(keys, kind)
        if self.filters:
            rows = rows.unionByName(self._stored_filters())
        return rows.repartition("shard").sortWithinPartitions("shard", "kind", "hash")

    def maybe_known(self, keys: DataFrame) -> DataFrame:
        """(hash): of the keys' hashes, those that the filters know (or seem to)."""
        if not self.filters:
            return self._by_shard(keys, 1).select("hash").limit(0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, blobs, hashes in shards_of(batches):
                hit = hashes[1][Shard(blobs).contains(hashes[1])]
                yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64())], names=["hash"])

        return self._shards(keys, 1).mapInArrow(run, "hash long")

    def _update_filters(self, keys: DataFrame, kind: int) -> None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard, blobs, hashes in shards_of(batches):
                s = Shard(blobs)
                s.add(np.unique(hashes[1]))
                s.remove(np.unique(hashes[2]))
                blobs = s.blobs()
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(blobs), pa.int32()), pa.array(range(len(blobs)), pa.int32()), pa.array(blobs, pa.binary())],
                                                 names=["shard", "part", "blob"])

        to = f"{self.path}/filters-{self.version}"
        self._shards(keys, kind).mapInArrow(run, "shard int, part int, blob binary").write.parquet(to)
        self.filters = to

    # -- changes --------------------------------------------------------------------------------

    def insert(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> None:
        """Add documents. An id that is in the store already keeps its references and gets the new ones."""
        to = f"{self.path}/log-{self.version}"
        new = references(docs, key, text, self.least).distinct()
        if self.logs:  # references in force are not added twice
            known = self.maybe_known(new.select("key").distinct())
            old = self.live().join(known.distinct(), self._hash() == F.col("hash"), "left_semi")
            new = new.join(old, ["key", "doc_id"], "left_anti")
        new.withColumn("sign", F.lit(1)).write.parquet(to)
        fresh = self.spark.read.parquet(to).select("key").distinct()
        if self.logs:
            known = self.maybe_known(fresh).distinct()
            held = self.live().join(known, self._hash() == F.col("hash"), "left_semi").select("key")
            fresh = fresh.join(held, "key", "left_anti")
        self._update_filters(fresh, 1)
        self.logs.append(to)
        self.version += 1

    def delete(self, ids: DataFrame, key: str = "doc_id") -> None:
        """Take documents back; ids that are not in the store change nothing."""
        to = f"{self.path}/log-{self.version}"
        gone = self.live().join(ids.select(F.col(key).alias("doc_id")).distinct(), "doc_id", "left_semi")
        gone.select("key", "doc_id").withColumn("sign", F.lit(-1)).write.parquet(to)
        touched = self.spark.read.parquet(to).select("key").distinct()
        self.logs.append(to)
        freed = touched.join(self.live(), "key", "left_anti")
        self._update_filters(freed, 2)
        self.version += 1

    # -- use ------------------------------------------------------------------------------------

    def kept(self, docs: DataFrame, key: str = "doc_id", text: str = "text", out: str = "kept") -> DataFrame:
        """``docs`` with n_lines, n_dropped and the text that stays: a line held by several documents
        stays only in the one with the least id."""
        shared = stored(self.counts().where(F.col("owner") != F.col("last")).select("key", "owner"), "shared-lines")
        mine = references(docs, key, text, self.least)
        lost = mine.join(shared, "key").where(F.col("doc_id") != F.col("owner")).groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("key").alias("__lost"))
        least = self.least

        def answer(batch: pa.RecordBatch) -> list:
            many, dropped, stays = [], [], []
            for line_text, gone in zip(c.raw(batch, text), batch.column("__lost").to_pylist()):
                lines = line_text.split(b"\n")
                many.append(len(lines))
                if gone:
                    gone = set(gone)
                    lines = [x for x in lines if not drops(x, gone, least)]
                dropped.append(many[-1] - len(lines))
                stays.append(b"\n".join(lines))
            return [pa.array(many, pa.int64()), pa.array(dropped, pa.int64()), pa.array(stays, pa.binary()).cast(pa.string())]

        joined = docs.drop("__id", "__lost").join(lost, F.col(key) == F.col("__id"), "left")
        return c.add_columns(joined, f"n_lines long, n_dropped long, {out} string", answer, extra=["__id", "__lost"] + ([text] if out == text else []))


def drops(line: bytes, gone: set[bytes], least: int) -> bool:
    k = line.strip().lower()
    return len(k) >= least and hashlib.md5(k).digest() in gone  # shorter keys have no references


def shards_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], dict[int, np.ndarray]]]:
    """(shard, filter blobs, hashes by kind) from rows sorted by shard."""
    shard, blobs, pieces = None, [], {1: [], 2: []}

    def packed():
        return shard, blobs, {k: np.concatenate(v) if v else np.empty(0, np.int64) for k, v in pieces.items()}

    for batch in batches:
        at, kinds, hashes, blob = (batch.column(i) for i in range(4))
        at, kinds, hashes = (x.to_numpy(zero_copy_only=False) for x in (at, kinds, hashes))
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if at[a] != shard:
                if shard is not None:
                    yield packed()
                shard, blobs, pieces = int(at[a]), [], {1: [], 2: []}
            for kind in (1, 2):
                pieces[kind].append(hashes[a:b][kinds[a:b] == kind])
            blobs += [x for x in blob.slice(a, b - a).to_pylist() if x is not None]
    if shard is not None:
        yield packed()
