"""Shared helpers: columns added batch by batch, count vectors summed over a corpus, hashed words."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_SLOTS = 8192      # slots of a count vector in one row
ROWS = 512              # rows that a function sees at once
SLICE_BYTES = 1 << 21   # text bytes that numpy handles at once
CACHED_WORDS = 1 << 20  # words whose hash a task remembers


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remainder(key: Column, by: int) -> Column:
    """crc32 of a key's text modulo ``by``; null for a null key."""
    return F.crc32(key.cast("string")) % by


def add_columns(df: DataFrame, fields: str, fn: Callable[[pa.RecordBatch], list], extra: Iterable[str] = ()) -> DataFrame:
    """All columns of ``df`` and those that ``fn`` makes of each Arrow batch, without a shuffle.

    A column that has the name of a new one (in any case of letters) is replaced; the columns
    ``extra`` are read by ``fn`` and left out of the result.
    """
    new = T._parse_datatype_string(fields)
    gone = {x.lower() for x in [*new.names, *extra]}
    kept = [f for f in df.schema.fields if f.name.lower() not in gone]
    names, made = [f.name for f in kept], new.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                columns = [batch.column(n) for n in names] + [pa.array(x) if not isinstance(x, pa.Array) else x for x in fn(batch)]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *made])

    return df.mapInArrow(run, T.StructType([*kept, *new.fields]))


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """Texts of a batch; null is the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def raw(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of the texts of a batch; null is the empty text."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def slices(parts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``limit`` bytes each; a longer text stands alone."""
    start, size = 0, 0
    for i, x in enumerate(parts):
        if i > start and size + len(x) > limit:
            yield start, i
            start, size = i, 0
        size += len(x)
    if start < len(parts):
        yield start, len(parts)


def gram_slots(parts: list[bytes], n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte n-grams of some texts, one after the other, and how many each text has."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    data = np.frombuffer(b"".join(parts), np.uint8)
    counts = np.maximum(sizes - n + 1, 0)
    if len(data) < n:
        return np.empty(0, np.uint32), counts
    h = np.zeros(len(data) - n + 1, np.uint32)
    for j in range(n):
        h *= np.uint32(0x01000193)
        h += data[j:j + len(h)]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h >>= np.uint32(32 - bits)
    inside = np.ones(len(h), bool)
    ends = np.cumsum(sizes)
    for j in range(1, n):  # grams that would reach into the next text
        at = (ends - j)[sizes >= j]
        inside[at[at < len(h)]] = False
    return h[inside], counts


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each text's own run of values; a text's sum doesn't depend on its neighbours."""
    out = np.zeros(len(counts))
    full = counts > 0
    if full.any():
        starts = np.concatenate(([0], np.cumsum(counts[full])[:-1]))
        out[full] = np.add.reduceat(values, starts)
    return out


class WordHash(dict):
    """63-bit hashes of words; forgets them all when it holds too many."""

    def __missing__(self, word: bytes | str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        data = word.encode("utf-8", "surrogatepass") if isinstance(word, str) else word
        value = self[word] = xxhash.xxh3_64_intdigest(data) >> 1
        return value

    def of(self, words: list[bytes] | list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit hashes (unsigned)."""
    h = h.astype(np.uint64)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Order-dependent hash of every window of n word hashes."""
    size = len(h) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    u = mix(h)
    out = np.zeros(size, np.uint64)
    for j in range(n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += u[j:j + size]
    return mix(out)


VECTOR = "part string, chunk int, counts binary"


def squeezed(data: bytes) -> bytes:
    """Bytes as zstd, behind their number."""
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(data, asbytes=True)


def opened(data: bytes) -> bytes:
    """What ``squeezed`` was given."""
    size = int.from_bytes(data[:8], "little")
    return pa.Codec("zstd").decompress(data[8:], size, asbytes=True) if size else b""


def squeezed_counts(piece: np.ndarray) -> bytes:
    """Counts as zstd, with all their first bytes first, then all second ones: most are small."""
    return squeezed(np.ascontiguousarray(piece.astype("<i4")).view(np.uint8).reshape(-1, 4).T.tobytes())


def opened_counts(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(opened(data), np.uint8).reshape(4, -1).T).view("<i4").ravel()


def vector_rows(vectors: dict[str, np.ndarray], rows: int = 64, pack: Callable[[np.ndarray], bytes] = lambda v: v.astype(np.int32).tobytes()) -> Iterator[pa.RecordBatch]:
    """A task's count vectors as rows of chunks, some at a time; chunks without a count are left out."""
    pending: list[tuple[str, int, bytes]] = []
    for name, v in vectors.items():
        for at in range(0, len(v), CHUNK_SLOTS):
            piece = v[at:at + CHUNK_SLOTS]
            if piece.any():
                pending.append((name, at // CHUNK_SLOTS, pack(piece)))  # of one task
                if len(pending) == rows:
                    yield vector_batch(pending)
                    pending = []
    if pending:
        yield vector_batch(pending)


def vector_batch(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    part, chunk, counts = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array(chunk, pa.int32()), pa.array(counts, pa.binary())],
                                      names=["part", "chunk", "counts"])


def summed(rows: DataFrame, finish: Callable[[np.ndarray], np.ndarray] = lambda v: v, kind=np.int32, unpack: Callable[[bytes], np.ndarray] | None = None) -> DataFrame:
    """Chunks (of numbers of a ``kind``, or what ``unpack`` makes of them) summed over all tasks, then handed through ``finish``.
    Each chunk's rows are added as they arrive, so a task holds one vector piece per chunk it was dealt, however many tasks the
    corpus took."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for part, chunk, counts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                piece = unpack(counts) if unpack else np.frombuffer(counts, kind)
                if (part, chunk) in total:
                    total[part, chunk] += piece
                else:
                    total[part, chunk] = piece.astype(np.int64 if kind is np.int32 else np.float64)
        if total:
            yield vector_batch([(*k, finish(v).tobytes()) for k, v in total.items()])

    return rows.repartition("part", "chunk").mapInArrow(run, VECTOR)


def gather(rows: DataFrame, slots: int, kind=np.int64) -> dict[str, np.ndarray]:
    """Finished vectors on the driver; their size is the model's (parts x slots), not the corpus's."""
    out: dict[str, np.ndarray] = {}
    for r in rows.toLocalIterator():
        v = out.setdefault(r["part"], np.zeros(slots, kind))
        piece = np.frombuffer(r["counts"], kind)
        v[r["chunk"] * len(piece):(r["chunk"] + 1) * len(piece)] = piece
    return out
