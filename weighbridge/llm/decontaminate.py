"""Benchmark decontamination by spaced seeds.

Texts are lower-cased word sequences. Fixed masks choose positions of a window, so hashes agree even
where a word at an ignored position was replaced. Hashes of the benchmark are joined with those of
every training text; around each hit the two texts are compared word by word along the
hit's diagonal, and the best stretch (a match counts 1, a replaced word -4) is the overlap. A
document is contaminated by an item when the overlap has ``least`` matching words, or four fifths
of the item's words if that is fewer.

The benchmark is taken in blocks of a bounded number of words, each joined in the map of one pass
over the documents, so no text is shuffled and no item or passage is a hot key.

Cases: null and empty texts match nothing. Items under SHORTEST words are left out, as they would match
by chance; items shorter than a mask are found by all their words. Repeated items are reported each;
repeated rows too. A document and an item give one row, with the longest overlap, the first among equals.
Rows of the result carry nulls where the id was null. ``clean`` judges rows, not ids: of an id with two texts
only the contaminated row goes, and so does a contaminated row without an id. Empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

#: Masks of the spaced seeds; 1 takes a position, 0 ignores it.
MASKS = ("110110110011", "11101001111", "1011110111", "1111111")
SHORTEST = 5
MISS = 4
FILTER_BITS = 22
WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the masked words at each window's start."""
    size = len(h) - len(mask) + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    out = np.full(size, len(mask) * 31 + mask.count("1"), np.uint64)
    for j, use in enumerate(mask):
        if use == "1":
            out *= np.uint64(0x9E3779B97F4A7C15)
            out += h[j:j + size]
    return c.mix(out)


@dataclass
class Index:
    """One block of items: their words, and all seeds sorted, each with its item and place."""

    ids: list
    tokens: list[np.ndarray]
    masks: list[str]
    hashes: np.ndarray
    items: np.ndarray
    places: np.ndarray
    filter: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple]) -> Index:
        hashes = c.WordHash()
        ids, tokens = [r[0] for r in rows], [c.mix(hashes.of(r[1])) for r in rows]
        short = {len(t) for t in tokens if len(t) < min(map(len, MASKS))}
        masks = [*MASKS, *("1" * n for n in sorted(short) if "1" * n not in MASKS)]
        found, items, places = [], [], []
        for m in masks:
            for i, t in enumerate(tokens):
                if len(m) < min(map(len, MASKS)) and len(t) != len(m):
                    continue
                s = seeds(t, m)
                found.append(s)
                items.append(np.full(len(s), i, np.int64))
                places.append(np.arange(len(s)))
        hashed, items, places = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((found, np.uint64), (items, np.int64), (places, np.int64)))
        order = np.argsort(hashed, kind="stable")
        hashed = hashed[order]
        filled = np.zeros(1 << FILTER_BITS, bool)
        filled[hashed >> np.uint64(64 - FILTER_BITS)] = True
        return cls(ids, tokens, masks, hashed, items[order], places[order], filled)

    def pairs(self, h: np.ndarray) -> list[tuple[int, int]]:
        """(item, diagonal) of every seed of a text that is in the block."""
        out = []
        for m in self.masks:
            s = seeds(h, m)
            at = np.flatnonzero(self.filter[s >> np.uint64(64 - FILTER_BITS)])
            if not len(at):
                continue
            left, right = np.searchsorted(self.hashes, s[at], "left"), np.searchsorted(self.hashes, s[at], "right")
            many = right - left
            hit = np.repeat(left - (np.cumsum(many) - many), many) + np.arange(many.sum())
            out.append(np.column_stack((self.items[hit], np.repeat(at, many) - self.places[hit])))
        return [tuple(x) for x in np.unique(np.concatenate(out), axis=0).tolist()] if out else []


def stretch(same: np.ndarray) -> tuple[int, int]:
    """Begin and end of the best-scored stretch of an aligned comparison."""
    total = np.concatenate(([0], np.cumsum(np.where(same, 1, -MISS))))
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    begin = int(np.flatnonzero(total[:end + 1] == low[end])[-1])
    return begin, end


def overlaps(index: Index, h: np.ndarray, least: int) -> list[tuple]:
    """(item, place in the text, place in the item, words, matching words) of each contaminating item."""
    best: dict[int, tuple] = {}
    for item, diagonal in index.pairs(h):
        t = index.tokens[item]
        a, b = max(0, -diagonal), min(len(t), len(h) - diagonal)
        same = t[a:b] == h[a + diagonal:b + diagonal]
        x, y = stretch(same)
        got = (int(same[x:y].sum()), -(a + x + diagonal), a + x, y - x)
        if item not in best or got > best[item]:
            best[item] = got
    return [(i, -g[1], g[2], g[3], g[0]) for i, g in sorted(best.items()) if g[0] >= min(least, -(-4 * len(index.tokens[i]) // 5))]


def blocks(benchmark: DataFrame, item: str, text: str, limit: int) -> Iterator[list[tuple]]:
    """Items with their words, about ``limit`` words at a time; longer items stand alone."""
    rows, size = [], 0
    for r in benchmark.select(F.col(item).alias("item"), F.col(text).alias("text")).toLocalIterator():
        found = words(r["text"] or "")
        if len(found) < SHORTEST:
            continue
        if rows and size + len(found) > limit:
            yield rows
            rows, size = [], 0
        rows.append((r["item"], found))
        size += len(found)
    if rows:
        yield rows


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
                 least: int = 13, limit: int = 500_000) -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, n_words, n_matched): one row per document and item that
    contaminates it, with the place of the overlap in words. ``limit``: words of the benchmark that
    one pass over the documents takes; a larger benchmark takes more passes."""
    fields = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    schema = f"doc_id {fields[0]}, item_id {fields[1]}, doc_word int, item_word int, n_words int, n_matched int"
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    out = None
    for block in blocks(benchmark, item, item_text, limit):
        held = docs.sparkSession.sparkContext.broadcast(Index.of(block))  # at most ``limit`` words
        part = rows.mapInArrow(_search(held, least), schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _search(held, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, hashes = held.value, c.WordHash()
        for batch in batches:
            rows: list[tuple] = []
            for n, t in enumerate(batch.column(1).to_pylist()):
                if t:
                    rows += [(n, *x) for x in overlaps(index, c.mix(hashes.of(words(t))), least)]
            if rows:
                n, items, *rest = zip(*rows)
                ids = batch.column(0).take(pa.array(n))
                yield pa.RecordBatch.from_arrays([ids, pa.array([index.ids[i] for i in items]), *(pa.array(x, pa.int32()) for x in rest)],
                                                 names=["doc_id", "item_id", "doc_word", "item_word", "n_words", "n_matched"])

    return run


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
          least: int = 13, limit: int = 500_000) -> DataFrame:
    """Rows without an overlap with the benchmark. Each row is judged by its own text, whatever its key or that of others."""
    for block in blocks(benchmark, item, item_text, limit):
        held = docs.sparkSession.sparkContext.broadcast(Index.of(block))  # at most ``limit`` words
        docs = docs.mapInArrow(_without(held, text, least), docs.schema)
    return docs


def _without(held, text: str, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, hashes = held.value, c.WordHash()
        for batch in batches:
            free = [not t or not overlaps(index, c.mix(hashes.of(words(t))), least) for t in batch.column(text).to_pylist()]
            yield batch.filter(pa.array(free, pa.bool_()))

    return run
