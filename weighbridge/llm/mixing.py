"""Language-model scores by online logistic mixing of hashed-context bit predictors.

Texts are lower-cased (A-Z) bytes and an end mark. Each byte is written as the bits of a prefix
code; every bit is predicted from several hashed contexts (the last three bytes, the last five, and
the word so far), whose counters hold how often the bit was 0 or 1 there in the training texts.
Logistic mixing combines the predictions. Two gates choose the weights: the place of the bit in its
byte's code, and whether the word so far is known; the weights are refined while a
document is read, a block of bits at a time. The bits' probabilities multiply to that of the text.

All words of the training texts teach the word so far (``word_paths``): the odds of the most frequent ones travel to
the tasks; for those of the others chunks of texts ask, range by range of words, and the answers meet the chunk.

Beside it stands a word model: add-one log probabilities of the words and one end token.

Cases: a null text is empty (its end mark alone is scored). Rows with a null key teach nothing and
are not held out. Without training texts all counters are empty and every bit has probability 1/2.
Repeated rows count as often as they occur. Weights start afresh every SEGMENT bytes, so one
very long text is as many independent pieces of work.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored
from . import common as c
from .word_paths import DOUBT, RANGE, SCALE, STEP, UNKNOWN, Layout, bounds, word_paths

SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
END = 0xFF                    # never a byte of UTF-8
ORDERS = (3, 5)               # bytes of context, beside the word so far
SLOT_BITS = 22                # counters per context of bytes
WORD_BITS = 24                # counters of the word context in a table of a few words
LEAD = max(ORDERS)
SEGMENT = 4096                # bytes after which weights start afresh
BLOCK = 64                    # bits between updates of the weights
RATE = 0.01
START = (0.25, 0.65, -0.15, -0.1, 0.45)  # weights of the orders, what known words add to them, of the word
WORK = 1 << 18                # bytes handled at once
CHUNKS = 8                    # chunks of texts that a task scores, about


# -- the code of bytes ----------------------------------------------------------------------

@dataclass
class Code:
    """For byte b and depth d: bit[b, d], and place[b, d], the path's place in a cell of 16 counters
    that serves STEP bits; entry[b, s] tells the s-th cells of different prefixes apart."""

    place: np.ndarray
    entry: np.ndarray
    bit: np.ndarray
    size: np.ndarray

    def first(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the first STEP bits, by depth and byte: place (0, which no bit uses, where the code has
        ended), bit, and +1 for a 1, -1 for a 0, 0 where the code has ended."""
        place, bit = self.place[:, :STEP].T.astype(np.int64), self.bit[:, :STEP].T.astype(np.int64)
        there = np.arange(len(place))[:, None] < self.size
        return np.ascontiguousarray(place), np.ascontiguousarray(bit), np.where(there, bit * 2.0 - 1, 0).astype(np.float32)

    @classmethod
    def of(cls, weight: np.ndarray) -> Code:
        """The shortest prefix code for 256 weights; ties by symbol."""
        heap = [(float(w), i, i) for i, w in enumerate(weight)]
        heapq.heapify(heap)
        children: dict[int, tuple[int, int]] = {}
        while len(heap) > 1:
            (wa, ra, a), (wb, rb, b) = heapq.heappop(heap), heapq.heappop(heap)
            new = 256 + len(children)
            children[new] = a, b
            heapq.heappush(heap, (wa + wb, min(ra, rb), new))
        paths: dict[int, list[tuple[int, int]]] = {}
        stack = [(heap[0][2], [])]
        while stack:
            at, path = stack.pop()
            if at < 256:
                paths[at] = path
            else:
                stack += [(child, [*path, (at, bit)]) for bit, child in enumerate(children[at])]
        depth = max(map(len, paths.values()))
        place, bit = np.zeros((256, depth), np.uint32), np.zeros((256, depth), np.uint8)
        entry, size = np.zeros((256, -(-depth // STEP)), np.uint32), np.zeros(256, np.int64)
        for symbol, path in paths.items():
            size[symbol] = len(path)
            for d, (node, b) in enumerate(path):
                bit[symbol, d] = b
                if d % STEP == 0:
                    entry[symbol, d // STEP] = node
                    here = 1
                place[symbol, d] = here
                here = here * 2 + b
        return cls(place, entry, bit, size)


def lay_out(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of some texts with room for context before and an end mark behind each, the places of
    the symbols to predict, and the number of them in each text."""
    data = np.frombuffer(b"".join([b"\0" * LEAD + x + b"\xff" for x in parts]), np.uint8)
    counts = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    starts = np.cumsum(counts + LEAD) - counts
    places = np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
    return data, places, counts


def contexts(data: np.ndarray, word: bool = True) -> list[np.ndarray]:
    """Hash of each context at each byte, from the bytes before it only; with or without the word's."""
    wide = data.astype(np.uint32)
    out = []
    for k, order in enumerate(ORDERS):
        h = np.full(len(data), k + 1, np.uint32)
        for j in range(1, order + 1):
            h[j:] += wide[:-j]
            h *= np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        out.append(h)
    if word:
        out.append(word_context(data))
    return out


def word_context(data: np.ndarray) -> np.ndarray:
    """Hash of the bytes since the last space: a polynomial, from sums of powers."""
    wide, n = data.astype(np.uint32), len(data)
    power = np.cumprod(np.full(n, 0x01000193, np.uint32), dtype=np.uint32)
    back = np.cumprod(np.full(n, pow(0x01000193, -1, 1 << 32), np.uint32), dtype=np.uint32)
    total = np.concatenate((np.zeros(1, np.uint32), np.cumsum((wide + np.uint32(1)) * power, dtype=np.uint32)))
    begin = np.maximum.accumulate(np.where(SPACES[data] | (data == 0) | (data == END), np.arange(1, n + 1), 0))
    begin = np.concatenate(([0], begin[:-1]))
    h = (total[:-1] - total[begin]) * np.concatenate((np.ones(1, np.uint32), back))[begin]
    h ^= h >> np.uint32(16)
    return h * np.uint32(0x85EBCA6B)


def cells(h: np.ndarray, entry: np.ndarray, bits: int = SLOT_BITS) -> np.ndarray:
    """First counter of the cell of a context behind a prefix of the code."""
    x = (h ^ (np.atleast_1d(entry) * np.uint32(0xC2B2AE35))) * np.uint32(0x27D4EB2F)
    x >>= np.uint32(32 - bits + STEP)
    return x.astype(np.int64) << STEP


def marks(h: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """What the unused first place of a word's cell must hold, so that other contexts don't pass for it."""
    x = (h + np.atleast_1d(entry)) * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE3D)
    return (x >> np.uint32(25)).astype(np.int8) | np.int8(1)


def deeper(code: Code, symbols: np.ndarray, hashes: list[np.ndarray], begin: int):
    """Per depth from ``begin`` (a multiple of STEP) on: which places still have a bit, the bits, and
    each context's counters."""
    where = np.arange(len(symbols))
    for d in range(begin, code.place.shape[1]):
        keep = np.flatnonzero(code.size[symbols] > d)
        if not len(keep):
            return
        if len(keep) < len(symbols):
            symbols, where = symbols.take(keep), where.take(keep)
            hashes = [h.take(keep) for h in hashes]
            if d % STEP:
                base = [x.take(keep) for x in base]
        if d % STEP == 0:
            entry = code.entry[symbols, d // STEP]
            base = [cells(h, entry) for h in hashes[:len(ORDERS)]] if len(hashes) > 1 else []
            if len(hashes) != len(ORDERS):  # the last one is the word's
                base += [cells(hashes[-1], entry, WORD_BITS), marks(hashes[-1], entry)]
        yield where, code.bit[symbols, d].astype(np.int64), base, code.place[symbols, d].astype(np.int64)


def tally(parts: list[bytes], code: Code, totals: list[np.ndarray]) -> None:
    """Add the bits of some training texts to the counters (zeros and ones side by side)."""
    data, places, _ = lay_out(parts)
    hashes, symbols = [h[places] for h in contexts(data, word=False)], data[places].astype(np.int64)
    place, bit, _ = code.first()
    step = ((place << 1) + bit).T.take(symbols, axis=0)  # a byte's bits stay together, as their counters do
    one = np.int32(1)
    for total, h in zip(totals, hashes):
        np.add.at(total, ((cells(h, code.entry[:1, 0]) << 1)[:, None] + step).ravel(), one)
    for _, bits, base, at in deeper(code, symbols, hashes, STEP):
        for total, x in zip(totals, base):
            np.add.at(total, ((x + at) << 1) + bits, one)


def word_table(words: dict[bytes, int], code: Code, work: int = 1 << 20) -> np.ndarray:
    """Stored log odds of the next bit after each beginning of the given words, from their counts.
    Of two contexts that fall into one cell, the more frequent has it."""
    table = np.zeros(1 << WORD_BITS, np.int8)
    if not words:
        return table
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    times = np.repeat(np.fromiter(words.values(), np.float32, len(words)), sizes)
    symbols, h = data[1:].astype(np.int64), word_context(data)[1:]
    keys, slots, weights = [], [], []
    for where, bit, (at, check), place in deeper(code, symbols, [h], 0):
        keys.append(at << 4 | check)  # cells are STEP bits apart, marks have eight
        slots.append((place * 2 + bit).astype(np.uint8))
        weights.append(times[where])
    key = np.concatenate(keys)
    del keys
    order = np.argsort(key, kind="stable")
    key, slot, weight = key[order], np.concatenate(slots)[order], np.concatenate(weights)[order]
    del slots, weights, order
    cell = key >> 8
    begin = 0
    while begin < len(key):  # some cells at a time, each with all its contexts
        end = min(len(key), begin + work)
        end = len(key) if end == len(key) else int(np.searchsorted(cell, cell[end], side="left")) or end
        end = end if end > begin else int(np.searchsorted(cell, cell[begin], side="right"))
        found, own = np.unique(key[begin:end], return_inverse=True)
        counts = np.bincount(own * 32 + slot[begin:end], weight[begin:end], len(found) * 32).reshape(-1, 16, 2)
        rows = np.clip(np.rint(SCALE * np.log((counts[:, :, 1] + DOUBT) / (counts[:, :, 0] + DOUBT))), -127, 127).astype(np.int8)
        rows[:, 0] = found & 255
        by = np.argsort(counts.sum(axis=(1, 2)), kind="stable")
        table.reshape(-1, 16)[found[by] >> 8] = rows[by]
        begin = end
    return table


def odds(counts: np.ndarray) -> np.ndarray:
    """Stored log odds of a 1 at each counter, in steps of 1/SCALE."""
    pair = counts.reshape(-1, 2)
    return np.clip(np.rint(SCALE * np.log((pair[:, 1] + 0.3) / (pair[:, 0] + 0.3))), -127, 127).astype(np.int8)


@dataclass
class Paths:
    """Odds of the words of some texts: the path of each one, in order, begins at ``starts`` in ``odds``; that of the
    empty word at ``empty``. Behind the last path there is room for a code."""

    layout: Layout
    odds: np.ndarray
    starts: np.ndarray
    empty: int


def score(parts: list[bytes], code: Code, tables: list[np.ndarray], paths: Paths | None = None) -> np.ndarray:
    """Log10 probability of each text (with its end mark). What is known of a word so far stands in ``paths`` or,
    for the words of one table, behind the other tables.

    Segments are rows of BLOCK symbols; a segment and a gate make a lane with weights of its own.
    Each of the first STEP bits is a gate, laid out alike for all symbols; the few deeper bits are one.
    """
    data, places, counts = lay_out(parts)
    pieces = -(-counts // SEGMENT)
    owner = np.repeat(np.arange(len(parts)), pieces)
    first = np.cumsum(pieces) - pieces
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    lane = np.repeat(first, counts) + within // SEGMENT
    many = np.bincount(lane, minlength=len(owner))
    blocks = -(-many // BLOCK)
    rows, room = int(blocks.sum()), packed(many)
    spread = np.full(rows * BLOCK, -1, np.int64)
    spread[room] = places
    there = spread >= 0
    symbols, hashes = data.take(spread).astype(np.int64), [h.take(spread) for h in contexts(data, word=not paths)]
    root = code.entry[:1, 0]
    place, _, signs = code.first()
    near = place.take(symbols, axis=1) + np.arange(0, 16 * len(symbols), 16)
    sign = signs.take(symbols, axis=1) * there
    inputs = []
    for k, (t, h) in enumerate(zip(tables, hashes)):
        word = k == len(ORDERS)
        # a whole cell is fetched once, then read for each of its bits
        found = t.reshape(-1, 16).take(cells(h, root, WORD_BITS if word else SLOT_BITS) >> STEP, axis=0).ravel()
        inputs.append(found.take(near).astype(np.float32))
        if word:
            known = (found[::16] == marks(h, root)).astype(np.float32)
            inputs[-1] *= known
    if paths:
        begin = np.zeros(len(spread), np.int64)
        begin[room] = paths.layout.places(data[places], paths.starts, paths.empty)
        found = paths.odds.take(begin + np.arange(STEP)[:, None])
        known = (found[0] != UNKNOWN).astype(np.float32)
        inputs.append(found * known)
        begin = begin.take(room)
    depth = len(sign)
    out = mix_lanes([x.reshape(-1, BLOCK) for x in inputs], known.reshape(-1, BLOCK), sign.reshape(-1, BLOCK), np.tile(blocks, depth))
    total = out.reshape(depth, -1).sum(axis=0)
    # the rest of the bits share a lane per segment: their rows are filled depth by depth
    symbols, hashes = symbols.take(room), [h.take(room) for h in hashes]
    rest = np.bincount(lane, np.maximum(code.size[symbols] - STEP, 0), len(owner)).astype(np.int64)
    blocks = -(-rest // BLOCK)
    free = (np.cumsum(blocks) - blocks) * BLOCK
    size = int(blocks.sum()) * BLOCK
    sign, known, *inputs = (np.zeros(size, np.float32) for _ in range(3 + len(ORDERS)))
    for d, (where, bit, base, place) in enumerate(deeper(code, symbols, hashes, STEP), STEP):
        own = lane[where]
        here = np.bincount(own, minlength=len(owner))
        at = np.arange(len(own)) + (free - (np.cumsum(here) - here))[own]
        free += here
        sign[at] = bit * 2 - 1
        if paths:
            found = paths.odds.take(begin.take(where) + d)
            known[at] = found != UNKNOWN
            inputs[-1][at] = found
        else:
            known[at] = tables[-1].take(base[-2]) == base[-1]
        for v, t, x in zip(inputs, tables, base):
            v[at] = t.take(x + place)
    inputs[-1] *= known
    total += mix_lanes([x.reshape(-1, BLOCK) for x in inputs], known.reshape(-1, BLOCK), sign.reshape(-1, BLOCK), blocks)
    return np.bincount(owner, total, len(parts))


def packed(many: np.ndarray) -> np.ndarray:
    """Places of each lane's items when every lane starts a new row of BLOCK."""
    blocks = -(-many // BLOCK)
    start = (np.cumsum(blocks) - blocks) * BLOCK - (np.cumsum(many) - many)
    return np.arange(many.sum()) + np.repeat(start, many)


def mix_lanes(inputs: list[np.ndarray], known: np.ndarray, sign: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Log10 probability of each lane's bits; a lane has ``blocks`` rows, one after the other, and
    its weights are refined behind each row. Where ``known`` is 1 the weights of known words
    hold; its rows may serve several gates in turn. Sign 0 is padding."""
    order = np.argsort(-blocks, kind="stable")
    start, steps = (np.cumsum(blocks) - blocks)[order], blocks[order]
    lanes, orders = len(order), len(inputs) - 1
    # of an order: a weight, and what is added to it in known words
    weight = [np.full((lanes, 1), w / SCALE, np.float32) for w in START]
    rate = np.float32(RATE / SCALE / SCALE)
    total = np.zeros(lanes)
    empty = (BLOCK - np.count_nonzero(sign, axis=1)) * math.log(2)  # padding counts as a bit of probability 1/2 below
    dot = lambda a, b: np.einsum("ab,ab->a", a, b)[:, None]
    for j in range(int(steps[0]) if lanes else 0):
        now = int(np.searchsorted(-steps, -j, side="left"))  # lanes with more than j rows
        at = start[:now] + j
        s, xs, gate = sign.take(at, axis=0), [x.take(at, axis=0) for x in inputs], known.take(at % len(known), axis=0)
        w = [v[:now] for v in weight]
        z = xs[0] * w[orders]
        for x, v in zip(xs[1:orders], w[orders + 1:]):
            z += x * v
        z *= gate
        for x, v in zip((*xs[:orders], xs[orders]), (*w[:orders], w[-1])):
            z += x * v
        z *= -s
        np.minimum(z, 30, out=z)
        np.exp(z, out=z)
        z += 1  # 1 / probability of the bit that came
        wrong = s - s / z
        np.log(z, out=z)
        total[:now] -= z.sum(axis=1, dtype=np.float64) - empty[at]
        wrong *= rate
        for x, v in zip((*xs[:orders], xs[orders]), (*w[:orders], w[-1])):
            v += dot(wrong, x)
        wrong *= gate
        for x, v in zip(xs[:orders], w[orders:]):
            v += dot(wrong, x)
    out = np.empty(lanes)
    out[order] = total / math.log(10)
    return out


# -- the job --------------------------------------------------------------------------------

def lowered(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return [x.lower() for x in c.raw(batch, column)]


def count_words(docs: DataFrame, learn: Column, text: str) -> DataFrame:
    """(word, n): how often each word occurs in the texts that teach, 0 for those of other texts only; the empty
    word counts the texts."""
    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for x, teaches in zip(lowered(batch, "text"), batch.column("teaches").to_pylist()):
                if teaches:
                    seen.update(x.split())
                    seen[b""] += 1
                else:
                    for w in (b"", *x.split()):
                        seen.setdefault(w, 0)
            if len(seen) > c.CACHED_WORDS:
                yield rows(seen)
                seen.clear()
        yield rows(seen)

    def rows(seen):
        return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    texts = docs.select(F.col(text).alias("text"), learn.alias("teaches"))
    return texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def count_bits(docs: DataFrame, text: str, code: Code) -> DataFrame:
    def count(batches):
        totals = [np.zeros(2 << SLOT_BITS, np.int32) for _ in ORDERS]
        for batch in batches:
            parts = lowered(batch, "text")
            for a, b in c.slices(parts, WORK):
                tally(parts[a:b], code, totals)
        yield from c.vector_rows({f"context{k}": t for k, t in enumerate(totals)}, pack=c.squeezed_counts)

    return c.summed(docs.select(F.col(text).alias("text")).mapInArrow(count, c.VECTOR), odds, unpack=c.opened_counts)


def byte_weights(words: DataFrame) -> np.ndarray:
    """Occurrences of each byte in the counted words and the spaces behind them: 256 sums."""
    def count(batches):
        total = np.zeros(256, np.int64)
        for batch in batches:
            found, times = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            np.add.at(total, np.frombuffer(b"".join(found), np.uint8).astype(np.int64), np.repeat(times, sizes))
            total[32] += times.sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int32()), pa.array(total)], names=["byte", "n"])

    out = np.zeros(256)
    for r in words.select("word", "n").mapInArrow(count, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        out[r["byte"]] = r["n"]
    return out


def frequent(words: DataFrame, most: int) -> DataFrame:
    """The most frequent words, at most so many: those above a count found from a histogram of
    logarithms, which has a few hundred bars."""
    level = F.floor(F.log2("n") * 8).cast("int")
    bars = sorted(((r["level"], r["count"]) for r in words.where("n > 0").groupBy(level.alias("level")).count().collect()), reverse=True)
    least, total = None, 0
    for at, many in bars:
        total += many
        if total > most:
            break
        least = at
    return words.where(F.lit(False) if least is None else (F.col("n") > 0) & (level >= least) & (F.length("word") > 0))


@dataclass
class Head:
    """The most frequent words in order, with their counts and paths; the path of the empty word is the first."""

    words: bytes
    counts: np.ndarray
    starts: np.ndarray
    odds: np.ndarray
    layout: Layout

    @classmethod
    def of(cls, paths: DataFrame, code: Code) -> Head:
        """The base of the paths."""
        layout, found = Layout(code), paths.where("base").toArrow().sort_by("word")
        words = found["word"].to_pylist()
        odds, starts, done = [], [], 0
        for at in range(0, len(words), c.CHUNK_SLOTS):  # some at a time: unpacking takes many times their room
            one, begin = layout.unpack(words[at:at + c.CHUNK_SLOTS], found["path"][at:at + c.CHUNK_SLOTS].to_pylist())
            odds.append(one)
            starts.append(begin + done)
            done += len(one)
        odds, starts = (np.concatenate(x) if x else np.empty(0, kind) for x, kind in ((odds, np.int8), (starts, np.int64)))
        return cls(b"\n".join(words[1:]), found["n"].to_numpy()[1:], starts, odds, layout)

    def numbers(self) -> dict[bytes, int]:
        return dict(zip(self.words.split(b"\n"), range(len(self.counts))))


def pieces(text: bytes) -> list[bytes]:
    """The words of a text, cut at zero bytes: what has a path."""
    return (text.replace(b"\0", b" ") if b"\0" in text else text).split()


def wanted(parts: list[bytes], known: dict[bytes, int]) -> list[bytes]:
    """What some texts must be brought, in order: their words and the words' pieces that are not among the known ones."""
    seen: set[bytes] = set()
    for x in parts:
        seen.update(x.split())
        if b"\0" in x:
            seen.update(pieces(x))
    return sorted(seen.difference(known))


class Scorer:
    """Scores texts with the words of the head and those that come with a chunk of texts."""

    def __init__(self, head: Head, code: Code, tables: list[np.ndarray]):
        self.head, self.code, self.tables = head, code, tables
        self.number = head.numbers()
        self.head_logs = np.log10(head.counts + 1.0)
        self.odds = head.odds

    def take(self, words: list[bytes], counts: np.ndarray, packed: list[bytes | None]) -> None:
        """From now on these words, with their counts and packed paths, are at hand beside the head's."""
        there = [i for i, x in enumerate(packed) if x is not None]
        flat, begin = self.head.layout.unpack([words[i] for i in there], [packed[i] for i in there], (self.head.odds, self.head.starts))
        base, room = len(self.head.odds), self.code.bit.shape[1]
        if len(self.odds) < base + len(flat) + room:
            self.odds = np.concatenate((self.head.odds, np.zeros(2 * len(flat) + room, np.int8)))
        self.odds[base:base + len(flat)] = flat
        places = np.zeros(len(words), np.int64)
        places[there] = begin + base
        self.starts = np.concatenate((self.head.starts[1:], places))
        self.logs = np.concatenate((self.head_logs, np.log10(counts + 1.0)))
        self.own = dict(zip(words, range(len(self.head_logs), len(self.logs))))

    def find(self, words: list[bytes]) -> np.ndarray:
        """Number of each word in the head or, from the head's end on, among those at hand beside it."""
        at = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        for i in np.flatnonzero(at < 0).tolist():
            at[i] = self.own[words[i]]
        return at

    def rate(self, parts: list[bytes]):
        """Log10 probability of each text, and of its words the number, the known ones and the sum of the logarithms of their
        counts and one."""
        tokens, known, base, found = [], [], [], []
        for x in parts:
            ws = x.split()
            at = self.find(ws)
            gains = self.logs[at]
            tokens.append(len(ws))
            known.append(int(np.count_nonzero(gains)))
            base.append(math.fsum(gains.tolist()))
            found.append(self.find(pieces(x)) if b"\0" in x else at)
        paths = Paths(self.head.layout, self.odds, self.starts[np.concatenate(found)], 0)
        return score(parts, self.code, self.tables, paths), tokens, known, base


def answers(paths: DataFrame, asks: DataFrame) -> DataFrame:
    """(__chunk, part, answer): counts and paths of the words that chunks of texts ask of a range, in the words' order. Ranges of words
    and what is asked of them meet in a task, which holds the words of one range at a time."""
    none = F.lit(None)
    rows = (paths.where("not base").select("part", F.lit(-1).cast("long").alias("__chunk"), "word", "n", "path")
            .unionByName(asks.select("part", "__chunk", F.col("words").alias("word"), none.cast("long").alias("n"), none.cast("binary").alias("path"))))

    def run(batches):
        at, known = None, {}
        for batch in batches:
            out = []
            for part, chunk, word, n, path in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if part != at:
                    at, known = part, {}
                if chunk < 0:
                    known[word] = n, path
                else:
                    counts, found = zip(*map(known.__getitem__, c.opened(word).split(b"\n")))
                    sizes = np.fromiter((-1 if x is None else len(x) for x in found), np.int32, len(found))
                    out.append((chunk, part, c.squeezed(b"".join((np.array([len(found)], np.int64), np.array(counts, np.int64), sizes, *filter(None, found))))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary()))],
                                                 names=["__chunk", "part", "answer"])

    return rows.repartition("part").sortWithinPartitions("part", "__chunk").mapInArrow(run, "__chunk long, part int, answer binary")


def answered(packed: list[bytes]) -> tuple[np.ndarray, list[bytes | None]]:
    """Counts and paths that were packed in ``answers``."""
    counts, paths = [np.empty(0, np.int64)], []
    for data in map(c.opened, packed):
        n = int.from_bytes(data[:8], "little")
        counts.append(np.frombuffer(data, np.int64, n, 8))
        sizes = np.frombuffer(data, np.int32, n, 8 + 8 * n)
        ends = (np.cumsum(np.maximum(sizes, 0)) + 8 + 12 * n).tolist()
        paths += [None if size < 0 else data[end - size:end] for size, end in zip(sizes.tolist(), ends)]
    return np.concatenate(counts), paths


def score_texts(docs: DataFrame, learn: Column, keep: list[str], text: str = "text", head: int = 200_000) -> DataFrame:
    """Columns ``keep`` of every row with n_tokens, n_known, train_tokens, base_score and score.

    ``learn`` says which rows teach. All their words count, for all columns: counts and paths of the ``head`` most frequent
    ones travel to the tasks with the bit counters (both of fixed size). Texts ask for those of the rest chunk by chunk: what a chunk asks
    meets the words range by range, and the answers meet the chunk, so ``head`` has no part in the result. The counters of bytes are taught by all texts, and shared
    by more contexts the larger the corpus is.
    """
    spark = docs.sparkSession
    learn = F.coalesce(learn, F.lit(False))
    words = stored(count_words(docs, learn, text), "words")
    stats = words.where("n > 0").agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.length("word") == 0, F.col("n"))).alias("ends")).first()
    n, v, ends = stats["n"] or 0, stats["v"], stats["ends"] or 0
    weight = byte_weights(words) + 1
    weight[END] += ends
    code = Code.of(weight)
    most = frequent(words, head).select("word").toArrow()["word"].to_pylist()
    between = bounds(words, RANGE)
    paths = stored(word_paths(words, code, [b"", *(w for w in most if b"\0" not in w)], between=between), "paths")
    counted = c.gather(count_bits(docs.where(learn), text, code), 1 << SLOT_BITS, np.int8)
    tables = [counted.get(f"context{k}", np.zeros(1 << SLOT_BITS, np.int8)) for k in range(len(ORDERS))]
    held, ranges = (spark.sparkContext.broadcast(x) for x in ((Head.of(paths, code), code, tables), between))
    fall, end_score = math.log10(n + v + 1), math.log10(ends + 1)
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def ask(batches):
        number = held.value[0].numbers()
        for whole in batches:
            for at in range(0, whole.num_rows, c.ROWS):
                batch = whole.slice(at, c.ROWS)
                parts = lowered(batch, "__text")
                for a, b in c.slices(parts):
                    yield chunk(batch.slice(a, b - a), parts[a:b], number)

    def chunk(batch, parts, number):
        asked = wanted(parts, number)
        cuts = [0, *(bisect_left(asked, x) for x in ranges.value), len(asked)]
        asks = [{"part": i, "words": c.squeezed(b"\n".join(asked[a:b]))} for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        whole = pa.array([0, batch.num_rows], pa.int32())
        return pa.RecordBatch.from_arrays([*(pa.ListArray.from_arrays(whole, pa.concat_arrays([batch.column(k)])) for k in keep), pa.array([c.squeezed(b"".join(parts))], pa.binary()),
                                           pa.array([[len(x) for x in parts]], pa.list_(pa.int64())), pa.array([asks], pa.list_(pa.struct([("part", pa.int32()), ("words", pa.binary())])))],
                                          names=[*keep, "__texts", "__sizes", "__asks"])

    def rate(batches):
        scorer, found = Scorer(*held.value), []
        for whole in batches:
            for at in range(whole.num_rows):
                batch = whole.slice(at, 1)
                if batch.column("answer")[0].is_valid:  # a chunk's answers come before its texts
                    found.append(batch.column("answer")[0].as_py())
                    continue
                data, until = c.opened(batch.column("__texts")[0].as_py()), np.cumsum(batch.column("__sizes")[0].as_py()).tolist()
                parts = [data[a:b] for a, b in zip([0, *until], until)]
                scorer.take(wanted(parts, scorer.number), *answered(found))
                found = []
                out = [scorer.rate(parts[a:b]) for a, b in c.slices(parts, WORK)]
                bits, tokens, known, base = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).flatten() for k in keep), pa.array(tokens + 1, pa.int64()), pa.array(known + (ends > 0), pa.int64()),
                                                  pa.array(base + end_score - (tokens + 1) * fall, pa.float64()), pa.array(bits, pa.float64())],
                                                 names=[*keep, "n_tokens", "n_known", "base_score", "score"])

    kept, lists = ("".join(f"`{k}` {kind.format(types[k])}, " for k in keep) for kind in ("{}", "array<{}>"))
    asked = docs.select(*keep, F.col(text).alias("__text")).mapInArrow(ask, f"{lists}__texts binary, __sizes array<long>, __asks array<struct<part: int, words: binary>>")
    asked = stored(asked.withColumn("__chunk", F.monotonically_increasing_id()), "asked")
    brought = answers(paths, asked.select("__chunk", F.inline("__asks")))
    chunks = asked.select("__chunk", F.lit(len(between) + 1).alias("part"), *keep, "__texts", "__sizes").unionByName(brought, allowMissingColumns=True)
    tasks = max(spark.sparkContext.defaultParallelism, asked.count() // CHUNKS)
    rated = chunks.repartition(tasks, "__chunk").sortWithinPartitions("__chunk", "part").drop("__chunk", "part").mapInArrow(
        rate, f"{kept}n_tokens long, n_known long, base_score double, score double")
    return rated.select(*keep, "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
