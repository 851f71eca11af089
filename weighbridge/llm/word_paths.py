"""What all counted words teach about the bits behind their beginnings.

The path of a word has, for each bit of the code of its bytes, the stored log odds of a 1 behind the word so far,
and behind its last byte those for every byte in ENDS. They come from the counts of all words that
begin alike. From where a word stands alone its odds follow from its own count, and some words, the base, are at hand
wherever paths are read; so what is stored of a word is what it shares with others beyond its nearest word of the base.

Words are dealt to tasks by ranges of their bytes. Beginnings that words of several ranges share are those of the
bounds between the ranges; their counts are summed over all words first.

Cases: a word is cut at each zero byte, as contexts are; its pieces have paths and it has none. Words
without a count have the paths of the words they begin like, and nothing is known from where they leave them.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEP = 4             # bits served by one cell of counters
SCALE = 16.0         # steps per unit of a stored log odds
DOUBT = 0.4          # added to the counts behind a word so far
UNKNOWN = -128       # where nothing was counted
ENDS = b" \t\n\v\f\r\0\xff"
RANGE = 200_000      # words of a range, about
TRIED = 32           # words looked at for each bound
BOUND_BYTES = 64     # bounds are no longer than this
ROWS = 10_000
HEADER = np.dtype([("alone", "i1"), ("near", "<i4"), ("skip", "<i4")])  # odds where a word stands alone (0: not, or unknown),
#                       its nearest word of the base (-1: none) and how many odds it has from that one


class Layout:
    """Where the odds of a path stand: the bits of its bytes, then those of each of the ENDS."""

    def __init__(self, code):
        self.code = code
        ends = np.frombuffer(ENDS, np.uint8)
        size = code.size[ends]
        self.total = int(size.sum())
        self.block = np.zeros(256, np.int64)
        self.block[ends] = np.cumsum(size) - size
        # behind a word that stands alone only a space was counted: 1 and -1 on its path, 0 beside it in its cells
        own, long = code.bit[32], code.size[32]
        lone = []
        for e in ends:
            def along(d):
                return d < long and (code.bit[e, :d] == own[:d]).all()
            lone += [(1 if own[d] else -1) if along(d) else 0 if along(d - d % STEP) else UNKNOWN for d in range(code.size[e])]
        self.lone = np.array(lone, np.int16)

    def spread(self, words: list[bytes]):
        """Bytes of all words, each word's length, the place of each byte's odds, each word's first place and
        the number of odds of its bytes."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        first = np.cumsum(sizes) - sizes
        until = np.concatenate(([0], np.cumsum(self.code.size[data])))
        body = until[first + sizes] - until[first]
        start = np.cumsum(body + self.total) - (body + self.total)
        return data, sizes, until[:-1] + np.repeat(start - until[first], sizes), start, body

    def unpack(self, words: list[bytes], packed: list[bytes], base: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Paths one after the other, and where each begins. ``base`` has this of the base."""
        if not words:
            return np.empty(0, np.int8), np.empty(0, np.int64)
        data, sizes, place, start, body = self.spread(words)
        flat = np.full(int(start[-1] + body[-1]) + self.total, UNKNOWN, np.int8)
        raw = np.frombuffer(b"".join(packed), np.int8)
        own = np.fromiter(map(len, packed), np.int64, len(packed))
        head = np.cumsum(own) - own
        header = raw[head[:, None] + np.arange(HEADER.itemsize)].copy().view(HEADER).ravel()
        value, skip = header["alone"], header["skip"].astype(np.int64)
        own -= HEADER.itemsize
        kept = skip + own
        flat[spans(start + skip, own)] = raw[spans(head + HEADER.itemsize, own)]
        some = np.flatnonzero(skip)
        if len(some):
            flat[spans(start[some], skip[some])] = base[0][spans(base[1][header["near"][some]], skip[some])]
        at = np.flatnonzero((np.repeat(value, sizes) > 0) & (place >= np.repeat(start + kept, sizes)))
        symbol, place, own = data[at], place[at], np.repeat(value, sizes)[at]
        for d in range(self.code.bit.shape[1]):
            keep = np.flatnonzero(self.code.size[symbol] > d)
            symbol, place, own = symbol[keep], place[keep], own[keep]
            flat[place + d] = np.where(self.code.bit[symbol, d], own, -own)
        alone = np.flatnonzero((value > 0) & (kept <= body))
        ends = np.where(self.lone == UNKNOWN, UNKNOWN, self.lone * value[alone, None]).astype(np.int8)
        flat[(start + body)[alone, None] + np.arange(self.total)] = ends
        return flat, start

    def places(self, symbols: np.ndarray, starts: np.ndarray, empty: int) -> np.ndarray:
        """Where the odds of each symbol of some texts (that end with their marks) begin: ``starts`` has the
        path of each word, in order, ``empty`` that of the empty one."""
        ends = np.isin(np.arange(256), list(ENDS))[symbols]
        fresh = np.concatenate(([True], ends[:-1]))
        size = self.code.size[symbols]
        done = np.cumsum(size) - size
        opening = np.flatnonzero(fresh & ~ends)
        word = np.cumsum(fresh & ~ends) - 1
        out = (starts - done[opening])[word] + done if len(opening) else done.copy()
        out[fresh & ends] = empty
        return out + self.block[symbols]


def spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Numbers of ranges, one after the other."""
    return np.arange(int(size.sum())) + np.repeat(begin - np.cumsum(size) + size, size)


def stored_odds(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(SCALE * np.log((ones + DOUBT) / (zeros + DOUBT))), -127, 127).astype(np.int8)


def fill(flat: np.ndarray, at: np.ndarray, context: np.ndarray, symbol: np.ndarray, times: np.ndarray, code) -> None:
    """Odds of each entry's symbol in its context, from the counts of all entries, written from ``at`` on; entries
    with a negative ``at`` are counted only."""
    group = np.unique(context, return_inverse=True)[1]
    seen = np.zeros(len(group), bool)
    for d in range(code.bit.shape[1]):
        keep = np.flatnonzero(code.size[symbol] > d)
        if not len(keep):
            return
        if len(keep) < len(symbol):
            at, group, symbol, times, seen = (x[keep] for x in (at, group, symbol, times, seen))
        key = group * 2 + code.bit[symbol, d]
        pair = np.bincount(key, times, 2 * int(group.max()) + 2).reshape(-1, 2)
        if d % STEP == 0:
            seen = (pair.sum(axis=1) > 0)[group]
        odds = np.where(seen, stored_odds(pair[:, 1], pair[:, 0])[group], np.int8(UNKNOWN))
        own = at >= 0
        flat[at[own] + d] = odds[own]
        there = np.zeros(pair.size, np.int64)
        there[key] = 1
        group = (np.cumsum(there) - 1)[key]


def nearest(word: bytes, base: list[bytes]) -> tuple[int, int]:
    """The word of the base that begins like a word for longest, and so many bytes; the base's own words have none."""
    at = bisect_right(base, word)
    if at and base[at - 1] == word:
        return -1, 0
    best, most = -1, 0
    for i in range(max(at - 1, 0), min(at + 1, len(base))):
        other, n = base[i], most
        if other[:n] != word[:n]:
            continue
        while n < len(word) and n < len(other) and other[n] == word[n]:
            n += 1
        if n > most:
            best, most = i, n
    return best, most


def pack(words: list[bytes], spaces: np.ndarray, zeros: np.ndarray, layout: Layout, shared: dict[bytes, dict[int, int]],
         base: list[bytes] = ()) -> list[bytes]:
    """Stored paths of some words (in order, each once): a header and the odds that follow from neither the word's own
    count nor ``base``, which is in order. ``spaces`` and ``zeros`` are the counts of a word before a space and before
    a zero byte; ``shared`` has the counts of all words for beginnings that words elsewhere have too."""
    code = layout.code
    data, sizes, place, start, body = layout.spread(words)
    first = np.cumsum(sizes) - sizes
    flat = np.full(int(start[-1] + body[-1]) + layout.total, UNKNOWN, np.int8)
    kept, at, alone = body + layout.total, start.copy(), np.zeros(len(words), bool)
    ends = np.frombuffer(ENDS, np.uint8).astype(np.int64)
    active, context = np.arange(len(words)), np.zeros(len(words), np.int64)
    wide = {0: b""} if b"" in shared else {}  # contexts with words elsewhere
    level = 0
    while len(active):
        last = sizes[active] == level
        on, done = active[~last], active[last]
        symbol = data[first[on] + level]
        counts = np.zeros((len(done), len(ends)))
        counts[:, ENDS.index(b" ")], counts[:, ENDS.index(b"\0")] = spaces[done], zeros[done]
        contexts = np.concatenate((context[~last], np.repeat(context[last], len(ends))))
        symbols = np.concatenate((symbol, np.tile(ends, len(done))))
        times = np.concatenate((spaces[on] + zeros[on], counts.ravel())).astype(np.float64)
        places = np.concatenate((at[on], (at[done, None] + layout.block[ends]).ravel()))
        if wide:
            times[np.isin(contexts, list(wide))] = 0
            rows = [(c, s, n) for c, p in wide.items() for s, n in shared[p].items()]
            more = np.array(rows, np.int64).reshape(-1, 3)
            contexts, symbols = np.concatenate((contexts, more[:, 0])), np.concatenate((symbols, more[:, 1]))
            times, places = np.concatenate((times, more[:, 2])), np.concatenate((places, np.full(len(more), -1)))
        fill(flat, places, contexts, symbols, times, code)
        at[on] += code.size[symbol]
        before = context[~last]
        new = np.ones(len(on), bool)
        new[1:] = (before[1:] != before[:-1]) | (symbol[1:] != symbol[:-1])
        context = np.cumsum(new) - 1
        longer = {}
        if wide:
            for i in np.flatnonzero(new & np.isin(before, list(wide))).tolist():
                beginning = wide[int(before[i])] + bytes([int(symbol[i])])
                if beginning in shared:
                    longer[int(context[i])] = beginning
        wide = longer
        single = (np.bincount(context)[context] == 1) & (zeros[on] == 0) if len(on) else np.zeros(0, bool)
        if wide:
            single &= ~np.isin(context, list(wide))
        kept[on[single]], alone[on[single]] = (at - start)[on[single]], True
        active, context = on[~single], context[~single]
        level += 1
    header = np.zeros(len(words), HEADER)
    header["alone"] = np.where(alone, stored_odds(spaces, np.zeros(len(words))), 0)
    header["near"], common = np.array([nearest(x, base) for x in words]).T
    until = np.append(place, 0)[first + common] - start
    skip = np.minimum(np.where(common < sizes, until, body), kept)
    header["skip"] = skip
    heads, step = header.tobytes(), HEADER.itemsize
    return [heads[i * step:i * step + step] + flat[a:b].tobytes() for i, (a, b) in enumerate(zip((start + skip).tolist(), (start + kept).tolist()))]


def pieces(word: bytes, n: int) -> list[tuple[bytes, int, int]]:
    """The pieces of a word between zero bytes, each with its counts before a space and before a zero byte."""
    *some, last = word.split(b"\0")
    return [*((x, 0, n) for x in some), (last, n, 0)]


def bounds(words: DataFrame, size: int) -> list[bytes]:
    """Words between ranges of about ``size`` words; which ones they are has no part in the paths."""
    total = words.count()
    if total <= size:
        return []
    every = max(1, total // (TRIED * (total // size + 1)))
    tried = words.where((F.length("word") <= BOUND_BYTES) & (F.length("word") > 0) & (F.pmod(F.xxhash64("word"), F.lit(every)) == 0)).select("word").collect()
    return sorted({bytes(r["word"]) for r in sorted(tried)[TRIED::TRIED] if b"\0" not in r["word"]})


def count_beginnings(words: DataFrame, beginnings: set[bytes]) -> dict[bytes, dict[int, int]]:
    """How often each byte follows these beginnings (with one, all its own beginnings are among them)."""
    out: dict[bytes, dict[int, int]] = {x: {} for x in beginnings}
    if not beginnings:
        return out

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for piece, space, zero in pieces(word, n) if n and word else ():
                    for i in range(len(piece)):
                        if piece[:i] not in beginnings:
                            break
                        seen[piece[:i], piece[i]] += n
                    else:
                        if piece in beginnings:
                            seen[piece, 32 if space else 0] += n
        rows = [(x, s, n) for (x, s), n in seen.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int32()),
                                          pa.array([r[2] for r in rows], pa.int64())], names=["beginning", "symbol", "n"])

    counted = words.select("word", "n").mapInArrow(count, "beginning binary, symbol int, n long").groupBy("beginning", "symbol").agg(F.sum("n").alias("n"))
    for r in counted.collect():
        out[bytes(r["beginning"])][r["symbol"]] = r["n"]
    return out


def word_paths(words: DataFrame, code, base: list[bytes] = (), size: int = RANGE, between: list[bytes] | None = None) -> DataFrame:
    """(word, n, path, base: whether it is a word of the base, part: number of its range) of all counted words, and of the empty one if it
    is among them; a word with a zero byte has no path, its pieces have (with n 0 if they are no words). ``between``: the ranges' bounds."""
    spark = words.sparkSession
    between = bounds(words, size) if between is None else between
    shared = count_beginnings(words, {x[:i] for x in between for i in range(len(x))})
    base = sorted(base)
    held = spark.sparkContext.broadcast((between, shared, Layout(code), base))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        between = held.value[0]
        for batch in batches:
            rows = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if b"\0" in word:
                    rows.append((word, 0, 0, n))
                    rows += [(*piece, 0) for piece in pieces(word, n)]
                else:
                    rows.append((word, n if word else 0, 0, n))
            if rows:
                found = [r[0] for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([bisect_right(between, x) for x in found], pa.int32()), pa.array(found, pa.binary()),
                                                  *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2, 3))], names=["part", "word", "spaces", "zeros", "n"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, shared, layout, base = held.value
        part, rows = None, []
        for batch in batches:
            for p, *row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if p != part:
                    yield from finished(part, rows, layout, shared, base)
                    part, rows = p, []
                if rows and rows[-1][0] == row[0]:
                    rows[-1] = [row[0], *(a + b for a, b in zip(rows[-1][1:], row[1:]))]
                else:
                    rows.append(row)
        yield from finished(part, rows, layout, shared, base)

    def finished(part, rows, layout, shared, base):
        whole, own = [r for r in rows if b"\0" not in r[0]], {*base}
        made = pack([r[0] for r in whole], *(np.array([r[k] for r in whole], np.int64) for k in (1, 2)), layout, shared, base) if whole else []
        out = [(r[0], r[3], path, r[0] in own) for r, path in zip(whole, made)]
        out += [(r[0], r[3], None, False) for r in rows if b"\0" in r[0]]
        for at in range(0, len(out), ROWS):
            some = out[at:at + ROWS]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], pa.binary()), pa.array([r[1] for r in some], pa.int64()),
                                              pa.array([r[2] for r in some], pa.binary()), pa.array([r[3] for r in some], pa.bool_()), pa.array([part] * len(some), pa.int32())],
                                             names=["word", "n", "path", "base", "part"])

    dealt = words.select("word", "n").mapInArrow(deal, "part int, word binary, spaces long, zeros long, n long")
    return dealt.repartition("part").sortWithinPartitions("part", "word").mapInArrow(build, "word binary, n long, path binary, base boolean, part int")
