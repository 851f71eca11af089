"""Periodic runs of words: stretches whose smallest period q repeats four times or more.

A run [s, e) has words q apart alike, is at least max(LEAST, 4 * q) long, has no smaller period, and no
neighbouring word extends it. Runs are found over the texts of a batch at once, one behind the other
with a separator of its own behind each, so no window, context or run reaches into another text:

* Periods below ``FIRST`` come from comparing words that far apart.
* For each scale t = FIRST, 2 * FIRST, ... a string synchronising set: place i is in it if the least
  hash among the windows of t words that begin in [i, i + t] begins at i or at i + t. Windows inside a
  known run with a period of t / 4 or less (highly periodic regions, known from the steps before) take no part.
  Membership depends on the 2t words from i alone, and every run with a period in [t, 2t) has two places
  one period apart among them. So each pair of successive places with equal contexts of 2t words that are t to
  2t - 1 apart proposes its distance as a period; the words decide, and tell how far the run goes.

Hashes only propose; words are compared as numbers that a task gives to distinct words, so every run
reported is exact (that one is hidden needs two different contexts with the same 64 bits in one text). Work
is O(n) per scale plus the lengths of the runs. A text is one row's, so its runs are found in one task;
a batch holds about SLICE_BYTES of text at a time, a longer text stands alone.

Cases: null and empty texts have no words and no runs; repeated rows are each answered; columns of the
input stay, but for those named like a new one (in any case of letters), which are replaced; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as c

FIRST = 4      # periods below are compared directly; the first scale
LEAST = 6      # words of a run, at least
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Numbers(dict):
    """A number for each distinct word."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def laid_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Numbered words of texts behind each other, a separator of its own (negative) behind each, and where each
    text begins."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]) if len(texts) else 0, np.int64)
    out[ends - 1] = -1 - np.arange(len(texts))
    inside = np.ones(len(out), bool)
    inside[ends - 1] = False
    out[inside] = np.concatenate(texts) if texts else 0
    return out, ends - sizes


def stretches(t: np.ndarray, q: int, least: int) -> list[tuple[int, int]]:
    """Maximal [s, e) with period q of which ``least`` or more words have their like q further on."""
    at = np.flatnonzero(t[:-q] == t[q:]) if len(t) > q else np.empty(0, np.int64)
    if not len(at):
        return []
    new = np.flatnonzero(np.concatenate(([True], np.diff(at) > 1)))
    size = np.diff(np.append(new, len(at)))
    long = size >= least
    return [(int(s), int(s + n + q)) for s, n in zip(at[new[long]], size[long])]


def reach(t: np.ndarray, i: int, q: int) -> tuple[int, int]:
    """The maximal stretch [s, e) with period q around the pair of words i and i + q (equal)."""
    lo, size = i, 64
    while lo > 0:
        step = min(size, lo)
        off = np.flatnonzero(t[lo - step:lo] != t[lo - step + q:lo + q])
        if len(off):
            lo = lo - step + int(off[-1]) + 1
            break
        lo, size = lo - step, size * 2
    hi, size = i, 64
    while hi + q < len(t):
        step = min(size, len(t) - q - hi)
        off = np.flatnonzero(t[hi:hi + step] != t[hi + q:hi + q + step])
        if len(off):
            hi += int(off[0])
            break
        hi, size = hi + step, size * 2
    return lo, hi + q


def primitive(t: np.ndarray, s: int, q: int) -> bool:
    """Whether q is the smallest period of a stretch from s on that repeats it four times (a smaller one divides q)."""
    rest, p = q, 2
    while rest > 1:
        if p * p > rest:
            p = rest
        if rest % p == 0:
            d = q // p
            if (t[s:s + 2 * q - d] == t[s + d:s + 2 * q]).all():
                return False
            while rest % p == 0:
                rest //= p
        p += 1
    return True


def least_of(values: np.ndarray, size: int) -> np.ndarray:
    """Least value of every window of ``size``, by doubling."""
    width = 1
    while width < size:
        step = min(width, size - width)
        values = np.minimum(values[step:], values[:-step])
        width += step
    return values


def synchronising(h: np.ndarray, tau: int, periodic: list[tuple[int, int]]) -> np.ndarray:
    """Places of the synchronising set, from the hashes of the windows of tau words; windows that begin in
    one of the ranges ``periodic`` take no part."""
    if len(h) <= tau:
        return np.empty(0, np.int64)
    if periodic:
        h = h.copy()
        for s, e in periodic:
            h[s:e] = NONE
    least = least_of(h, tau + 1)
    return np.flatnonzero(((h[:-tau] == least) | (h[tau:] == least)) & (least != NONE))


def proposals(t: np.ndarray, h: np.ndarray, contexts: np.ndarray, tau: int, periodic: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of successive places with equal contexts that are tau to 2 tau - 1 apart, by distance."""
    at = synchronising(h, tau, periodic)
    at = at[at < len(contexts)]
    found = contexts[at]
    order = np.argsort(found, kind="stable")
    at, found = at[order], found[order]
    step = np.diff(at)
    hit = np.flatnonzero((found[1:] == found[:-1]) & (step >= tau) & (step < 2 * tau))
    at, step = at[hit], step[hit]
    hit = t[at] == t[at + step]
    at, step = at[hit], step[hit]
    order = np.lexsort((at, step))
    return at[order], step[order]


def doubled(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of windows of 2 * size words from those of ``size``."""
    if len(h) <= size:
        return h[:0]
    out = h[:-size] * np.uint64(0x9E3779B97F4A7C15)
    out += h[size:]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def runs(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each text of numbered words, by start, then period."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))  # those too short for a scale are at the end
    t, begins = laid_out([texts[i] for i in order])
    found: list[tuple[int, int, int]] = []  # (s, e, q) with e - s >= 4 * q
    for q in range(1, FIRST):
        found += [(s, e, q) for s, e in stretches(t, q, 3 * q) if primitive(t, s, q)]
    sizes = [len(texts[i]) for i in order]
    h, size, many = c.mix(t - (1 << 40)), 1, len(order)  # no word has hash 0
    while size < FIRST:
        h, size = doubled(h, size), size * 2
    while True:
        while many and sizes[many - 1] < 4 * size:
            many -= 1
        if not many:
            break
        end = int(begins[many]) if many < len(begins) else len(t)
        t, h = t[:end], h[:end]
        contexts = doubled(h, size)
        periodic = [(s, e - size + 1) for s, e, q in found if 4 * q <= size <= e - s and e <= end]
        low = high = last = 0
        for i, q in zip(*(x.tolist() for x in proposals(t, h, contexts, size, periodic))):
            if q == last and low <= i < high - q:  # in the stretch before
                continue
            low, high = reach(t, i, q)
            last = q
            if high - low >= 4 * q and primitive(t, low, q):
                found.append((low, high, q))
        h, size = contexts, size * 2
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    owner = np.searchsorted(begins, np.array([s for s, _, _ in found], np.int64), side="right") - 1
    for (s, e, q), k in zip(found, owner.tolist()):
        if e - s >= LEAST:
            out[order[k]].append((s - int(begins[k]), e - s, q))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def strongest(found: list[tuple[int, int, int]]) -> int | None:
    """Place of the run with the greatest length / period; ties by start, then period."""
    if not found:
        return None
    return max(range(len(found)), key=lambda k: (Fraction(found[k][1], found[k][2]), -found[k][0], -found[k][2]))


def collapse(docs: DataFrame, text: str = "text", rearrange: tuple[str, Callable[[int, int], np.ndarray | None]] | None = None,
             leave_out: tuple[str, ...] = ()) -> DataFrame:
    """All columns (but ``leave_out``) with runs (array of start, length, period, in words), strongest (place of the run with the
    greatest exponent, null without runs), and collapsed: the words, joined by one space, without those that
    a run contains after its first period.

    ``rearrange`` (a column and a function of its value and the number of words) may give, for a text,
    the words to take instead: an array of word numbers, or None for the words as they are.
    """
    numbers = Numbers()
    column, given = rearrange or (None, None)

    def make(batch: pa.RecordBatch) -> list:
        parts = c.raw(batch, text)
        keys = batch.column(column).to_pylist() if column else [None] * len(parts)
        every, best, left = [], [], []
        for a, b in c.slices(parts):
            if len(numbers) > c.CACHED_WORDS:
                numbers.clear()
            words = [x.split() for x in parts[a:b]]
            for k, w in enumerate(words):
                places = given(keys[a + k], len(w)) if given else None
                if places is not None:
                    words[k] = [w[i] for i in places.tolist()]
            found = runs([np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in words])
            for w, r in zip(words, found):
                every.append([{"start": s, "length": n, "period": q} for s, n, q in r])
                best.append(strongest(r))
                if r:
                    keep = np.ones(len(w), bool)
                    for s, n, q in r:
                        keep[s + q:s + n] = False
                    w = [w[i] for i in np.flatnonzero(keep).tolist()]
                left.append(b" ".join(w))
        return [pa.array(every, pa.list_(RUN)), pa.array(best, pa.int32()), pa.array(left, pa.binary()).cast(pa.string())]

    return c.add_columns(docs, "runs array<struct<start:long,length:long,period:long>>, strongest int, collapsed string", make, extra=leave_out)
