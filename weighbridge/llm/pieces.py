"""Sentence pieces with byte offsets: encoding and decoding with a compiled BPE model.

The model file is read here: its character map (a compiled trie of replacements), its pieces with
their scores, and its flags. A text is normalised by the longest prefix that the map knows; each
normalised character remembers the bytes of the text it came from, and so every piece is given
back as a span of original bytes. Merging follows piece scores, the leftmost pair first among equals.

Cases: a null text is empty and has no pieces. Characters without a piece become byte pieces. Very long texts are merged word by word, or with
a heap where a word is long. Other columns pass through; columns named like an output are replaced.
"""

from __future__ import annotations

import heapq
import re
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as c

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # kinds of pieces, fixed by the file format
NEVER = float("inf")
WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
LONG = 64            # words from this length on are merged with a heap and not remembered
REMEMBERED = 400_000  # words, about 100 MB


def _varint(data: bytes, at: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def fields(data: bytes):
    """(number, value) of each field of an encoded message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 5:
            value, at = struct.unpack_from("<f", data, at)[0], at + 4
        elif kind == 1:
            value, at = struct.unpack_from("<d", data, at)[0], at + 8
        else:
            size, at = _varint(data, at)
            value, at = data[at:at + size], at + size
        yield tag >> 3, value


@dataclass
class CharMap:
    """A compiled map of replacements: a double-array trie over UTF-8 bytes whose values are places
    in a block of zero-terminated strings."""

    units: tuple[int, ...] = ()
    block: bytes = b""

    @classmethod
    def read(cls, blob: bytes) -> CharMap:
        if not blob:
            return cls()
        size = struct.unpack_from("<I", blob)[0]
        return cls(struct.unpack_from(f"<{size // 4}I", blob, 4), blob[4 + size:])

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest known prefix of ``data`` from ``at`` on."""
        best, node = None, 0
        if not self.units:
            return None
        unit = self.units[0]
        node ^= (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                best = i + 1 - at, self.units[node] & 0x7FFFFFFF
        if best is None:
            return None
        return best[0], self.block[best[1]:self.block.index(0, best[1])]


@dataclass
class Model:
    pieces: list[str] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    rank: dict[str, tuple[float, int]] = field(default_factory=dict)  # mergeable pieces: (-score, id)
    cost: dict[str, float] = field(default_factory=dict)
    byte_ids: dict[int, int] = field(default_factory=dict)
    unknown: int = 0
    charmap: CharMap = field(default_factory=CharMap)
    dummy_prefix: bool = True
    trim: bool = True
    escape: bool = True
    suffix: bool = False
    splits: bool = False  # no piece goes from a word into the next

    @classmethod
    def read(cls, path: str) -> Model:
        """The model of a .model file; an error for other kinds of models than BPE."""
        with open(path, "rb") as f:
            return cls.parse(f.read())

    @classmethod
    def parse(cls, data: bytes) -> Model:
        m, kind = cls(), 1
        for number, value in fields(data):
            if number == 1:
                got = dict(fields(value))
                m.pieces.append(got.get(1, b"").decode())
                m.kinds.append(got.get(3, NORMAL))
                m.rank.update({m.pieces[-1]: (-got.get(2, 0.0), len(m.pieces) - 1)} if m.kinds[-1] == NORMAL else {})
            elif number == 2:
                got = dict(fields(value))
                kind, m.suffix = got.get(3, 1), bool(got.get(24, 0))
            elif number == 3:
                got = dict(fields(value))
                m.charmap = CharMap.read(got.get(2, b""))
                m.dummy_prefix, m.trim, m.escape = (bool(got.get(i, 1)) for i in (3, 4, 5))
        if kind != 2 or m.suffix or {USER, UNUSED} & set(m.kinds):
            raise ValueError("only BPE models without user-defined or unused pieces and with leading space marks are read")
        if m.kinds.count(BYTE) != 256:
            raise ValueError("only models with a piece for each byte are read")
        m.unknown = m.kinds.index(UNKNOWN)
        m.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(m.pieces, m.kinds)) if k == BYTE}
        m.cost = {p: r[0] for p, r in m.rank.items()}
        m.splits = not any(SPACE in p.lstrip(SPACE) for p in m.rank)
        return m

    # -- normalisation ----------------------------------------------------------------------

    def normalise(self, text: str) -> tuple[str, list[int]]:
        """Normalised text, and for each of its characters the byte of the original that it starts at
        (one more entry for the end)."""
        data = text.encode()
        out: list[str] = []
        where: list[int] = []
        at = 0
        mark = SPACE if self.escape else " "

        def put(piece: str, start: int) -> None:
            for ch in piece:
                if ch == " ":
                    if self.trim and (not out or out[-1] == mark):
                        continue
                    out.append(mark)
                else:
                    out.append(ch)
                where.append(start)

        steps: list[tuple[str, int]] = []
        while at < len(data):
            hit = self.charmap.longest(data, at)
            if hit:
                size, piece = hit[0], hit[1].decode()
            else:
                size = 1 if data[at] < 128 else 2 if data[at] < 224 else 3 if data[at] < 240 else 4
                piece = data[at:at + size].decode()
            steps.append((piece, at))
            at += size
        if self.trim:
            while steps and steps[0][0] in (" ", ""):
                steps.pop(0)
        if steps and self.dummy_prefix:
            out.append(mark)
            where.append(steps[0][1])
        if self.trim and steps and self.dummy_prefix:
            steps[0] = (steps[0][0].lstrip(" "), steps[0][1])
        for piece, start in steps:
            put(piece, start)
        end = len(data)
        if self.trim:
            while out and out[-1] == mark:
                out.pop()
                end = where.pop()
        where.append(end)
        return "".join(out), where

    def plain(self) -> bool:
        """No replacements and no trimming: only spaces change, so offsets are those of the text."""
        return not self.charmap.units and not self.trim and self.escape

    # -- merging ----------------------------------------------------------------------------

    def merge(self, word: str) -> list[str]:
        """Pieces of a word: the best-scored pair is merged first, the leftmost among equals."""
        if len(word) >= LONG:
            return self._merge_heap(word)
        parts, cost = list(word), self.cost
        costs = [cost.get(x + y, NEVER) for x, y in zip(parts, parts[1:])]
        while costs:
            best = min(costs)
            if best == NEVER:
                break
            i = costs.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i:
                costs[i - 1] = cost.get(parts[i - 1] + parts[i], NEVER)
            if i < len(costs):
                costs[i] = cost.get(parts[i] + parts[i + 1], NEVER)
        return parts

    def _merge_heap(self, word: str) -> list[str]:
        parts: list[str] = list(word)
        before, after = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0:
                both = parts[i] + parts[j]
                r = self.rank.get(both)
                if r is not None:
                    heapq.heappush(heap, (r[0], i, j, both))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if not parts[i] or not parts[j] or after[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p]

    def ids(self, pieces: list[str]) -> list[int]:
        """Ids of pieces; a character without a piece becomes its bytes."""
        out: list[int] = []
        for p in pieces:
            r = self.rank.get(p)
            if r is not None:
                out.append(r[1])
            else:
                out += [self.byte_ids[b] for b in p.encode()]
        return out

    def words(self, text: str) -> list[str]:
        """Normalised text in parts that merge on their own."""
        return WORD.findall(text) if self.splits else [text] if text else []

    # -- decoding ---------------------------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        """Text of ids: marks become spaces, the leading one goes, byte pieces are read as UTF-8
        with U+FFFD for every byte that doesn't fit."""
        out: list[str] = []
        run = bytearray()
        lead = self.dummy_prefix or self.trim
        for i in ids:
            if self.kinds[i] == BYTE:
                run.append(int(self.pieces[i][3:5], 16))
                continue
            if run:
                out.append(utf8(bytes(run)))
                run.clear()
            if self.kinds[i] == CONTROL:
                continue
            piece = " ⁇ " if i == self.unknown else self.pieces[i]
            if lead and not any(out) and piece.startswith(SPACE):
                piece = piece[1:] if not self.trim else piece.lstrip(SPACE)
                lead = self.trim
            out.append(piece.replace(SPACE, " "))
        if run:
            out.append(utf8(bytes(run)))
        return "".join(out)


def utf8(data: bytes) -> str:
    """Bytes as text; each byte that starts no whole character becomes one U+FFFD."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at:at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


class Encoder:
    """A model with the words it has met; forgets them all when there are too many."""

    def __init__(self, model: Model):
        self.model, self.plain = model, model.plain()
        self.known: dict[str, tuple[int, ...]] = {}
        self.size = np.array([1 if k in (BYTE, UNKNOWN) else len(p) for p, k in zip(model.pieces, model.kinds)], np.int64)
        self.byte = np.array([int(p[3:5], 16) if k == BYTE else -1 for p, k in zip(model.pieces, model.kinds)])
        self.bytes = [b"" if k == CONTROL else bytes([int(p[3:5], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN
                      else p.replace(SPACE, " ").encode() for p, k in zip(model.pieces, model.kinds)]

    def word(self, w: str) -> tuple[int, ...]:
        got = self.known.get(w)
        if got is None:
            got = tuple(self.model.ids(self.model.merge(w)))
            if len(w) < LONG:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[w] = got
        return got

    def sizes(self, ids: np.ndarray) -> np.ndarray:
        """Normalised characters that each id stands for: of a character's bytes, the last has it."""
        size, byte = self.size[ids], self.byte[ids]
        more = (byte[:-1] >= 0) & (byte[1:] >= 0x80) & (byte[1:] < 0xC0)
        size[:-1][more] = 0
        return size

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """As the model's; a model without replacements changes spaces only, which needs no steps."""
        if not self.plain:
            normal, where = self.model.normalise(text)
            return normal, np.array(where, np.int32)
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        size = 1 + (code >= 0x80).astype(np.int32) + (code >= 0x800) + (code >= 0x10000)
        lead = int(self.model.dummy_prefix and bool(text))
        where = np.zeros(len(code) + 1 + lead, np.int32)
        np.cumsum(size, out=where[1 + lead:])
        return SPACE * lead + text.replace(" ", SPACE), where

    def encode(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Ids and, for each, the first byte and the byte after the last of its part of the text."""
        normal, where = self.normalise(text)
        ids: list[int] = []
        get, word = self.known.get, self.word
        for w in self.model.words(normal):
            ids += get(w) or word(w)
        at = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.sizes(np.array(ids, np.int64)), out=at[1:])
        places = where[at]
        return ids, places[:-1], places[1:]

    def decode(self, ids: list[int]) -> str:
        """As the model's: pieces are joined as bytes, and taken one by one only if they don't fit."""
        m = self.model
        if not ids or m.trim or m.kinds[ids[0]] != NORMAL:
            return m.decode(ids)
        data = b"".join(map(self.bytes.__getitem__, ids))
        if m.dummy_prefix and m.pieces[ids[0]].startswith(SPACE):
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return m.decode(ids)


def _lists(rows: list, kind=pa.int32()) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    values = np.concatenate([np.asarray(r, np.int32) for r in rows]) if rows else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _worker(held, cache: dict) -> Encoder:
    if "encoder" not in cache:
        cache["encoder"] = Encoder(held.value)
    return cache["encoder"]


def encode(docs: DataFrame, model: Model, text: str = "text", decoded: bool = False) -> DataFrame:
    """``docs`` with ids, starts and ends (byte offsets of each piece in the text's UTF-8); with
    ``decoded`` also the text that the ids give back."""
    held, cache = docs.sparkSession.sparkContext.broadcast(model), {}  # size of the model file

    def answer(batch: pa.RecordBatch) -> list:
        e = _worker(held, cache)
        got = [e.encode(t) for t in c.texts(batch, text)]
        out = [_lists([g[i] for g in got]) for i in range(3)]
        return [*out, pa.array([e.decode(g[0]) for g in got], pa.string())] if decoded else out

    more = ", decoded string" if decoded else ""
    return c.add_columns(docs, f"ids array<int>, starts array<int>, ends array<int>{more}", answer)


def decode(docs: DataFrame, model: Model, ids: str = "ids") -> DataFrame:
    """``docs`` with decoded, the text of an array of ids; null ids are no ids."""
    held, cache = docs.sparkSession.sparkContext.broadcast(model), {}

    def answer(batch: pa.RecordBatch) -> list:
        e = _worker(held, cache)
        return [pa.array([e.decode(x or []) for x in batch.column(ids).to_pylist()], pa.string())]

    return c.add_columns(docs, "decoded string", answer)
