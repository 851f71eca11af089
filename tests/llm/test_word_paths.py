"""What words teach about their beginnings against counters kept one by one."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weighbridge.llm import mixing as m
from weighbridge.llm import word_paths as w

from fixtures import ODD, prose
from test_mixing_scalar import cell, context, lane


def vocabulary():
    r = random.Random(4)
    counts = Counter(x for i, lang in enumerate(["en", "de", "fr"] * 20) for x in prose(i, 60, lang).encode().split())
    counts.update({x: r.randint(1, 9) for x in (b"a", b"ab", b"abc", b"abcd" * 30, b"abcd" * 30 + b"e", b"x\0y", b"x", b"\0", b"y\0\0the", "日本語".encode(), "日本".encode())})
    return {**counts, b"abx": 0, b"unheard": 0, b"theth\xc3\xa9x": 0, b"only\0here": 0, b"": 7}


def code_of(words):
    weight = np.ones(256)
    for word, n in words.items():
        np.add.at(weight, np.frombuffer(word + b" ", np.uint8), n)
    return m.Code.of(weight)


def counters(words, code):
    """Per beginning and path of bits how often the next bit was 0 or 1."""
    out = defaultdict(lambda: [0, 0])
    for word, n in words.items():
        beginning = b""
        for symbol in word + b" " if word else b"":
            bits = code.bit[symbol, :code.size[symbol]].tolist()
            for d, bit in enumerate(bits):
                out[beginning, tuple(bits[:d])][bit] += n
            beginning = b"" if symbol == 0 else beginning + bytes([symbol])
    return out


def odds(seen, code, beginning, symbol, d):
    """(known, odds) of the d-th bit of a symbol behind the beginning of a word."""
    bits = code.bit[symbol, :code.size[symbol]].tolist()
    if not sum(seen.get((beginning, tuple(bits[:d - d % m.STEP])), [0])):
        return 0, 0
    zero, one = seen.get((beginning, tuple(bits[:d])), [0, 0])
    return 1, max(-127, min(127, round(m.SCALE * math.log((one + m.DOUBT) / (zero + m.DOUBT)))))


def brute_path(seen, code, word):
    steps = [(word[:i], word[i]) for i in range(len(word))] + [(word, e) for e in w.ENDS]
    found = [odds(seen, code, b, s, d) for b, s in steps for d in range(code.size[s])]
    return [value if known else w.UNKNOWN for known, value in found]


@pytest.mark.parametrize("size", [10 ** 6, 25])
def test_paths(spark, monkeypatch, size):
    """In one range, and in many whose words share beginnings."""
    monkeypatch.setattr(w, "TRIED", 3)
    words = vocabulary()
    base = [] if size > 25 else [x for x in words if b"\0" not in x][::5]
    code = code_of(words)
    seen, layout = counters(words, code), w.Layout(code)
    frame = spark.createDataFrame([(bytearray(x), n) for x, n in words.items()], "word binary, n long")
    assert (len(w.bounds(frame, size)) > 9) == (size == 25)
    rows = w.word_paths(frame, code, base, size).collect()
    got = {bytes(r["word"]): (r["n"], r["path"]) for r in rows}
    assert sorted(bytes(r["word"]) for r in rows if r["base"]) == sorted(base)
    assert len(got) == len(rows) and set(got) == {*words, *(p for x in words for p in x.split(b"\0"))}
    names = sorted(x for x in got if b"\0" not in x)
    at_hand = layout.unpack(sorted(base), [bytes(got[x][1]) for x in sorted(base)])
    flat, start = layout.unpack(names, [bytes(got[x][1]) for x in names], at_hand)
    for x, begin, end in zip(names, start, [*start[1:], len(flat)]):
        assert got[x][0] == words.get(x, 0)
        assert flat[begin:end].tolist() == brute_path(seen, code, x), x
    assert all(got[x] == (words[x], None) for x in words if b"\0" in x)


def test_scores_with_paths_bit_by_bit(spark):
    words = vocabulary()
    code = code_of(words)
    seen, layout = counters(words, code), w.Layout(code)
    texts = [(t or "").encode() for t in ODD] + [b" the  a\n", b"x\0y z\0 "] + [prose(i, 40, lang).encode() for i, lang in enumerate(["en", "de", "fr"])]
    totals = [np.zeros(2 << m.SLOT_BITS, np.int32) for _ in m.ORDERS]
    m.tally(texts[-9:], code, totals)
    tables = [m.odds(t) for t in totals]
    some = sorted({b"", *(p for x in texts for p in m.pieces(x))})
    frame = spark.createDataFrame([(bytearray(x), words.get(x, 0)) for x in {*words, *some}], "word binary, n long")
    path = {bytes(r["word"]): r["path"] for r in w.word_paths(frame, code).collect()}
    flat, start = layout.unpack(some, [bytes(path[x]) for x in some])
    at = dict(zip(some, start.tolist()))
    starts = np.array([at[p] for x in texts for p in m.pieces(x)])
    got = m.score(texts, code, tables, m.Paths(layout, np.append(flat, np.zeros(99, np.int8)), starts, at[b""]))

    def inputs(text, begun, i, d):
        symbol = text[i]
        entry, place, bit = int(code.entry[symbol, d // m.STEP]), int(code.place[symbol, d]), int(code.bit[symbol, d])
        xs = [float(t[cell(context(text, i, order, k), entry, m.SLOT_BITS) + place]) for k, (t, order) in enumerate(zip(tables, m.ORDERS))]
        known, value = odds(seen, code, begun[i], symbol, d)
        return bit, [*xs, float(value)], float(known)

    for text, value in zip(texts, got):
        text += bytes([m.END])
        begun, now = [], b""
        for symbol in text:
            begun.append(now)
            now = b"" if symbol in w.ENDS else now + bytes([symbol])
        want = 0.0
        for first in range(0, len(text), m.SEGMENT):
            places = range(first, min(len(text), first + m.SEGMENT))
            for d in range(m.STEP):
                rows = [places[i:i + m.BLOCK] for i in range(0, len(places), m.BLOCK)]
                want += lane([[inputs(text, begun, i, d) for i in row if code.size[text[i]] > d] for row in rows])
            rest = [inputs(text, begun, i, d) for d in range(m.STEP, code.place.shape[1]) for i in places if code.size[text[i]] > d]
            want += lane([rest[i:i + m.BLOCK] for i in range(0, len(rest), m.BLOCK)])
        assert value == pytest.approx(want, rel=2e-4, abs=1e-4)


def test_words_beyond_the_head_teach_the_score(spark):
    rows = [(i, prose(i % 25, 60) + f" rareword{i % 30}" * 2) for i in range(60)] + [(500 + i, t) for i, t in enumerate(ODD)] + [(900, "unheard rarewords")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole, joined = ({r["doc_id"]: (r["score"], r["n_known"]) for r in m.score_texts(docs, F.col("doc_id") % 7 != 2, ["doc_id"], head=head).collect()} for head in (200_000, 3))
    assert set(whole) == {i for i, _ in rows}
    for key, (score, known) in whole.items():
        assert joined[key] == (pytest.approx(score, rel=1e-4), known)


def test_a_chunk_of_texts_asks_once_for_a_word(spark, monkeypatch):
    """What is written and shuffled for words beyond the head grows with the words of a chunk, not with those of its texts."""
    monkeypatch.setattr(w, "TRIED", 3)
    monkeypatch.setattr(m, "RANGE", 25)
    rare = " ".join(f"rareword{i}" for i in range(90)) + " rare\0word \0 é"
    rows = [(i, f"{rare} {prose(i, 9)}") for i in range(40)] + [(100, ""), (101, None), (102, "unheard rareword7 \0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    asked, answers = [], m.answers
    monkeypatch.setattr(m, "answers", lambda paths, asks: asked.append(asks) or answers(paths, asks))
    whole, joined = ({r["doc_id"]: (r["score"], r["n_known"], r["base_score"]) for r in m.score_texts(docs, F.col("doc_id") < 90, ["doc_id"], head=head).collect()} for head in (200_000, 3))
    words = Counter(x for r in asked[1].collect() for x in m.c.opened(bytes(r["words"])).split(b"\n"))
    assert len({r["part"] for r in asked[1].collect()}) > 3 and 1 < max(words.values()) <= asked[1].select("__chunk").distinct().count() <= 4
    assert set(whole) == {i for i, _ in rows}
    for key, (score, known, base) in whole.items():
        assert joined[key] == (pytest.approx(score, rel=1e-4), known, pytest.approx(base))


def test_packed_counts():
    counts = np.array([0, 1, 255, 256, 65_536, 2 ** 31 - 1, 0], np.int32)
    assert m.c.opened_counts(m.c.squeezed_counts(counts)).tolist() == counts.tolist()
    assert m.c.opened(m.c.squeezed(b"")) == b""
