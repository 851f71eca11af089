"""The mixed score against a version that goes bit by bit."""

import functools
import math
import random

import numpy as np
import pytest

from weighbridge.llm import mixing as m

from fixtures import ODD, prose

WORD = 0xFFFFFFFF


def context(text, at, order, k):
    h = k + 1
    for j in range(1, order + 1):
        h = (h + (text[at - j] if at >= j else 0)) * 0x9E3779B1 & WORD
        h ^= h >> 15
    return h


@functools.cache
def words_so_far(text):
    """For each place the hash of the bytes since the last space: a polynomial, one byte at a time."""
    out, total, power = [], 0, 0x01000193
    for byte in text:
        h = total ^ (total >> 16)
        out.append(h * 0x85EBCA6B & WORD)
        total, power = (total + (byte + 1) * power) & WORD, power * 0x01000193 & WORD
        if byte in b" \t\n\v\f\r" or byte in (0, m.END):
            total, power = 0, 0x01000193
    return out


def cell(h, entry, bits):
    x = (h ^ (entry * 0xC2B2AE35 & WORD)) * 0x27D4EB2F & WORD
    return (x >> (32 - bits + m.STEP)) << m.STEP


def mark(h, entry):
    x = (h + entry) * 0x9E3779B1 & WORD
    x ^= x >> 13
    x = x * 0xC2B2AE3D & WORD
    return (x >> 25) | 1


def inputs(text, at, d, code, tables):
    """(bit, values of the contexts, whether the word is known) of the d-th bit of the symbol at a place."""
    symbol = text[at]
    entry, place, bit = int(code.entry[symbol, d // m.STEP]), int(code.place[symbol, d]), int(code.bit[symbol, d])
    xs = [float(t[cell(context(text, at, order, k), entry, m.SLOT_BITS) + place]) for k, (t, order) in enumerate(zip(tables, m.ORDERS))]
    h = words_so_far(text)[at]
    base = cell(h, entry, m.WORD_BITS)
    known = float(tables[-1][base] == np.int8(mark(h, entry)))
    return bit, [*xs, float(tables[-1][base + place]) * known], known


def lane(blocks):
    """Log10 probability of blocks of bits; the weights are refined behind each block."""
    orders = len(m.ORDERS)
    w = [x / m.SCALE for x in m.START]
    total = 0.0
    for bits in blocks:
        slopes = [0.0] * len(w)
        for bit, xs, known in bits:
            z = sum(x * (w[k] + known * w[orders + k]) for k, x in enumerate(xs[:orders])) + xs[orders] * w[-1]
            s = 2 * bit - 1
            p = 1 / (1 + math.exp(min(-s * z, 30)))
            total += math.log10(p)
            wrong = s * (1 - p) * m.RATE / m.SCALE ** 2
            for k, x in enumerate(xs[:orders]):
                slopes[k] += wrong * x
                slopes[orders + k] += wrong * known * x
            slopes[-1] += wrong * xs[orders]
        w = [a + b for a, b in zip(w, slopes)]
    return total


def brute(text, code, tables):
    text = text + bytes([m.END])
    total = 0.0
    for begin in range(0, len(text), m.SEGMENT):
        places = range(begin, min(len(text), begin + m.SEGMENT))
        for d in range(m.STEP):  # a lane for each of the first bits: blocks of symbols
            rows = [places[i:i + m.BLOCK] for i in range(0, len(places), m.BLOCK)]
            total += lane([[inputs(text, at, d, code, tables) for at in row if code.size[text[at]] > d] for row in rows])
        rest = [inputs(text, at, d, code, tables) for d in range(m.STEP, code.place.shape[1]) for at in places if code.size[text[at]] > d]
        total += lane([rest[i:i + m.BLOCK] for i in range(0, len(rest), m.BLOCK)])
    return total


@pytest.fixture(scope="module")
def model():
    from collections import Counter

    taught = [prose(i, 120, lang).encode() for i, lang in enumerate(["en", "de", "fr"] * 8)]
    weight = np.ones(256)
    for x in taught:
        np.add.at(weight, np.frombuffer(x, np.uint8), 1)
    code = m.Code.of(weight)
    totals = [np.zeros(2 << m.SLOT_BITS, np.int32) for _ in m.ORDERS]
    m.tally(taught, code, totals)
    words = Counter(w for x in taught for w in x.split())
    return code, [*map(m.odds, totals), m.word_table(dict(words), code)]


def test_scores_bit_by_bit(model):
    code, tables = model
    r = random.Random(1)
    texts = [(t or "").encode() for t in ODD] + [prose(i, r.randint(1, 90), lang).encode() for i, lang in enumerate(["en", "de", "fr"] * 3)]
    texts.append(prose(77, 1500).encode())  # more than one segment
    assert len(texts[-1]) > m.SEGMENT
    got = m.score(texts, code, tables)
    for text, value in zip(texts, got):
        assert value == pytest.approx(brute(text, code, tables), rel=2e-4, abs=1e-4)


def test_counters_bit_by_bit(model):
    code, _ = model
    texts = [prose(5, 40).encode(), b"", b"\x00 a"]
    totals = [np.zeros(2 << m.SLOT_BITS, np.int32) for _ in m.ORDERS]
    m.tally(texts, code, totals)
    want = [{} for _ in m.ORDERS]
    for text in texts:
        text += bytes([m.END])
        for at, symbol in enumerate(text):
            for d in range(int(code.size[symbol])):
                for k, order in enumerate(m.ORDERS):
                    slot = cell(context(text, at, order, k), int(code.entry[symbol, d // m.STEP]), m.SLOT_BITS) + int(code.place[symbol, d])
                    slot = slot * 2 + int(code.bit[symbol, d])
                    want[k][slot] = want[k].get(slot, 0) + 1
    for total, found in zip(totals, want):
        assert {int(i): int(total[i]) for i in np.flatnonzero(total) if i >> 1 & 15} == found  # the first place of a cell is no counter
