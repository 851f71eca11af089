"""Source divergence against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weighbridge.llm import divergence

from fixtures import ODD, prose

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute_terms(text):
    return TERM.findall("".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text))


def brute_audit(rows, least, top=50):
    held, used, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source, found = lang or "", source or "", brute_terms(text or "")
        held[lang].update(set(found))
        used[lang, source].update(found)
        groups.add((lang, source))
    out = []
    for lang in {x for x, _ in groups}:
        kept = sorted(w for w, n in held[lang].items() if n >= least)
        sources = sorted((s for x, s in groups if x == lang), key=str.encode)
        whole = Counter()
        for s in sources:
            whole.update(used[lang, s])

        def priced(count):
            n = sum(count[w] for w in kept)
            return [1 + 10 ** 9 * (count[w] + 5) // (n + 5 * len(kept)) for w in kept]

        q, p = priced(whole), {s: priced(used[lang, s]) for s in sources}
        for s in sources:
            far = [(sum(abs(a - b) for a, b in zip(p[s], p[o])), o) for o in sources if o != s]
            near = [(a - b, w) for a, b, w in zip(p[s], q, kept) if used[lang, s][w] and a > b]
            for part, values, most in (("pair", far, len(far)), ("term", near, top)):
                values.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(values[:most])]
    return sorted(out)


def corpus(seed, n=140):
    r = random.Random(seed)
    rows = [(prose(r.randrange(40), r.randint(0, 60), lang), lang, r.choice(["a", "b", "B", "é", "c c", None])) for lang in ["en", "de", "fr"] for _ in range(n)]
    rows += [(t, None, "odd") for t in ODD] + [("Alpha ALPHA alpha1beta [x] {y} é_É", "en", "a")] * 4 + [(None, "en", "nothing"), ("1 2", "zz", "u"), (None, "zz", "v")]
    rows += [(" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)), "en", "hot")] * 40
    return rows


def asked(spark, rows, **more):
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    for name in ("n", "v", "term", "uses", "item"):
        docs = docs.withColumn(name, F.lit("clash"))
    got = divergence.audit(docs, **more)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("least", [1, 6])
def test_against_plain_counting(spark, least):
    rows = corpus(least)
    want = brute_audit(rows, least)
    assert {x[2] for x in want} == {"pair", "term"} and len(want) > 100
    assert asked(spark, rows, least=least) == want


def test_blocks_of_terms_and_ranges_of_sources(spark, monkeypatch):
    monkeypatch.setattr(divergence, "CELLS", 40)
    monkeypatch.setattr(divergence, "SOURCES", 2)
    rows = corpus(9, 40)
    assert asked(spark, rows, least=2, top=3) == brute_audit(rows, 2, 3)


def test_empty_and_single(spark):
    assert asked(spark, []) == []
    assert asked(spark, [("a a b", "en", "s")], least=1) == []
    assert asked(spark, [("a a b", "en", "s"), (None, "en", None)], least=2) == [("en", "", "pair", "s", 0, 1), ("en", "s", "pair", "", 0, 1)]


def test_joint_tables():
    rng = np.random.default_rng(1)
    counts = np.concatenate((rng.zipf(1.4, (500, 4)).clip(0, 10 ** 6) - 1, rng.integers(0, 400, (900, 4))))
    total, blocks = defaultdict(int), 0
    for levels, begins, joint in divergence.products(counts):
        blocks += 1
        ends = [*begins[1:], joint.shape[0]]
        for a in range(4):
            for b in range(4):
                table = joint[begins[a]:ends[a], begins[b]:ends[b]]
                for i, j in zip(*np.nonzero(table)):
                    total[a, b, levels[a][i], levels[b][j]] += int(table[i, j])
    want = Counter((a, b, x, y) for row in counts.tolist() for a, x in enumerate(row) for b, y in enumerate(row))
    assert blocks > 1 and dict(total) == dict(want)


def test_prices_of_large_counts():
    levels = np.array([0, 1, 9 * 10 ** 17], np.int64)
    assert divergence.prices(levels, 10 ** 18, 10 ** 6).tolist() == [1 + 10 ** 9 * (x + 5) // (10 ** 18 + 5 * 10 ** 6) for x in levels.tolist()]
