"""Periodic runs against a search over all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weighbridge.llm import periodic, queries

from fixtures import ODD, documents, prose, write


def brute_runs(t):
    out = []
    for q in range(1, len(t) // 4 + 1):
        i = 0
        while i + q < len(t):
            j = i
            while j + q < len(t) and t[j] == t[j + q]:
                j += 1
            s, e = i, j + q
            if j > i and e - s >= max(6, 4 * q) and not any(all(t[k] == t[k + d] for k in range(s, e - d)) for d in range(1, q)):
                out.append((s, e - s, q))
            i = j + 1 if j == i else j
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(r, most=160):
    k = r.choice([1, 2, 2, 3, 5, 50])
    x = [r.randrange(k) for _ in range(r.randint(0, most))]
    for _ in range(r.randint(0, 3)):
        q = r.randint(1, 20)
        w = [r.randrange(k) for _ in range(q)]
        if r.random() < 0.4 and q % 2 == 0:
            w = w[:q // 2] * 2
        at = r.randint(0, len(x))
        x[at:at] = (w * 6)[:r.randint(1, 6 * q)]
    return x


def test_runs_against_all_periods():
    r = random.Random(3)
    many = 0
    for _ in range(600):
        texts = [planted(r) for _ in range(r.randint(1, 6))]
        want = [brute_runs(x) for x in texts]
        many += sum(map(len, want))
        assert periodic.runs([np.array(x, np.int64) for x in texts]) == want
    assert many > 1000


@pytest.mark.parametrize("word", [lambda n: bin(n).count("1") % 2, lambda n: int(((n + 1) * 0.6180339887498949) % 1 < 0.6180339887498949),
                                  lambda n: (n + 1 & -(n + 1)).bit_length() % 2, lambda n: n * n % 97])
def test_structured_texts(word):
    """Thue-Morse (no cube), Fibonacci, period doubling, a long period: dense with squares at every scale."""
    x = [word(n) for n in range(700)]
    assert periodic.runs([np.array(x, np.int64), np.array(x[:300] * 5, np.int64)]) == [brute_runs(x), brute_runs(x[:300] * 5)]


def test_synchronising_set_is_consistent_and_dense():
    r = random.Random(4)
    x = np.array([r.randrange(3) for _ in range(600)] * 2 + [0] * 100 + [r.randrange(3) for _ in range(200)], np.int64)
    t, _ = periodic.laid_out([x])
    h, size = periodic.c.mix(t - (1 << 40)), 1
    while size <= 64:
        if size >= periodic.FIRST:
            found = set(periodic.synchronising(h, size, [(1200, 1300 - size + 1)] if size <= 100 else []).tolist())
            for i in range(600 - 2 * size):  # equal contexts
                assert (i in found) == (i + 600 in found)
            for i in range(600 - 3 * size):
                assert any(j in found for j in range(i, i + size))
        h, size = periodic.doubled(h, size), size * 2


def test_long_period_in_a_long_text():
    r = random.Random(5)
    block = [r.randrange(10 ** 6) for _ in range(20_000)]
    x = [7] * 50_000 + block * 4 + block[:3] + [r.randrange(10 ** 6) for _ in range(1000)]
    assert periodic.runs([np.array(x, np.int64)]) == [[(0, 50_000, 1), (50_000, 80_003, 20_000)]]


def test_collapse_cases(spark):
    texts = ODD + ["x y " * 3 + "x", "x y " * 4, "x y " * 4, "a b c\n" * 5 + "d", prose(1, 50)]
    docs = documents(spark, [(i, t, None) for i, t in enumerate(texts)] + [(None, "q " * 9, None)])
    got = periodic.collapse(docs.withColumn("RUNS", F.lit("clash")).withColumn("__text", F.lit(1)))
    assert got.columns == [*docs.columns, "__text", "runs", "strongest", "collapsed"] and got.count() == len(texts) + 1
    for r in got.collect():
        words = (r["text"] or "").encode().split()
        want = brute_runs(words)
        assert [tuple(x) for x in r["runs"]] == want
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert r["collapsed"] == b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
        assert (r["strongest"] is None) == (not want)
    assert periodic.collapse(docs.limit(0)).count() == 0


def test_op11_small(spark, tmp_path):
    r = random.Random(6)
    texts = ODD + [" ".join(map(str, planted(r, 90))) for _ in range(120)]
    write(tmp_path, "documents", {"doc_id": list(range(len(texts))) + [None], "text": [*texts, "a " * 8]})
    got = {x["doc_id"]: x for x in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    changed = 0
    for i, text in [*enumerate(texts), (None, "a " * 8)]:
        w = (text or "").encode().split()
        h = 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w, changed = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)], changed + 1
        want = brute_runs(w)
        gone = {j for s, n, q in want for j in range(s + q, s + n)}
        best = min(want, key=lambda x: (-(x[1] * 10 ** 9 // x[2]), x[0], x[2])) if want else (None,) * 3
        assert (got[i]["n_runs"], got[i]["start"], got[i]["length"], got[i]["period"]) == (len(want), *best)
        assert got[i]["exponent_milli"] == (1000 * best[1] // best[2] if want else None)
        assert got[i]["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in want).encode()).hexdigest()
        assert got[i]["collapsed_sha256"] == hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()
    assert changed > 5
