"""Candidates with structures of their own against plain Python and against candidates of one shape."""

import itertools

import pytest
from pyspark.sql import functions as F

from weighbridge.operators import ragged as rg
from weighbridge.operators import search as se

RANGES = rg.Ranges(variables=(1, 4), numerical=(0, 1), categories=(1, 4), spans=(1, 3), rules=(0, 3), labels=3)


def brute(c, labels, max_gap, least):
    """Label counts, least decisiveness (as an early stop sees it), penalty."""
    cells, found = c["starts"][-1], []
    for at in itertools.product(*(range(n) for n in c["sizes"])):
        scores = []
        for label in range(labels):
            a = b = 0.0
            for v, d in enumerate(at):
                first = label * cells + c["starts"][v]
                w, s = c["w"][first + d], c["s"][first + d]
                if c["numerical"][v]:
                    t = (d + 0.5) / c["sizes"][v]
                    t = 1 - t if c["falling"][label * len(at) + v] else t
                    w, s = c["w"][first] + t * (c["w"][first + 1] - c["w"][first]), c["s"][first]
                a, b = a + w * s, b + w
            for r in c["rules"]:
                if at[r["var_a"]] == r["val_a"] and at[r["var_b"]] == r["val_b"]:
                    a, b = a + r["w"] * r["s"], b + r["w"]
            scores.append(a / b if b > 0 else 0.0)
        best = sorted(scores, reverse=True)
        found.append((scores.index(best[0]), max(0.0, min(1.0, best[0] - best[1])), best[0]))
    counts = [sum(x[0] == label for x in found) for label in range(labels)]
    gap = max(abs(n / len(found) - 1 / labels) for n in counts)
    stop = next((d for _, d, _ in found if d < least), min(d for _, d, _ in found))
    return counts, stop, max(0.0, least - stop) + gap, gap <= max_gap and stop >= least


def test_structures_and_scores(spark):
    cands = rg.random_structures(spark.range(60).withColumnRenamed("id", "k"), RANGES, 5, "k")
    rows = {r["cand"]: r for r in cands.collect()}
    again = {r["cand"]: r for r in rg.random_structures(spark.range(60).repartition(3).withColumnRenamed("id", "k"), RANGES, 5, "k").collect()}
    assert rows == again
    assert {len(r["sizes"]) for r in rows.values()} == {1, 2, 3, 4} and {sum(r["numerical"]) for r in rows.values()} == {0, 1}
    assert {len(r["rules"]) for r in rows.values()} >= {0, 1, 2, 3}
    for r in rows.values():
        width = [max(n, 2) if num else n for num, n in zip(r["numerical"], r["sizes"])]
        assert r["starts"] == [sum(width[:i]) for i in range(len(width) + 1)]
        assert len(r["w"]) == len(r["s"]) == 3 * sum(width) and len(r["falling"]) == 3 * len(width)
        assert all(1 <= n <= (3 if num else 4) for num, n in zip(r["numerical"], r["sizes"]))
        used = [(x["var_a"], x["val_a"]) for x in r["rules"]] + [(x["var_b"], x["val_b"]) for x in r["rules"]]
        assert len(set(used)) == len(used) and all(0 <= d < r["sizes"][v] for v, d in used) and all(x["var_a"] != x["var_b"] for x in r["rules"])
        for v, num in enumerate(r["numerical"]):
            for label in range(3):
                first = label * r["starts"][-1] + r["starts"][v]
                assert not num or r["w"][first] <= r["w"][first + 1]
    for chunk in (5, 4096):
        scored = {r["cand"]: r for r in rg.score_structures(cands, 3, 0.3, 0.02, chunk).collect()}
        assert scored.keys() == rows.keys()
        for k, r in rows.items():
            counts, stop, penalty, ok = brute(r, 3, 0.3, 0.02)
            got = scored[k]
            assert list(got["label_counts"]) == counts and got["total"] == sum(counts) and got["passes"] == ok
            assert got["min_decisiveness"] == pytest.approx(stop) and got["penalty"] == pytest.approx(penalty)


def test_one_shape_scores_as_before(spark):
    shape = se.Shape(labels=2, sizes=(3, 2, 4), numerical=(False, False, True), rules=((0, 1, 1, 0), (1, 1, 2, 3)))
    cands = se.random_population(spark.range(20).withColumnRenamed("id", "cand"), shape, 3, "cand")
    rules = [F.struct(F.lit(a).alias("var_a"), F.col("ra")[i].alias("val_a"), F.lit(b).alias("var_b"), F.lit(vb).alias("val_b"), F.col("rw")[i].alias("w"), F.col("rs")[i].alias("s"))
             for i, (a, _, b, vb) in enumerate(shape.rules)]
    flat = cands.select("cand", F.array(*[F.lit(x) for x in shape.numerical]).alias("numerical"), F.array(*[F.lit(n) for n in shape.sizes]).alias("sizes"),
                        F.array(*[F.lit(n) for n in (0, 3, 5, 9)]).alias("starts"), "w", "s", "falling", F.array(*rules).alias("rules"))
    names = ["cand", "total", "label_counts", "penalty", "passes", "min_decisiveness", "avg_decisiveness"]
    got = {r["cand"]: r for r in rg.score_structures(flat, 2, 0.2, 0.1).select(names).collect()}
    for r in se.score_population(cands, shape, 0.2, 0.1).select(names).collect():
        assert list(got[r["cand"]]["label_counts"]) == list(r["label_counts"]) and got[r["cand"]]["passes"] == r["passes"]
        assert got[r["cand"]]["penalty"] == pytest.approx(r["penalty"]) and got[r["cand"]]["avg_decisiveness"] == pytest.approx(r["avg_decisiveness"])


def test_bad_ranges_and_too_many_rules(spark):
    for bad in ({"variables": (0, 2)}, {"numerical": (0, 3)}, {"categories": (3, 2)}, {"labels": 0}):
        with pytest.raises(ValueError):
            rg.Ranges(**{"variables": (2, 2), "numerical": (0, 1), "categories": (1, 2), "spans": (1, 2), "rules": (0, 1), **bad})
    few = rg.Ranges(variables=(2, 2), numerical=(0, 0), categories=(1, 1), spans=(1, 1), rules=(5, 5))
    assert {len(r["rules"]) for r in rg.random_structures(spark.range(4), few, 1, "id").collect()} == {1}
    many = rg.Ranges(variables=(2, 2), numerical=(0, 0), categories=(1, 1), spans=(1, 1), rules=(5, 5), allow_multi_use=True)
    assert {len(r["rules"]) for r in rg.random_structures(spark.range(4), many, 1, "id").collect()} == {5}
    assert rg.score_structures(rg.random_structures(spark.range(0), few, 1, "id"), 2, 0.1, 0.1).count() == 0
