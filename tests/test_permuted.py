"""Draws by a permutation of numbers, and unseen combinations by rank, against plain enumeration."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from weighbridge.functions.permuted import permute
from weighbridge.operators import sampling as sp


def test_permutation_of_every_size(spark):
    sizes = [1, 2, 3, 4, 5, 8, 9, 10, 17, 63, 64, 65, 480, 1000, 4097]
    df = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", F.explode(F.sequence(F.lit(-1), F.col("n"))).alias("x"))
    rows = df.select("n", "x", permute(F.col("x"), F.col("n"), "seed", F.col("n")).alias("y"), permute(F.col("x"), F.col("n"), "other").alias("z")).collect()
    for n in sizes:
        mine = [r for r in rows if r["n"] == n]
        assert all(r["y"] is None for r in mine if not 0 <= r["x"] < n)
        for name in "yz":
            assert sorted(r[name] for r in mine if r[name] is not None) == list(range(n))
        if n > 400:
            images = [r["y"] for r in sorted(mine, key=lambda r: r["x"]) if r["y"] is not None]
            assert images != [r["z"] for r in sorted(mine, key=lambda r: r["x"]) if r["z"] is not None]
            assert sum(a < b for a, b in zip(images, images[1:])) == pytest.approx(n / 2, abs=3 * n ** 0.5)


def test_thousand_of_ten_to_the_fifteen(spark):
    one = spark.range(1).withColumnRenamed("id", "k")
    drawn = sp.sample_configurations(one, [f"V{i}" for i in range(15)], [10] * 15, 1000, 3, ["k"])
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    rows = drawn.collect()
    assert len({r["aid"] for r in rows}) == 1000 and {r["draw"] for r in rows} == set(range(1000))
    assert all(int("".join(str(r[f"V{i}"]) for i in range(15))) == r["aid"] for r in rows)
    assert sum(r["aid"] for r in rows) / 1000 == pytest.approx(5e14, rel=0.1)
    again = sp.sample_configurations(one.repartition(3), [f"V{i}" for i in range(15)], [10] * 15, 7, 3, ["k"]).collect()
    assert {r["aid"] for r in again} == {r["aid"] for r in rows if r["draw"] < 7}


def test_all_combinations_if_few(spark):
    df = spark.createDataFrame([(1, 2), (2, 5), (3, 0)], "k long, n long")
    for k in (None, 10):
        rows = sp.sample_configurations(df, ["A", "B"], [F.col("n"), 2], k, 1, ["k"]).collect()
        assert sorted((r["k"], r["aid"], r["A"], r["B"]) for r in rows) == [(g, a * 2 + b, a, b) for g, n in ((1, 2), (2, 5)) for a in range(n) for b in range(2)]
    assert sp.sample_configurations(df, ["A", "B"], [F.col("n"), 2], 0, 1, ["k"]).count() == 0


def brute_unseen(sizes, seen):
    return [x for x in itertools.product(*(range(n) for n in sizes)) if x not in seen]


@pytest.mark.parametrize("rows", [3, 1_000_000])
def test_unseen_against_enumeration(spark, rows):
    r = random.Random(rows)
    sizes = {1: (3, 2, 4), 2: (1, 1, 2), 3: (2, 2, 2), 4: (5, 5, 5), 5: (2, 1, 1)}
    seen = {g: {tuple(r.randrange(n) for n in s) for _ in range(r.randint(0, 40))} for g, s in sizes.items()}
    seen[3] = set(brute_unseen(sizes[3], set()))  # nothing is left
    seen[5] = set()
    domains = spark.createDataFrame([(g, *s) for g, s in sizes.items()], "g long, a int, b int, c int")
    noise = [(1, None, 0, 0), (1, 9, 0, 0), (2, 0, -1, 0), (77, 0, 0, 0), (None, 0, 0, 0)]
    given = spark.createDataFrame([(g, *x) for g, xs in seen.items() for x in xs for _ in range(2)] + noise, "g long, A int, B int, C int")
    columns = (["g"], ["A", "B", "C"], [F.col("a"), F.col("b"), F.col("c")])
    every = sp.unseen_draws(domains, given.toDF("g", "V0", "V1", "V2"), ["g"], ["V0", "V1", "V2"], columns[2], None, 1, rows).collect()
    want = sorted((g, *x) for g, s in sizes.items() for x in brute_unseen(s, seen[g]))
    assert sorted((x["g"], x["V0"], x["V1"], x["V2"]) for x in every) == want
    some = sp.unseen_draws(domains, given.toDF("g", "V0", "V1", "V2"), ["g"], ["V0", "V1", "V2"], columns[2], 4, 1, rows).collect()
    found = sorted((x["g"], x["V0"], x["V1"], x["V2"]) for x in some)
    assert len(set(found)) == len(found) and set(found) <= set(want)
    for g in sizes:
        assert sum(x[0] == g for x in found) == min(4, sum(x[0] == g for x in want))
    again = sp.unseen_draws(domains.repartition(3), given.repartition(2).toDF("g", "V0", "V1", "V2"), ["g"], ["V0", "V1", "V2"], columns[2], 4, 1, rows).collect()
    assert sorted((x["g"], x["V0"], x["V1"], x["V2"]) for x in again) == found


def test_unseen_of_a_huge_product_without_keys(spark):
    names, sizes = [f"V{i}" for i in range(15)], [10] * 15
    one = spark.range(1)
    drawn = sp.sample_configurations(one, names, sizes, 300, 3, ["id"])
    fresh = sp.unseen_draws(one, drawn, [], names, sizes, 500, 3).collect()
    before = {r["aid"] for r in drawn.collect()}
    assert len({r["aid"] for r in fresh}) == 500 and not before & {r["aid"] for r in fresh}
    assert fresh[0].asDict().keys() == {"id", "aid", *names}


def test_draws_of_a_small_file_are_many_tasks_work(spark, tmp_path):
    from weighbridge.plans import QUERIES

    spark.range(400).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    drawn = QUERIES["sample_configurations"](spark, str(tmp_path))
    rows = drawn.select("c_custkey", "draw", "aid", F.spark_partition_id().alias("task")).collect()
    assert len({r["task"] for r in rows}) > 1 and len({(r["c_custkey"], r["aid"]) for r in rows}) == len(rows) == 1200
