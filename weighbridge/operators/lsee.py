"""Locally scaled exponential error: errors weighed by the density of known values around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import CHUNK_ROWS, chunked, running


def knn_scale(train: DataFrame, value: str, queries: DataFrame, query: str, k: int, rows: int = CHUNK_ROWS) -> DataFrame:
    """Mean distance from every distinct query value to its k nearest training values.

    Equal training values are first merged, at most k copies of each (more can never be among
    the k nearest), so a value that fills a third of the table is one small row. The rest is
    ordered and numbered in chunks; the k nearest of a query lie among
    the k numbers on either side of its place. Fewer than k training values give null.
    """
    merged = train.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("x")).agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("n"))
    asked = queries.where(F.col(query).isNotNull()).select(F.col(query).cast("double").alias("x")).distinct()
    both = merged.select("x", "n", F.lit(False).alias("ask")).unionByName(asked.select("x", F.lit(0).cast("long").alias("n"), F.lit(True).alias("ask")))
    placed = running(chunked(both, ["x", "ask"], rows), [], ["x", "ask"], F.col("__part"), {"upto": ("sum", F.col("n"))})
    known = placed.where(~F.col("ask")).select(F.explode(F.sequence(F.col("upto") - F.col("n") + 1, F.col("upto"))).alias("place"), F.col("x").alias("t"))
    near = placed.where("ask").select("x", F.explode(F.sequence(F.greatest(F.col("upto") - (k - 1), F.lit(1).cast("long")), F.col("upto") + k)).alias("place"))
    distances = near.join(known, "place").groupBy("x").agg(F.sort_array(F.collect_list(F.abs(F.col("x") - F.col("t")))).alias("d"))
    mean = F.aggregate(F.slice("d", 1, k), F.lit(0.0), lambda a, v: a + v) / k
    return distances.select("x", F.when(F.size("d") >= k, mean).alias("sigma"))


def lsee(truth: Column, predicted: Column, sigma: Column, strictness: float = 3.0, epsilon: float = 1e-6) -> Column:
    return F.lit(1.0) - F.exp(-(F.abs(truth - predicted) * strictness) / F.greatest(sigma, F.lit(epsilon)))


def lsee_score(train: DataFrame, value: str, rows: DataFrame, truth: str, predicted: str, k: int = 5,
               strictness: float = 3.0, epsilon: float = 1e-6) -> DataFrame:
    """Add ``sigma`` and ``lsee`` to rows of truths and predictions."""
    scale = knn_scale(train, value, rows, truth, k)
    j = rows.join(scale, F.col(truth).cast("double") == F.col("x"), "left").drop("x")
    return j.withColumn("lsee", F.when(F.col("sigma").isNotNull(), lsee(F.col(truth), F.col(predicted), F.col("sigma"), strictness, epsilon)))
