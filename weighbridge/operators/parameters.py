"""Completing and ordering the parameter tables of models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clamp01
from ..functions.seeded import u01


def complete_params(ids: DataFrame, given: DataFrame, keys: Sequence[str], labels: int, categories: int, seed) -> DataFrame:
    """Every (label, cat) cell of every id: the given value clamped, else a seeded draw.

    A given row without a label is an old-style cell and holds for all labels.
    """
    keys = list(keys)
    every = F.sequence(F.lit(0), F.lit(labels - 1))
    spread = given.select(
        *keys, F.explode(F.when(F.col("label").isNull(), every).otherwise(F.array("label"))).alias("label"), "cat",
        clamp01(F.col("value")).alias("value"))
    grid = ids.select(*keys, F.explode(every).alias("label")).select(
        *keys, "label", F.explode(F.sequence(F.lit(0), F.lit(categories - 1))).alias("cat"))
    drawn = u01(seed, *[F.col(k) for k in keys], F.col("label"), F.col("cat"))
    return grid.join(spread, [*keys, "label", "cat"], "left").select(
        *keys, "label", "cat", F.coalesce("value", drawn).alias("value"))


def ordered_bounds(low: Column, high: Column) -> tuple[Column, Column]:
    """Clamped bounds of a numerical weight, the smaller first."""
    a, b = clamp01(low), clamp01(high)
    return F.least(a, b), F.greatest(a, b)
