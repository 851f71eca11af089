"""Importance resampling: documents are drawn without replacement with probability proportional to
the ratio of a target's and the raw corpus's n-gram likelihoods, by taking the k largest
log ratio + Gumbel noise.

Cases: null and very short texts have log weight 0. Noise comes from a hash of the key, so a rerun
draws the same rows; repeated rows with one key and text have equal keys, and a tie at the cut is
decided by the key, then all rows equal in both are taken together (only then more than k rows are
drawn). A null key counts as a value of its own. An empty table gives an empty result. Other columns pass through; columns
named like an output are replaced.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored
from . import common as c
from .grams import Ratio, totals

DIGIT = 12  # bits settled per pass of the selection


def weigh(docs: DataFrame, model: Ratio, text: str = "text") -> DataFrame:
    """``docs`` with log_weight, the sum of log target over raw probability of the text's grams."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # one number per slot
    return c.add_columns(docs, "log_weight double", lambda batch: [pa.array(totals(held.value, c.raw(batch, text))[0], pa.float64())])


def gumbel(key: Column, seed: int) -> Column:
    """Standard Gumbel noise from a hash of the key."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def ordinal(value: Column) -> Column:
    """A double as an integer of 48 bits that rises with it (differences below 2^-20 vanish)."""
    return F.least(F.greatest(F.round((value + F.lit(float(1 << 26))) * F.lit(float(1 << 20))).cast("long"), F.lit(0)), F.lit((1 << 48) - 1))


def cut(df: DataFrame, column: str, k: int, width: int) -> tuple[int, int]:
    """The k-th largest value of a non-negative integer column of ``width`` bits, and how many rows
    with exactly that value belong to the k: a digit per pass over counts, 4,096 numbers each time."""
    known, left = 0, k
    for shift in range(width - DIGIT, -1, -DIGIT):
        counts = (df.where(F.shiftright(column, shift + DIGIT) == F.lit(known)).groupBy((F.shiftright(column, shift).bitwiseAND((1 << DIGIT) - 1)).alias("d"))
                  .count().collect())
        for r in sorted(counts, key=lambda r: -r["d"]):
            if r["count"] >= left:
                known = (known << DIGIT) | r["d"]
                break
            left -= r["count"]
    return known, left


def sample(weighed: DataFrame, share: float, key: str = "doc_id", seed: int = 1) -> DataFrame:
    """``weighed`` with gumbel_key and selected: the round(share * rows) largest keys."""
    rows = stored(weighed.drop("gumbel_key", "selected").withColumn("gumbel_key", F.col("log_weight") + gumbel(F.col(key), seed))
                  .withColumn("__order", ordinal(F.col("gumbel_key")))
                  .withColumn("__tie", F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), F.col(key)), 16)), "resample")
    k = min(rows.count(), round(share * rows.count()))
    if k <= 0:
        chosen = F.lit(False)
    else:
        value, left = cut(rows.select("__order"), "__order", k, 48)
        tie, _ = cut(rows.where(F.col("__order") == value).select("__tie"), "__tie", left, 48)
        chosen = (F.col("__order") > value) | ((F.col("__order") == value) & (F.col("__tie") >= tie))
    return rows.withColumn("selected", chosen).drop("__order", "__tie")
