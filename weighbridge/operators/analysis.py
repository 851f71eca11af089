"""How balanced and how decisive a model is over a set of scored assignments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def radix_digits(index: Column, sizes: Sequence[int | Column]) -> list[Column]:
    """Mixed-radix digits of an index, the last variable changing fastest.

    Sizes are numbers, or columns where every row has its own domains.
    """
    digits, rest = [], index.cast("long")
    for n in reversed(sizes):
        n = n.cast("long") if isinstance(n, Column) else F.lit(n).cast("long")
        digits.append((rest % n).cast("int"))
        rest = F.call_function("div", rest, n)
    return digits[::-1]


def radix_index(digits: Sequence[Column], sizes: Sequence[int | Column]) -> Column:
    index = F.lit(0).cast("long")
    for d, n in zip(digits, sizes):
        index = index * n + d
    return index


def combinations(sizes: Sequence[int | Column]) -> Column:
    """How many combinations the domains have."""
    total = F.lit(1).cast("long")
    for n in sizes:
        total = total * n
    return total


def explode_range(df: DataFrame, total: Column, name: str, chunk: int = 4096) -> DataFrame:
    """Each row once for every number below its ``total``.

    A row's range is exploded to starts of chunks first, so no array holds more than the greater
    of ``chunk`` and the number of chunks.
    """
    step = F.lit(chunk).cast("long")
    cut = df.select("*", total.alias("__total")).where(F.col("__total") > 0)
    cut = cut.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__total") - 1, step)).alias("__start"))
    return cut.select(*df.columns, F.explode(F.sequence(F.col("__start"), F.least(F.col("__start") + step, F.col("__total")) - 1)).alias(name))


def explode_combinations(df: DataFrame, names: Sequence[str], sizes: Sequence[Column], chunk: int = 4096) -> DataFrame:
    """Every combination of each row's own category domains, as rows (..., aid, names...)."""
    rows = explode_range(df, combinations(sizes), "aid", chunk)
    return rows.select("*", *[d.alias(n) for n, d in zip(names, radix_digits(F.col("aid"), sizes))])


def enumerate_assignments(spark: SparkSession, names: Sequence[str], sizes: Sequence[int]) -> DataFrame:
    """Every combination of the category domains as rows (aid, one column per variable)."""
    total = 1
    for n in sizes:
        total *= n
    base = spark.range(total).withColumnRenamed("id", "aid")
    steps, digits = 1, []
    for n in reversed(sizes):
        digits.append((F.expr(f"aid div {steps}") % n).cast("int"))
        steps *= n
    return base.select("aid", *[d.alias(n) for n, d in zip(names, digits[::-1])])


def analysis_aggregates(labels: int, label="label", dec="decisiveness", score="score") -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total"),
        F.array(*[F.count_if(F.col(label) == i) for i in range(labels)]).alias("label_counts"),
        F.avg(dec).alias("avg_decisiveness"),
        F.avg(score).alias("avg_top_score"),
    ]


def early_stop_minimum(dec: Column, order: Column, threshold: float) -> Column:
    """The running minimum a scan in order holds when it stops at the first value below threshold."""
    return F.coalesce(F.min_by(F.when(dec < threshold, dec), F.when(dec < threshold, order)), F.min(dec))


def with_fractions(df: DataFrame, labels: int) -> DataFrame:
    """Add label_fractions and the largest distance of a fraction from the uniform share."""
    share = F.transform("label_counts", lambda c: F.when(F.col("total") > 0, c / F.col("total")).otherwise(F.lit(0.0)))
    return df.withColumn("label_fractions", share).withColumn(
        "max_gap",
        F.when(F.col("total") > 0, F.array_max(F.transform("label_fractions", lambda f: F.abs(f - F.lit(1.0 / labels)))))
        .otherwise(F.lit(0.0)),
    )


def analyze(scored: DataFrame, labels: int, keys: Sequence[str] = ()) -> DataFrame:
    """Counts and fractions per label (absent labels count 0), average margin and top score."""
    agg = scored.groupBy(*keys).agg(*analysis_aggregates(labels))
    filled = agg.withColumn("avg_decisiveness", F.coalesce("avg_decisiveness", F.lit(0.0))).withColumn(
        "avg_top_score", F.coalesce("avg_top_score", F.lit(0.0)))
    return with_fractions(filled, labels)


def penalty(gap: Column, min_dec: Column, property_gap: Column, min_required: float, property_weight=0.5) -> Column:
    shortfall = F.greatest(F.lit(0.0), F.lit(float(min_required)) - min_dec)
    return shortfall + gap + F.lit(float(property_weight)) * property_gap


def passes(gap: Column, min_dec: Column, max_gap: float, min_required: float) -> Column:
    return (gap <= F.lit(float(max_gap))) & (min_dec >= F.lit(float(min_required)))
