"""Pairing samples of several tables, and subsets applied to all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import number_by_position


def align_by_sample_id(wanted: DataFrame, available: DataFrame, id_: str, pos: str) -> DataFrame:
    """The n-th request of an id gets the n-th row of that id; ``missing`` marks ids that ran out."""
    left = number_by_position(wanted, [id_], pos, "__nth")
    right = number_by_position(available, [id_], pos, "__nth").withColumnRenamed(pos, "__pos")
    j = left.join(right, [id_, "__nth"], "left")
    return j.withColumn("missing", F.col("__pos").isNull()).withColumnRenamed("__pos", f"matched_{pos}").drop("__nth")


def align_by_position(a: DataFrame, b: DataFrame, pos: str) -> DataFrame:
    """The n-th row of one table with the n-th of the other, in order of their positions; tables of
    different sizes cannot be aligned. Positions are those of the first table."""
    n, m = a.count(), b.count()
    if n != m:
        raise ValueError(f"cannot align by position: {n} rows against {m}")
    right = number_by_position(b, [], pos, "__nth").drop(pos)
    return number_by_position(a, [], pos, "__nth").join(right, "__nth").drop("__nth")


def subset_dataset(chosen: DataFrame, instances: DataFrame, id_: str, lineage: dict[str, Column]) -> DataFrame:
    """Rows of every instance whose sample was chosen, with a note on where they come from."""
    kept = instances.join(chosen.select(id_), id_, "left_semi")
    return kept.withColumn("subset_info", F.struct(*[v.alias(k) for k, v in lineage.items()]))


def fill_phrases(expected: DataFrame, given: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Phrases of every expected (keys..., var, cat, kind, role); a missing one gets a default.

    A categorical default names the role (or variable) and category, a numerical one is empty.
    """
    j = expected.join(given, [*keys, "var", "cat"], "left")
    base = F.when(F.length("role") > 0, F.col("role")).otherwise(F.col("var"))
    default = F.when(F.col("kind") == "numerical", F.lit("")).otherwise(F.concat(base, F.lit(" category "), F.col("cat").cast("string")))
    return j.select(*keys, "var", "cat", F.coalesce("phrase", default).alias("phrase"), F.col("phrase").isNull().alias("filled"))


def fill_label_names(tasks: DataFrame, labels: Column, given: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Names of every output label of a task, given as (keys..., label, name); a missing one is ``Label i``."""
    every = tasks.where(labels > 0).select(*keys, F.explode(F.sequence(F.lit(0), labels - 1)).alias("label"))
    j = every.join(given, [*keys, "label"], "left")
    return j.select(*keys, "label", F.coalesce("name", F.concat(F.lit("Label "), F.col("label").cast("string"))).alias("name"), F.col("name").isNull().alias("filled"))


def fill_property_labels(expected: DataFrame, given: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Texts of every label of categorical properties (keys..., property, type, num_output_labels);
    given: (keys..., property, label, text). A missing one is named after property and label."""
    plain = expected.where((F.lower(F.coalesce("type", F.lit("categorical"))) != "numerical") & (F.col("num_output_labels") > 0))
    every = plain.select(*keys, "property", F.explode(F.sequence(F.lit(0), F.col("num_output_labels") - 1)).alias("label"))
    j = every.join(given, [*keys, "property", "label"], "left")
    default = F.concat("property", F.lit(" label "), F.col("label").cast("string"))
    return j.select(*keys, "property", "label", F.coalesce("text", default).alias("text"), F.col("text").isNull().alias("filled"))


def fill_property_ranges(expected: DataFrame, given: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Range, unit and description of numerical properties (keys..., property, type, min_value,
    max_value, unit, description); given: (keys..., property, low, high, range_unit, note). The mapping's
    range comes first, then the property's own, then 0 to 1."""
    numbers = expected.where(F.lower("type") == "numerical").join(given, [*keys, "property"], "left")
    mapped, own = F.col("low").isNotNull() & F.col("high").isNotNull(), F.col("min_value").isNotNull() & F.col("max_value").isNotNull()
    pick = lambda a, b, default: F.when(mapped, F.col(a)).when(own, F.col(b)).otherwise(default)
    return numbers.select(*keys, "property", pick("low", "min_value", F.lit(0.0)).alias("low"), pick("high", "max_value", F.lit(1.0)).alias("high"),
                          F.when(mapped, F.col("range_unit")).when(own, F.col("unit")).alias("unit"),
                          F.coalesce("note", "description", F.concat("property", F.lit(" value"))).alias("description"))
