"""Output properties: side outputs of a sample that apply to some labels only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.seeded import u01
from .model import Model
from .scoring import SCORED, score_wide


def gate(value: Column, label: Column, support: Column, empty_means_all: bool = False) -> Column:
    """The value where the label is supported, else null.

    At creation an empty support list blocks everything; in experiments it blocks nothing.
    """
    ok = F.array_contains(support, label)
    if empty_means_all:
        ok = ok | (F.size(support) == 0)
    return F.when(ok, value)


def categorical_property(df: DataFrame, model: Model, cats: Mapping[str, Column],
                         values: Mapping[str, Column] | None, name: str) -> DataFrame:
    """Add ``name`` (label) and ``name_score`` from the property's own model."""
    keep = df.columns
    made = [c for c in SCORED if c in keep]
    scored = score_wide(df.withColumnsRenamed({c: f"__in_{c}" for c in made}), model, cats, values)
    return scored.select(*[F.col(f"__in_{c}").alias(c) if c in made else F.col(c) for c in keep],
                         F.col("label").alias(name), F.col("score").alias(f"{name}_score"))


def numerical_property(low: float, high: float, seed, *parts: Column) -> Column:
    return F.lit(low) + u01(seed, *parts) * F.lit(high - low)


def infer_properties(df: DataFrame, keys: Sequence[str], labels="property_labels", scores="property_scores") -> DataFrame:
    """Distinct property names over the label and score maps."""
    names = F.array_union(F.coalesce(F.map_keys(labels), F.array()), F.coalesce(F.map_keys(scores), F.array()))
    return df.select(*keys, F.explode(names).alias("property")).distinct()


def property_keys(sources: Sequence[Column], seen: Column) -> Column:
    """Sorted union of the key lists; only if all are empty the names seen in the data."""
    union = F.array_sort(F.array_distinct(F.concat(*sources)))
    return F.when(F.size(union) > 0, union).otherwise(F.array_sort(F.array_distinct(seen)))


def property_label_names(mapped: Column, metadata: Column, model_labels: Column, top_seen: Column) -> Column:
    """map<int, string> of label names: the mapping's numbered names, else "0", "1", ... up to the
    count known from metadata, the property's model, the largest label seen, or one."""
    numbered = F.map_filter(mapped, lambda k, v: k.rlike("^[0-9]+$"))
    count = F.greatest(F.lit(1), F.coalesce(metadata, model_labels, top_seen + 1, F.lit(1)).cast("int"))
    plain = F.map_from_entries(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i, i.cast("string"))))
    return F.when(F.size(numbered) > 0, F.transform_keys(numbered, lambda k, v: k.cast("int"))).otherwise(plain)


def infer_schema(long: DataFrame, keys: Sequence[str], roles: Mapping[str, str]) -> DataFrame:
    """Sorted distinct categories and the role of every variable; bounded by the categories."""
    role = F.lit(None).cast("string")
    for var, text in roles.items():
        role = F.when(F.col("var") == var, F.lit(text)).otherwise(role)
    return long.groupBy(*keys, "var").agg(F.array_sort(F.collect_set("cat")).alias("values")).select(*keys, "var", "values", role.alias("role"))
