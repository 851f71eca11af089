"""Running requested experiments against a model, in batch."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import normalize_assignment
from ..functions.text import label_name
from .model import Model
from .properties import gate
from .scoring import barrier, score_wide


def run_experiments(requests: DataFrame, model: Model, text: str, names: Column,
                    properties: Mapping[str, tuple[Model, Sequence[int]]] | None = None) -> DataFrame:
    """Score requested assignments given as JSON text.

    Adds status, message, label, label_name, score and one label column per property. A request
    that cannot be read, or names a category that does not exist, gets status Error and its
    message; unknown variables are ignored. An empty property support list means all labels.
    """
    properties = properties or {}
    read = requests.withColumn("__a", normalize_assignment(F.col(text)))
    base = barrier(read, requests.columns, ["__a"])
    # the values are whole numbers by now, so a category is right when it lies in its domain
    value = {v.name: f"try_element_at(__a.assignment, '{v.name}')" for v in model.variables}
    outside = [f"IF({value[v.name]} < 0 OR {value[v.name]} >= {v.categories}, concat('Assignment value ', {value[v.name]}, ' out of range for {v.name}'), NULL)"
               for v in model.variables]
    own = [f"`{c}`" for c in requests.columns]
    staged = base.selectExpr(*own, f"coalesce(__a.error, {', '.join(outside)}) AS message",
                             *[f"{value[v.name]} AS `__v_{v.name}`" for v in model.variables])
    staged = barrier(staged, requests.columns, ["message", *[f"__v_{v.name}" for v in model.variables]])
    cats = {v.name: F.col(f"__v_{v.name}") for v in model.variables}
    keep = [*requests.columns, "message", *[f"__v_{v.name}" for v in model.variables]]
    scored = score_wide(staged, model, cats).select(*keep, F.col("label").alias("__label"), F.col("score").alias("__score"))
    for name, (prop, support) in properties.items():
        keep = scored.columns
        allowed = F.array(*[F.lit(s) for s in support]).cast("array<int>")
        scored = score_wide(scored, prop, cats).select(*keep, gate(F.col("label"), F.col("__label"), allowed, True).alias(f"__p_{name}"))
    fine = F.col("message").isNull()
    return scored.select(
        *requests.columns, F.when(fine, "Success").otherwise("Error").alias("status"), "message",
        F.when(fine, F.col("__label")).alias("label"), F.when(fine, label_name(names, F.col("__label"))).alias("label_name"),
        F.when(fine, F.col("__score")).alias("score"), *[F.when(fine, F.col(f"__p_{n}")).alias(n) for n in properties])
