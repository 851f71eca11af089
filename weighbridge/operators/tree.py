"""A small decision tree fitted on samples, and its rules as text and rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feature_vector(sample: Column, indices: list[int]) -> Column:
    """Numbers of the digit-named keys in numeric order; missing ones are 0.0."""
    return F.array(*[F.coalesce(F.try_element_at(sample, F.lit(str(i))).cast("double"), F.lit(0.0)) for i in indices])


def digit_keys(first: Column) -> Column:
    """Digit-named keys of a sample, in numeric order."""
    return F.array_sort(F.transform(F.filter(F.map_keys(first), lambda k: k.rlike("^[0-9]+$")), lambda k: k.cast("int")))


def derive_tree(df: DataFrame, features: list[str], label: str, depth: int = 3):
    """Fit a tree of bounded depth; returns (model, frame with a ``prediction`` label text, classes)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler

    text = df.withColumn("__label", F.coalesce(F.col(label).cast("string"), F.lit("unknown")))
    indexer = StringIndexer(inputCol="__label", outputCol="__y", stringOrderType="alphabetAsc").fit(text)
    stages = [VectorAssembler(inputCols=features, outputCol="__x"),
              DecisionTreeClassifier(featuresCol="__x", labelCol="__y", predictionCol="__p", maxDepth=depth, seed=7),
              IndexToString(inputCol="__p", outputCol="prediction", labels=indexer.labels)]
    fitted = Pipeline(stages=stages).fit(indexer.transform(text))
    tree = fitted.stages[1]
    out = fitted.transform(indexer.transform(text)).drop("__x", "rawPrediction", "probability", "__p", "__y", "__label")
    return tree, out, list(indexer.labels)


def training_accuracy(predicted: DataFrame, label: str) -> DataFrame:
    return predicted.agg(F.avg((F.col("prediction") == F.col(label).cast("string")).cast("double")).alias("accuracy"),
                         F.count(F.lit(1)).alias("sample_count"))


_SPLIT = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>|in|not in) ([^)]*)\)")
_LEAF = re.compile(r"^( *)Predict: ([0-9.]+)")


def tree_rules(tree, features: list[str], classes: list[str]) -> list[tuple[str, str]]:
    """(condition, class) of every leaf of a fitted tree, which has at most 2 ** depth leaves."""
    path: list[tuple[int, str]] = []
    rules = []
    for line in tree.toDebugString.splitlines():
        split, leaf = _SPLIT.match(line), _LEAF.match(line)
        if split:
            indent = len(split.group(1))
            path = [p for p in path if p[0] < indent]
            test = split.group(5).strip()
            bound = f"{float(test):.4f}" if re.fullmatch(r"-?[0-9.eE+-]+", test) else test
            path.append((indent, f"{features[int(split.group(3))]} {split.group(4)} {bound}"))
        elif leaf:
            indent = len(leaf.group(1))
            rules.append((" and ".join(t for i, t in path if i < indent), classes[int(float(leaf.group(2)))]))
    return rules


def tree_to_text(tree, features: list[str], classes: list[str]) -> str:
    """A fitted tree as nested if/else text, four spaces per level."""
    out = []
    for line in tree.toDebugString.splitlines():
        split, leaf = _SPLIT.match(line), _LEAF.match(line)
        if split:
            test = split.group(5).strip()
            bound = f"{float(test):.4f}" if re.fullmatch(r"-?[0-9.eE+-]+", test) else test
            head = "else:" if split.group(2) == "Else" else f"if {features[int(split.group(3))]} {split.group(4)} {bound}:"
            out.append((len(split.group(1)), head))
        elif leaf:
            out.append((len(leaf.group(1)), f"return '{classes[int(float(leaf.group(2)))]}'"))
    depth = {d: i for i, d in enumerate(sorted({d for d, _ in out}))}
    return "\n".join("    " * depth[d] + t for d, t in out)


def rule_check(rows: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """How many rows there are, whether each meets the condition of one leaf only, and whether that
    leaf's class is the row's ``prediction``."""
    met = F.array(*[F.struct(F.expr(c or "true").alias("met"), F.lit(p).alias("class")) for c, p in rules])
    held = F.filter(met, lambda m: m["met"])
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.bool_and(F.size(held) == 1).alias("one_leaf"),
                    F.bool_and(F.get(held, F.lit(0))["class"] == F.col("prediction")).alias("same_class"))
