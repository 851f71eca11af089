"""Evaluation of predictions: confusion counts, per-label and macro metrics, multi-output accuracy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored

INVALID = -1


def prediction_label(raw: Column) -> Column:
    """int-castable label of a prediction, -1 when there is none.

    A text must be a whole number; a real number is cut; NaN and what no int can hold are no label.
    """
    text = F.regexp_replace(raw.cast("string"), "^[ \\t\\r\\n]+|[ \\t\\r\\n]+$", "")
    from_text = F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("int"))
    number = F.when(~F.isnan(raw.try_cast("double")), raw.try_cast("double"))
    from_number = F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).try_cast("int")
    return F.coalesce(F.when(F.typeof(raw) == "string", from_text).otherwise(from_number), F.lit(INVALID))


def _div(n: Column, d: Column) -> Column:
    return F.when(d == 0, F.lit(0.0)).otherwise(n / d)


def confusion_counts(df: DataFrame, truth="label", pred="pred", keys: Sequence[str] = ()) -> DataFrame:
    """Sparse counts per (keys, label, pred); null predictions count as -1."""
    return df.groupBy(
        *keys, F.col(truth).cast("int").alias("label"), F.coalesce(F.col(pred).cast("int"), F.lit(INVALID)).alias("pred")
    ).agg(F.count(F.lit(1)).alias("n"))


def _known(labels: int) -> Column:
    return F.sequence(F.lit(0), F.lit(labels - 1)) if labels else F.expr("CAST(array() AS ARRAY<INT>)")


def label_universe(counts: DataFrame, labels: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    """Known labels 0..labels-1 together with every label seen as truth or prediction."""
    seen = counts.groupBy(*keys).agg(F.collect_set("label").alias("a"), F.collect_set("pred").alias("b"))
    return seen.select(*keys, F.array_sort(F.array_union(_known(labels), F.array_union("a", "b"))).alias("labels"))


def confusion_matrix(counts: DataFrame, labels: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    """Dense (keys, label, pred, n) over the label universe.

    The labels of a key are one list; its cells are made by exploding that list twice, so no row
    ever holds labels squared. The counts are needed twice, for the labels and the cells, and
    written in between, so what led to them runs once.
    """
    counts = stored(counts, "confusion")
    seen = label_universe(counts, labels, keys)
    grid = seen.select(*keys, "labels", F.explode("labels").alias("label")).select(*keys, "label", F.explode("labels").alias("pred"))
    zeros = grid.select(*keys, "label", "pred", F.lit(0).cast("long").alias("n"))
    return counts.select(*zeros.columns).unionByName(zeros).groupBy(*keys, "label", "pred").agg(F.sum("n").alias("n"))


def per_label_metrics(counts: DataFrame, labels: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, tnr and support per label; 0/0 is 0.

    One pass over the counts: both sides of each cell are summed per label, the labels of a key
    are gathered into one short array, and known labels that did not occur are added to it.
    """
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(zero)
    sides = counts.select(*keys, F.inline(F.array(
        F.struct(F.col("label").alias("label"), hit.alias("tp"), F.col("n").alias("truth"), zero.alias("guess")),
        F.struct(F.col("pred").alias("label"), zero.alias("tp"), zero.alias("truth"), F.col("n").alias("guess")))))
    sums = sides.groupBy(*keys, "label").agg(F.sum("tp").alias("tp"), F.sum("truth").alias("truth"), F.sum("guess").alias("guess"))
    packed = sums.groupBy(*keys).agg(F.collect_list(F.struct("label", "tp", "truth", "guess")).alias("rows"), F.sum("truth").alias("total"))
    absent = F.array_except(_known(labels), F.transform("rows", lambda r: r["label"]))
    filler = F.transform(absent, lambda x: F.struct(x.alias("label"), zero.alias("tp"), zero.alias("truth"), zero.alias("guess")))
    base = packed.select(*keys, "total", F.inline(F.concat("rows", filler)))
    fp, fn = F.col("guess") - F.col("tp"), F.col("truth") - F.col("tp")
    tn = F.col("total") - F.col("tp") - fp - fn
    m = base.select(*keys, "label", "tp", fp.alias("fp"), fn.alias("fn"), tn.alias("tn"),
                    _div(F.col("tp"), F.col("guess")).alias("precision"),
                    _div(F.col("tp"), F.col("truth")).alias("recall"),
                    _div(tn, tn + fp).alias("tnr"), F.col("truth").alias("support"))
    p, r = F.col("precision"), F.col("recall")
    return m.withColumn("f1", _div(2 * p * r, p + r))


def eval_report(counts: DataFrame, labels: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    """total, correct, accuracy, full_accuracy, macro precision/recall/f1, balanced accuracy."""
    per = per_label_metrics(counts, labels, keys)
    rep = per.groupBy(*keys).agg(
        F.sum("support").alias("total"), F.sum("tp").alias("correct"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"), F.avg("recall").alias("balanced_accuracy"))
    acc = _div(F.col("correct"), F.col("total"))
    return rep.select(*keys, "total", "correct", acc.alias("accuracy"),
                      F.when(acc == 1.0, 1).otherwise(0).alias("full_accuracy"),
                      "macro_precision", "macro_recall", "macro_f1", "balanced_accuracy")


def output_cells(correct: Column, truth: Column, predicted: Column, properties: Sequence[str] = (),
                 failed: Column | None = None) -> tuple[Column, Column]:
    """(right cells, all cells) of one row: the main label plus one cell per property.

    truth and predicted are map<string, int>. An absent truth is right only when nothing was
    predicted. A failed prediction adds one wrong cell; pass failed=None to leave it out.
    """
    empty = F.expr("CAST(map() AS MAP<STRING, INT>)")
    t, p = F.coalesce(truth, empty), F.coalesce(predicted, empty)
    listed = F.array(*[F.lit(x) for x in properties]) if properties else F.expr("CAST(array() AS ARRAY<STRING>)")
    names = F.array_distinct(F.concat(listed, F.map_keys(t), F.filter(F.map_keys(p), lambda k: k != "label")))
    right = F.size(F.filter(names, lambda k: F.try_element_at(t, k).eqNullSafe(F.try_element_at(p, k))))
    extra = failed.cast("int") if failed is not None else F.lit(0)
    return correct.cast("int") + right, F.lit(1) + F.size(names) + extra


def all_output_accuracy(df: DataFrame, correct: Column, truth: Column, predicted: Column,
                        properties: Sequence[str] = (), failed: Column | None = None,
                        keys: Sequence[str] = ()) -> DataFrame:
    right, cells = output_cells(correct, truth, predicted, properties, failed)
    return df.groupBy(*keys).agg(F.coalesce(F.sum(right), F.lit(0)).alias("correct_cells"),
                                 F.coalesce(F.sum(cells), F.lit(0)).alias("cells")).withColumn(
        "all_output_accuracy", _div(F.col("correct_cells"), F.col("cells")))


def zero_totals(tasks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The all-zero summary row of tasks that have no classifier."""
    whole = [F.lit(0).cast("long").alias(c) for c in ("total", "correct")]
    real = [F.lit(0.0).alias(c) for c in ("accuracy", "macro_precision", "macro_recall", "macro_f1", "balanced_accuracy", "all_output_accuracy")]
    return tasks.select(*keys, *whole, *real, F.lit(0).alias("full_accuracy"))


def zero_confusion(tasks: DataFrame, labels: int, keys: Sequence[str]) -> DataFrame:
    """The all-zero confusion cells of tasks that have no classifier."""
    grid = tasks.select(*keys, F.explode(_known(labels)).alias("label"))
    return grid.select(*keys, "label", F.explode(_known(labels)).alias("pred"), F.lit(0).cast("long").alias("n"))


def zero_report(tasks: DataFrame, labels: int, keys: Sequence[str]) -> DataFrame:
    """All-zero per-label rows for tasks that have no classifier."""
    zeros = [F.lit(0.0).alias(c) for c in ("precision", "recall", "f1", "tnr")]
    return tasks.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(labels - 1))).alias("label"),
                        F.lit(0).cast("long").alias("support"), *zeros)
