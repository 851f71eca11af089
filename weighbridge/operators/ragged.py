"""Candidate models whose structure is data: each has its own variables, types, sizes and rule pairs.

A candidate is one row:

    cand, numerical array<boolean>, sizes array<int>    per variable
    starts array<int>     first cell of each variable within a label, and the cells of a label at the end
    w, s array<double>    weight and score per cell, label after label; a numerical variable has
                          its lower and upper weight in its first two cells and its score in the first
    falling array<boolean>   per label and variable
    rules array<struct<var_a, val_a, var_b, val_b, w, s>>

Generation, enumeration and scoring read the shape from the row, so one plan serves a population of any
mixture of shapes, and candidates of a fixed shape score as ``search`` scores them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import interpolated_weight
from ..functions.seeded import draw_index, u01
from .analysis import analysis_aggregates, early_stop_minimum, explode_range, passes, penalty, with_fractions
from .scoring import argmax_label, decisiveness, ratio


@dataclass(frozen=True)
class Ranges:
    """What random structures are drawn from; all bounds are inclusive. Too few free cells give fewer rules."""

    variables: tuple[int, int]
    numerical: tuple[int, int]
    categories: tuple[int, int]
    spans: tuple[int, int]
    rules: tuple[int, int]
    labels: int = 2
    allow_multi_use: bool = False

    def __post_init__(self) -> None:
        for name in ("variables", "numerical", "categories", "spans", "rules"):
            low, high = getattr(self, name)
            if low > high or low < (0 if name in ("numerical", "rules") else 1):
                raise ValueError(f"bad range of {name}: {low} to {high}")
        if self.numerical[1] > self.variables[0]:
            raise ValueError("more numerical variables than variables")
        if self.labels < 1:
            raise ValueError("at least one label")


def _numbers(n: Column) -> Column:
    """0 .. n - 1; empty for 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("CAST(array() AS ARRAY<INT>)"))


def _between(bounds: tuple[int, int], seed, *parts) -> Column:
    return (draw_index(bounds[1] - bounds[0] + 1, seed, *parts) + bounds[0]).cast("int")


def random_structures(ids: DataFrame, ranges: Ranges, seed, id_: str = "cand") -> DataFrame:
    """One random candidate per id: structure first, then parameters."""
    cid = F.col("cand")
    rows = ids.select(F.col(id_).alias("cand")).select(
        "cand", _between(ranges.variables, seed, cid, F.lit("n")).alias("__n"), _between(ranges.numerical, seed, cid, F.lit("k")).alias("__k"),
        _between(ranges.rules, seed, cid, F.lit("r")).alias("__r"))
    # the numerical variables are the first ones of a seeded shuffle
    shuffled = F.sort_array(F.transform(_numbers(F.col("__n")), lambda v: F.struct(u01(seed, cid, F.lit("type"), v).alias("u"), v.alias("v"))))
    rows = rows.withColumn("__first", F.transform(F.slice(shuffled, F.lit(1), F.col("__k")), lambda x: x["v"]))
    rows = rows.withColumn("numerical", F.transform(_numbers(F.col("__n")), lambda v: F.array_contains(F.col("__first"), v)))
    rows = rows.withColumn("sizes", F.transform("numerical", lambda num, v: F.when(num, _between(ranges.spans, seed, cid, F.lit("size"), v)).otherwise(
        _between(ranges.categories, seed, cid, F.lit("size"), v))))
    rows = rows.withColumn("starts", starts(F.col("numerical"), F.col("sizes")))
    rows = rows.withColumn("rules", _rule_pairs(ranges, seed, cid))
    cells = F.element_at("starts", -1) * ranges.labels
    low_cell = lambda i: F.exists(F.arrays_zip("numerical", F.slice("starts", F.lit(1), F.col("__n"))), lambda x: x["numerical"] & (x["1"] == F.pmod(i, F.element_at("starts", -1))))
    draw = lambda tag, i: u01(seed, cid, F.lit(tag), i)
    weight = F.transform(_numbers(cells), lambda i: F.when(low_cell(i), F.least(draw("w", i), draw("w", i + 1))).when(
        low_cell(i - 1), F.greatest(draw("w", i - 1), draw("w", i))).otherwise(draw("w", i)))
    return rows.select(
        "cand", "numerical", "sizes", "starts", weight.alias("w"), F.transform(_numbers(cells), lambda i: draw("s", i)).alias("s"),
        F.transform(_numbers(F.col("__n") * ranges.labels), lambda i: draw("d", i) < 0.5).alias("falling"),
        F.transform("rules", lambda r, i: F.struct(*[r[x].alias(x) for x in ("var_a", "val_a", "var_b", "val_b")], draw("rw", i).alias("w"), draw("rs", i).alias("s"))).alias("rules"))


def starts(numerical: Column, sizes: Column) -> Column:
    """First cells of the variables and, last, the number of cells; a numerical variable has two at least."""
    width = F.zip_with(numerical, sizes, lambda num, n: F.when(num, F.greatest(n, F.lit(2))).otherwise(n))
    return F.aggregate(width, F.array(F.lit(0)), lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n)))


def _rule_pairs(ranges: Ranges, seed, cid: Column) -> Column:
    """Pairs of cells of two variables: proposals in order, kept while both cells are free (unless reuse is
    allowed), until there are enough or max(1000, 20 * rules) were tried."""
    attempts = max(1000, 20 * ranges.rules[1])
    n = F.size("sizes")

    def proposal(i: Column) -> Column:
        a = draw_index(n, seed, cid, F.lit("a"), i).cast("int")
        other = draw_index(n - 1, seed, cid, F.lit("b"), i).cast("int")
        b = F.when(other >= a, other + 1).otherwise(other)
        return F.struct(a.alias("var_a"), draw_index(F.get("sizes", a), seed, cid, F.lit("ca"), i).cast("int").alias("val_a"),
                        b.alias("var_b"), draw_index(F.get("sizes", b), seed, cid, F.lit("cb"), i).cast("int").alias("val_b"))

    def taken(kept: Column, p: Column) -> Column:
        return F.exists(kept, lambda k: (
            ((k["var_a"] == p["var_a"]) & (k["val_a"] == p["val_a"])) | ((k["var_b"] == p["var_a"]) & (k["val_b"] == p["val_a"]))
            | ((k["var_a"] == p["var_b"]) & (k["val_a"] == p["val_b"])) | ((k["var_b"] == p["var_b"]) & (k["val_b"] == p["val_b"]))))

    def add(kept: Column, i: Column) -> Column:
        one = F.transform(F.array(proposal(i)), lambda p: p)  # proposed only while rules are missing
        free = one if ranges.allow_multi_use else F.filter(one, lambda p: ~taken(kept, p))
        return F.when(F.size(kept) < F.col("__r"), F.concat(kept, free)).otherwise(kept)

    empty = F.expr("CAST(array() AS ARRAY<STRUCT<var_a: INT, val_a: INT, var_b: INT, val_b: INT>>)")
    return F.when(n > 1, F.aggregate(F.sequence(F.lit(0), F.lit(attempts - 1)), empty, add)).otherwise(empty)


def product(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(1).cast("long"), lambda total, n: total * n)


def digits(index: Column, sizes: Column) -> Column:
    """Categories of a combination's number, the last variable changing fastest."""
    done = F.aggregate(F.reverse(sizes), F.struct(index.cast("long").alias("rest"), F.expr("CAST(array() AS ARRAY<INT>)").alias("out")), lambda s, n: F.struct(
        F.call_function("div", s["rest"], n.cast("long")).alias("rest"), F.concat(F.array((s["rest"] % n).cast("int")), s["out"]).alias("out")))
    return done["out"]


def scores(labels: int, at: Column) -> Column:
    """Scores per label of the assignment ``at`` (categories of the variables)."""
    n, cells = F.size("sizes"), F.element_at("starts", -1)
    none = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    more = lambda t, w, s: F.struct((t["a"] + w * s).alias("a"), (t["b"] + w).alias("b"))

    def score(label: Column) -> Column:
        def variable(t: Column, v: Column) -> Column:
            first = label * cells + F.get("starts", v)
            middle = (F.get(at, v) + 0.5) / F.get("sizes", v)
            ramp = interpolated_weight(middle, F.get("w", first), F.get("w", first + 1), ~F.get("falling", label * n + v))
            num = F.get("numerical", v)
            return more(t, F.when(num, ramp).otherwise(F.get("w", first + F.get(at, v))), F.get("s", F.when(num, first).otherwise(first + F.get(at, v))))

        def rule(t: Column, r: Column) -> Column:
            hit = (F.get(at, r["var_a"]) == r["val_a"]) & (F.get(at, r["var_b"]) == r["val_b"])
            return F.when(hit, more(t, r["w"], r["s"])).otherwise(t)

        return F.aggregate("rules", F.aggregate(_numbers(n), none, variable), rule, lambda t: ratio(t["a"], t["b"]))

    return F.transform(F.sequence(F.lit(0), F.lit(labels - 1)), score)


def score_structures(cands: DataFrame, labels: int, max_gap: float, min_required: float, chunk: int = 4096) -> DataFrame:
    """Analysis, penalty and pass flag of every candidate over all of its own assignments.

    A candidate's assignments are numbered in chunks, which are dealt over the tasks before they grow to rows, so
    a single candidate with a large product is spread as well."""
    step = F.lit(chunk).cast("long")
    total = product(F.col("sizes"))
    cut = explode_range(cands, F.call_function("div", total + step - 1, step), "__chunk")
    cut = cut.repartition(int(cands.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cand", "__chunk")
    begin = F.col("__chunk") * step
    rows = cut.withColumn("aid", F.explode(F.sequence(begin, F.least(begin + step, total) - 1))).withColumn("__at", digits(F.col("aid"), F.col("sizes")))
    scored = rows.select("cand", "aid", scores(labels, F.col("__at")).alias("scores"))
    scored = scored.select("cand", "aid", argmax_label(F.col("scores")).alias("label"), F.array_max("scores").alias("score"), decisiveness(F.col("scores")).alias("decisiveness"))
    agg = scored.groupBy("cand").agg(*analysis_aggregates(labels), F.min("decisiveness").alias("true_min_decisiveness"),
                                     early_stop_minimum(F.col("decisiveness"), F.col("aid"), min_required).alias("min_decisiveness"))
    return with_fractions(agg, labels).select("*", penalty(F.col("max_gap"), F.col("min_decisiveness"), F.lit(0.0), min_required).alias("penalty"),
                                              passes(F.col("max_gap"), F.col("min_decisiveness"), max_gap, min_required).alias("passes"))
