"""Ordered lists, running texts and numbered rows built in bounded pieces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import CHUNK_ROWS, number_by_position


def list_blocks(df: DataFrame, keys: Sequence[str], rank: str, value: Column, size: int, name: str) -> DataFrame:
    """The values of each key in rank order, as lists of at most ``size`` (keys, block, name)."""
    cut = df.withColumn("block", F.floor((F.col(rank) - 1) / size).cast("long"))
    packed = cut.groupBy(*keys, "block").agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), value.alias("v")))).alias("l"))
    return packed.select(*keys, "block", F.transform("l", lambda e: e["v"]).alias(name))


def indices_by_label(df: DataFrame, label: str, position: str, size: int = 10_000) -> DataFrame:
    """label -> ordered positions, as lists of bounded length."""
    ranked = number_by_position(df.select(label, position), [label], position, "__rank")
    return list_blocks(ranked, [label], "__rank", F.col(position), size, "indices")


def rolling_mean(df: DataFrame, keys: Sequence[str], position: str, value: Column, window: int, name: str,
                 rows: int = CHUNK_ROWS) -> DataFrame:
    """Mean over the last ``window`` rows of a key.

    Rows are numbered and cut into blocks; the last rows of a block also go to the next one,
    where they complete the first windows and are dropped again.
    """
    rows = max(rows, window)
    numbered = number_by_position(df.withColumn("__v", value), keys, position, "__n", rows)
    block, at = F.floor((F.col("__n") - 1) / rows), F.pmod(F.col("__n") - 1, F.lit(rows))
    copies = F.when(at > rows - window, F.array(block, block + 1)).otherwise(F.array(block))
    spread = numbered.withColumn("__home", block).withColumn("__block", F.explode(copies))
    frame = Window.partitionBy(*keys, "__block").orderBy("__n").rowsBetween(1 - window, 0)
    means = spread.withColumn(name, F.avg("__v").over(frame))
    return means.where(F.col("__home") == F.col("__block")).select(*df.columns, name)


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int) -> DataFrame:
    """First n rows per key. Spark cuts each group to n rows before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", place).where(F.col("__n") <= n).drop("__n")


def join_lines(df: DataFrame, keys: Sequence[str], order: str, line: Column, name: str, sep: str = "\n") -> DataFrame:
    """Lines of a (bounded) group joined in order."""
    packed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("t"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(packed, lambda e: e["t"]), sep).alias(name))


def transcript(df: DataFrame, keys: Sequence[str], turn: str, role: str, text: str, turns_per_part: int = 1000) -> DataFrame:
    """``[ROLE]`` tagged conversation text in turn order, in parts of bounded length."""
    tag = F.when(F.col(role) == "system", "[SYSTEM]").when(F.col(role) == "user", "[USER]").otherwise("[ASSISTANT]")
    piece = F.concat(tag, F.lit("\n"), F.trim(F.col(text)), F.lit("\n"))
    rows = df.select(*keys, turn, piece.alias("__piece")).withColumn("part", F.floor(F.col(turn) / turns_per_part).cast("long"))
    return join_lines(rows, [*keys, "part"], turn, F.col("__piece"), "transcript")


def side_by_side(df: DataFrame, label: str, a: int, b: int, position: str, value: str) -> DataFrame:
    """i-th row of label a next to the i-th row of label b."""
    rows = number_by_position(df.where(F.col(label).isin(a, b)).select(label, position, value), [label], position, "pair")
    left = rows.where(F.col(label) == a).select("pair", F.col(value).alias("left"))
    right = rows.where(F.col(label) == b).select("pair", F.col(value).alias("right"))
    return left.join(right, "pair", "full_outer")


def label_summary(df: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Count, percent text and a note on the share of every label."""
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("count"))
    totals = counts.groupBy(*keys).agg(F.sum("count").alias("__total"))
    both = counts.join(totals, list(keys)) if keys else counts.withColumn("__total", totals.select("__total").scalar())
    share = F.col("count") / F.col("__total")
    return both.select(*keys, label, "count", F.format_string("%.1f%%", share * 100).alias("percent"),
                       F.when(share > 0.4, "High volume").otherwise("Balanced").alias("note"))


def unique_titles(df: DataFrame, keys: Sequence[str], title: str, position: str, width: int = 31) -> DataFrame:
    """Repeated titles of a key get ``_2``, ``_3``, ... within the title width; numbers that would make
    another original title of the key are skipped."""
    base = F.substring(F.when(F.trim(F.coalesce(F.col(title), F.lit(""))) == "", "Sheet").otherwise(F.trim(F.col(title))), 1, width)
    rows = number_by_position(df.withColumn("__base", base), [*keys, "__base"], position, "__nth")
    suffix = lambda n: F.concat(F.lit("_"), n.cast("string"))
    cut = lambda end: F.substring(F.col("__base"), F.lit(1), F.lit(width) - end)
    # an original title that ends in a number is taken from every title it could be made of
    number = F.regexp_extract("__base", "_([1-9][0-9]{0,8})$", 1)
    made = rows.where(F.col("__nth") == 1).select(*keys, "__base", number.alias("__k")).where("__k <> ''")
    made = made.select(*keys, (F.length("__k") + 1).alias("__len"), F.col("__k").cast("long").alias("__k"),
                       F.substring(F.col("__base"), F.lit(1), F.length("__base") - F.length("__k") - 1).alias("__stem"))
    again = rows.where(F.col("__nth") == 2).select(*keys, "__base", F.explode(F.sequence(F.lit(2), F.lit(10))).alias("__len"))
    again = again.withColumn("__stem", cut(F.col("__len")))
    taken = again.join(made, [*keys, "__stem", "__len"]).groupBy(*keys, "__base").agg(F.sort_array(F.collect_list("__k")).alias("__taken"))
    j = rows.join(taken, [*keys, "__base"], "left")
    free = F.coalesce(F.aggregate("__taken", F.col("__nth"), lambda n, t: F.when((t <= n) & (t > 1), n + 1).otherwise(n)), F.col("__nth"))
    named = F.concat(cut(F.length(suffix(free))), suffix(free))
    return j.select(*df.columns, F.when(F.col("__nth") == 1, F.col("__base")).otherwise(named).alias("unique_title"))


def even_odd_split(df: DataFrame, position: str) -> DataFrame:
    """Even positions to part 0, odd ones to part 1; a set left empty repeats row 0."""
    part = F.when(F.pmod(F.col(position), F.lit(2)) == 0, 0).otherwise(1)
    rows = df.withColumn("part", part)
    only_one = df.agg((F.count(F.lit(1)) <= 1).alias("x"))
    again = df.where((F.col(position) == 0) & only_one.select("x").scalar()).withColumn("part", F.lit(1))
    return rows.unionByName(again)


def block_assignment(claims: DataFrame, samples: DataFrame, sample: str) -> DataFrame:
    """Blocks claim samples in order: the first claim wins, a claim on null takes all that remain.

    claims: (block, sample), one row per claimed index; returns (sample, block), block null for
    the samples nobody claimed.
    """
    rest = claims.where(F.col(sample).isNull()).agg(F.min("block").alias("rest_block"))
    won = claims.where(F.col(sample).isNotNull()).groupBy(sample).agg(F.min("block").alias("claimed"))
    joined = samples.select(sample).join(won, sample, "left").withColumn("rest_block", rest.select("rest_block").scalar())
    early = F.col("claimed").isNull() | (F.col("rest_block") < F.col("claimed"))
    return joined.select(sample, F.when(early, F.col("rest_block")).otherwise(F.col("claimed")).alias("block"))


def coverage(expected: DataFrame, used: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Per group: expected, used and missing counts and whether everything is covered."""
    hit = used.select(*by, key).distinct().withColumn("__hit", F.lit(1))
    j = expected.select(*by, key).distinct().join(hit, [*by, key], "left")
    return j.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count("__hit").alias("used"),
                              F.count_if(F.col("__hit").isNull()).alias("missing")).withColumn("covered", F.col("missing") == 0)


def property_matrix(df: DataFrame, idx: str, scores: str, properties: Sequence[str]) -> DataFrame:
    """One column per property from a map of scores; absent values are 0."""
    return df.select(idx, *[F.coalesce(F.try_element_at(F.col(scores), F.lit(p)).try_cast("double"), F.lit(0.0)).alias(p) for p in properties])
