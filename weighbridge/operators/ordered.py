"""Running aggregates over groups of any size.

A plain window puts a whole group into one task. Here each group is cut into chunks along
its order, chunks are scanned on their own, and the totals of earlier chunks (a table that
is smaller by the chunk size) are added, so one group may hold any share of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seeded import md5_bucket
from ..sources.storage import stored

CHUNK_ROWS = 1_000_000

_FUNCS = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}


def _merge(kind: str, before: Column, here: Column) -> Column:
    if kind in ("sum", "count"):
        return F.when(before.isNull(), here).when(here.isNull(), before).otherwise(before + here)
    return F.greatest(before, here) if kind == "max" else F.least(before, here)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    chunk: Column,
    aggs: dict[str, tuple[str, Column]],
    before_row: bool = False,
) -> DataFrame:
    """Add running aggregates ``name -> (sum|max|min|count, expression)`` per key in order.

    ``chunk`` must rise with the order. With ``before_row`` the current row is left out.
    max and min also take structs, so "latest non-null by position" is a running max of
    ``struct(position, value)``.
    """
    keys = list(keys)
    cut = df.withColumn("__chunk", chunk)
    frame = Window.partitionBy(*keys, "__chunk").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1 if before_row else 0
    )
    local = cut.select(
        "*", *[_FUNCS[kind](expr).over(frame).alias(f"__in_{name}") for name, (kind, expr) in aggs.items()]
    )
    totals = cut.groupBy(*keys, "__chunk").agg(
        *[_FUNCS[kind](expr).alias(f"__all_{name}") for name, (kind, expr) in aggs.items()]
    )
    earlier = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        "__chunk",
        *[
            (F.sum if kind in ("sum", "count") else _FUNCS[kind])(f"__all_{name}").over(earlier).alias(f"__before_{name}")
            for name, (kind, _) in aggs.items()
        ],
    )
    left, right = local.alias("__l"), offsets.alias("__r")
    cond = F.lit(True)
    for k in (*keys, "__chunk"):
        cond = cond & F.col(f"__l.{k}").eqNullSafe(F.col(f"__r.{k}"))
    return left.join(right, cond, "inner").select(
        *[F.col(f"__l.{c}") for c in df.columns],
        *[
            _merge(kind, F.col(f"__r.__before_{name}"), F.col(f"__l.__in_{name}")).alias(name)
            for name, (kind, _) in aggs.items()
        ],
    )


def position_chunk(position: Column, rows: int = CHUNK_ROWS) -> Column:
    """Chunk of an integer position that is unique within its group."""
    return F.floor(position / rows).cast("long")


def number_by_position(df, keys, position: str, name: str = "rn", rows: int = CHUNK_ROWS) -> DataFrame:
    """row_number() per key along an integer position column."""
    return running(df, keys, [position], position_chunk(F.col(position), rows), {name: ("sum", F.lit(1).cast("long"))})


def number_by_key(df, keys, key: str, name: str = "rn", tie: Sequence[str] = (), rows: int = CHUNK_ROWS) -> DataFrame:
    """row_number() per key along an md5 key column (a seeded shuffle).

    The input is written once; chunks are cut by as many leading digits as bring the whole table down to
    about ``rows`` rows a chunk, so totals stay few however small the groups are.
    """
    kept = stored(df, "ranked")
    digits = max(1, math.ceil(math.log(max(1.0, kept.count() / rows), 16)))
    return running(kept, keys, [key, *tie], md5_bucket(F.col(key), digits), {name: ("sum", F.lit(1).cast("long"))})


def chunked(df: DataFrame, order: Sequence[Column | str], rows: int = CHUNK_ROWS) -> DataFrame:
    """The rows in a written table with ``__part``, a chunk number that rises with ``order``.

    Spark's range partitioning cuts the order into pieces of about ``rows`` rows, however many
    rows there are; equal values are split as well if ``order`` ends in a column that tells them apart. The
    table is written because both passes of ``running`` must see the same cuts.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))
    return stored(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ordered")


def number_by_value(df: DataFrame, column: str, tie: str, name: str = "rn", descending: bool = False) -> DataFrame:
    """row_number() of the whole table by a column, ties by a second one."""
    order = [F.col(column).desc() if descending else F.col(column), F.col(tie)]
    return running(chunked(df, order), [], order, F.col("__part"), {name: ("sum", F.lit(1).cast("long"))}).drop("__part")


def smallest_key(df: DataFrame, key: str, k: int, digits: int = 3, size: int = 32) -> str | None:
    """The k-th smallest of hexadecimal keys, found a few digits at a time from counts (16**digits
    numbers per pass reach the driver); null when there are no more than k rows."""
    known, left = "", k
    while len(known) < size:
        step = min(digits, size - len(known))
        near = df.where(F.col(key).startswith(known)) if known else df
        counts = sorted((r["d"], r["count"]) for r in near.groupBy(F.substring(key, len(known) + 1, step).alias("d")).count().collect())
        if sum(n for _, n in counts) <= left:
            return known + "g" if known else None  # every key with this beginning
        for d, n in counts:
            if n >= left:
                known += d
                break
            left -= n
    return known
