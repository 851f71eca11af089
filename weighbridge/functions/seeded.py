"""Reproducible randomness from md5, independent of partitioning and of the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.lit(c)


def md5_key(seed, *parts) -> Column:
    """32 hex digits of ``seed|part|part...``; ordering by it is a seeded shuffle."""
    return F.md5(F.concat_ws("|", *[_col(p).cast("string") for p in (seed, *parts)]))


def u01(seed, *parts) -> Column:
    """Uniform double in [0, 1) from the first 32 bits of the md5 key."""
    return F.conv(F.substring(md5_key(seed, *parts), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def draw_index(n, seed, *parts) -> Column:
    """Uniform integer in [0, n)."""
    return F.floor(u01(seed, *parts) * _col(n)).cast("long")


def md5_bucket(key: Column, digits: int = 3) -> Column:
    """Leading hex digits as a number: an order-preserving, evenly filled bucket of an md5 key."""
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("int")
