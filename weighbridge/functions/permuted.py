"""A seeded permutation of the numbers below N as a column: k distinct draws from a range of any size.

A number x is split into (x div b, x mod b) with b close to the root of N, and goes through Feistel rounds over
the two halves, each adding an md5 draw of the other half. That permutes the a * b >= N pairs; as fewer than b of
them are N or more, such an image is simply sent through again until it falls below N (cycle walking).
Nothing is stored: the image of any number is known on its own, so draws can be made in any number of tasks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .seeded import md5_key

ROUNDS = 6
WALK = 64  # steps for b below 64, where fewer than b images are outside; else 12 steps, each outside less than once in b


def _long(x: int | Column) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("long")


def halves(n: Column) -> tuple[Column, Column]:
    """(a, b): the sizes of the halves, a * b >= n and a * b - n < b."""
    b = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("long"), F.lit(1).cast("long"))
    return F.call_function("div", n + b - 1, b), b


def permute(x: int | Column, n: int | Column, seed, *parts) -> Column:
    """The image of x (0 <= x < n) under the permutation of [0, n) that seed and parts choose.

    n may differ from row to row, up to 2**62; null for x outside. Draws of different (seed, parts)
    are unrelated."""
    x, n = _long(x), _long(n)
    a, b = halves(n)
    # bound once: written out, the sizes would be worked out anew in every round
    sizes = F.array(F.struct(n.alias("n"), a.alias("a"), b.alias("b")))
    image = F.get(F.transform(sizes, lambda s: _image(x, s["n"], s["a"], s["b"], seed, parts)), F.lit(0))
    return F.when((x >= 0) & (x < n), image)


def _image(x: Column, n: Column, a: Column, b: Column, seed, parts) -> Column:
    def step(pair: Column, i: Column) -> Column:
        draw = F.conv(F.substring(md5_key(seed, *parts, i, pair["r"]), 1, 15), 16, 10).cast("long")
        # even rounds move the left half (below a), odd ones the right half (below b): they change places
        size = F.when(i % 2 == 0, a).otherwise(b)
        return F.struct(pair["r"].alias("l"), F.pmod(pair["l"] + F.pmod(draw, size), size).alias("r"))

    def once(value: Column) -> Column:
        start = F.struct(F.call_function("div", value, b).alias("l"), (value % b).alias("r"))
        end = F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, step)
        return F.aggregate(F.array(end), F.lit(0).cast("long"), lambda _, p: p["l"] * b + p["r"])

    walk = F.sequence(F.lit(0).cast("long"), F.least(a * b - n, F.when(b < WALK, WALK).otherwise(12).cast("long")))
    return F.aggregate(walk, x, lambda value, i: F.when((i == 0) | (value >= n), once(value)).otherwise(value))
