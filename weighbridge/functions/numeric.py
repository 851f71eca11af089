"""Bounds, spans and category resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN_WIDENING = 1e-6


def literal_doubles(values: Sequence[float]) -> Column:
    """A literal array<double>; the optimizer folds it into one constant."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x.cast("double")))


def equal_spans(n: Column) -> Column:
    """n equal spans of [0, 1] as array<struct<lo, hi>>; the last end is exactly 1.0."""
    n = n.cast("int")
    return F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(
            (i / n).alias("lo"),
            F.when(i == n - 1, F.lit(1.0)).otherwise((i + 1) / n).alias("hi"),
        ),
    )


def equal_span_bounds(n: int) -> list[tuple[float, float]]:
    """The same spans as literal bounds, for a model held on the driver."""
    return [(i / n, 1.0 if i == n - 1 else (i + 1) / n) for i in range(n)]


def normalize_span(lo: Column, hi: Column) -> Column:
    """Clamp both ends, order them, and give a zero-width span a minimal width."""
    a, b = clamp01(lo), clamp01(hi)
    low, high = F.least(a, b), F.greatest(a, b)
    return F.struct(
        low.alias("lo"),
        F.when(low == high, F.least(F.lit(1.0), low + F.lit(SPAN_WIDENING))).otherwise(high).alias("hi"),
    )


def span_index(x: Column, spans: Sequence[tuple[float, float]]) -> Column:
    """Index of the half-open literal span holding x (last span closed); outside values clamp."""
    last = len(spans) - 1
    if all(spans[i][1] == spans[i + 1][0] for i in range(last)):  # no gaps: the upper ends decide
        index = F.lit(last)
        for i in range(last - 1, -1, -1):
            index = F.when(x < F.lit(spans[i][1]), F.lit(i)).otherwise(index)
        return F.when(x.isNotNull(), index)
    hit = F.lit(None).cast("int")
    for i in range(last, -1, -1):
        lo, hi = spans[i]
        inside = (x >= F.lit(lo)) & ((x <= F.lit(hi)) if i == last else (x < F.lit(hi)))
        hit = F.when(inside, F.lit(i)).otherwise(hit)
    return (
        F.when(x.isNull(), F.lit(None).cast("int"))
        .when(hit.isNotNull(), hit)
        .when(x < F.lit(spans[0][0]), F.lit(0))
        .otherwise(F.lit(last))
    )


def span_index_of(x: Column, spans: Column) -> Column:
    """The same lookup when the spans are themselves a column, array<struct<lo, hi>>."""
    last = F.size(spans) - 1
    flags = F.transform(
        spans,
        lambda s, i: (x >= s["lo"]) & ((x < s["hi"]) | ((i == last) & (x <= s["hi"]))),
    )
    pos = F.array_position(flags, F.lit(True)).cast("int")
    return (
        F.when(x.isNull(), F.lit(None).cast("int"))
        .when(pos > 0, pos - 1)
        .when(x < spans[0]["lo"], F.lit(0))
        .otherwise(last)
    )


def span_midpoint(value: Column, lo: Column, hi: Column) -> Column:
    return F.coalesce(value.cast("double"), (lo + hi) / 2)


def interpolated_weight(x: Column, low: Column, high: Column, rising: Column) -> Column:
    """Weight between low and high at x; a falling direction mirrors x."""
    t = clamp01(x)
    t = F.when(rising, t).otherwise(F.lit(1.0) - t)
    return clamp01(low + t * (high - low))


_INT_TEXT = r"^[+-]?[0-9]+$"
_FLOAT_TEXT = r"(?i)^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)$"


def parse_number(raw: Column) -> Column:
    """Trimmed text as a double, null where it is not a number."""
    text = F.trim(raw.cast("string"))
    return F.when(text.rlike(_FLOAT_TEXT), text.try_cast("double"))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, for bodies that mention it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def resolve_category(
    raw: Column, name: str, categories: int, spans: Sequence[tuple[float, float]] | None = None
) -> Column:
    """struct<category, error>: an assignment value given as text, turned into a category index.

    Whole numbers are indexes; fractions fall into a span for numerical variables and are an
    error for categorical ones; an index outside the domain is an error.
    """
    text = F.trim(raw.cast("string"))

    def with_index(b: Column) -> Column:
        t, n = b["text"], b["number"]
        whole = n.isNotNull() & ~F.isnan(n) & (F.abs(n) < F.lit(float("inf"))) & (n == F.floor(n))
        fraction = span_index(n, spans).cast("long") if spans else F.lit(None).cast("long")
        return let(F.struct(t.alias("text"), n.alias("number"), F.when(whole, n.cast("long")).otherwise(fraction).alias("index")), finish)

    def finish(b: Column) -> Column:
        t, n, index = b["text"], b["number"], b["index"]
        error = (
            F.when(t.isNull(), F.lit(f"Unsupported assignment value type for {name}"))
            .when(t == "", F.lit(f"Empty assignment value for {name}"))
            .when(n.isNull(), F.concat(F.lit("could not convert string to float: '"), t, F.lit("'")))
            .when(index.isNull(), F.concat(F.lit("Non-integer assignment "), t,
                                           F.lit(f" provided for categorical variable {name}")))
            .when((index < 0) | (index >= categories),
                  F.concat(F.lit("Assignment value "), index.cast("string"), F.lit(f" out of range for {name}")))
        )
        return F.struct(F.when((index >= 0) & (index < categories), index.cast("int")).alias("category"), error.alias("error"))

    number = F.when(F.lower(text) == "true", F.lit(1.0)).when(F.lower(text) == "false", F.lit(0.0)).otherwise(parse_number(raw))
    return let(F.struct(text.alias("text"), number.alias("number")), with_index)
