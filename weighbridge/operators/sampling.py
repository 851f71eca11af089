"""Seeded sampling: stratified, balanced, unseen, subsets, buckets.

All draws come from md5 keys of row ids, so they do not depend on partitioning. Ranks of all rows are
chunked running counts, and k first rows are found from counts of keys by their leading
digits, so one label may hold any share of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.permuted import permute
from ..functions.seeded import draw_index, md5_bucket, md5_key, u01
from ..sources.storage import stored
from .analysis import combinations, explode_range, radix_digits, radix_index
from .ordered import chunked, number_by_key, number_by_position, running, smallest_key


def stratified_rank(df: DataFrame, by: Sequence[str], seed, ids: Sequence[str], name: str = "rank") -> DataFrame:
    """Random rank (1-based) inside each stratum."""
    keyed = df.withColumn("__key", md5_key(seed, *[F.col(i) for i in ids]))
    return number_by_key(keyed, by, "__key", name, tie=ids).drop("__key")


def seeded_shuffle(df: DataFrame, seed, ids: Sequence[str]) -> DataFrame:
    """Random order as an explicit position column (0-based)."""
    ranked = stratified_rank(df, [], seed, ids, "__rank")
    return ranked.withColumn("position", F.col("__rank") - 1).drop("__rank")


def sample_rows(df: DataFrame, k: int, seed, ids: Sequence[str]) -> DataFrame:
    """k rows without replacement (all rows if fewer): the k smallest md5 keys.

    The largest key that still belongs is found from counts; the rows are then a plain filter,
    whatever k is. Rows with equal ids have equal keys and stay or go together.
    """
    if k <= 0:
        return df.limit(0)
    key = md5_key(seed, *[F.col(i) for i in ids])
    last = smallest_key(df.select(key.alias("__key")), "__key", k)
    return df if last is None else df.where(key <= last)


def label_from_scores(scores: Column, draw: Column | None = None) -> Column:
    """Arg-max label, or a draw proportional to positive scores (uniform if none is positive)."""
    best = (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
    if draw is None:
        return F.when(F.size(scores) == 0, F.lit(0)).otherwise(best)
    positive = F.transform(scores, lambda s: F.greatest(s, F.lit(0.0)))
    total = F.aggregate(positive, F.lit(0.0), lambda a, x: a + x)
    target = draw * total
    running = F.transform(
        F.sequence(F.lit(1), F.size(scores)),
        lambda i: F.aggregate(F.slice(positive, F.lit(1), i), F.lit(0.0), lambda a, x: a + x),
    )
    first = (F.array_position(F.transform(running, lambda c: target <= c), F.lit(True)) - 1).cast("int")
    return (
        F.when(F.size(scores) == 0, F.lit(0))
        .when(total <= 0, F.floor(draw * F.size(scores)).cast("int"))
        .otherwise(F.when(first >= 0, first).otherwise(best))
    )


BUCKET_ROWS = 1_000_000


def key_buckets(df: DataFrame, by: Sequence[str], key: Column, rows: int = BUCKET_ROWS) -> tuple[DataFrame, int]:
    """How many rows of each stratum have an md5 key with the same leading digits, and how many lie before them, as
    a written table (by..., __bucket, __count, __before), and the number of digits: enough for
    at most about ``rows`` rows a bucket."""
    digits = 3
    while True:
        counts = stored(df.select(*by, md5_bucket(key, digits).alias("__bucket")).groupBy(*by, "__bucket").agg(F.count("*").alias("__count")), "buckets")
        most = counts.agg(F.max("__count")).first()[0] or 0
        if most <= rows or digits >= 7:
            break
        digits = min(7, digits + max(1, math.ceil(math.log(most / rows, 16))))
    before = F.coalesce(F.sum("__count").over(Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("__before", before), digits


def _in_buckets(df: DataFrame, by: Sequence[str], key: Column, ids: Sequence[str], wanted: DataFrame, digits: int) -> DataFrame:
    """The rows of the wanted buckets (by..., __bucket, __before) with ``__rank`` in their stratum."""
    keyed = df.select(*df.columns, key.alias("__key"), md5_bucket(key, digits).alias("__bucket"))
    here = Window.partitionBy(*by, "__bucket").orderBy("__key", *ids)
    found = keyed.join(wanted.select(*by, "__bucket", "__before"), [*by, "__bucket"])
    return found.withColumn("__rank", F.row_number().over(here) + F.col("__before")).select(*df.columns, "__rank")


def bottom_rows(df: DataFrame, by: Sequence[str], k: int, seed, ids: Sequence[str]) -> DataFrame:
    """The k rows of each stratum that come first in a seeded shuffle (all of a smaller one).

    One pass counts keys by their leading digits; a second one takes only the rows of buckets that begin
    before the k-th row, so a pool of any size is neither sorted nor shuffled. Strata with a null are left out."""
    key = md5_key(seed, *[F.col(i) for i in ids])
    buckets, digits = key_buckets(df, by, key)
    return _in_buckets(df, by, key, ids, buckets.where(F.col("__before") < k), digits).where(F.col("__rank") <= k).drop("__rank")


def balanced_sample(df: DataFrame, label: str, labels: int, n: int, seed, ids: Sequence[str]) -> DataFrame:
    """n draws: n // labels per label without replacement, a short pool topped up with
    replacement, what is left drawn with replacement from the largest pool, then shuffled.

    A draw is a rank in the seeded shuffle of its label's pool. Counts of keys by their leading digits tell
    which bucket holds a rank, so only rows of buckets with a draw are shuffled; pool sizes (one number
    per label) go into the draw table as literals. ``df`` is written once, as it is counted and picked from.
    """
    spark = df.sparkSession
    df = stored(df, "pool")
    key = md5_key(seed, *[F.col(i) for i in ids])
    buckets, digits = key_buckets(df.where(F.col(label).between(0, labels - 1)), [label], key)
    pools = {r[label]: r["n"] for r in buckets.groupBy(label).agg(F.sum("__count").alias("n")).collect()}
    base = n // labels
    sizes = [pools.get(i, 0) for i in range(labels)]
    largest = max(range(labels), key=lambda i: (sizes[i], -i))
    if sizes[largest] == 0:
        return df.limit(0).withColumn("draw", F.lit(0).cast("long")).withColumn("position", F.lit(0).cast("long"))
    filled = [i for i in range(labels) if sizes[i]]
    regular = base * len(filled)
    slot = F.floor(F.col("draw") / F.lit(max(base, 1))).cast("int")
    is_regular = F.col("draw") < regular
    lbl = F.when(is_regular, F.get(F.array(*[F.lit(i) for i in filled]), slot)).otherwise(F.lit(largest))
    nth = F.when(is_regular, F.col("draw") - slot * base)
    draws = spark.range(n).withColumnRenamed("id", "draw").select("draw", lbl.alias("__label"), nth.alias("__nth"))
    pool = F.get(F.array(*[F.lit(s).cast("long") for s in sizes]), F.col("__label"))
    again = draw_index(pool, seed, F.lit("again"), F.col("draw")) + 1
    draws = draws.withColumn("__wanted", F.when(F.col("__nth") < pool, F.col("__nth") + 1).otherwise(again))
    wanted = buckets.where(F.col("__before") < base).select(label, "__bucket", "__before")  # all of a short pool
    if n > regular:  # ranks anywhere in the largest pool; they meet buckets by stretches of ranks of about a bucket's size
        width = F.lit(max(sizes[largest] // 16 ** digits, 1)).cast("long")
        stretch = lambda rank: F.call_function("div", rank - 1, width)
        cut = buckets.where(F.col(label) == largest).select(label, "__bucket", "__before", "__count", F.explode(F.sequence(
            stretch(F.col("__before") + 1), stretch(F.col("__before") + F.col("__count")))).alias("__stretch"))
        rest = draws.where(F.col("draw") >= regular).select("__wanted", stretch(F.col("__wanted")).alias("__stretch")).join(cut, "__stretch")
        hit = rest.where((F.col("__wanted") > F.col("__before")) & (F.col("__wanted") <= F.col("__before") + F.col("__count")))
        wanted = wanted.unionByName(hit.select(label, "__bucket", "__before")).distinct()
    ranked = _in_buckets(df, [label], key, ids, wanted, digits)
    rows = draws.join(ranked, (F.col("__label") == F.col(label)) & (F.col("__wanted") == F.col("__rank"))).select(*df.columns, "draw")
    return seeded_shuffle(rows, f"{seed}-order", ["draw"])


def unseen(all_rows: DataFrame, seen: DataFrame, variables: Sequence[str], cap: int | None, seed, id_: str) -> DataFrame:
    """Combinations that do not occur in the seen rows, at most ``cap`` of them."""
    rest = all_rows.join(seen.select(*variables).distinct(), list(variables), "left_anti")
    return rest if cap is None else sample_rows(rest, cap, seed, [id_])


def sample_configurations(df: DataFrame, names: Sequence[str], sizes: Sequence[int | Column], k: int | None, seed, keys: Sequence[str]) -> DataFrame:
    """For each row, k distinct combinations of its category domains (all of them, in order, if there are no
    more than k or k is None), as rows (..., draw, aid, names...).

    The draws are images under a seeded permutation of the combinations' numbers, so only those drawn are
    ever made, without a shuffle. ``keys`` make rows draw on their own.
    """
    total = F.col("__combinations")
    rows = explode_range(df.withColumn("__combinations", combinations(sizes)), total if k is None else F.least(total, F.lit(max(k, 0)).cast("long")), "draw")
    drawn = F.col("draw") if k is None else F.when(total <= k, F.col("draw")).otherwise(permute(F.col("draw"), total, seed, *[F.col(x) for x in keys]))
    rows = rows.select(*df.columns, "draw", drawn.alias("aid"))
    return rows.select("*", *[d.alias(n) for n, d in zip(names, radix_digits(F.col("aid"), sizes))])


def unseen_draws(domains: DataFrame, seen: DataFrame, keys: Sequence[str], names: Sequence[str], sizes: Sequence[int | Column],
                 cap: int | None, seed, rows: int = 1_000_000) -> DataFrame:
    """Combinations that do not occur in ``seen`` (keys..., names...), at most ``cap`` distinct random ones for each
    row of ``domains`` (one row per key; all, in order, if there are no more or ``cap`` is None), as rows
    (domains' columns, aid, names...).

    The product is never made: of N combinations and m seen ones, draws are numbers below N - m, and the j-th
    unseen combination is j + t, where t counts the seen ones with at most j unseen ones before them. Sorted seen
    numbers and draws meet in one running count, cut by ranges, so neither a key's seen rows nor its draws need
    to fit a task. Seen rows with a null or a category outside its domain are no combinations.
    """
    if not names:
        raise ValueError("no variables")
    group = list(keys) or ["__all"]
    domains, seen = (df if keys else df.withColumn("__all", F.lit(0)) for df in (domains, seen))
    sized = domains.select(*domains.columns, *[(n if isinstance(n, Column) else F.lit(n)).cast("long").alias(f"__n{i}") for i, n in enumerate(sizes)])
    size = [F.col(f"__n{i}") for i in range(len(names))]
    inside = F.lit(True)
    for n, s in zip(names, size):
        inside = inside & F.col(f"__s_{n}").between(0, s - 1)
    known = (seen.select(*group, *[F.col(n).alias(f"__s_{n}") for n in names]).join(sized.select(*group, *[f"__n{i}" for i in range(len(names))]), group)
             .where(inside).select(*group, radix_index([F.col(f"__s_{n}") for n in names], size).alias("__seen")).distinct())
    known = stored(known, "seen")
    many = known.groupBy(*group).agg(F.count("*").alias("__m"))
    left = combinations(size) - F.coalesce("__m", F.lit(0))
    free = sized.join(many, group, "left").withColumn("__left", left).drop("__m")
    draws = explode_range(free, F.col("__left") if cap is None else F.least(F.col("__left"), F.lit(max(cap, 0)).cast("long")), "__draw")
    at = F.col("__draw") if cap is None else F.when(F.col("__left") <= cap, F.col("__draw")).otherwise(permute(F.col("__draw"), F.col("__left"), seed, *[F.col(x) for x in keys]))
    order = [*group, "__seen"]
    ranked = running(chunked(known, order, rows), group, ["__seen"], F.col("__part"), {"__rank": ("sum", F.lit(1).cast("long"))})
    gaps = ranked.select(*group, (F.col("__seen") - F.col("__rank") + 1).alias("__at"), F.lit(0).alias("__kind"), F.col("__seen").alias("__tie"))
    wanted = draws.select(*domains.columns, *[f"__n{i}" for i in range(len(names))], at.alias("__at"), F.lit(1).alias("__kind"), F.col("__draw").alias("__tie"))
    both = wanted.unionByName(gaps, allowMissingColumns=True)
    place = ["__at", "__kind", "__tie"]
    counted = running(chunked(both, [*group, *place], rows), group, place, F.col("__part"), {"__before": ("sum", F.when(F.col("__kind") == 0, 1).otherwise(0).cast("long"))})
    found = counted.where("__kind = 1").withColumn("aid", F.col("__at") + F.col("__before"))
    return found.select(*[c for c in domains.columns if c != "__all"], "aid", *[d.alias(n) for n, d in zip(names, radix_digits(F.col("aid"), size))])


def subset_rows(df: DataFrame, label: str, k: int, seed, ids: Sequence[str], balance: bool = True) -> DataFrame:
    """k uniform rows, or half per label 0 and 1 capped by the smaller class."""
    total, n0, n1 = df.agg(F.count(F.lit(1)), F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).first()
    if k >= total:
        raise ValueError(f"subset size {k} must be smaller than the number of rows {total}")
    if not balance or not n0 or not n1:
        return sample_rows(df, k, seed, ids)
    cap = min(n0, n1, k // 2)
    if cap == 0:
        raise ValueError(f"no balanced subset of size {k}: class0={n0}, class1={n1}")
    binary = df.where(F.col(label).isin(0, 1))
    return bottom_rows(binary, [label], cap, seed, ids)


def bucketize(df: DataFrame, buckets: int, seed, ids: Sequence[str]) -> DataFrame:
    """Random non-empty buckets: the first ``buckets`` rows of a shuffle open one each."""
    shuffled = seeded_shuffle(df, seed, ids)
    return shuffled.withColumn(
        "bucket",
        F.when(F.col("position") < buckets, F.col("position"))
        .otherwise(F.floor(u01(seed, F.lit("bucket"), *[F.col(i) for i in ids]) * buckets)).cast("int"),
    ).drop("position")


def sample_in_span(lo: Column, hi: Column, seed, *parts: Column) -> Column:
    """Uniform value inside a span."""
    return lo + u01(seed, *parts) * (hi - lo)


def running_scores(scores: Column) -> Column:
    """Cumulative positive scores over the labels of one row."""
    return F.transform(
        F.sequence(F.lit(1), F.size(scores)),
        lambda i: F.aggregate(F.slice(scores, F.lit(1), i), F.lit(0.0), lambda a, x: a + F.greatest(x, F.lit(0.0))))


def oracle_samples(df: DataFrame, k: int, seed, id_: str) -> DataFrame:
    """k rows by a fixed seed, numbered in id order; asking for more rows than there are is an error."""
    total = df.count()
    if k > total:
        raise ValueError(f"Requested more oracle samples than available in the dataset: requested={k}, available={total}")
    return number_by_position(sample_rows(df, k, seed, [id_]), [], id_, "place")


def example_assignment(domains: DataFrame, seed, id_: str) -> DataFrame:
    """One random category per (id, var) with n categories, and the line that describes it."""
    return domains.select(
        id_, "var", draw_index(F.col("n"), seed, F.col(id_), F.col("var")).cast("int").alias("cat"),
        F.concat(F.lit("- "), F.col("var"), F.lit(": num categories = "), F.col("n").cast("string")).alias("line"))


def property_hints(names: DataFrame, keys: Sequence[str], value: str, k: int, seed) -> DataFrame:
    """Up to k random values per key. A small k lets Spark cut every group before the shuffle."""
    from pyspark.sql import Window
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(md5_key(seed, F.col(value)), value))
    return names.withColumn("__r", place).where(F.col("__r") <= k).select(*keys, value)
