"""Populations of candidate models, generated, mutated, scored and selected as tables.

All candidates of a population share a shape (variables, category counts, rule variables);
their parameters are flat arrays in a fixed layout, so scoring a candidate on an assignment
is plain array indexing and the only shuffle is the aggregate per candidate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clamp01, equal_span_bounds, interpolated_weight
from ..functions.seeded import draw_index, u01
from ..sources.storage import cut_lineage
from .analysis import analysis_aggregates, early_stop_minimum, passes, penalty, radix_digits, with_fractions
from .ordered import number_by_value
from .scoring import argmax_label, decisiveness, ratio


@dataclass(frozen=True)
class Shape:
    """Structure shared by a population: category counts, numerical flags, rule conditions."""

    labels: int
    sizes: tuple[int, ...]
    numerical: tuple[bool, ...]
    rules: tuple[tuple[int, int, int, int], ...]  # (var_a, val_a, var_b, val_b)

    @property
    def assignments(self) -> int:
        total = 1
        for n in self.sizes:
            total *= n
        return total

    def offset(self, label: int, var: int) -> int:
        """Start of a variable's cells in the flat arrays: label-major, then variable, then category."""
        return label * sum(self.sizes) + sum(self.sizes[:var])

    @property
    def cells(self) -> int:
        return self.labels * sum(self.sizes)


def random_population(ids: DataFrame, shape: Shape, seed, id_: str = "cand") -> DataFrame:
    """One candidate per id with seeded parameters.

    weight, score: one cell per (label, variable, category); a numerical variable uses its
    first two weight cells as its bounds and its first score cell as its score.
    """
    cid = F.col(id_)

    def draws(tag: str, n: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: u01(seed, cid, F.lit(tag), i))

    return repair(ids.select(
        cid.alias("cand"),
        draws("w", shape.cells).alias("w"),
        draws("s", shape.cells).alias("s"),
        F.transform(draws("d", shape.labels * len(shape.sizes)), lambda u: u < 0.5).alias("falling"),
        (draws("rw", len(shape.rules)) if shape.rules else F.expr("CAST(array() AS ARRAY<DOUBLE>)")).alias("rw"),
        (draws("rs", len(shape.rules)) if shape.rules else F.expr("CAST(array() AS ARRAY<DOUBLE>)")).alias("rs"),
        F.array(*[F.lit(r[1]) for r in shape.rules]).cast("array<int>").alias("ra"),
    ), shape)


def repair(cands: DataFrame, shape: Shape) -> DataFrame:
    """Put the bounds of numerical variables back in order (lower cell first)."""
    lows = [shape.offset(lbl, v) for lbl in range(shape.labels) for v, num in enumerate(shape.numerical) if num]
    if not lows:
        return cands
    low, high = F.array(*[F.lit(i) for i in lows]), F.array(*[F.lit(i + 1) for i in lows])
    w = F.col("w")
    return cands.withColumn("w", F.transform(
        w, lambda x, i: F.when(F.array_contains(low, i), F.least(x, F.get(w, i + 1)))
        .when(F.array_contains(high, i), F.greatest(x, F.get(w, i - 1))).otherwise(x)))


def mutate(cands: DataFrame, shape: Shape, seed, rate: float, strength: float = 0.1) -> DataFrame:
    """Shake each cell with probability ``rate``; weight and score of a cell move together.

    Rules move the same way and re-draw their first condition at half the rate. Columns other
    than the parameters pass through; the draw is keyed by ``cand``.
    """
    cid = F.col("cand")

    def noise(tag: str, i: Column) -> Column:
        return (u01(seed, cid, F.lit(tag), i) * 2 - 1) * strength

    def moved(column: str, gate_tag: str, tag: str, gate_of=lambda i: i) -> Column:
        return F.transform(column, lambda x, i: F.when(
            u01(seed, cid, F.lit(gate_tag), gate_of(i)) < rate, clamp01(x + noise(tag, i))).otherwise(x))

    # cells of one numerical variable and label share a gate, as they are one mutable unit
    unit = list(range(shape.cells))
    for lbl in range(shape.labels):
        for v, num in enumerate(shape.numerical):
            if num:
                start = shape.offset(lbl, v)
                for k in range(shape.sizes[v]):
                    unit[start + k] = start
    units = F.array(*[F.lit(u) for u in unit])
    retarget = F.array(*[F.lit(shape.sizes[r[0]]) for r in shape.rules]).cast("array<int>")
    changed = {
        "w": moved("w", "cell", "w", lambda i: F.get(units, i)),
        "s": moved("s", "cell", "s", lambda i: F.get(units, i)),
        "rw": moved("rw", "rule", "rw"),
        "rs": moved("rs", "rule", "rs"),
        "ra": F.transform("ra", lambda x, i: F.when(
            u01(seed, cid, F.lit("swap"), i) < rate * 0.5,
            draw_index(F.get(retarget, i), seed, cid, F.lit("target"), i).cast("int")).otherwise(x)),
    }
    return repair(cands.withColumns(changed), shape)


def initial_population(base: DataFrame, ids: DataFrame, shape: Shape, seed, rate: float) -> DataFrame:
    """Candidate 0 is the base itself, every other id a mutant of it. ``base`` is one row."""
    one = base.limit(1).drop("cand")
    parts = one.select(F.struct(*one.columns).alias("b")).scalar()
    everyone = ids.select(F.col("cand"), parts.alias("b")).select("cand", "b.*")
    original = everyone.where(F.col("cand") == 0)
    return original.unionByName(mutate(everyone.where(F.col("cand") != 0), shape, seed, rate))


def candidate_scores(shape: Shape, digits: list[Column]) -> tuple[Column, list[Column]]:
    """Scores per label of the assignment with the given digits, from the flat parameter arrays."""
    scores = []
    for lbl in range(shape.labels):
        weighted, weights = F.lit(0.0), F.lit(0.0)
        for v, d in enumerate(digits):
            start = shape.offset(lbl, v)
            if shape.numerical[v]:
                lo, hi = F.col("w")[start], F.col("w")[start + 1]
                mids = [(a + b) / 2 for a, b in equal_span_bounds(shape.sizes[v])]
                x = F.get(F.array(*[F.lit(m) for m in mids]), d)
                w = interpolated_weight(x, lo, hi, ~F.col("falling")[lbl * len(shape.sizes) + v])
                s = F.col("s")[start]
            else:
                w, s = F.get(F.col("w"), d + start), F.get(F.col("s"), d + start)
            weighted, weights = weighted + w * s, weights + w
        for r, (a, _, b, vb) in enumerate(shape.rules):
            hit = (digits[a] == F.col("ra")[r]) & (digits[b] == vb)
            w = F.when(hit, F.col("rw")[r]).otherwise(F.lit(0.0))
            weighted, weights = weighted + w * F.col("rs")[r], weights + w
        scores.append(ratio(weighted, weights))
    return F.array(*scores), scores


def explode_assignments(cands: DataFrame, shape: Shape, chunk: int = 4096) -> DataFrame:
    """Every assignment of every candidate as rows (..., aid).

    A candidate is first cut into chunks, which spreads even a single candidate over tasks.
    """
    n = shape.assignments
    chunks = (n + chunk - 1) // chunk
    cut = cands.withColumn("__c", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    # a fixed number of partitions: the rows are few and small, but each grows by the chunk
    cut = cut.repartition(int(cands.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cand", "__c")
    start = F.col("__c").cast("long") * chunk
    return cut.withColumn("aid", F.explode(F.sequence(start, F.least(start + chunk - 1, F.lit(n - 1).cast("long"))))).drop("__c")


def score_population(cands: DataFrame, shape: Shape, max_gap: float, min_required: float,
                     property_gap: Column | None = None, chunk: int = 4096) -> DataFrame:
    """Analysis, penalty and pass flag of every candidate."""
    rows = explode_assignments(cands, shape, chunk)
    digits = radix_digits(F.col("aid"), shape.sizes)
    rows = rows.select("cand", "aid", *[c for c in ("w", "s", "falling", "rw", "rs", "ra")],
                       *[d.alias(f"__d{i}") for i, d in enumerate(digits)])
    scored = rows.select("cand", "aid", candidate_scores(shape, [F.col(f"__d{i}") for i in range(len(digits))])[0].alias("scores"))
    scored = scored.select("cand", "aid", argmax_label(F.col("scores")).alias("label"),
                           F.array_max("scores").alias("score"), decisiveness(F.col("scores")).alias("decisiveness"))
    agg = scored.groupBy("cand").agg(
        *analysis_aggregates(shape.labels), F.min("decisiveness").alias("true_min_decisiveness"),
        early_stop_minimum(F.col("decisiveness"), F.col("aid"), min_required).alias("min_decisiveness"))
    gap_prop = property_gap if property_gap is not None else F.lit(0.0)
    return with_fractions(agg, shape.labels).select(
        "*",
        penalty(F.col("max_gap"), F.col("min_decisiveness"), gap_prop, min_required).alias("penalty"),
        passes(F.col("max_gap"), F.col("min_decisiveness"), max_gap, min_required).alias("passes"))


def elite(scored: DataFrame, population: int) -> DataFrame:
    """The max(1, population // 4) candidates of lowest penalty, by a distributed rank."""
    k = max(1, population // 4)
    return number_by_value(scored, "penalty", "cand", "__rank").where(F.col("__rank") <= k).drop("__rank")


def best_candidate(scored: DataFrame) -> DataFrame:
    """First passing candidate in order, else the first of strictly lowest penalty."""
    key = F.struct((~F.col("passes")).alias("miss"),
                   F.when(F.col("passes"), F.lit(0.0)).otherwise(F.col("penalty")).alias("penalty"), F.col("cand"))
    return scored.agg(F.min_by(F.struct("cand", "penalty", "passes"), key).alias("b")).select("b.*")


def next_generation(cands: DataFrame, winners: DataFrame, shape: Shape, population: int, seed, rate: float) -> DataFrame:
    """Winners keep their places 0..k-1, the other places are mutants of randomly chosen winners."""
    k = max(1, population // 4)
    places = number_by_value(winners.select("cand", "penalty"), "penalty", "cand", "place")
    ranked = places.select("cand", (F.col("place") - 1).cast("int").alias("place"))
    parents = cands.join(ranked, "cand").drop("cand")
    places = cands.sparkSession.range(population).withColumnRenamed("id", "cand").withColumn(
        "place", F.when(F.col("cand") < k, F.col("cand")).otherwise(draw_index(F.lit(k), seed, F.lit("parent"), F.col("cand"))).cast("int"))
    filled = places.join(parents, "place").drop("place")
    keep = filled.where(F.col("cand") < k)
    return keep.unionByName(mutate(filled.where(F.col("cand") >= k), shape, seed, rate).select(*keep.columns))


def evolve(cands: DataFrame, shape: Shape, budget: int, population: int, max_gap: float, min_required: float,
           seed, rate: float = 0.2) -> dict:
    """Generations of score, select, mutate until one passes or the evaluation budget is spent.

    The population is fixed in size; each generation is cut from its lineage by a reliable
    checkpoint, so a lost executor costs one generation at most. Returns the best candidate
    and the numbers of evaluations and generations.
    """
    best, evaluations, generation = None, 0, 0
    while evaluations < budget:
        room = min(population, budget - evaluations)
        scored = cut_lineage(score_population(cands.where(F.col("cand") < room), shape, max_gap, min_required))
        top = best_candidate(scored).first()
        if top["passes"]:
            return {"cand": top["cand"], "penalty": top["penalty"], "passes": True,
                    "evaluations": evaluations + top["cand"] + 1, "generations": generation,
                    "population": cands, "scored": scored}
        if best is None or top["penalty"] < best["penalty"]:
            best = {"cand": top["cand"], "penalty": top["penalty"], "passes": False, "population": cands, "scored": scored}
        evaluations += room
        cands = cut_lineage(next_generation(cands, elite(scored, population), shape, population, f"{seed}-{generation}", rate))
        generation += 1
    return {**(best or {}), "evaluations": evaluations, "generations": generation}


def random_rules(ids: DataFrame, sizes: list[int], count: int, seed, attempts: int | None = None,
                 allow_multi_use: bool = False, id_: str = "cand") -> DataFrame:
    """Rule conditions per candidate: proposals in order, kept while both (variable, category)
    cells are still free (unless reuse is allowed), up to ``count`` rules.

    Returns ``rules`` as array<struct<var_a, val_a, var_b, val_b>>. The fold over proposals is
    bounded by the attempts, not by the data.
    """
    attempts = attempts or max(1000, count * 20)
    n, cid = len(sizes), F.col(id_)
    size_of = F.array(*[F.lit(s) for s in sizes])

    def proposal(i: Column) -> Column:
        a = draw_index(n, seed, cid, F.lit("a"), i).cast("int")
        other = draw_index(n - 1, seed, cid, F.lit("b"), i).cast("int")
        b = F.when(other >= a, other + 1).otherwise(other)
        return F.struct(
            a.alias("var_a"), draw_index(F.get(size_of, a), seed, cid, F.lit("ca"), i).cast("int").alias("val_a"),
            b.alias("var_b"), draw_index(F.get(size_of, b), seed, cid, F.lit("cb"), i).cast("int").alias("val_b"))

    proposals = F.transform(F.sequence(F.lit(0), F.lit(attempts - 1)), proposal)

    def free(kept: Column, p: Column) -> Column:
        return ~F.exists(kept, lambda k: (
            ((k["var_a"] == p["var_a"]) & (k["val_a"] == p["val_a"])) | ((k["var_b"] == p["var_a"]) & (k["val_b"] == p["val_a"]))
            | ((k["var_a"] == p["var_b"]) & (k["val_a"] == p["val_b"])) | ((k["var_b"] == p["var_b"]) & (k["val_b"] == p["val_b"]))))

    empty = F.expr("CAST(array() AS ARRAY<STRUCT<var_a: INT, val_a: INT, var_b: INT, val_b: INT>>)")

    def step(kept: Column, p: Column) -> Column:
        ok = F.size(kept) < count
        if not allow_multi_use:
            ok = ok & free(kept, p)
        return F.when(ok, F.concat(kept, F.array(p))).otherwise(kept)

    return ids.select(cid.alias("cand"), proposals.alias("__p")).select(
        "cand", F.aggregate("__p", empty, step).alias("rules"))


def random_search(scored: DataFrame) -> DataFrame:
    """The first passing candidate, else the best, with the number of evaluations it took."""
    total = scored.agg(F.count(F.lit(1)).alias("n"))
    best = best_candidate(scored)
    return best.withColumn("evaluations", F.when(F.col("passes"), F.col("cand") + 1).otherwise(total.select("n").scalar()))


PARTS = ("w", "s", "falling", "rw", "rs", "ra")


def to_long(cands: DataFrame) -> DataFrame:
    """Parameters as rows (cand, part, idx, value)."""
    parts = F.array(*[F.struct(F.lit(p).alias("part"), F.col(p).cast("array<double>").alias("v")) for p in PARTS])
    return cands.select("cand", F.explode(parts).alias("p")).select(
        "cand", F.col("p.part").alias("part"), F.posexplode("p.v").alias("idx", "value"))


def from_long(long: DataFrame, shape: Shape) -> DataFrame:
    """Rows back to one record per candidate; the size of a record is fixed by the shape."""
    def gather(part: str, kind: str) -> Column:
        cells = F.array_sort(F.collect_list(F.when(F.col("part") == part, F.struct("idx", "value"))))
        return F.transform(cells, lambda c: c["value"]).cast(f"array<{kind}>").alias(part)

    kinds = {"falling": "boolean", "ra": "int"}
    return long.groupBy("cand").agg(*[gather(p, kinds.get(p, "double")) for p in PARTS])


def summary_text(shape: Shape) -> Column:
    """Text listing of a candidate's variables and rules."""
    lines = [F.lit(f"Output labels: {shape.labels}"), F.lit(f"Variables: {len(shape.sizes)}")]
    for v, n in enumerate(shape.sizes):
        if shape.numerical[v]:
            spans = ", ".join(f"[{lo:.2f}, {hi:.2f}]" for lo, hi in equal_span_bounds(n))
            lines.append(F.lit(f"  - V{v}: type=numerical spans={spans}"))
        else:
            lines.append(F.lit(f"  - V{v}: type=categorical categories={n}"))
    lines.append(F.lit(f"Rules: {len(shape.rules)}"))

    def condition(var: int, value: Column) -> Column:
        if shape.numerical[var]:
            texts = F.array(*[F.lit(f"V{var} in [{lo:.2f}, {hi:.2f}]") for lo, hi in equal_span_bounds(shape.sizes[var])])
            return F.get(texts, value)
        return F.concat(F.lit(f"V{var}=="), value.cast("string"))

    for r, (a, _, b, vb) in enumerate(shape.rules):
        lines.append(F.concat(F.lit(f"  - R_{r}: IF "), condition(a, F.col("ra")[r]), F.lit(" AND "), condition(b, F.lit(vb)),
                              F.format_string(" -> (w=%.3f, s=%.3f)", F.col("rw")[r], F.col("rs")[r])))
    return F.concat_ws("\n", *lines)


def property_models(ids: DataFrame, shape: Shape, categories: int, labels: int, seed, name: str, id_: str = "cand") -> DataFrame:
    """A fresh model per candidate for a categorical property: the candidate's shape with its own
    parameters and ``categories`` labels, plus the main labels it applies to (at least one)."""
    own = Shape(categories, shape.sizes, shape.numerical, shape.rules)
    models = random_population(ids, own, f"{seed}-{name}", id_)
    cid = F.col("cand")
    on = F.filter(F.sequence(F.lit(0), F.lit(labels - 1)), lambda i: u01(seed, F.lit("support"), cid, i) < 0.5)
    guard = F.array(draw_index(labels, seed, F.lit("guard"), cid).cast("int"))
    return models.withColumn("support", F.when(F.size(on) == 0, guard).otherwise(on))
