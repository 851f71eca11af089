"""Weighted scoring and arg-max labelling.

Two forms with equal results: *wide* for one model (a codegen'd expression per label, no
shuffle, no join) and *long* for tables of models (joins on parameters, then an aggregate).
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import interpolated_weight, literal_doubles, span_index, span_index_of, span_midpoint
from .model import Model


def _pick(values: list[float], index: Column) -> Column:
    """Literal table lookup by a category index; an absent or unknown category gives null."""
    return F.get(literal_doubles(values), index)


def span_bounds(model: Model, var: str, cat: Column) -> tuple[Column, Column]:
    spans = model.variable(var).spans
    return _pick([s[0] for s in spans], cat), _pick([s[1] for s in spans], cat)


def _entities(model: Model, label: int, cats: Mapping[str, Column], values: Mapping[str, Column]):
    """Ordered (name, weight, score) of one label; a missing entity has a null weight."""
    out: dict[str, tuple[Column, Column]] = {}
    for v in model.variables:
        if v.name not in cats:
            continue
        cat = cats[v.name]
        if v.numerical:
            lo, hi = span_bounds(model, v.name, cat)
            x = span_midpoint(values[v.name] if v.name in values else F.lit(None), lo, hi)
            w = interpolated_weight(x, F.lit(v.low[label]), F.lit(v.high[label]), F.lit(v.rising[label]))
            out[v.name] = (F.when(cat.isNotNull(), w), F.lit(float(v.score[label])))
        else:
            n = range(v.categories)
            out[v.name] = (_pick([v.weights[label][c] for c in n], cat), _pick([v.scores[label][c] for c in n], cat))
    for r in model.rules:
        if r.var_a not in cats or r.var_b not in cats:
            continue
        hit = (cats[r.var_a] == r.val_a) & (cats[r.var_b] == r.val_b)
        old_w, old_s = out.get(r.name, (F.lit(None).cast("double"), F.lit(None).cast("double")))
        out[r.name] = (
            F.when(hit, F.coalesce(old_w, F.lit(0.0)) + F.lit(float(r.weight))).otherwise(old_w),
            F.when(hit, F.lit(float(r.score))).otherwise(old_s),
        )
    return [(name, w, s) for name, (w, s) in out.items()]


def _total(terms: list[Column]) -> Column:
    total = F.lit(0.0)
    for t in terms:
        total = total + F.coalesce(t, F.lit(0.0))
    return total


def score_parts(model: Model, cats: Mapping[str, Column], values: Mapping[str, Column] | None = None):
    """(weighted sums, weight sums): one Column per label each."""
    values = values or {}
    weighted, weights = [], []
    for label in range(model.labels):
        ents = _entities(model, label, cats, values)
        weighted.append(_total([w * s for _, w, s in ents]))
        weights.append(_total([w for _, w, _ in ents]))
    return weighted, weights


def ratio(weighted: Column, weight: Column) -> Column:
    return F.when(weight > 0, weighted / weight).otherwise(F.lit(0.0))


def barrier(df: DataFrame, keep, costly) -> DataFrame:
    """The same rows, with the costly columns computed once and for all.

    Without the generator a filter or join on such a column is pushed down through the
    projections and drags a copy of the whole expression along each time.
    """
    return df.selectExpr(*[f"`{c}`" for c in keep], f"inline(array(struct({', '.join(f'`{c}`' for c in costly)})))")


def argmax_label(scores: Column) -> Column:
    """Position of the largest score; ties go to the smallest label."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def decisiveness(scores: Column) -> Column:
    """Best minus second best, clamped to [0, 1]; a single label counts 0 as its rival."""
    ranked = F.sort_array(scores, asc=False)
    margin = F.get(ranked, F.lit(0)) - F.coalesce(F.get(ranked, F.lit(1)), F.lit(0.0))
    return F.when(F.size(scores) == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), margin)))


BLOCK_LIMIT = 4096
SCORED = ["weighted_sums", "weight_sums", "scores", "label", "score", "decisiveness"]


def _blocks(model: Model, used: set[str]) -> tuple[list[list[str]], list[int]]:
    """Groups of variables small enough for one lookup table, and the rules left outside them.

    Variables tied by a rule share a group while its combinations stay under BLOCK_LIMIT.
    """
    size = {v.name: v.categories + 1 for v in model.variables}  # one slot more for "absent"
    group = {v.name: [v.name] for v in model.variables if v.name in used}

    def combos(names) -> int:
        total = 1
        for n in names:
            total *= size[n]
        return total

    def join(a, b) -> bool:
        if group[a] is group[b]:
            return True
        both = group[a] + group[b]
        if combos(both) > BLOCK_LIMIT:
            return False
        for n in both:
            group[n] = both
        return True

    apart = [i for i, r in enumerate(model.rules) if r.var_a in used and r.var_b in used and not join(r.var_a, r.var_b)]
    plain = [v.name for v in model.variables if v.name in used and not v.numerical]
    for a, b in zip(plain, plain[1:]):
        join(a, b)
    seen, blocks = set(), []
    for names in group.values():
        if id(names) not in seen:
            seen.add(id(names))
            blocks.append(sorted(names, key=[v.name for v in model.variables].index))
    return blocks, apart


def _block_tables(model: Model, names: list[str], rules: list[int]) -> list[tuple[list[float], list[float]]]:
    """Per label the weighted sum and weight sum of every combination of a block.

    Equally named rules add their weights and the last matching one gives the score.
    """
    variables = [model.variable(n) for n in names]
    cells = list(product(*[range(v.categories + 1) for v in variables]))
    out = []
    for label in range(model.labels):
        ws, w = [], []
        for combo in cells:
            at = {n: c for n, c, v in zip(names, combo, variables) if c < v.categories}
            entities: dict[str, tuple[float, float]] = {}
            for v in variables:
                if v.name in at and not v.numerical:
                    entities[v.name] = (v.weights[label][at[v.name]], v.scores[label][at[v.name]])
            for i in rules:
                r = model.rules[i]
                if at.get(r.var_a) == r.val_a and at.get(r.var_b) == r.val_b:
                    entities[r.name] = (entities.get(r.name, (0.0, 0.0))[0] + r.weight, r.score)
            ws.append(sum(a * b for a, b in entities.values()))
            w.append(sum(a for a, _ in entities.values()))
        out.append((ws, w))
    return out


def score_wide(
    df: DataFrame, model: Model, cats: Mapping[str, Column], values: Mapping[str, Column] | None = None
) -> DataFrame:
    """Add weighted_sums, weight_sums, scores (arrays by label), label, score, decisiveness.

    Categories and rules are folded into lookup tables over blocks of variables, so a row costs
    one index and two lookups per block and label; numerical variables add their interpolated
    weight. The work is staged over projections, which keeps the generated code small enough
    to be compiled. Models whose names collide across blocks go through the general expression.
    """
    values = values or {}
    used = [v for v in model.variables if v.name in cats]
    names = {v.name for v in used}
    entity_names = [v.name for v in used] + [r.name for r in model.rules]
    labels = range(model.labels)
    if len(set(entity_names)) < len(entity_names):
        weighted, weights = score_parts(model, cats, values)
        sums = df.select("*", *[c.alias(f"__ws_{i}") for i, c in enumerate(weighted)],
                         *[c.alias(f"__sw_{i}") for i, c in enumerate(weights)])
        return _finish(df, sums, model.labels)

    blocks, apart = _blocks(model, names)
    # From here on expressions are SQL text: building them costs one call to the JVM each.
    numeric = [v for v in used if v.numerical]
    place = df.select(
        "*", *[cats[v.name].cast("int").alias(f"__c_{v.name}") for v in used],
        *[values[v.name].cast("double").alias(f"__x_{v.name}") for v in numeric if v.name in values])
    staged = []
    for b, block in enumerate(blocks):
        index = "0"
        for n in block:
            size, cat = model.variable(n).categories, f"`__c_{n}`"
            index = f"({index}) * {size + 1} + IF({cat} >= 0 AND {cat} < {size}, {cat}, {size})"
        staged.append(f"{index} AS __b_{b}")
    for v in numeric:
        mids = f"get({_array_sql([(lo + hi) / 2 for lo, hi in v.spans])}, `__c_{v.name}`)"
        x = f"coalesce(`__x_{v.name}`, {mids})" if v.name in values else mids
        staged.append(f"IF(`__c_{v.name}` IS NOT NULL, greatest(0D, least(1D, {x})), NULL) AS `__t_{v.name}`")
    for i in apart:
        r = model.rules[i]
        staged.append(f"coalesce(`__c_{r.var_a}` = {r.val_a} AND `__c_{r.var_b}` = {r.val_b}, false) AS __h_{i}")
    placed = place.selectExpr("*", *staged)

    tables = []
    for block in blocks:
        inside = [i for i, r in enumerate(model.rules) if i not in apart and r.var_a in block and r.var_b in block]
        tables.append(_block_tables(model, block, inside))
    cells, sums = [], []
    for label in labels:
        ws, w = [], []
        for b, table in enumerate(tables):
            ws.append(f"coalesce(get({_array_sql(table[label][0])}, __b_{b}), 0D)")
            w.append(f"coalesce(get({_array_sql(table[label][1])}, __b_{b}), 0D)")
        for v in numeric:
            t = f"`__t_{v.name}`" if v.rising[label] else f"(1D - `__t_{v.name}`)"
            low, width = float(v.low[label]), float(v.high[label] - v.low[label])
            cell = f"`__w_{label}_{v.name}`"
            cells.append(f"IF(`__t_{v.name}` IS NOT NULL, greatest(0D, least(1D, {low!r}D + {t} * {width!r}D)), 0D) AS {cell}")
            ws.append(f"{cell} * {float(v.score[label])!r}D")
            w.append(cell)
        for i in apart:
            r = model.rules[i]
            ws.append(f"IF(__h_{i}, {r.weight * r.score!r}D, 0D)")
            w.append(f"IF(__h_{i}, {float(r.weight)!r}D, 0D)")
        sums += [f"{' + '.join(ws) or '0D'} AS __ws_{label}", f"{' + '.join(w) or '0D'} AS __sw_{label}"]
    own = [f"`{c}`" for c in df.columns]
    return _finish(df, placed.selectExpr("*", *cells).selectExpr(*own, *sums), model.labels)


def _array_sql(values) -> str:
    return f"CAST(split('{','.join(repr(float(v)) for v in values)}', ',') AS ARRAY<DOUBLE>)"


def _finish(df: DataFrame, sums: DataFrame, n: int) -> DataFrame:
    own = [f"`{c}`" for c in df.columns]
    labels = range(n)
    sums = barrier(sums, df.columns, [f"__{k}_{i}" for k in ("ws", "sw") for i in labels])
    arrays = sums.selectExpr(
        *own, f"array({', '.join(f'__ws_{i}' for i in labels)}) AS weighted_sums",
        f"array({', '.join(f'__sw_{i}' for i in labels)}) AS weight_sums",
        f"array({', '.join(f'IF(__sw_{i} > 0, __ws_{i} / __sw_{i}, 0D)' for i in labels)}) AS scores")
    # best minus second best; a single label counts 0 as its rival
    second = "sort_array(scores, false)[1]" if n > 1 else "0D"
    return arrays.selectExpr(
        "*", "CAST(array_position(scores, array_max(scores)) - 1 AS INT) AS label", "array_max(scores) AS score",
        f"greatest(0D, least(1D, array_max(scores) - {second})) AS decisiveness")


def contributions(
    df: DataFrame, model: Model, cats: Mapping[str, Column], values: Mapping[str, Column] | None = None
) -> DataFrame:
    """One row per (row, label, entity) with its weight and score; absent entities give no row."""
    values = values or {}
    used = [v for v in model.variables if v.name in cats]
    rules = [r for r in model.rules if r.var_a in cats and r.var_b in cats]
    own = [f"`{c}`" for c in df.columns]
    if len({v.name for v in used} | {r.name for r in rules}) < len(used) + len(rules):
        rows = []
        for label in range(model.labels):
            for ord_, (name, w, s) in enumerate(_entities(model, label, cats, values)):
                rows.append(F.struct(F.lit(label).alias("label"), F.lit(ord_).alias("ord"), F.lit(name).alias("entity"),
                                     w.alias("weight"), s.alias("score")))
        return df.select("*", F.inline(F.array(*rows))).where("weight IS NOT NULL")

    place = df.select(
        "*", *[cats[v.name].cast("int").alias(f"__c_{v.name}") for v in used],
        *[values[v.name].cast("double").alias(f"__x_{v.name}") for v in used if v.numerical and v.name in values])
    at = []
    for v in used:
        if v.numerical:
            mids = f"get({_array_sql([(lo + hi) / 2 for lo, hi in v.spans])}, `__c_{v.name}`)"
            x = f"coalesce(`__x_{v.name}`, {mids})" if v.name in values else mids
            at.append(f"IF(`__c_{v.name}` IS NOT NULL, greatest(0D, least(1D, {x})), NULL) AS `__t_{v.name}`")
    at += [f"(`__c_{r.var_a}` = {r.val_a} AND `__c_{r.var_b}` = {r.val_b}) AS __h_{i}" for i, r in enumerate(rules)]
    cells = []
    for label in range(model.labels):
        entities = []
        for v in used:
            cat, n = f"`__c_{v.name}`", range(v.categories)
            if v.numerical:
                t = f"`__t_{v.name}`" if v.rising[label] else f"(1D - `__t_{v.name}`)"
                low, width = float(v.low[label]), float(v.high[label] - v.low[label])
                entities.append((v.name, f"IF(`__t_{v.name}` IS NOT NULL, greatest(0D, least(1D, {low!r}D + {t} * {width!r}D)), NULL)", f"{float(v.score[label])!r}D"))
            else:
                entities.append((v.name, f"get({_array_sql([v.weights[label][c] for c in n])}, {cat})", f"get({_array_sql([v.scores[label][c] for c in n])}, {cat})"))
        entities += [(r.name, f"IF(__h_{i}, {float(r.weight)!r}D, NULL)", f"{float(r.score)!r}D") for i, r in enumerate(rules)]
        cells += [f"{label}, {ord_}, '{name}', {w}, {s}" for ord_, (name, w, s) in enumerate(entities)]
    rows = place.selectExpr("*", *at).selectExpr(*own, f"stack({len(cells)}, {', '.join(cells)}) AS (label, ord, entity, weight, score)")
    return rows.where("weight IS NOT NULL")


def applied_rules(model: Model, cats: Mapping[str, Column]) -> Column:
    """Names of the matching rules, in rule order."""
    hits = [
        F.when((cats[r.var_a] == r.val_a) & (cats[r.var_b] == r.val_b), F.lit(r.name)) for r in model.rules
    ]
    return F.filter(F.array(*hits), lambda n: n.isNotNull())


def classifier(model: Model, inputs: Mapping[str, Column]) -> Column:
    """Label of an input vector: categories for categorical variables, raw numbers for numerical.

    A whole number given for a numerical variable is a span index, yet it is also the value
    the weight is read at.
    """
    cats, values = {}, {}
    for v in model.variables:
        if v.name not in inputs:
            continue
        x = inputs[v.name]
        if v.numerical:
            x = x.cast("double")
            whole = x == F.floor(x)
            cats[v.name] = F.when(whole, x.cast("int")).otherwise(span_index(x, v.spans))
            values[v.name] = x
        else:
            cats[v.name] = x.cast("int")
    weighted, weights = score_parts(model, cats, values)
    return argmax_label(F.array(*[ratio(a, b) for a, b in zip(weighted, weights)]))


def span_join(long: DataFrame, spans: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Span index of every (keys..., var, value) row, from span tables keyed the same way.

    The spans of a variable are first gathered into one array (bounded by its categories), so
    the range question becomes an equality join and a lookup; outside values clamp.
    """
    by = [*keys, "var"]
    arrays = spans.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("idx", "lo", "hi"))).alias("__spans"))
    return long.join(arrays, by).withColumn("idx", span_index_of(F.col("value"), F.col("__spans"))).drop("__spans")


# -- long form ---------------------------------------------------------------------------

def unpivot_assignment(df: DataFrame, ids: list[str], cats: Mapping[str, Column],
                       values: Mapping[str, Column] | None = None) -> DataFrame:
    """(ids..., var, cat, value) rows of wide category columns; null categories are dropped."""
    values = values or {}
    items = [
        F.struct(F.lit(n).alias("var"), c.cast("int").alias("cat"),
                 (values[n] if n in values else F.lit(None)).cast("double").alias("value"))
        for n, c in cats.items()
    ]
    return df.select(*ids, F.explode(F.array(*items)).alias("e")).select(*ids, "e.*").where("cat IS NOT NULL")


def param_join(long: DataFrame, tables: Mapping[str, DataFrame], ids: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Weight and score of every (assignment, variable, label); unknown variables drop out.

    ``keys`` names extra equality columns (such as a model id) shared by data and parameters.
    """
    keys = list(keys)
    cols = list(dict.fromkeys([*ids, *keys]))
    cat = long.join(tables["categories"], [*keys, "var", "cat"]).select(
        *cols, "label", F.col("var").alias("entity"), "weight", "score")
    spans = tables["spans"].select(*keys, "var", F.col("idx").alias("cat"), "lo", "hi")
    num = (
        long.join(spans, [*keys, "var", "cat"])
        .join(tables["numeric"], [*keys, "var"])
        .select(
            *cols, "label", F.col("var").alias("entity"),
            interpolated_weight(span_midpoint(F.col("value"), F.col("lo"), F.col("hi")),
                                F.col("low"), F.col("high"), F.col("rising")).alias("weight"),
            "score")
    )
    return cat.unionByName(num)


def rule_join(long: DataFrame, rules: DataFrame, ids: list[str], labels: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rules whose two conditions both hold, one row per label; equal names merge."""
    keys = list(keys)
    cols = list(dict.fromkeys([*ids, *keys]))
    first = long.select(*cols, F.col("var").alias("var_a"), F.col("cat").alias("val_a"))
    second = long.select(*cols, F.col("var").alias("var_b"), F.col("cat").alias("val_b"))
    matched = first.join(rules, [*keys, "var_a", "val_a"]).join(second, [*cols, "var_b", "val_b"])
    merged = matched.groupBy(*cols, F.col("name").alias("entity")).agg(
        F.sum("weight").alias("weight"), F.max_by("score", "ord").alias("score"))
    return merged.select(
        *cols, F.explode(F.sequence(F.lit(0), F.lit(labels - 1))).alias("label"), "entity", "weight", "score")


def score_long(entities: DataFrame, ids: list[str]) -> DataFrame:
    """Per (ids, label) weighted sum, weight sum and score of entity rows."""
    return (
        entities.groupBy(*ids, "label")
        .agg(F.sum(F.col("weight") * F.col("score")).alias("weighted_sum"), F.sum("weight").alias("weight_sum"))
        .withColumn("score", ratio(F.col("weighted_sum"), F.col("weight_sum")))
    )


def label_long(scores: DataFrame, ids: list[str]) -> DataFrame:
    """Arg-max label per id of long scores."""
    best = F.max(F.struct(F.col("score"), (-F.col("label")).alias("neg")))
    return scores.groupBy(*ids).agg(best.alias("b")).select(
        *ids, (-F.col("b.neg")).cast("int").alias("label"), F.col("b.score").alias("score"))
