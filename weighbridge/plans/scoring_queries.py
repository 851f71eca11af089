"""Scoring, labelling and numeric functions over orders and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as num
from ..operators import scoring as sc
from .bridge import (MODEL, SQL_LINES, SQL_ORDERS, cats, line_samples, order_samples, sql_model, sql_scores, table, values,
                     with_scores)
from .registry import query


def r6(c):
    return F.round(c, 6)


def scored_orders(spark, sf):
    return sc.score_wide(order_samples(spark, sf), MODEL, cats(), values())


@query("clamp01", "SELECT l_orderkey, l_linenumber, greatest(0, least(1, (l_extendedprice - 30000) / 40000)) AS clamped FROM lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", num.clamp01((F.col("l_extendedprice") - 30000) / 40000).alias("clamped"))


@query("equal_spans", """SELECT p_partkey, i AS idx, i / n::DOUBLE AS lo, CASE WHEN i = n - 1 THEN 1 ELSE (i + 1) / n::DOUBLE END AS hi
FROM (SELECT p_partkey, p_size AS n, unnest(range(p_size)) AS i FROM part)""")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.posexplode(num.equal_spans(F.col("p_size"))).alias("idx", "s")).select(
        "p_partkey", "idx", "s.lo", "s.hi")


@query("normalize_span", """SELECT l_orderkey, l_linenumber, least(a, b) AS lo,
  CASE WHEN a = b THEN least(1, least(a, b) + 1e-6) ELSE greatest(a, b) END AS hi
FROM (SELECT *, greatest(0, least(1, l_discount * 20)) AS a, greatest(0, least(1, l_tax * 20)) AS b FROM lineitem)""")
def _(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", num.normalize_span(F.col("l_discount") * 20, F.col("l_tax") * 20).alias("s")).select(
        "l_orderkey", "l_linenumber", "s.lo", "s.hi")


_UNEVEN = [(0.0, 0.15), (0.15, 0.4), (0.4, 0.9)]


@query("span_index", """SELECT l_orderkey, l_linenumber, l_quantity,
  CASE WHEN x < 0 THEN 0 WHEN x < 0.15::DOUBLE THEN 0 WHEN x < 0.4::DOUBLE THEN 1 ELSE 2 END AS idx,
  least(greatest(CAST(floor(x * l_linenumber) AS INTEGER), 0), l_linenumber - 1) AS equal_idx
FROM (SELECT *, (l_quantity - 5) / 40 AS x FROM lineitem)""")
def _(spark, sf):
    x = (F.col("l_quantity") - 5) / 40
    equal = num.span_index_of(x, num.equal_spans(F.col("l_linenumber")))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", num.span_index(x, _UNEVEN).alias("idx"), equal.alias("equal_idx"))


_RAW = """CASE WHEN event_type = 'click' THEN CAST(CAST(floor(value) AS INTEGER) % 6 AS VARCHAR)
  WHEN event_type = 'view' THEN ' ' || CAST(CAST(floor(value) AS INTEGER) % 4 AS VARCHAR) || '.0 '
  WHEN event_type = 'purchase' THEN CASE WHEN value < 1 THEN '0.25' WHEN value < 5 THEN '0.99' ELSE '0.5' END
  WHEN event_type = 'signup' THEN CASE WHEN value < 20 THEN '' ELSE 'true' END ELSE 'abc' END"""


@query("resolve_category", f"""SELECT event_id, CASE WHEN n IS NOT NULL AND n = floor(n) AND n >= 0 AND n < 4 THEN CAST(n AS INTEGER) END AS categorical,
  CASE WHEN n IS NULL THEN NULL WHEN n = floor(n) THEN CASE WHEN n >= 0 AND n < 4 THEN CAST(n AS INTEGER) END
    WHEN n < 0.25 THEN 0 WHEN n < 0.5 THEN 1 WHEN n < 0.75 THEN 2 ELSE 3 END AS numerical,
  CASE WHEN t = '' THEN 'Empty assignment value for V' WHEN n IS NULL THEN 'could not convert string to float: ''' || t || ''''
    WHEN n <> floor(n) THEN 'Non-integer assignment ' || t || ' provided for categorical variable V'
    WHEN n < 0 OR n >= 4 THEN 'Assignment value ' || CAST(CAST(n AS BIGINT) AS VARCHAR) || ' out of range for V' END AS error
FROM (SELECT *, CASE WHEN t = 'true' THEN 1 ELSE TRY_CAST(t AS DOUBLE) END AS n FROM (SELECT event_id, trim({_RAW}) AS t FROM events))""")
def _(spark, sf):
    raw = F.expr(_RAW.replace("VARCHAR", "STRING"))
    c = num.resolve_category(raw, "V", 4)
    n = num.resolve_category(raw, "V", 4, num.equal_span_bounds(4))
    return table(spark, sf, "events").select(
        "event_id", c["category"].alias("categorical"), n["category"].alias("numerical"), c["error"].alias("error"))


@query("span_midpoint", """SELECT event_id, CASE WHEN event_type = 'error' THEN ((k % 4) / 4::DOUBLE + (k % 4 + 1) / 4::DOUBLE) / 2 ELSE value END AS x
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""")
def _(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int") % 4
    given = F.when(F.col("event_type") != "error", F.col("value"))
    return table(spark, sf, "events").select("event_id", num.span_midpoint(given, k / 4, (k + 1) / 4).alias("x"))


@query("interpolated_weight", """SELECT l_orderkey, l_linenumber,
  round(greatest(0, least(1, 0.2 + (CASE WHEN l_linestatus = 'F' THEN t ELSE 1 - t END) * 0.6)), 6) AS weight
FROM (SELECT *, greatest(0, least(1, l_extendedprice / 90000)) AS t FROM lineitem)""")
def _(spark, sf):
    w = num.interpolated_weight(F.col("l_extendedprice") / 90000, F.lit(0.2), F.lit(0.8), F.col("l_linestatus") == "F")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r6(w).alias("weight"))


@query("weight_score_lookup", f"""WITH {SQL_ORDERS}, {sql_model(MODEL)}, {sql_scores()}
SELECT sid, label, entity, round(w, 6) AS weight, round(s, 6) AS score FROM ent WHERE entity LIKE 'V%'""")
def _(spark, sf):
    rows = sc.contributions(order_samples(spark, sf), MODEL, cats(), values()).where(F.col("entity").startswith("V"))
    return rows.select("sid", "label", "entity", r6("weight").alias("weight"), r6("score").alias("score"))


@query("param_join", f"""WITH {SQL_ORDERS}, {sql_model(MODEL)}, {sql_scores()}
SELECT label, entity, count(*) AS n, round(sum(w), 4) AS weight, round(sum(w * s), 4) AS weighted FROM ent
WHERE entity LIKE 'V%' GROUP BY label, entity""")
def _(spark, sf):
    long = sc.unpivot_assignment(order_samples(spark, sf), ["sid"], {**cats(), "Vx": F.lit(1)}, values())
    ents = sc.param_join(long, MODEL.tables(spark), ["sid"])
    return ents.groupBy("label", "entity").agg(
        F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("weight"),
        F.round(F.sum(F.col("weight") * F.col("score")), 4).alias("weighted"))


@query("rule_match_join", f"""WITH {SQL_ORDERS}, {sql_model(MODEL)}, {sql_scores()}
SELECT sid, label, entity, round(w, 6) AS weight, round(s, 6) AS score FROM ent WHERE entity LIKE 'R%'""")
def _(spark, sf):
    long = sc.unpivot_assignment(order_samples(spark, sf), ["sid"], cats())
    rows = sc.rule_join(long, MODEL.tables(spark)["rules"], ["sid"], MODEL.labels)
    return rows.select("sid", "label", "entity", r6("weight").alias("weight"), r6("score").alias("score"))


@query("span_range_join", f"""WITH {SQL_LINES} SELECT l_orderkey, l_linenumber, 'V3' AS var, V3 AS idx FROM smp UNION ALL SELECT l_orderkey, l_linenumber, 'V4', V4 FROM smp""")
def _(spark, sf):
    rows = line_samples(spark, sf).select("l_orderkey", "l_linenumber", F.expr("stack(2, 'V3', x3, 'V4', x4) AS (var, value)"))
    return sc.span_join(rows, MODEL.tables(spark)["spans"]).drop("value")


@query("udd_score", f"""WITH {SQL_LINES}, {sql_model(MODEL)}, {sql_scores()}
SELECT l_orderkey, l_linenumber, label, round(ws, 6) AS weighted_sum, round(sw, 6) AS weight_sum, round(score, 6) AS score
FROM sc JOIN smp USING (sid)""")
def _(spark, sf):
    df = sc.score_wide(line_samples(spark, sf), MODEL, cats(), values())
    rows = df.select("l_orderkey", "l_linenumber", F.explode(F.array(*[
        F.struct(F.lit(i).alias("label"), r6(F.col("weighted_sums")[i]).alias("weighted_sum"),
                 r6(F.col("weight_sums")[i]).alias("weight_sum"), r6(F.col("scores")[i]).alias("score"))
        for i in range(MODEL.labels)])).alias("e"))
    return rows.select("l_orderkey", "l_linenumber", "e.*")


@query("entity_contributions", f"""WITH {SQL_ORDERS}, {sql_model(MODEL)}, {sql_scores()}
SELECT ent.sid, label, entity, round(w, 6) AS weight, round(s, 6) AS score, coalesce(applied, '') AS applied FROM ent
LEFT JOIN (SELECT sid, string_agg(entity, ',' ORDER BY entity) AS applied FROM ent WHERE label = 0 AND entity LIKE 'R%' GROUP BY sid) a USING (sid)""")
def _(spark, sf):
    df = order_samples(spark, sf).withColumn("applied", F.array_join(sc.applied_rules(MODEL, cats()), ","))
    rows = sc.contributions(df, MODEL, cats(), values())
    return rows.select("sid", "label", "entity", r6("weight").alias("weight"), r6("score").alias("score"), "applied")


@query("predict_label", f"""WITH {SQL_LINES}, {sql_model(MODEL)}, {sql_scores()}
SELECT l_orderkey, l_linenumber, label, round(score, 6) AS score FROM lab JOIN smp USING (sid)""")
def _(spark, sf):
    df = sc.score_wide(line_samples(spark, sf), MODEL, cats(), values())
    return df.select("l_orderkey", "l_linenumber", "label", r6("score").alias("score"))


@query("decisiveness", f"{with_scores()} SELECT sid, round(dec, 6) AS decisiveness FROM lab")
def _(spark, sf):
    return scored_orders(spark, sf).select("sid", r6("decisiveness").alias("decisiveness"))


# for a numerical input the span is the index itself when the value is whole
_CLASSIFY = SQL_ORDERS.replace("smp AS (", "smp1 AS (") + """,
smp AS (SELECT * REPLACE (CASE WHEN x3 = floor(x3) THEN CAST(x3 AS INTEGER) ELSE V3 END AS V3,
  CASE WHEN x4 = floor(x4) THEN CAST(x4 AS INTEGER) ELSE V4 END AS V4) FROM smp1)"""


@query("udd_classifier", f"WITH {_CLASSIFY}, {sql_model(MODEL)}, {sql_scores()} SELECT sid, label FROM lab")
def _(spark, sf):
    inputs = {"V0": F.col("V0"), "V1": F.col("V1"), "V2": F.col("V2"), "V3": F.col("x3"), "V4": F.col("x4")}
    return order_samples(spark, sf).select("sid", sc.classifier(MODEL, inputs).alias("label"))


@query("classifier_contract", """SELECT event_id, CASE WHEN event_type = 'error' OR event_id % 5 < 4 THEN -1 ELSE CAST(json_extract_string(props, '$.k') AS INTEGER) END AS pred,
  CASE WHEN event_id % 3 = 0 THEN -1 ELSE CAST(trunc(value) AS INTEGER) END AS from_number FROM events""")
def _(spark, sf):
    from ..operators.metrics import prediction_label
    odd = F.get(F.array(*[F.lit(x) for x in ("nan", "1e20", "3.7", "99999999999")]), (F.col("event_id") % 5).cast("int"))
    raw = F.when(F.col("event_type") == "error", "oops").otherwise(F.coalesce(odd, F.get_json_object("props", "$.k")))
    number = F.when(F.col("event_id") % 6 == 0, F.lit(float("nan"))).when(F.col("event_id") % 3 == 0, 1e20).otherwise(F.col("value"))
    return table(spark, sf, "events").select("event_id", prediction_label(raw).alias("pred"), prediction_label(number).alias("from_number"))


@query("normalize_param_tables", """WITH grid AS (SELECT p_partkey, l.l AS label, c.c AS cat FROM part, range(2) l(l), range(3) c(c)),
u AS (SELECT *, (('0x' || substr(md5(concat_ws('|', '7', p_partkey, label, cat)), 1, 8))::UBIGINT / 4294967296::DOUBLE) AS fill FROM grid)
SELECT p_partkey, label, cat, round(CASE WHEN cat = p_size % 3 THEN greatest(0, least(1, p_size / 30::DOUBLE))
  WHEN cat = (p_size + 1) % 3 AND label = 0 THEN greatest(0, least(1, p_retailprice / 1000)) ELSE fill END, 6) AS weight
FROM u JOIN part USING (p_partkey)""")
def _(spark, sf):
    from ..operators.parameters import complete_params
    part = table(spark, sf, "part")
    # an old-style cell (no label) holds for all labels; a labelled cell only for its own
    given = part.select("p_partkey", F.explode(F.array(
        F.struct(F.lit(None).cast("int").alias("label"), (F.col("p_size") % 3).alias("cat"), (F.col("p_size") / 30).alias("value")),
        F.struct(F.lit(0).alias("label"), ((F.col("p_size") + 1) % 3).alias("cat"), (F.col("p_retailprice") / 1000).alias("value")),
    )).alias("e")).select("p_partkey", "e.*")
    full = complete_params(part.select("p_partkey"), given, ["p_partkey"], labels=2, categories=3, seed=7)
    return full.select("p_partkey", "label", "cat", r6("value").alias("weight"))
