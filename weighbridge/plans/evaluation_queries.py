"""Distribution analysis and prediction metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analysis as an
from ..operators import metrics as mt
from ..operators import properties as pr
from ..operators import scoring as sc
from .bridge import (AMOUNT_LABELS, MODEL, SEED, SQL_LINES, SQL_ORDERS, SQL_PRED, TONE, TONE_LABELS, VARS, cats, line_samples,
                     order_samples, predicted, sql_model, sql_scores, sql_u01, table, values, with_scores)
from .registry import query

L = MODEL.labels


def r6(c):
    return F.round(c, 6)


def scored(spark, sf):
    return sc.score_wide(order_samples(spark, sf), MODEL, cats(), values())


def answers(spark, sf):
    """Samples with truth (label), prediction and failure flag."""
    return scored(spark, sf).select("sid", "custkey", "status", "V1", "label", predicted().alias("pred"))


ANSWERS = f"{with_scores()}, ev AS (SELECT smp.sid, custkey, status, V1, lab.label, {SQL_PRED} AS guess, coalesce({SQL_PRED}, -1) AS pred FROM smp JOIN lab USING (sid))"
COUNTS = f"{ANSWERS}, cn AS (SELECT status, label, pred, count(*) AS n FROM ev GROUP BY ALL)"
UNIVERSE = f"""{COUNTS}, un AS (SELECT DISTINCT status, label FROM (SELECT status, label FROM cn UNION ALL SELECT status, pred FROM cn
  UNION ALL SELECT DISTINCT status, i FROM cn, range({L}) r(i)))"""
PER_LABEL = f"""{UNIVERSE}, pl0 AS (SELECT status, label, coalesce((SELECT sum(n) FROM cn c WHERE c.status = un.status AND c.label = un.label AND c.pred = un.label), 0) AS tp,
  coalesce((SELECT sum(n) FROM cn c WHERE c.status = un.status AND c.label = un.label), 0) AS truth,
  coalesce((SELECT sum(n) FROM cn c WHERE c.status = un.status AND c.pred = un.label), 0) AS guess,
  (SELECT sum(n) FROM cn c WHERE c.status = un.status) AS total FROM un),
pl1 AS (SELECT status, label, CAST(tp AS BIGINT) AS tp, CAST(guess - tp AS BIGINT) AS fp, CAST(truth - tp AS BIGINT) AS fn,
  CAST(total - truth - guess + tp AS BIGINT) AS tn, CAST(truth AS BIGINT) AS support, CAST(total AS BIGINT) AS total,
  CASE WHEN guess = 0 THEN 0 ELSE tp / guess::DOUBLE END AS precision, CASE WHEN truth = 0 THEN 0 ELSE tp / truth::DOUBLE END AS recall,
  CASE WHEN total - truth = 0 THEN 0 ELSE (total - truth - guess + tp) / (total - truth)::DOUBLE END AS tnr FROM pl0),
pl AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM pl1)"""


@query("analyze_distribution", f"""WITH {SQL_LINES}, {sql_model(MODEL)}, {sql_scores()}
SELECT status, count(*) AS total, count(*) FILTER (label = 0) AS n_0, count(*) FILTER (label = 1) AS n_1, count(*) FILTER (label = 2) AS n_2,
  round(avg(dec), 6) AS avg_decisiveness, round(avg(lab.score), 6) AS avg_top_score,
  round(greatest(abs(n_0 / total - 1/3::DOUBLE), abs(n_1 / total - 1/3::DOUBLE), abs(n_2 / total - 1/3::DOUBLE)), 6) AS max_gap
FROM lab JOIN smp USING (sid) GROUP BY status""")
def _(spark, sf):
    df = sc.score_wide(line_samples(spark, sf), MODEL, cats(), values())
    rep = an.analyze(df, L, ["status"])
    return rep.select("status", "total", *[F.col("label_counts")[i].alias(f"n_{i}") for i in range(L)],
                      r6("avg_decisiveness").alias("avg_decisiveness"), r6("avg_top_score").alias("avg_top_score"),
                      r6("max_gap").alias("max_gap"))


@query("min_decisiveness", f"""{with_scores()}
SELECT status, round(min(dec), 6) AS exact_min, round(coalesce(arg_min(dec, sid) FILTER (dec < 0.05::DOUBLE), min(dec)), 6) AS early_min
FROM lab JOIN smp USING (sid) GROUP BY status""")
def _(spark, sf):
    return scored(spark, sf).groupBy("status").agg(
        r6(F.min("decisiveness")).alias("exact_min"),
        r6(an.early_stop_minimum(F.col("decisiveness"), F.col("sid"), 0.05)).alias("early_min"))


_TONE_SQL = f"""{with_scores()}, {sql_model(TONE, 't')}, {sql_scores('t')}"""


@query("property_balance", f"""{_TONE_SQL},
g AS (SELECT status, 'main' AS property, max(abs(n / total - 1/3::DOUBLE)) AS gap FROM (SELECT status, label, count(*) AS n, sum(count(*)) OVER (PARTITION BY status) AS total FROM lab JOIN smp USING (sid) GROUP BY status, label) GROUP BY status
 UNION ALL SELECT status, 'tone', max(abs(n / total - 0.5)) FROM (SELECT status, label, count(*) AS n, sum(count(*)) OVER (PARTITION BY status) AS total FROM labt JOIN smp USING (sid) GROUP BY status, label) GROUP BY status)
SELECT status, round(avg(gap), 6) AS property_gap, count(*) AS properties FROM g GROUP BY status""")
def _(spark, sf):
    # both labels of a row in one pass, then one small row per status, property and label
    df = order_samples(spark, sf)
    one = sc.score_wide(df, MODEL, cats(), values()).select(*df.columns, F.col("label").alias("main"))
    two = sc.score_wide(one, TONE, cats(), values()).select("status", "main", F.col("label").alias("tone"))
    n = lambda c, labels: F.array(*[F.count_if(F.col(c) == i) for i in range(labels)])
    counts = two.groupBy("status").agg(F.count("*").alias("total"), n("main", MODEL.labels).alias("main"), n("tone", TONE.labels).alias("tone"))
    gap = lambda c, labels: F.array_max(F.transform(c, lambda x: F.abs(x / F.col("total") - 1.0 / labels)))
    return counts.select("status", r6((gap("main", MODEL.labels) + gap("tone", TONE.labels)) / 2).alias("property_gap"), F.lit(2).cast("long").alias("properties"))


@query("udd_penalty", f"""{with_scores()},
a AS (SELECT status, coalesce(arg_min(dec, sid) FILTER (dec < 0.05::DOUBLE), min(dec)) AS md,
  greatest(abs(count(*) FILTER (label = 0) / count(*) - 1/3::DOUBLE), abs(count(*) FILTER (label = 1) / count(*) - 1/3::DOUBLE), abs(count(*) FILTER (label = 2) / count(*) - 1/3::DOUBLE)) AS gap
  FROM lab JOIN smp USING (sid) GROUP BY status)
SELECT status, round(greatest(0, 0.05::DOUBLE - md) + gap + 0.5 * 0.1::DOUBLE, 6) AS penalty, gap <= 0.25 AND md >= 0.05::DOUBLE AS passes FROM a""")
def _(spark, sf):
    df = scored(spark, sf)
    agg = df.groupBy("status").agg(*an.analysis_aggregates(L), an.early_stop_minimum(F.col("decisiveness"), F.col("sid"), 0.05).alias("md"))
    rep = an.with_fractions(agg, L)
    return rep.select("status", r6(an.penalty(F.col("max_gap"), F.col("md"), F.lit(0.1), 0.05)).alias("penalty"),
                      an.passes(F.col("max_gap"), F.col("md"), 0.25, 0.05).alias("passes"))


@query("confusion_matrix", f"""{UNIVERSE}
SELECT a.status, a.label, b.label AS pred, coalesce(n, 0) AS n FROM un a JOIN un b ON a.status = b.status
LEFT JOIN cn ON cn.status = a.status AND cn.label = a.label AND cn.pred = b.label""")
def _(spark, sf):
    counts = mt.confusion_counts(answers(spark, sf), keys=["status"])
    return mt.confusion_matrix(counts, L, ["status"])


@query("label_universe", f"{UNIVERSE} SELECT status, string_agg(CAST(label AS VARCHAR), ',' ORDER BY label) AS labels FROM un GROUP BY status")
def _(spark, sf):
    counts = mt.confusion_counts(answers(spark, sf), keys=["status"])
    return mt.label_universe(counts, L, ["status"]).select("status", F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"))


@query("per_label_metrics", f"""{PER_LABEL} SELECT status, label, tp, fp, fn, tn, support, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1, round(tnr, 6) AS tnr FROM pl""")
def _(spark, sf):
    counts = mt.confusion_counts(answers(spark, sf), keys=["status"])
    return mt.per_label_metrics(counts, L, ["status"]).select(
        "status", "label", "tp", "fp", "fn", "tn", "support", *[r6(c).alias(c) for c in ("precision", "recall", "f1", "tnr")])


@query("eval_report", f"""{PER_LABEL} SELECT status, CAST(max(total) AS BIGINT) AS total, CAST(sum(tp) AS BIGINT) AS correct, round(sum(tp) / max(total), 6) AS accuracy,
  CASE WHEN sum(tp) = max(total) THEN 1 ELSE 0 END AS full_accuracy, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall,
  round(avg(f1), 6) AS macro_f1, round(avg(recall), 6) AS balanced_accuracy FROM pl GROUP BY status""")
def _(spark, sf):
    counts = mt.confusion_counts(answers(spark, sf), keys=["status"])
    rep = mt.eval_report(counts, L, ["status"])
    return rep.select("status", "total", "correct", "full_accuracy", *[
        r6(c).alias(c) for c in ("accuracy", "macro_precision", "macro_recall", "macro_f1", "balanced_accuracy")])


@query("theory_accuracy", f"{ANSWERS} SELECT count(*) AS total, round(avg(CASE WHEN label = pred THEN 1 ELSE 0 END), 6) AS accuracy FROM ev")
def _(spark, sf):
    rep = mt.eval_report(mt.confusion_counts(answers(spark, sf)), L)
    return rep.select("total", r6("accuracy").alias("accuracy"))


@query("all_output_accuracy", f"""{_TONE_SQL}, ev AS (SELECT status, custkey, lab.label, {SQL_PRED} AS pred, CASE WHEN lab.label IN (0, 2) THEN labt.label END AS tone,
  CASE WHEN custkey % 3 <> 0 THEN V1 END AS guess FROM smp JOIN lab USING (sid) JOIN labt USING (sid)),
c AS (SELECT status, CASE WHEN coalesce(pred, -1) = label THEN 1 ELSE 0 END
   + CASE WHEN (CASE WHEN pred IS NULL THEN NULL ELSE guess END) IS NOT DISTINCT FROM tone THEN 1 ELSE 0 END AS ok,
  2 + CASE WHEN pred IS NOT NULL AND custkey % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN pred IS NULL THEN 1 ELSE 0 END AS cells FROM ev)
SELECT status, CAST(sum(ok) AS BIGINT) AS correct_cells, CAST(sum(cells) AS BIGINT) AS cells, round(sum(ok) / sum(cells), 6) AS all_output_accuracy FROM c GROUP BY status""")
def _(spark, sf):
    base = scored(spark, sf).select("sid", "status", "custkey", *VARS, "x3", "x4", "label", predicted().alias("pred"))
    df = pr.categorical_property(base, TONE, cats(), values(), "tone")
    truth = F.create_map(F.lit("tone"), pr.gate(F.col("tone"), F.col("label"), F.array(*[F.lit(x) for x in TONE_LABELS])))
    guess = F.create_map(F.lit("tone"), F.when(F.col("custkey") % 3 != 0, F.col("V1")))
    guess = F.when(F.col("custkey") % 5 == 0, F.map_concat(guess, F.create_map(F.lit("extra"), F.lit(1)))).otherwise(guess)
    failed = F.col("pred").isNull()
    rep = mt.all_output_accuracy(df, F.coalesce(F.col("pred"), F.lit(-1)) == F.col("label"), truth, F.when(~failed, guess), ["tone"], failed, ["status"])
    return rep.withColumn("all_output_accuracy", r6("all_output_accuracy"))


@query("zero_report", f"""SELECT doc_id, i AS label, CAST(0 AS BIGINT) AS support, 0::DOUBLE AS precision, 0::DOUBLE AS recall, 0::DOUBLE AS f1, 0::DOUBLE AS tnr
FROM (SELECT doc_id, unnest(range({L}))::INTEGER AS i FROM documents ANTI JOIN labels USING (doc_id))""")
def _(spark, sf):
    return mt.zero_report(without_classifier(spark, sf), L, ["doc_id"])


def without_classifier(spark, sf):
    """Documents without a label row stand for tasks without a classifier."""
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left_anti")


@query("zero_report_totals", """SELECT doc_id, CAST(0 AS BIGINT) AS total, CAST(0 AS BIGINT) AS correct, 0::DOUBLE AS accuracy, 0 AS full_accuracy, 0::DOUBLE AS macro_precision, 0::DOUBLE AS macro_recall, 0::DOUBLE AS macro_f1,
  0::DOUBLE AS balanced_accuracy, 0::DOUBLE AS all_output_accuracy FROM documents ANTI JOIN labels USING (doc_id)""")
def _(spark, sf):
    return mt.zero_totals(without_classifier(spark, sf), ["doc_id"])


@query("zero_report_confusion", f"""SELECT doc_id, i AS label, unnest(range({L}))::INTEGER AS pred, CAST(0 AS BIGINT) AS n
FROM (SELECT doc_id, unnest(range({L}))::INTEGER AS i FROM documents ANTI JOIN labels USING (doc_id))""")
def _(spark, sf):
    return mt.zero_confusion(without_classifier(spark, sf), L, ["doc_id"])


@query("infer_properties", f"""{with_scores()}, p AS (SELECT DISTINCT status, unnest(CASE label WHEN 0 THEN ['tone'] WHEN 1 THEN ['amount'] ELSE ['tone', 'amount', 'note'] END) AS property FROM lab JOIN smp USING (sid))
SELECT status, property FROM p""")
def _(spark, sf):
    none_i, none_d = F.expr("CAST(map() AS MAP<STRING, INT>)"), F.expr("CAST(map() AS MAP<STRING, DOUBLE>)")
    labels = F.when(F.col("label") == 0, F.create_map(F.lit("tone"), F.lit(1))).when(
        F.col("label") == 2, F.create_map(F.lit("tone"), F.lit(0), F.lit("note"), F.lit(None).cast("int"))).otherwise(none_i)
    scores = F.when(F.col("label") >= 1, F.create_map(F.lit("amount"), F.lit(1.5))).otherwise(none_d)
    df = scored(spark, sf).select("status", labels.alias("property_labels"), scores.alias("property_scores"))
    return pr.infer_properties(df, ["status"])


@query("property_cardinality", """WITH seen AS (SELECT o_custkey, max(CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) - 1 AS top FROM orders GROUP BY 1)
SELECT c_custkey, CAST(CASE WHEN c_acctbal < 0 THEN 2 ELSE greatest(1, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END, CASE WHEN c_custkey % 5 = 0 THEN 7 END, top + 1, 1)) END AS INTEGER) AS cardinality,
  CASE WHEN c_acctbal < 0 THEN 'low,high' ELSE array_to_string(range(greatest(1, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END, CASE WHEN c_custkey % 5 = 0 THEN 7 END, top + 1, 1))), ',') END AS names
FROM customer LEFT JOIN seen ON c_custkey = o_custkey""")
def _(spark, sf):
    seen = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.max(F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("top"))
    c = table(spark, sf, "customer").join(seen, F.col("c_custkey") == F.col("o_custkey"), "left")
    mapped = F.when(F.col("c_acctbal") < 0, F.expr("map('0', 'low', '1', 'high', 'type', 'categorical')"))
    names = pr.property_label_names(mapped, F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey")),
                                    F.when(F.col("c_custkey") % 5 == 0, F.lit(7)), F.col("top"))
    return c.select("c_custkey", F.size(names).alias("cardinality"),
                    F.array_join(F.transform(F.array_sort(F.map_entries(names)), lambda e: e["value"]), ",").alias("names"))


@query("property_key_union", """SELECT p_partkey, CASE WHEN len(k) > 0 THEN array_to_string(list_sort(list_distinct(k)), ',') ELSE 'seen' END AS keys FROM (SELECT p_partkey,
  list_filter([CASE WHEN p_size > 25 THEN 'size' END, CASE WHEN p_brand < 'Brand#3' THEN 'brand' END, CASE WHEN p_size > 40 THEN 'size' END], lambda x: x IS NOT NULL) AS k FROM part)""")
def _(spark, sf):
    def keys(cond, name):
        return F.when(cond, F.array(F.lit(name))).otherwise(F.expr("CAST(array() AS ARRAY<STRING>)"))
    u = pr.property_keys([keys(F.col("p_size") > 25, "size"), keys(F.col("p_brand") < "Brand#3", "brand"),
                          keys(F.col("p_size") > 40, "size")], F.array(F.lit("seen")))
    return table(spark, sf, "part").select("p_partkey", F.array_join(u, ",").alias("keys"))


@query("infer_schema", f"""WITH {SQL_ORDERS}, l AS (SELECT status, unnest(['V0','V1','V2','V3','V4']) AS var, unnest([V0, V1, V2, V3, V4]) AS cat FROM smp)
SELECT status, var, string_agg(CAST(cat AS VARCHAR), ',' ORDER BY cat) AS cats, CASE var WHEN 'V0' THEN 'order status' END AS role FROM (SELECT DISTINCT * FROM l) GROUP BY status, var""")
def _(spark, sf):
    long = sc.unpivot_assignment(order_samples(spark, sf), ["status"], cats())
    s = pr.infer_schema(long, ["status"], {"V0": "order status"})
    return s.select("status", "var", F.array_join(F.col("values").cast("array<string>"), ",").alias("cats"), "role")


@query("property_gate", f"{_TONE_SQL} SELECT sid, lab.label, CASE WHEN lab.label IN (0, 2) THEN labt.label END AS tone, CASE WHEN lab.label IN (0, 2) THEN round(labt.score, 6) END AS tone_score FROM lab JOIN labt USING (sid)")
def _(spark, sf):
    tone = pr.categorical_property(scored(spark, sf).select("sid", *VARS, "x3", "x4", "label"), TONE, cats(), values(), "tone")
    support = F.array(*[F.lit(x) for x in TONE_LABELS])
    return tone.select("sid", "label", pr.gate(F.col("tone"), F.col("label"), support).alias("tone"),
                       r6(pr.gate(F.col("tone_score"), F.col("label"), support)).alias("tone_score"))


@query("property_outputs", f"""{_TONE_SQL} SELECT sid, lab.label, CASE WHEN lab.label IN (0, 2) THEN labt.label END AS tone, NULL::INTEGER AS amount_label,
  CASE WHEN lab.label IN (1, 2) THEN round(10 + {sql_u01(repr(str(SEED)), "'amount'", 'sid')} * 10, 6) END AS amount FROM lab JOIN labt USING (sid)""")
def _(spark, sf):
    tone = pr.categorical_property(scored(spark, sf).select("sid", *VARS, "x3", "x4", "label"), TONE, cats(), values(), "tone")
    amount = pr.numerical_property(10.0, 20.0, SEED, F.lit("amount"), F.col("sid"))
    return tone.select("sid", "label", pr.gate(F.col("tone"), F.col("label"), F.array(*[F.lit(x) for x in TONE_LABELS])).alias("tone"),
                       F.lit(None).cast("int").alias("amount_label"),
                       r6(pr.gate(amount, F.col("label"), F.array(*[F.lit(x) for x in AMOUNT_LABELS]))).alias("amount"))
