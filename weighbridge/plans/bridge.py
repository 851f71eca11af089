"""The given tables seen as labelled samples, and the models used on them.

Orders become samples: V0 status, V1 customer parity, V2 priority, V3 day of the year and
V4 day of the month as numerical variables in [0, 1]. Lineitem joined to orders becomes the
large sample table with V0 return flag, V1 line status, V2 priority, V3 discount, V4 quantity.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import equal_span_bounds, span_index
from ..operators.model import NUMERICAL, Model, Rule, Variable

SEED = 7
VARS = ["V0", "V1", "V2", "V3", "V4"]
SIZES = [3, 2, 5, 4, 4]


def _cell(kind: int, label: int, var: int, cat: int) -> float:
    return ((37 * label + 17 * var + 29 * cat + 53 * kind + 11) * 419 % 997) / 997


def build_model(labels: int, shift: int = 0) -> Model:
    """Model of the bridge: parameters from a fixed arithmetic rule."""
    variables = []
    for i, n in enumerate(SIZES):
        if i < 3:
            variables.append(Variable(
                VARS[i], n,
                weights={lbl: {c: _cell(shift, lbl, i, c) for c in range(n)} for lbl in range(labels)},
                scores={lbl: {c: _cell(shift + 1, lbl, i, c) for c in range(n)} for lbl in range(labels)}))
        else:
            ends = {lbl: sorted((_cell(shift + 2, lbl, i, 0), _cell(shift + 3, lbl, i, 1))) for lbl in range(labels)}
            variables.append(Variable(
                VARS[i], n, NUMERICAL, spans=equal_span_bounds(n),
                low={lbl: e[0] for lbl, e in ends.items()}, high={lbl: e[1] for lbl, e in ends.items()},
                rising={lbl: (lbl + i + shift) % 2 == 0 for lbl in range(labels)},
                score={lbl: _cell(shift + 4, lbl, i, 2) for lbl in range(labels)}))
    rules = [
        Rule("R_0", "V0", 0, "V1", 1, _cell(shift + 5, 0, 0, 0), _cell(shift + 5, 0, 0, 1)),
        Rule("R_1", "V1", 0, "V2", 3, _cell(shift + 5, 0, 1, 0), _cell(shift + 5, 0, 1, 1)),
        Rule("R_2", "V2", 1, "V3", 2, _cell(shift + 5, 0, 2, 0), _cell(shift + 5, 0, 2, 1)),
        Rule("R_3", "V3", 1, "V4", 0, _cell(shift + 5, 0, 3, 0), _cell(shift + 5, 0, 3, 1)),
    ]
    return Model(labels, variables, rules)


MODEL = build_model(3)
TONE = build_model(2, shift=6)       # categorical property "tone", for labels 0 and 2
TONE_LABELS = [0, 2]
AMOUNT_LABELS = [1, 2]               # numerical property "amount" in [10, 20]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Deal the order table out to so many tasks; 0 leaves it as it is read. For trial tables in one
#: small file, which one task would read; tables in many files need no shuffle.
DEAL = int(os.environ.get("WEIGHBRIDGE_DEAL", "0"))


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt to as many tasks as a shuffle has: a small file whose rows mean much work would be one task's."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, key: str) -> DataFrame:
    return df.repartition(DEAL, key) if DEAL else df


def _spanned(df: DataFrame) -> DataFrame:
    spans = equal_span_bounds(4)
    return df.withColumns({"V3": span_index(F.col("x3"), spans), "V4": span_index(F.col("x4"), spans)})


def order_samples(spark: SparkSession, sf: str) -> DataFrame:
    """(sid, custkey, status, V0..V4, x3, x4): one sample per order."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    return _spanned(spread(o, "o_orderkey").select(
        F.col("o_orderkey").alias("sid"), F.col("o_custkey").alias("custkey"), F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("V0"),
        (F.col("o_custkey") % 2).cast("int").alias("V1"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("V2"),
        ((F.dayofyear("o_orderdate") - 1) / 366).alias("x3"),
        ((F.dayofmonth("o_orderdate") - 1) / 30).alias("x4")))


def line_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Lineitem joined to orders as samples.

    Both sides grow with the data, so they are shuffled on the order key and merged; neither is
    broadcast, however small the tables of a trial run are.
    """
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_discount", "l_quantity")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    j = li.join(o.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    return _spanned(j.select(
        "l_orderkey", "l_linenumber", F.col("o_orderstatus").alias("status"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("V0"),
        F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("V1"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("V2"),
        (F.col("l_discount") * 10).alias("x3"),
        ((F.col("l_quantity") - 1) / 49).alias("x4")))


def cats():
    return {v: F.col(v) for v in VARS}


def values():
    return {"V3": F.col("x3"), "V4": F.col("x4")}


def predicted(custkey: str = "custkey"):
    """A hand-written rival: null (no answer) for every eleventh customer."""
    return (F.when(F.col(custkey) % 11 == 0, F.lit(None))
            .when(F.col("V2") >= 3, 2).when(F.col("V0") + F.col("V1") >= 2, 1).otherwise(0).cast("int"))


# -- the same things as SQL text -----------------------------------------------------------

def _v(rows) -> str:
    def lit(x):
        if isinstance(x, bool):
            return "TRUE" if x else "FALSE"
        if isinstance(x, str):
            return "'" + x.replace("'", "''") + "'"
        return f"CAST({x!r} AS DOUBLE)" if isinstance(x, float) else str(x)
    return ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows)


def sql_model(model: Model, tag: str = "") -> str:
    return f"""
cp{tag}(var, label, cat, w, s) AS (VALUES {_v(model.category_rows())}),
np{tag}(var, label, low, high, rising, s) AS (VALUES {_v(model.numeric_rows())}),
rl{tag}(ord, name, va, ca, vb, cb, w, s) AS (VALUES {_v(model.rule_rows())}),
lb{tag}(label) AS (VALUES {_v([(i,) for i in range(model.labels)])})"""


def _sql_span(x: str, n: int = 4) -> str:
    arms = " ".join(f"WHEN {x} >= {i}/{n}::DOUBLE AND {x} < {i + 1}/{n}::DOUBLE THEN {i}" for i in range(n - 1))
    return f"CASE WHEN {x} < 0 THEN 0 {arms} ELSE {n - 1} END"


SQL_ORDERS = f"""
smp0 AS (SELECT o_orderkey AS sid, o_custkey AS custkey, o_orderstatus AS status,
  CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS V0,
  CAST(o_custkey % 2 AS INTEGER) AS V1, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS V2,
  (dayofyear(o_orderdate) - 1) / 366::DOUBLE AS x3, (dayofmonth(o_orderdate) - 1) / 30::DOUBLE AS x4 FROM orders),
smp AS (SELECT *, {_sql_span('x3')} AS V3, {_sql_span('x4')} AS V4 FROM smp0)"""

SQL_LINES = f"""
smp0 AS (SELECT row_number() OVER () AS sid, l_orderkey, l_linenumber, o_orderstatus AS status,
  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS V0,
  CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS V1, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS V2,
  l_discount * 10 AS x3, (l_quantity - 1) / 49 AS x4 FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
smp AS (SELECT *, {_sql_span('x3')} AS V3, {_sql_span('x4')} AS V4 FROM smp0)"""


def sql_scores(tag: str = "", smp: str = "smp", numeric: bool = True) -> str:
    """ent{tag}, sc{tag} (sid, label, ws, sw, score) and lab{tag} (sid, label, score, dec) over a sample CTE."""
    x3, x4 = ("x3", "x4") if numeric else ("(V3 + 0.5) / 4", "(V4 + 0.5) / 4")
    return f"""
lg{tag} AS (SELECT sid, 'V0' AS var, V0 AS cat, NULL::DOUBLE AS x FROM {smp}
  UNION ALL SELECT sid, 'V1', V1, NULL FROM {smp} UNION ALL SELECT sid, 'V2', V2, NULL FROM {smp}
  UNION ALL SELECT sid, 'V3', V3, {x3} FROM {smp} UNION ALL SELECT sid, 'V4', V4, {x4} FROM {smp}),
ent{tag} AS (SELECT sid, label, var AS entity, w, s FROM lg{tag} JOIN cp{tag} USING (var, cat)
  UNION ALL SELECT sid, label, var, greatest(0, least(1, low + (CASE WHEN rising THEN t ELSE 1 - t END) * (high - low))), s
    FROM (SELECT sid, var, greatest(0, least(1, x)) AS t FROM lg{tag} WHERE x IS NOT NULL) JOIN np{tag} USING (var)
  UNION ALL SELECT a.sid, lb{tag}.label, r.name, r.w, r.s FROM rl{tag} r JOIN lg{tag} a ON a.var = r.va AND a.cat = r.ca
    JOIN lg{tag} b ON b.sid = a.sid AND b.var = r.vb AND b.cat = r.cb, lb{tag}),
sc{tag} AS (SELECT sid, label, sum(w * s) AS ws, sum(w) AS sw,
  CASE WHEN sum(w) > 0 THEN sum(w * s) / sum(w) ELSE 0 END AS score FROM ent{tag} GROUP BY sid, label),
lab{tag} AS (SELECT sid, arg_max(label, score) AS label, max(score) AS score,
  greatest(0, least(1, max(score) - coalesce(list_reverse_sort(list(score))[2], 0))) AS dec FROM sc{tag} GROUP BY sid)"""


def with_scores(samples: str = SQL_ORDERS, model: Model = MODEL, numeric: bool = True) -> str:
    return f"WITH {samples}, {sql_model(model)}, {sql_scores(numeric=numeric)}"


SQL_PRED = """CASE WHEN custkey % 11 = 0 THEN NULL WHEN V2 >= 3 THEN 2 WHEN V0 + V1 >= 2 THEN 1 ELSE 0 END"""


def sql_u01(*parts: str) -> str:
    """SQL of functions.seeded.u01 over string-able expressions."""
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::UBIGINT / 4294967296::DOUBLE)"


def sql_key(*parts: str) -> str:
    return f"md5(concat_ws('|', {', '.join(parts)}))"


def sql_permute(x: str, n: str, seed: str, *parts: str, rounds: int = 6) -> str:
    """DuckDB form of functions.permuted.permute; the arguments are SQL expressions."""
    b = f"greatest(CAST(ceil(sqrt(CAST({n} AS DOUBLE))) AS BIGINT), 1)"
    a = f"(({n} + {b} - 1) // {b})"
    key = " || '|' || ".join([seed, *(f"CAST({p} AS VARCHAR)" for p in parts), "k[1]", "p[2]"])
    size = "CASE WHEN k[1] % 2 = 0 THEN p[3] ELSE p[4] END"
    draw = f"CAST('0x' || substr(md5({key}), 1, 15) AS BIGINT)"
    step = f"lambda p, k: [p[2], (p[1] + {draw} % {size}) % {size}, p[3], p[4]]"
    numbered = f"list_transform(range({rounds}), lambda i: [i, 0, 0, 0])"
    once = f"list_transform([list_reduce(list_prepend([v // {b}, v % {b}, {a}, {b}], {numbered}), {step})], lambda q: q[1] * {b} + q[2])[1]"
    return f"list_reduce(list_prepend(CAST({x} AS BIGINT), range(0, least({a} * {b} - {n}, CASE WHEN {b} < 64 THEN 64 ELSE 12 END) + 1)), lambda v, j: CASE WHEN j = 0 OR v >= {n} THEN {once} ELSE v END)"
