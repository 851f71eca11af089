"""Enumeration, sampling and candidate search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.seeded import u01
from ..operators import analysis as an
from ..operators import ragged as rg
from ..operators import sampling as sp
from ..operators import scoring as sc
from ..operators import search as se
from .bridge import (MODEL, SEED, SIZES, SQL_ORDERS, VARS, cats, dealt, order_samples, sql_key, sql_model, sql_permute, sql_scores, sql_u01, table,
                     values, with_scores)
from .registry import query

S = repr(str(SEED))


def r6(c):
    return F.round(c, 6)


def labelled(spark, sf):
    return sc.score_wide(order_samples(spark, sf), MODEL, cats(), values()).select("sid", "custkey", "status", *VARS, "x3", "x4", "label", "score", "scores")


@query("enumerate_assignments", """SELECT p_partkey, aid, CAST(aid // (3 * n1) AS INTEGER) AS V0, CAST(aid // 3 % n1 AS INTEGER) AS V1, CAST(aid % 3 AS INTEGER) AS V2
FROM (SELECT p_partkey, n1, unnest(range(n0 * n1 * 3)) AS aid FROM (SELECT p_partkey, p_size % 3 + 2 AS n0, p_size % 2 + 1 AS n1 FROM part))""")
def _(spark, sf):
    sizes = [F.col("p_size") % 3 + 2, F.col("p_size") % 2 + 1, F.lit(3)]
    return an.explode_combinations(table(spark, sf, "part").select("p_partkey", "p_size"), ["V0", "V1", "V2"], sizes).drop("p_size")


@query("decode_index", """SELECT o_orderkey, CAST(i // 160 AS INTEGER) AS V0, CAST(i // 80 % 2 AS INTEGER) AS V1, CAST(i // 16 % 5 AS INTEGER) AS V2,
  CAST(i // 4 % 4 AS INTEGER) AS V3, CAST(i % 4 AS INTEGER) AS V4, i AS encoded FROM (SELECT o_orderkey, o_orderkey % 480 AS i FROM orders)""")
def _(spark, sf):
    digits = an.radix_digits(F.col("o_orderkey") % 480, SIZES)
    df = table(spark, sf, "orders").select("o_orderkey", *[d.alias(v) for v, d in zip(VARS, digits)])
    return df.withColumn("encoded", an.radix_index([F.col(v) for v in VARS], SIZES))


_COMBOS = """cb AS (SELECT c_custkey, aid, CAST(aid // 10 AS INTEGER) AS V0, CAST(aid // 5 % 2 AS INTEGER) AS V1, CAST(aid % 5 AS INTEGER) AS V2
  FROM (SELECT c_custkey, unnest(range(30)) AS aid FROM customer))"""


def combos(spark, sf):
    return an.explode_combinations(table(spark, sf, "customer").select("c_custkey"), ["V0", "V1", "V2"], [F.lit(n) for n in SIZES[:3]])


_WIDE = [f"W{i}" for i in range(12)]


def _digit(i: int) -> str:
    return f"CAST(aid // {'1' if i == 11 else ' // '.join(['n'] * (11 - i))} % n AS INTEGER) AS W{i}"


@query("sample_configurations", f"""WITH c AS (SELECT c_custkey, CAST(10 + c_custkey % 5 AS BIGINT) AS n, CAST(pow(10 + c_custkey % 5, 12) AS BIGINT) AS total, unnest(range(3)) AS draw FROM customer),
d AS (SELECT c_custkey, n, draw, {sql_permute('draw', 'total', S, 'c_custkey')} AS aid FROM c)
SELECT c_custkey, draw, aid, {', '.join(_digit(i) for i in range(12))} FROM d""")
def _(spark, sf):
    # 12 variables of 10 to 14 categories: three of up to 5.7e13 combinations per customer
    n = F.col("c_custkey") % 5 + 10
    return sp.sample_configurations(dealt(table(spark, sf, "customer").select("c_custkey")), _WIDE, [n] * 12, 3, SEED, ["c_custkey"])


_UNSEEN = f"WITH {SQL_ORDERS}, {_COMBOS}, un AS (SELECT cb.* FROM cb ANTI JOIN smp ON custkey = c_custkey AND cb.V0 = smp.V0 AND cb.V1 = smp.V1 AND cb.V2 = smp.V2)"


def unseen_combos(spark, sf):
    seen = order_samples(spark, sf).withColumnRenamed("custkey", "c_custkey")
    return sp.unseen(combos(spark, sf), seen, ["c_custkey", "V0", "V1", "V2"], None, SEED, "aid")


@query("unseen_anti_join", f"{_UNSEEN} SELECT c_custkey, aid, V0, V1, V2 FROM un")
def _(spark, sf):
    return unseen_combos(spark, sf).select("c_custkey", "aid", "V0", "V1", "V2")


@query("unseen_samples", f"""{_UNSEEN}, nu AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY aid) - 1 AS j, count(*) OVER (PARTITION BY c_custkey) AS u FROM un),
dr AS (SELECT c_custkey, CASE WHEN u <= 5 THEN draw ELSE {sql_permute('draw', 'u', S, 'c_custkey')} END AS j FROM (SELECT DISTINCT c_custkey, u, unnest(range(least(u, 5))) AS draw FROM nu)),
pk AS (SELECT nu.* FROM nu JOIN dr USING (c_custkey, j)),
smpu AS (SELECT c_custkey * 30 + aid AS sid, c_custkey, V0, V1, V2, v3 AS V3, v4 AS V4, v3 / 4::DOUBLE + {sql_u01(S, "'x3'", 'c_custkey', 'aid')} * 0.25 AS x3, v4 / 4::DOUBLE + {sql_u01(S, "'x4'", 'c_custkey', 'aid')} * 0.25 AS x4
  FROM (SELECT *, CAST(aid % 4 AS INTEGER) AS v3, CAST((aid + 1) % 4 AS INTEGER) AS v4 FROM pk)),
{sql_model(MODEL)}, {sql_scores(smp='smpu')} SELECT c_custkey, V0, V1, V2, V3, V4, round(x3, 6) AS x3, label, round(score, 6) AS score FROM smpu JOIN lab USING (sid)""")
def _(spark, sf):
    seen = order_samples(spark, sf).withColumnRenamed("custkey", "c_custkey")
    rest = sp.unseen_draws(table(spark, sf, "customer").select("c_custkey"), seen, ["c_custkey"], VARS[:3], SIZES[:3], 5, SEED)
    at = (F.col("c_custkey"), F.col("aid"))
    df = rest.select("c_custkey", "aid", "V0", "V1", "V2", (F.col("aid") % 4).cast("int").alias("V3"), ((F.col("aid") + 1) % 4).cast("int").alias("V4"))
    df = df.withColumns({"x3": sp.sample_in_span(F.col("V3") / 4, F.col("V3") / 4 + 0.25, SEED, F.lit("x3"), *at),
                         "x4": sp.sample_in_span(F.col("V4") / 4, F.col("V4") / 4 + 0.25, SEED, F.lit("x4"), *at)})
    s = sc.score_wide(df, MODEL, cats(), values())
    return s.select("c_custkey", *VARS, r6("x3").alias("x3"), "label", r6("score").alias("score"))


@query("sample_numeric", f"WITH {SQL_ORDERS} SELECT sid, round(V3 / 4::DOUBLE + {sql_u01(S, 'sid')} * ((V3 + 1) / 4::DOUBLE - V3 / 4::DOUBLE), 6) AS x FROM smp")
def _(spark, sf):
    lo, hi = sc.span_bounds(MODEL, "V3", F.col("V3"))
    return order_samples(spark, sf).select("sid", r6(sp.sample_in_span(lo, hi, SEED, F.col("sid"))).alias("x"))


_DRAW = f"""{with_scores()}, d AS (SELECT sid, {sql_u01(S, 'sid')} AS u, max(CASE label WHEN 0 THEN score END) AS s0, max(CASE label WHEN 1 THEN score END) AS s1, max(CASE label WHEN 2 THEN score END) AS s2 FROM sc GROUP BY sid)"""


@query("label_from_scores", f"{_DRAW} SELECT sid, CASE WHEN u * (s0 + s1 + s2) <= s0 THEN 0 WHEN u * (s0 + s1 + s2) <= s0 + s1 THEN 1 ELSE 2 END AS drawn, lab.label AS best FROM d JOIN lab USING (sid)")
def _(spark, sf):
    return labelled(spark, sf).select("sid", sp.label_from_scores(F.col("scores"), u01(SEED, F.col("sid"))).alias("drawn"),
                                      sp.label_from_scores(F.col("scores")).alias("best"))


@query("cumulative_label_draw", f"{_DRAW} SELECT sid, label, round(sum(score) OVER (PARTITION BY sid ORDER BY label), 6) AS running, u * (s0 + s1 + s2) <= sum(score) OVER (PARTITION BY sid ORDER BY label) AS reached FROM sc JOIN d USING (sid)")
def _(spark, sf):
    df = labelled(spark, sf).select("sid", "scores", u01(SEED, F.col("sid")).alias("u"))
    return df.select("sid", "u", F.posexplode(sp.running_scores(F.col("scores"))).alias("label", "c"), F.aggregate("scores", F.lit(0.0), lambda a, x: a + x).alias("t")).select(
        "sid", "label", r6("c").alias("running"), (F.col("u") * F.col("t") <= F.col("c")).alias("reached"))


_RANK = f"{with_scores()}, rk AS (SELECT sid, label, row_number() OVER (PARTITION BY label ORDER BY {sql_key(S, 'sid')}) AS rank FROM lab)"


@query("stratified_rank", f"{_RANK} SELECT * FROM rk")
def _(spark, sf):
    return sp.stratified_rank(labelled(spark, sf).select("sid", "label"), ["label"], SEED, ["sid"])


@query("seeded_shuffle", f"SELECT event_id, row_number() OVER (ORDER BY {sql_key(S, 'event_id')}) - 1 AS position FROM events")
def _(spark, sf):
    return sp.seeded_shuffle(table(spark, sf, "events").select("event_id"), SEED, ["event_id"])


_N = 30000


@query("balanced_sample", f"""{_RANK}, pool AS (SELECT i AS label, count(rk.sid) AS n FROM range({MODEL.labels}) t(i) LEFT JOIN rk ON rk.label = i GROUP BY i),
big AS (SELECT arg_max(label, n * 10 - label) AS label FROM pool),
filled AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS slot FROM pool WHERE n > 0),
dr AS (SELECT draw, coalesce(f.label, (SELECT label FROM big)) AS label, CASE WHEN f.label IS NOT NULL THEN draw % {_N // MODEL.labels} END AS nth
  FROM range({_N}) t(draw) LEFT JOIN filled f ON f.slot = draw // {_N // MODEL.labels}),
pk AS (SELECT draw, label, CASE WHEN nth < n THEN nth + 1 ELSE CAST(floor({sql_u01(S, "'again'", 'draw')} * n) AS BIGINT) + 1 END AS rank FROM dr JOIN pool USING (label))
SELECT sid, label, row_number() OVER (ORDER BY {sql_key(repr(f"{SEED}-order"), 'draw')}) - 1 AS position FROM pk JOIN rk USING (label, rank)""")
def _(spark, sf):
    s = sp.balanced_sample(labelled(spark, sf).select("sid", "label"), "label", MODEL.labels, _N, SEED, ["sid"])
    return s.select("sid", "label", "position")


@query("subset_indices", f"""WITH c AS (SELECT least(least(count(*) FILTER (quality = 0), count(*) FILTER (quality = 1)), 30) AS cap FROM labels)
SELECT doc_id, quality FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {sql_key(S, 'doc_id')}) AS r FROM labels), c WHERE r <= cap""")
def _(spark, sf):
    return sp.subset_rows(table(spark, sf, "labels"), "quality", 60, SEED, ["doc_id"]).select("doc_id", "quality")


@query("oracle_samples", f"SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS place FROM (SELECT doc_id FROM documents ORDER BY {sql_key(S, 'doc_id')} LIMIT 50)")
def _(spark, sf):
    return sp.oracle_samples(table(spark, sf, "documents").select("doc_id"), 50, SEED, "doc_id")


@query("bucketize", f"""SELECT doc_id, CAST(CASE WHEN p < 7 THEN p ELSE floor({sql_u01(S, "'bucket'", 'doc_id')} * 7) END AS INTEGER) AS bucket
FROM (SELECT doc_id, row_number() OVER (ORDER BY {sql_key(S, 'doc_id')}) - 1 AS p FROM documents)""")
def _(spark, sf):
    return sp.bucketize(table(spark, sf, "documents").select("doc_id"), 7, SEED, ["doc_id"])


@query("example_assignment", f"""SELECT p_partkey, v AS var, CAST(floor({sql_u01(S, 'p_partkey', 'v')} * n) AS INTEGER) AS cat, '- ' || v || ': num categories = ' || n AS line
FROM (SELECT p_partkey, unnest(['V0', 'V1']) AS v, unnest([p_size % 4 + 2, 3]) AS n FROM part)""")
def _(spark, sf):
    domains = table(spark, sf, "part").select("p_partkey", F.explode(F.array(
        F.struct(F.lit("V0").alias("var"), (F.col("p_size") % 4 + 2).alias("n")),
        F.struct(F.lit("V1").alias("var"), F.lit(3).alias("n")))).alias("d")).select("p_partkey", "d.*")
    return sp.example_assignment(domains, SEED, "p_partkey")


@query("property_hints", f"""SELECT l_suppkey, l_returnflag, l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY {sql_key(S, 'l_shipdate')}) AS r
FROM (SELECT DISTINCT l_suppkey, l_returnflag, strftime(l_shipdate, '%Y-%m') AS l_shipdate FROM lineitem)) WHERE r <= 3""")
def _(spark, sf):
    named = table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", F.date_format("l_shipdate", "yyyy-MM").alias("l_shipdate")).distinct()
    return sp.property_hints(named, ["l_suppkey", "l_returnflag"], "l_shipdate", 3, SEED)


# -- candidate search: every supplier carries one candidate model -------------------------------

SHAPE = se.Shape(labels=2, sizes=(3, 2, 4), numerical=(False, False, True), rules=((0, 1, 1, 0), (1, 1, 2, 3)))
_C = SHAPE.cells  # 18 cells, label-major


def candidates(spark, sf):
    return se.random_population(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("cand")), SHAPE, SEED)


def _arr(tag, n):
    return f"list_transform(range({n}), lambda i: {sql_u01(S, 'cand', repr(tag), 'i')})"


def _fix(e):
    # cells 5/6 and 14/15 are the bounds of the numerical variable (1-based 6/7 and 15/16)
    return (f"list_transform({e}, lambda x, i: CASE WHEN i IN (6, 15) THEN least(x, ({e})[i + 1]) WHEN i IN (7, 16) THEN greatest(x, ({e})[i - 1]) ELSE x END)")


POP = f"""pop0 AS (SELECT cand, {_arr('w', _C)} AS w0, {_arr('s', _C)} AS s, list_transform({_arr('d', 6)}, lambda u: u < 0.5) AS falling,
  {_arr('rw', 2)} AS rw, {_arr('rs', 2)} AS rs, [1, 1] AS ra FROM (SELECT s_suppkey AS cand FROM supplier)),
pop AS (SELECT cand, {_fix('w0')} AS w, s, falling, rw, rs, ra FROM pop0)"""


def _scored(pop):
    return f"""ex{pop} AS (SELECT *, CAST(aid // 8 AS INTEGER) AS d0, CAST(aid // 4 % 2 AS INTEGER) AS d1, CAST(aid % 4 AS INTEGER) AS d2 FROM (SELECT *, unnest(range(24)) AS aid FROM {pop})),
el{pop} AS (SELECT e.*, l, l * 9 AS o, CASE WHEN falling[l * 3 + 3] THEN 1 - (d2 + 0.5) / 4 ELSE (d2 + 0.5) / 4 END AS t FROM ex{pop} e, range(2) r(l)),
en{pop} AS (SELECT cand, aid, l, w[o + d0 + 1] AS w0, s[o + d0 + 1] AS s0, w[o + 3 + d1 + 1] AS w1, s[o + 3 + d1 + 1] AS s1,
  greatest(0, least(1, w[o + 6] + t * (w[o + 7] - w[o + 6]))) AS w2, s[o + 6] AS s2,
  CASE WHEN d0 = ra[1] AND d1 = 0 THEN rw[1] ELSE 0 END AS w3, rs[1] AS s3, CASE WHEN d1 = ra[2] AND d2 = 3 THEN rw[2] ELSE 0 END AS w4, rs[2] AS s4 FROM el{pop}),
sc{pop} AS (SELECT cand, aid, l, (w0 * s0 + w1 * s1 + w2 * s2 + w3 * s3 + w4 * s4) / (w0 + w1 + w2 + w3 + w4) AS score FROM en{pop}),
lb{pop} AS (SELECT cand, aid, arg_max(l, score) AS label, max(score) AS score, max(score) - min(score) AS dec FROM sc{pop} GROUP BY cand, aid),
an{pop} AS (SELECT cand, count(*) AS total, count(*) FILTER (label = 0) AS n0, avg(dec) AS ad, avg(score) AS ats, abs(n0 / 24 - 0.5) AS gap, min(dec) AS tmin,
  coalesce(arg_min(dec, aid) FILTER (dec < 0.1::DOUBLE), min(dec)) AS md FROM lb{pop} GROUP BY cand),
pn{pop} AS (SELECT *, greatest(0, 0.1::DOUBLE - md) + gap AS penalty, gap <= 0.2 AND md >= 0.1::DOUBLE AS passes FROM an{pop})"""


def scored_candidates(spark, sf, cands=None):
    return se.score_population(cands if cands is not None else candidates(spark, sf), SHAPE, 0.2, 0.1, chunk=16)


@query("generate_udd", f"WITH {POP} SELECT cand, round(list_sum(w), 6) AS w, round(list_sum(s), 6) AS s, len(list_filter(falling, lambda x: x)) AS falling, round(rw[1] + rs[2], 6) AS rules FROM pop")
def _(spark, sf):
    add = lambda a, x: a + x
    return candidates(spark, sf).select(
        "cand", r6(F.aggregate("w", F.lit(0.0), add)).alias("w"), r6(F.aggregate("s", F.lit(0.0), add)).alias("s"),
        F.size(F.filter("falling", lambda x: x)).cast("long").alias("falling"), r6(F.col("rw")[0] + F.col("rs")[1]).alias("rules"))


# -- candidates with structures of their own ---------------------------------------------------

RANGES = rg.Ranges(variables=(2, 4), numerical=(0, 1), categories=(2, 4), spans=(2, 3), rules=(0, 2))


def structures(spark, sf):
    return rg.random_structures(table(spark, sf, "supplier"), RANGES, SEED, "s_suppkey")


def _int(tag: str, size: str, *more: str) -> str:
    return f"CAST(floor({sql_u01(S, 'cand', repr(tag), *more)} * {size}) AS INTEGER)"


def _draws(tag: str, i: str = "i") -> str:
    return sql_u01(S, "cand", repr(tag), i)


STRUCTURES = f"""RECURSIVE st0 AS (SELECT s_suppkey AS cand, {_int('n', '3').replace('cand', 's_suppkey')} + 2 AS n, {_int('k', '2').replace('cand', 's_suppkey')} AS k, {_int('r', '3').replace('cand', 's_suppkey')} AS r FROM supplier),
st1 AS (SELECT *, list_transform(list_sort(list_transform(range(n), lambda v: {{'u': {_draws('type', 'v')}, 'v': v}}))[1:k], lambda x: x.v) AS chosen FROM st0),
st2 AS (SELECT *, list_transform(range(n), lambda v: list_contains(chosen, v)) AS numerical FROM st1),
st3 AS (SELECT *, list_transform(range(n), lambda v: CASE WHEN numerical[v + 1] THEN {_int('size', '2', 'v')} + 2 ELSE {_int('size', '3', 'v')} + 2 END) AS sizes FROM st2),
st4 AS (SELECT *, list_transform(range(n + 1), lambda i: coalesce(CAST(list_sum(sizes[1:i]) AS BIGINT), 0)) AS starts FROM st3),
tries(cand, n, sizes, r, i, kept, txt) AS (SELECT cand, n, sizes, r, -1, []::INTEGER[], '' FROM st4
  UNION ALL SELECT cand, n, sizes, r, i, CASE WHEN ok THEN kept || [a, ca, b, cb] ELSE kept END, CASE WHEN ok THEN txt || a || '.' || ca || '-' || b || '.' || cb || ' ' ELSE txt END
  FROM (SELECT *, NOT list_contains(list_transform(range(len(kept) // 2), lambda x: kept[2 * x + 1] * 100 + kept[2 * x + 2]), a * 100 + ca)
      AND NOT list_contains(list_transform(range(len(kept) // 2), lambda x: kept[2 * x + 1] * 100 + kept[2 * x + 2]), b * 100 + cb) AS ok
    FROM (SELECT *, {_int('ca', 'sizes[a + 1]', 'i')} AS ca, {_int('cb', 'sizes[b + 1]', 'i')} AS cb
      FROM (SELECT *, CASE WHEN o >= a THEN o + 1 ELSE o END AS b
        FROM (SELECT *, {_int('a', 'n', 'i')} AS a, {_int('b', '(n - 1)', 'i')} AS o
          FROM (SELECT cand, n, sizes, r, i + 1 AS i, kept, txt FROM tries WHERE len(kept) < 4 * r AND i < 999)))))),
pairs AS (SELECT cand, arg_max(kept, i) AS kept, rtrim(arg_max(txt, i)) AS rules FROM tries GROUP BY cand),
st AS (SELECT *, list_transform(list_filter(range(n), lambda v: numerical[v + 1]), lambda v: starts[v + 1]) AS lows, starts[n + 1] AS cells,
  list_transform(range(len(kept) // 4), lambda i: {_draws('rw')}) AS rw, list_transform(range(len(kept) // 4), lambda i: {_draws('rs')}) AS rs FROM st4 JOIN pairs USING (cand)),
par AS (SELECT *, list_transform(range(2 * cells), lambda i: CASE WHEN list_contains(lows, i % cells) THEN least({_draws('w')}, {_draws('w', 'i + 1')})
    WHEN i > 0 AND list_contains(lows, (i - 1) % cells) THEN greatest({_draws('w', 'i - 1')}, {_draws('w')}) ELSE {_draws('w')} END) AS w,
  list_transform(range(2 * cells), lambda i: {_draws('s')}) AS s, list_transform(range(2 * n), lambda i: {_draws('d')} < 0.5) AS falling FROM st)"""


@query("generate_structures", f"""WITH {STRUCTURES} SELECT cand, array_to_string(list_transform(numerical, lambda x: CASE WHEN x THEN 'n' ELSE 'c' END), '') AS types,
  array_to_string(sizes, ',') AS sizes, array_to_string(starts, ',') AS starts, rules, round(list_sum(w), 6) AS w, round(list_sum(s), 6) AS s,
  CAST(len(list_filter(falling, lambda x: x)) AS BIGINT) AS falling, round(coalesce(list_sum(rw), 0), 6) AS rw, round(coalesce(list_sum(rs), 0), 6) AS rs FROM par""")
def _(spark, sf):
    total = lambda c: r6(F.aggregate(c, F.lit(0.0), lambda a, x: a + x))
    pair = lambda x: F.concat_ws("", x["var_a"], F.lit("."), x["val_a"], F.lit("-"), x["var_b"], F.lit("."), x["val_b"])
    return structures(spark, sf).select(
        "cand", F.array_join(F.transform("numerical", lambda x: F.when(x, "n").otherwise("c")), "").alias("types"), F.array_join("sizes", ",").alias("sizes"),
        F.array_join("starts", ",").alias("starts"), F.array_join(F.transform("rules", pair), " ").alias("rules"), total("w").alias("w"), total("s").alias("s"),
        F.size(F.filter("falling", lambda x: x)).cast("long").alias("falling"), total(F.transform("rules", lambda x: x["w"])).alias("rw"),
        total(F.transform("rules", lambda x: x["s"])).alias("rs"))


@query("score_structures", f"""WITH {STRUCTURES},
ex AS (SELECT *, list_transform(range(n), lambda v: aid // CAST(list_product(sizes[v + 2:] || [1]) AS BIGINT) % sizes[v + 1]) AS cat
  FROM (SELECT *, unnest(range(CAST(list_product(sizes) AS BIGINT))) AS aid FROM par)),
el AS (SELECT e.*, l, list_transform(range(n), lambda v: {{'v': v, 'f': l * cells + starts[v + 1] + 1, 'd': cat[v + 1], 't': CASE WHEN falling[l * n + v + 1] THEN 1 - (cat[v + 1] + 0.5) / sizes[v + 1] ELSE (cat[v + 1] + 0.5) / sizes[v + 1] END}}) AS vs,
  list_filter(range(len(rw)), lambda i: cat[kept[4 * i + 1] + 1] = kept[4 * i + 2] AND cat[kept[4 * i + 3] + 1] = kept[4 * i + 4]) AS hits FROM ex e, range(2) q(l)),
en AS (SELECT *, list_transform(vs, lambda x: CASE WHEN numerical[x.v + 1] THEN greatest(0, least(1, w[x.f] + x.t * (w[x.f + 1] - w[x.f]))) ELSE w[x.f + x.d] END) AS ew,
  list_transform(vs, lambda x: CASE WHEN numerical[x.v + 1] THEN s[x.f] ELSE s[x.f + x.d] END) AS es FROM el),
sc AS (SELECT cand, aid, l, (list_sum(list_transform(range(n), lambda i: ew[i + 1] * es[i + 1])) + coalesce(list_sum(list_transform(hits, lambda i: rw[i + 1] * rs[i + 1])), 0))
  / (list_sum(ew) + coalesce(list_sum(list_transform(hits, lambda i: rw[i + 1])), 0)) AS score FROM en),
lb AS (SELECT cand, aid, arg_max(l, score) AS label, max(score) AS score, max(score) - min(score) AS dec FROM sc GROUP BY cand, aid),
an AS (SELECT cand, count(*) AS total, count(*) FILTER (label = 0) AS n0, avg(dec) AS ad, abs(n0 / total - 0.5) AS gap, coalesce(arg_min(dec, aid) FILTER (dec < 0.02::DOUBLE), min(dec)) AS md FROM lb GROUP BY cand)
SELECT cand, total, n0, round(ad, 6) AS avg_decisiveness, round(gap, 6) AS max_gap, round(md, 6) AS early_min, round(greatest(0, 0.02::DOUBLE - md) + gap, 6) AS penalty,
  gap <= 0.3 AND md >= 0.02::DOUBLE AS passes FROM an""")
def _(spark, sf):
    s = rg.score_structures(structures(spark, sf), RANGES.labels, 0.3, 0.02, chunk=16)
    return s.select("cand", "total", F.col("label_counts")[0].alias("n0"), r6("avg_decisiveness").alias("avg_decisiveness"), r6("max_gap").alias("max_gap"),
                    r6("min_decisiveness").alias("early_min"), r6("penalty").alias("penalty"), "passes")


_PROP_STEP = "((p.a = k.a AND p.ca = k.ca) OR (p.a = k.b AND p.ca = k.cb) OR (p.b = k.a AND p.cb = k.ca) OR (p.b = k.b AND p.cb = k.cb))"


@query("random_rules", f"""WITH RECURSIVE p0 AS (SELECT cand, i, CAST(floor({sql_u01(S, 'cand', "'a'", 'i')} * 4) AS INTEGER) AS a, CAST(floor({sql_u01(S, 'cand', "'b'", 'i')} * 3) AS INTEGER) AS o,
  {sql_u01(S, 'cand', "'ca'", 'i')} AS ua, {sql_u01(S, 'cand', "'cb'", 'i')} AS ub FROM (SELECT c_custkey AS cand, unnest(range(12)) AS i FROM customer)),
p AS (SELECT cand, i, a, CASE WHEN o >= a THEN o + 1 ELSE o END AS b, CAST(floor(ua * [3, 2, 4, 3][a + 1]) AS INTEGER) AS ca, CAST(floor(ub * [3, 2, 4, 3][b + 1]) AS INTEGER) AS cb FROM p0),
f(cand, i, kept, txt) AS (SELECT DISTINCT cand, -1, []::INTEGER[], '' FROM p
  UNION ALL SELECT f.cand, f.i + 1, CASE WHEN ok THEN f.kept || [a * 10 + ca, b * 10 + cb] ELSE f.kept END, CASE WHEN ok THEN f.txt || a || '.' || ca || '-' || b || '.' || cb || ' ' ELSE f.txt END
  FROM (SELECT f.*, p.a, p.b, p.ca, p.cb, len(f.kept) < 6 AND NOT list_contains(f.kept, p.a * 10 + p.ca) AND NOT list_contains(f.kept, p.b * 10 + p.cb) AS ok FROM f JOIN p ON p.cand = f.cand AND p.i = f.i + 1) f)
SELECT cand, rtrim(txt) AS rules FROM f WHERE i = 11""")
def _(spark, sf):
    ids = table(spark, sf, "customer").select(F.col("c_custkey").alias("cand"))
    r = se.random_rules(ids, [3, 2, 4, 3], 3, SEED, attempts=12)
    text = F.transform("rules", lambda x: F.concat_ws("", x["var_a"], F.lit("."), x["val_a"], F.lit("-"), x["var_b"], F.lit("."), x["val_b"]))
    return r.select("cand", F.array_join(text, " ").alias("rules"))


@query("score_population", f"""WITH {POP}, {_scored('pop')} SELECT cand, total, n0, round(ad, 6) AS avg_decisiveness, round(ats, 6) AS avg_top_score, round(gap, 6) AS max_gap,
  round(tmin, 6) AS true_min, round(md, 6) AS early_min, round(penalty, 6) AS penalty, passes FROM pnpop""")
def _(spark, sf):
    s = scored_candidates(spark, sf)
    return s.select("cand", "total", F.col("label_counts")[0].alias("n0"), r6("avg_decisiveness").alias("avg_decisiveness"), r6("avg_top_score").alias("avg_top_score"),
                    r6("max_gap").alias("max_gap"), r6("true_min_decisiveness").alias("true_min"), r6("min_decisiveness").alias("early_min"), r6("penalty").alias("penalty"), "passes")


@query("elite_quarter", f"WITH {POP}, {_scored('pop')} SELECT cand, round(penalty, 6) AS penalty FROM pnpop ORDER BY pnpop.penalty, cand LIMIT (SELECT greatest(1, count(*) // 4) FROM pop)")
def _(spark, sf):
    n = table(spark, sf, "supplier").count()
    return se.elite(scored_candidates(spark, sf), n).select("cand", r6("penalty").alias("penalty"))


@query("best_candidate", f"WITH {POP}, {_scored('pop')} SELECT cand, round(penalty, 6) AS penalty, passes FROM pnpop ORDER BY NOT passes, CASE WHEN passes THEN 0 ELSE pnpop.penalty END, cand LIMIT 1")
def _(spark, sf):
    return se.best_candidate(scored_candidates(spark, sf)).select("cand", r6("penalty").alias("penalty"), "passes")


@query("random_search", f"WITH {POP}, {_scored('pop')} SELECT cand, round(penalty, 6) AS penalty, passes, CASE WHEN passes THEN cand + 1 ELSE (SELECT count(*) FROM pop) END AS evaluations FROM pnpop ORDER BY NOT passes, CASE WHEN passes THEN 0 ELSE pnpop.penalty END, cand LIMIT 1")
def _(spark, sf):
    scored = scored_candidates(spark, sf)
    return se.random_search(scored).withColumn("penalty", r6("penalty"))


def _mut(e, gate, tag, rate="0.2", unit="i - 1"):
    return f"list_transform({e}, lambda x, i: CASE WHEN {sql_u01(repr('m'), 'cand', repr(gate), unit)} < {rate} THEN greatest(0, least(1, x + ({sql_u01(repr('m'), 'cand', repr(tag), 'i - 1')} * 2 - 1) * 0.1)) ELSE x END)"


_UNIT = "CASE WHEN i BETWEEN 6 AND 9 THEN 5 WHEN i BETWEEN 15 AND 18 THEN 14 ELSE i - 1 END"
MUTANTS = f"""mt0 AS (SELECT cand, {_mut('w', 'cell', 'w', unit=_UNIT)} AS w0, {_mut('s', 'cell', 's', unit=_UNIT)} AS s, falling, {_mut('rw', 'rule', 'rw')} AS rw, {_mut('rs', 'rule', 'rs')} AS rs,
  list_transform(ra, lambda x, i: CASE WHEN {sql_u01(repr('m'), 'cand', repr('swap'), 'i - 1')} < 0.1 THEN CAST(floor({sql_u01(repr('m'), 'cand', repr('target'), 'i - 1')} * [3, 2][i]) AS INTEGER) ELSE x END) AS ra FROM {{src}}),
mt AS (SELECT cand, {_fix('w0')} AS w, s, falling, rw, rs, ra FROM mt0)"""


def _flat(df):
    cells = F.concat(F.transform("w", lambda x: x), F.col("s"), F.col("rw"), F.col("rs"), F.col("ra").cast("array<double>"))
    return df.select("cand", F.posexplode(cells).alias("cell", "v")).select("cand", F.col("cell").cast("int").alias("cell"), r6("v").alias("v"))


_FLAT = "SELECT cand, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS cell, round(unnest(v), 6) AS v FROM (SELECT cand, w || s || rw || rs || ra::DOUBLE[] AS v FROM {src})"


@query("mutate_candidates", f"WITH {POP}, {MUTANTS.format(src='pop')} {_FLAT.format(src='mt')}")
def _(spark, sf):
    return _flat(se.mutate(candidates(spark, sf), SHAPE, "m", 0.2))


@query("initial_population", f"""WITH {POP}, base AS (SELECT c.cand, p.w, p.s, p.falling, p.rw, p.rs, p.ra FROM pop p, pop c WHERE p.cand = 0),
{MUTANTS.format(src='base')}, ip AS (SELECT * FROM mt WHERE cand <> 0 UNION ALL SELECT * FROM pop WHERE cand = 0) {_FLAT.format(src='ip')}""")
def _(spark, sf):
    cands = candidates(spark, sf)
    return _flat(se.initial_population(cands.where("cand = 0"), cands.select("cand"), SHAPE, "m", 0.2))


@query("dna_roundtrip", f"WITH {POP} {_FLAT.format(src='pop')}")
def _(spark, sf):
    return _flat(se.from_long(se.to_long(candidates(spark, sf)), SHAPE))


@query("summarize_udd", f"""WITH {POP} SELECT cand, 'Output labels: 2' || chr(10) || 'Variables: 3' || chr(10) || '  - V0: type=categorical categories=3' || chr(10) || '  - V1: type=categorical categories=2' || chr(10)
 || '  - V2: type=numerical spans=[0.00, 0.25], [0.25, 0.50], [0.50, 0.75], [0.75, 1.00]' || chr(10) || 'Rules: 2' || chr(10)
 || format('  - R_0: IF V0=={{}} AND V1==0 -> (w={{:.3f}}, s={{:.3f}})', ra[1], rw[1], rs[1]) || chr(10) || format('  - R_1: IF V1=={{}} AND V2 in [0.75, 1.00] -> (w={{:.3f}}, s={{:.3f}})', ra[2], rw[2], rs[2]) AS summary FROM pop""")
def _(spark, sf):
    return candidates(spark, sf).select("cand", se.summary_text(SHAPE).alias("summary"))


@query("evolve")
def _(spark, sf):
    cands = candidates(spark, sf)
    n = table(spark, sf, "supplier").count()
    found = se.evolve(cands, SHAPE, budget=2 * n, population=n, max_gap=0.01, min_required=0.3, seed=SEED)
    return found["population"].where(F.col("cand") == found["cand"]).select(
        "cand", F.lit(found["penalty"]).alias("penalty"), F.lit(found["passes"]).alias("passes"),
        F.lit(found["evaluations"]).alias("evaluations"), F.lit(found["generations"]).alias("generations"))
