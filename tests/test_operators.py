"""Operators against brute force on small data, with groups cut into many chunks."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from weighbridge.functions import numeric as num
from weighbridge.functions import parsing as ps
from weighbridge.functions import text as tx
from weighbridge.operators import alignment as al
from weighbridge.operators import analysis as an
from weighbridge.operators import blocks as bl
from weighbridge.operators import lsee as ls
from weighbridge.operators import metrics as mt
from weighbridge.operators import ordered as od
from weighbridge.operators import sampling as sp
from weighbridge.operators import scoring as sc
from weighbridge.operators import search as se
from weighbridge.operators import sessions as ss
from weighbridge.operators.model import NUMERICAL, Model, Rule, Variable
from weighbridge.plans.bridge import MODEL, SIZES, VARS, cats, values


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def skewed(spark, n=400):
    """A table where one key holds a good third of the rows."""
    rng = random.Random(3)
    rows = [(0 if rng.random() < 0.4 else rng.randrange(1, 12), i, rng.randrange(0, 7)) for i in range(n)]
    return spark.createDataFrame(rows, "k int, pos long, v long"), rows


def test_running_equals_plain_window(spark):
    df, _ = skewed(spark)
    w = Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("k", "pos", F.sum("v").over(w).alias("s"), F.max("v").over(w).alias("m"), F.count("v").over(w).alias("c"))
    got = od.running(df, ["k"], ["pos"], od.position_chunk(F.col("pos"), 7),
                     {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "c": ("count", F.col("v"))}).drop("v")
    assert sorted(got.collect()) == sorted(want.collect())
    before = od.running(df, ["k"], ["pos"], od.position_chunk(F.col("pos"), 7), {"s": ("sum", F.col("v"))}, before_row=True)
    w0 = Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    assert sorted(map(str, before.select("k", "pos", "s").collect())) == sorted(map(str, df.select("k", "pos", F.sum("v").over(w0).alias("s")).collect()))


def sequential_ledger(rows, budgets):
    left, out = dict(budgets), {}
    for k, pos, cost, ok in sorted(rows, key=lambda r: r[1]):
        if not ok or cost <= 0:
            out[k, pos] = ("free", 0, left[k])
        elif left[k] is not None and cost > left[k]:
            out[k, pos] = ("rejected", 0, left[k])
        else:
            left[k] = None if left[k] is None else left[k] - cost
            out[k, pos] = ("charged", cost, left[k])
    return out


@pytest.mark.parametrize("costs", [[1, 5], [2, 3, 7], [1], [4]])
def test_budget_ledger_equals_sequential_rule(spark, costs):
    rng = random.Random(sum(costs))
    for trial in range(2):
        rows = [(rng.randrange(6), i, rng.choice([0, *costs]), rng.random() < 0.9) for i in range(160)]
        budgets = {k: (None if k == 5 else rng.randrange(0, 30)) for k in range(6)}
        df = spark.createDataFrame([(k, p, c, ok, budgets[k]) for k, p, c, ok in rows],
                                   "k int, pos long, cost int, runnable boolean, budget long")
        got = ss.budget_ledger(df, ["k"], "pos", "cost", "runnable", "budget", costs, rows=11).collect()
        want = sequential_ledger(rows, budgets)
        assert {(r["k"], r["pos"]): (r["outcome"], r["charged"], r["left"]) for r in got} == want


def test_status_delivery_equals_state_machine(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(3), i, rng.choice(["connect", "disconnect", "message", "message", "turn"])) for i in range(240)]
    df = spark.createDataFrame(rows, "k int, pos long, kind string")
    for grace in (0, 1, 2):
        got = {(r["k"], r["pos"]): r["delivered_at"] for r in ss.status_delivery(df, ["k"], "pos", "kind", grace, rows=13).collect()
               if r["outcome"] in ("delivered", "held", "notice")}
        want = {}
        for k in range(3):
            connected, left, held = True, 0, []
            for _, pos, kind in sorted(r for r in rows if r[0] == k):
                if kind == "message":
                    if connected:
                        want[k, pos] = pos
                    elif left > 0:
                        held.append(pos)
                elif kind == "turn" and not connected and left > 0:
                    left -= 1
                    held = held if left else []
                elif kind == "connect":
                    if not connected:
                        want[k, pos] = pos
                        want.update({(k, m): pos for m in held})
                        held = []
                    connected, left = True, 0
                elif kind == "disconnect":
                    connected, left = False, grace
        assert got == want


def test_knn_scale_with_one_value_in_a_third_of_the_rows(spark):
    rng = np.random.default_rng(1)
    train = np.concatenate([np.full(60, 5.0), rng.normal(5, 3, 80), rng.normal(40, 10, 40)]).round(2)
    query = np.concatenate([[5.0] * 20, rng.uniform(-20, 90, 60).round(2)])
    t = spark.createDataFrame([(float(x),) for x in train], "v double")
    q = spark.createDataFrame([(float(x),) for x in query], "q double")
    got = {r["x"]: r["sigma"] for r in ls.knn_scale(t, "v", q, "q", 5, rows=20).collect()}
    for x in set(query.tolist()):
        assert got[x] == pytest.approx(np.sort(np.abs(train - x))[:5].mean(), abs=1e-9)
    few = ls.knn_scale(t.limit(3), "v", q, "q", 5).collect()
    assert all(r["sigma"] is None for r in few)


def test_lsee_is_zero_for_a_perfect_guess_and_below_one(spark):
    r = one(spark, ls.lsee(F.lit(2.0), F.lit(2.0), F.lit(0.5)).alias("a"), ls.lsee(F.lit(2.0), F.lit(9.0), F.lit(0.5)).alias("b"),
            ls.lsee(F.lit(2.0), F.lit(3.0), F.lit(0.0)).alias("c"))
    assert r["a"] == 0.0 and r["b"] == pytest.approx(1 - math.exp(-42)) and r["c"] == 1.0


def test_spans(spark):
    spans = num.equal_span_bounds(4)
    xs = [-0.1, 0.0, 0.2499, 0.25, 0.75, 1.0, 1.5]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = df.select(num.span_index(F.col("x"), spans).alias("a"), num.span_index_of(F.col("x"), num.equal_spans(F.lit(4))).alias("b")).collect()
    assert [r["a"] for r in got] == [0, 0, 0, 1, 3, 3, 3] == [r["b"] for r in got]
    gap = num.span_index(F.lit(0.5), [(0.1, 0.2), (0.3, 0.4)])
    assert one(spark, gap.alias("g"))["g"] == 1
    r = one(spark, num.normalize_span(F.lit(0.7), F.lit(0.2)).alias("s"), num.normalize_span(F.lit(1.4), F.lit(1.0)).alias("t"),
            num.normalize_span(F.lit(0.5), F.lit(0.5)).alias("u"))
    assert tuple(r["s"]) == (0.2, 0.7) and tuple(r["t"]) == (1.0, 1.0) and tuple(r["u"]) == (0.5, 0.500001)


def test_resolve_category(spark):
    rows = ["2", " 1 ", "1.0", "0.6", "", "x", "-1", "9", "true", None, "+3"]
    df = spark.createDataFrame([(r,) for r in rows], "raw string")
    spans = num.equal_span_bounds(4)
    got = df.select(num.resolve_category(F.col("raw"), "V", 4).alias("c"), num.resolve_category(F.col("raw"), "V", 4, spans).alias("n")).collect()
    assert [r["c"]["category"] for r in got] == [2, 1, 1, None, None, None, None, None, 1, None, 3]
    assert [r["n"]["category"] for r in got] == [2, 1, 1, 2, None, None, None, None, 1, None, 3]
    assert all((r["c"]["category"] is None) == (r["c"]["error"] is not None) for r in got)


def grid(spark):
    e = an.enumerate_assignments(spark, VARS, SIZES)
    return e.withColumns({"x3": (F.col("V3") + 0.3) / 4, "x4": (F.col("V4") + 0.9) / 4})


def test_wide_and_long_scoring_agree(spark):
    df = grid(spark)
    wide = {r["aid"]: r for r in sc.score_wide(df, MODEL, cats(), values()).collect()}
    long = sc.unpivot_assignment(df, ["aid"], cats(), values())
    tables = MODEL.tables(spark)
    ents = sc.param_join(long, tables, ["aid"]).unionByName(sc.rule_join(long, tables["rules"], ["aid"], MODEL.labels))
    labels = {r["aid"]: r for r in sc.label_long(sc.score_long(ents, ["aid"]), ["aid"]).collect()}
    assert len(labels) == len(wide) == 480
    for aid, r in labels.items():
        assert r["label"] == wide[aid]["label"] and r["score"] == pytest.approx(wide[aid]["score"], abs=1e-12)
    sums = sc.contributions(df, MODEL, cats(), values()).groupBy("aid", "label").agg(F.sum("weight").alias("w")).collect()
    for r in sums:
        assert r["w"] == pytest.approx(wide[r["aid"]]["weight_sums"][r["label"]], abs=1e-12)


def tiny(rules, labels=2):
    return Model(labels, [
        Variable("A", 2, weights={0: {0: 0.5, 1: 0.0}, 1: {0: 0.5, 1: 0.0}}, scores={0: {0: 0.4, 1: 0.9}, 1: {0: 0.4, 1: 0.1}}),
        Variable("B", 2, weights={0: {0: 0.0, 1: 0.2}, 1: {0: 0.0, 1: 0.2}}, scores={0: {0: 0.3, 1: 0.5}, 1: {0: 0.3, 1: 0.6}})], rules)


def test_ties_zero_weights_and_absent_variables(spark):
    m = tiny([])
    df = spark.createDataFrame([(0, 0), (1, 0), (0, 1), (None, 1), (None, None)], "A int, B int")
    got = sc.score_wide(df, m, {"A": F.col("A"), "B": F.col("B")}).collect()
    assert [r["label"] for r in got] == [0, 0, 1, 1, 0]  # tie, all weights zero, B decides, B alone, nothing
    assert [r["score"] for r in got][1] == 0.0 and [r["score"] for r in got][4] == 0.0


def test_equally_named_rules_add_weights_and_keep_the_last_score(spark):
    m = tiny([Rule("R", "A", 0, "B", 1, 0.3, 0.2), Rule("R", "A", 0, "B", 1, 0.1, 0.8)])
    df = spark.createDataFrame([(0, 1)], "A int, B int")
    r = sc.score_wide(df, m, {"A": F.col("A"), "B": F.col("B")}).first()
    assert r["weight_sums"][0] == pytest.approx(0.5 + 0.2 + 0.4)
    assert r["weighted_sums"][0] == pytest.approx(0.5 * 0.4 + 0.2 * 0.5 + 0.4 * 0.8)


def test_classifier_reads_a_whole_number_as_span_and_value(spark):
    v = Variable("N", 4, NUMERICAL, spans=num.equal_span_bounds(4), low={0: 0.0, 1: 0.5}, high={0: 1.0, 1: 0.5},
                 rising={0: True, 1: True}, score={0: 1.0, 1: 0.6})
    c = Variable("C", 2, weights={0: {0: 0.5, 1: 0.5}, 1: {0: 0.5, 1: 0.5}}, scores={0: {0: 0.0, 1: 0.0}, 1: {0: 0.3, 1: 0.3}})
    m = Model(2, [v, c], [Rule("R", "N", 1, "C", 0, 1.0, 0.0)])
    df = spark.createDataFrame([(1.0, 0), (0.3, 0), (0.99, 1), (0.05, 1)], "N double, C int")
    got = [r[0] for r in df.select(sc.classifier(m, {"N": F.col("N"), "C": F.col("C")})).collect()]
    want = []
    for n, cat in [(1.0, 0), (0.3, 0), (0.99, 1), (0.05, 1)]:
        span = 1 if n == 1.0 else int(n * 4)
        s = []
        for lbl in range(2):
            w = [v.low[lbl] + n * (v.high[lbl] - v.low[lbl]), 0.5]
            sco = [v.score[lbl], c.scores[lbl][cat]]
            if span == 1 and cat == 0:
                w.append(1.0)
                sco.append(0.0)
            s.append(sum(a * b for a, b in zip(w, sco)) / sum(w))
        want.append(max(range(2), key=lambda i: (s[i], -i)))
    assert got == want


def test_radix_round_trip(spark):
    df = an.enumerate_assignments(spark, VARS, SIZES).withColumn("back", an.radix_index([F.col(v) for v in VARS], SIZES))
    assert df.where("back <> aid").count() == 0 and df.select(*VARS).distinct().count() == 480
    assert tuple(df.orderBy("aid").limit(2).select(*VARS).collect()[1]) == (0, 0, 0, 0, 1)


def test_metrics_of_the_sum_rule(spark):
    rows = [(0, 2, 1, 1), (1, 1, 0, 0), (0, 0, 2, 1), (2, 1, 0, 0)]
    df = spark.createDataFrame(rows, "a int, b int, c int, label int").withColumn("pred", F.when(F.col("a") + F.col("b") + F.col("c") > 2, 1).otherwise(0))
    counts = mt.confusion_counts(df)
    r = mt.eval_report(counts, 2).first()
    assert (r["total"], r["correct"], r["accuracy"], r["full_accuracy"]) == (4, 2, 0.5, 0)
    dense = {(x["label"], x["pred"]): x["n"] for x in mt.confusion_matrix(counts, 2).collect()}
    assert dense == {(0, 0): 1, (0, 1): 1, (1, 0): 1, (1, 1): 1}


def test_invalid_predictions_join_the_universe(spark):
    df = spark.createDataFrame([(0, None), (0, 0), (1, 7)], "label int, pred int")
    per = {r["label"]: r for r in mt.per_label_metrics(mt.confusion_counts(df), 3).collect()}
    assert sorted(per) == [-1, 0, 1, 2, 7]
    assert per[-1]["fp"] == 1 and per[0]["recall"] == 0.5 and per[2]["f1"] == 0.0
    rep = mt.eval_report(mt.confusion_counts(df), 3).first()
    assert rep["macro_recall"] == pytest.approx(0.5 / 5) == rep["balanced_accuracy"]


def test_all_output_accuracy_counts_cells(spark):
    df = spark.createDataFrame([(True, {"p": 1}, {"p": 1, "q": 2}, False), (False, {"p": None}, {}, False), (False, {"p": 0}, None, True)],
                               "ok boolean, t map<string,int>, g map<string,int>, failed boolean")
    r = mt.all_output_accuracy(df, F.col("ok"), F.col("t"), F.col("g"), ["p"], F.col("failed")).first()
    assert (r["correct_cells"], r["cells"]) == (3, 3 + 2 + 3)


def test_balanced_sample(spark):
    df = spark.createDataFrame([(i, 0 if i < 5 else 1 if i < 60 else 2) for i in range(200)], "id long, label int")
    s = sp.balanced_sample(df, "label", 4, 62, 1, ["id"]).collect()
    counts = {lbl: sum(r["label"] == lbl for r in s) for lbl in range(4)}
    assert len(s) == 62 and counts[0] == 15 and counts[1] == 15 and counts[2] == 32 and counts[3] == 0
    assert {r["id"] for r in s if r["label"] == 0} == set(range(5))
    assert len({r["id"] for r in s if r["label"] == 1}) == 15
    assert sorted(r["position"] for r in s) == list(range(62))
    again = sp.balanced_sample(df.repartition(7), "label", 4, 62, 1, ["id"]).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, s))


def test_unseen_subset_and_buckets(spark):
    full = an.enumerate_assignments(spark, ["A", "B"], [4, 5])
    seen = full.where("A = B")
    rest = sp.unseen(full, seen, ["A", "B"], None, 1, "aid")
    assert rest.count() == 16 and rest.join(seen, ["A", "B"]).count() == 0
    assert sp.unseen(full, seen, ["A", "B"], 6, 1, "aid").count() == 6
    df = spark.createDataFrame([(i, int(i < 4)) for i in range(50)], "id long, label int")
    sub = sp.subset_rows(df, "label", 20, 1, ["id"]).collect()
    assert sum(r["label"] for r in sub) == 4 and len(sub) == 8
    with pytest.raises(ValueError):
        sp.subset_rows(df, "label", 50, 1, ["id"])
    sizes = [r["count"] for r in sp.bucketize(df, 9, 1, ["id"]).groupBy("bucket").count().collect()]
    assert len(sizes) == 9 and sum(sizes) == 50


def test_label_draw_falls_back_to_uniform(spark):
    zero = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    some = F.array(F.lit(0.2), F.lit(0.6), F.lit(0.2))
    got = one(spark, *[sp.label_from_scores(a, F.lit(u)).alias(f"c{i}") for i, (a, u) in enumerate([(zero, 0.0), (zero, 0.7), (some, 0.1), (some, 0.5), (some, 0.95)])],
              sp.label_from_scores(some).alias("best"))
    assert tuple(got) == (0, 2, 0, 1, 2, 1)


def test_population_scores_match_the_scorer(spark):
    shape = se.Shape(2, (3, 2, 4), (False, False, True), ((0, 1, 1, 0), (1, 1, 2, 3)))
    cands = se.random_population(spark.range(3).withColumnRenamed("id", "cand"), shape, "t")
    got = {r["cand"]: r for r in se.score_population(cands, shape, 0.2, 0.1, chunk=5).collect()}
    for c in cands.collect():
        w, s = c["w"], c["s"]
        variables = []
        for v, n in enumerate(shape.sizes):
            o = [shape.offset(lbl, v) for lbl in range(2)]
            if shape.numerical[v]:
                variables.append(Variable(f"V{v}", n, NUMERICAL, spans=num.equal_span_bounds(n), low={i: w[x] for i, x in enumerate(o)}, high={i: w[x + 1] for i, x in enumerate(o)},
                                          rising={i: not c["falling"][i * 3 + v] for i in range(2)}, score={i: s[x] for i, x in enumerate(o)}))
            else:
                variables.append(Variable(f"V{v}", n, weights={i: {k: w[x + k] for k in range(n)} for i, x in enumerate(o)}, scores={i: {k: s[x + k] for k in range(n)} for i, x in enumerate(o)}))
        m = Model(2, variables, [Rule(f"R{i}", f"V{a}", c["ra"][i], f"V{b}", vb, c["rw"][i], c["rs"][i]) for i, (a, _, b, vb) in enumerate(shape.rules)])
        names = [v.name for v in variables]
        rep = an.analyze(sc.score_wide(an.enumerate_assignments(spark, names, m.sizes), m, {n: F.col(n) for n in names}), 2).first()
        g = got[c["cand"]]
        assert g["total"] == 24 and g["label_counts"] == rep["label_counts"]
        assert g["avg_decisiveness"] == pytest.approx(rep["avg_decisiveness"], abs=1e-12)


def test_mutation_stays_in_bounds_and_keeps_some_cells(spark):
    shape = se.Shape(2, (3, 2, 4), (False, False, True), ((0, 1, 1, 0),))
    cands = se.random_population(spark.range(20).withColumnRenamed("id", "cand"), shape, "t")
    before, after = cands.orderBy("cand").collect(), se.mutate(cands, shape, "m", 0.2).orderBy("cand").collect()
    same = changed = 0
    for a, b in zip(before, after):
        for x, y in zip(a["w"] + a["s"], b["w"] + b["s"]):
            assert 0.0 <= y <= 1.0 and abs(x - y) <= 0.2
            same, changed = same + (x == y), changed + (x != y)
        for lbl in range(2):
            o = shape.offset(lbl, 2)
            assert b["w"][o] <= b["w"][o + 1]
        assert 0 <= b["ra"][0] < 3
    assert same > changed > 0


def test_evolution_spends_its_budget_and_never_gets_worse(spark):
    shape = se.Shape(2, (3, 2), (False, False), ((0, 1, 1, 0),))
    cands = se.random_population(spark.range(8).withColumnRenamed("id", "cand"), shape, "e")
    first = se.best_candidate(se.score_population(cands, shape, 0.0, 0.9)).first()
    found = se.evolve(cands, shape, budget=20, population=8, max_gap=0.0, min_required=0.9, seed=1)
    assert found["passes"] or (found["evaluations"] == 20 and found["generations"] == 3)
    assert found["penalty"] <= first["penalty"] + 1e-12


def test_rolling_mean_and_titles(spark):
    df, rows = skewed(spark, 120)
    got = {(r["k"], r["pos"]): r["m"] for r in bl.rolling_mean(df, ["k"], "pos", F.col("v"), 5, "m", rows=7).collect()}
    for k, pos, _ in rows:
        last = [v for kk, p, v in rows if kk == k and p <= pos][-5:]
        assert got[k, pos] == pytest.approx(sum(last) / len(last))
    t = spark.createDataFrame([(1, i, "x" * 40 if i % 2 else "Sheet") for i in range(6)], "g int, pos long, title string")
    names = [r["unique_title"] for r in bl.unique_titles(t, ["g"], "title", "pos").collect()]
    assert len(set(names)) == 6 and max(map(len, names)) == 31


def test_block_assignment(spark):
    claims = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (1, 3), (2, None), (3, 5)], "block int, sample long")
    samples = spark.createDataFrame([(i,) for i in range(7)], "sample long")
    got = {r["sample"]: r["block"] for r in bl.block_assignment(claims, samples, "sample").collect()}
    assert got == {0: 2, 1: 0, 2: 0, 3: 1, 4: 2, 5: 2, 6: 2}
    none = {r["sample"]: r["block"] for r in bl.block_assignment(claims.where("sample IS NOT NULL"), samples, "sample").collect()}
    assert none == {0: None, 1: 0, 2: 0, 3: 1, 4: None, 5: 3, 6: None}


def test_alignment_by_id_and_position(spark):
    w = spark.createDataFrame([(7, 0), (7, 1), (8, 2), (7, 3)], "id int, pos long")
    a = spark.createDataFrame([(7, 10), (8, 11), (7, 12)], "id int, pos long")
    got = sorted((r["pos"], r["matched_pos"]) for r in al.align_by_sample_id(w, a, "id", "pos").collect() if not r["missing"])
    assert got == [(0, 10), (1, 12), (2, 11)]
    with pytest.raises(ValueError):
        al.align_by_position(w, a, "pos")
    one = spark.createDataFrame([(i, f"a{i}") for i in range(10)], "pos long, x string")
    two = spark.createDataFrame([(i + 1, f"b{i}") for i in range(10)], "pos long, y string")
    assert sorted(tuple(r) for r in al.align_by_position(one, two, "pos").collect()) == [(i, f"a{i}", f"b{i}") for i in range(10)]


def test_number_formats(spark):
    xs = [3.0, 2.0000000001, 1.5, 1.25, 0.125, 1.005, 10.004, 1234567.891, -2.5]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(tx.format_number(F.col("x"))).collect()]
    want = [str(round(x)) if abs(x - round(x)) < 1e-6 else f"{x:.2f}".rstrip("0").rstrip(".") for x in xs]
    assert got == want


def test_text_pieces(spark):
    r = one(spark, tx.slug(F.lit("  a b/ç  ")).alias("slug"), tx.slug(F.lit("__")).alias("none"),
            F.array_join(tx.chunk_text(F.lit("abcdefg"), 3), "|").alias("chunks"), F.size(tx.chunk_text(F.lit(""), 3)).alias("empty"),
            tx.clean_cell_text(F.lit("a\r\nb​c d\te")).alias("cell"), tx.safe_title(F.lit("[]:")).alias("title"),
            tx.parse_mode(F.lit("STATIC")).alias("mode"), tx.parse_level(F.lit(" Files ")).alias("level"),
            tx.safe_format(F.lit("{a.b()} {c}"), F.create_map(F.lit("a"), F.lit("x"))).alias("fmt"),
            tx.redact_terms(F.lit("Score {score} {label} {x}"), ["label"]).alias("red"))
    assert r["slug"] == "a_b" and r["none"] == "unnamed" and r["chunks"] == "abc|def|g" and r["empty"] == 1
    assert r["cell"] == "a  bcde" and r["title"] == "Sheet" and r["mode"] == "static" and r["level"] == "files"
    assert r["fmt"] == "x {c}" and r["red"] == "  {label} "


def test_json_pieces(spark):
    rows = ['{"a": {"b": 1}}', 'x {"a": {"b": 1}} y {"c"', "no", "{ open", None]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = [r[0] for r in df.select(ps.extract_json_object(F.col("t"))).collect()]
    assert got == ['{"a": {"b": 1}}', '{"a": {"b": 1}}', None, None, None]
    r = one(spark, ps.last_code_block(F.lit("```python\na```b```\nc\n```")).alias("code"),
            ps.parse_tool_call(F.lit('{"function": {"name": "f", "arguments": {"x": "{\\"y\\": 1}"}}}'))["args"]["x"].alias("x"))
    assert r["code"] == "c\n" and r["x"] == '{"y": 1}'


def test_tree_rules_say_what_the_tree_predicts(spark):
    from weighbridge.operators import tree as tr
    rows = [(float(a), float(b), int(a > 3 and b < 2)) for a in range(8) for b in range(5)]
    df = spark.createDataFrame(rows, "A double, B double, label int")
    model, out, classes = tr.derive_tree(df, ["A", "B"], "label")
    assert model.depth <= 3 and classes == ["0", "1"]
    assert tr.training_accuracy(out, "label").first()["accuracy"] == 1.0
    rules = tr.tree_rules(model, ["A", "B"], classes)
    told = F.lit(None).cast("string")
    for condition, cls in rules:
        told = F.when(F.expr(condition), F.lit(cls)).otherwise(told)
    assert 2 <= len(rules) <= 8 and out.where(~told.eqNullSafe(F.col("prediction"))).count() == 0
    text = tr.tree_to_text(model, ["A", "B"], classes)
    assert text.count("return") == len(rules) and text.count("if ") == text.count("else:") == len(rules) - 1


def test_prediction_labels(spark):
    texts = {"3": 3, " 4 ": 4, "+5": 5, "3.7": -1, "nan": -1, "1e20": -1, "": -1, "x": -1, None: -1, "99999999999": -1, "-1": -1}
    got = {r["t"]: r["p"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", mt.prediction_label(F.col("t")).alias("p")).collect()}
    assert got == texts
    numbers = [(3.7, 3), (-0.4, 0), (float("nan"), -1), (1e20, -1), (None, -1), (2.0, 2)]
    rows = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(numbers)], "i int, x double").select("i", mt.prediction_label(F.col("x")).alias("p")).collect()
    assert [r["p"] for r in sorted(rows)] == [w for _, w in numbers]


def test_json_objects_in_text(spark):
    cases = {'{"a": 1}': '{"a": 1}', ' x {"a": {"b": 2}} y {c}': '{"a": {"b": 2}}', "} {a} }": "{a}", "x {a {b}": None, "{a {b}": "{a {b}", "none": None, None: None,
             "{a} and {b}": "{a} and {b}", "x{}": "{}", "x {a\n{b}\n} z": "{a\n{b}\n}"}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r["t"]: r["o"] for r in df.select("t", ps.extract_json_object(F.col("t")).alias("o")).collect()} == cases


def test_budget_reads_costs_or_names_unlisted_ones(spark):
    rows = [(1, i, c, True, 7) for i, c in enumerate((5, 2, 3, 1))]
    df = spark.createDataFrame(rows, "k long, pos long, cost int, runnable boolean, budget long")
    got = [(r["outcome"], r["left"]) for r in sorted(ss.budget_ledger(df, ["k"], "pos", "cost", "runnable", "budget").collect(), key=lambda r: r["pos"])]
    assert got == [("charged", 2), ("charged", 0), ("rejected", 0), ("rejected", 0)]
    with pytest.raises(Exception, match="not listed"):
        ss.budget_ledger(df, ["k"], "pos", "cost", "runnable", "budget", [1, 5]).collect()


def test_sampling_takes_the_smallest_keys(spark):
    df = spark.range(3000).withColumnRenamed("id", "i")
    for k in (0, 1, 17, 2999, 3000, 4000):
        got = {r["i"] for r in sp.sample_rows(df, k, 5, ["i"]).collect()}
        want = {r["i"] for r in df.orderBy(F.md5(F.concat_ws("|", F.lit("5"), F.col("i").cast("string")))).limit(k).collect()}
        assert got == want
    seen = spark.createDataFrame([(i % 3, i % 2) for i in range(6)], "a int, b int").where("a < 2")
    rows = spark.createDataFrame([(i, i % 3, i % 2) for i in range(60)], "i int, a int, b int")
    assert {r["a"] for r in sp.unseen(rows, seen, ["a", "b"], 7, 1, "i").collect()} == {2}
    assert sp.unseen(rows, seen, ["a", "b"], 7, 1, "i").count() == 7


def test_numbered_titles_avoid_original_ones(spark):
    rows = [(1, i, t) for i, t in enumerate(["a", "a_3", "a", "a", "a_2", "a", "b", "b", "x" * 40, "x" * 29 + "_2", "x" * 35])] + [(2, 0, "a"), (2, 1, "a")]
    df = spark.createDataFrame(rows, "k int, pos long, title string")
    got = {(r["k"], r["pos"]): r["unique_title"] for r in bl.unique_titles(df, ["k"], "title", "pos").collect()}
    assert [got[1, i] for i in range(11)] == ["a", "a_3", "a_4", "a_5", "a_2", "a_6", "b", "b_2", "x" * 31, "x" * 29 + "_2", "x" * 29 + "_3"]
    assert [got[2, i] for i in range(2)] == ["a", "a_2"]


def test_budget_of_many_costs_and_long_sessions(spark):
    """50 distinct costs, sessions over three levels of stretches, large, null and negative budgets, gaps, null keys."""
    rng = random.Random(50)
    budgets = {None: 40, 1: 10 ** 12, 2: None, 3: -5, 4: 0, 5: 700, 6: 4321}
    rows = [(k, 7 + p * rng.choice([1, 1, 3]) + 3000 * (p > 200), rng.randrange(-1, 50), rng.random() < 0.9) for k in budgets for p in range(0, 400, 3 if k else 1)]
    rows = [(k, p, c, ok) for (k, p), (c, ok) in {(k, p): (c, ok) for k, p, c, ok in rows}.items()]
    df = spark.createDataFrame([(k, p, c, ok, budgets[k], f"x{p}") for k, p, c, ok in rows], "k int, pos long, cost int, runnable boolean, budget long, row string")
    want = sequential_ledger(rows, budgets)
    for size in (8, 64):
        got = ss.budget_ledger(df, ["k"], "pos", "cost", "runnable", "budget", rows=size)
        assert got.columns == [*df.columns, "outcome", "charged", "left"]
        assert {(r["k"], r["pos"]): (r["outcome"], r["charged"], r["left"]) for r in got.collect()} == want
    assert ss.budget_ledger(df.limit(0), ["k"], "pos", "cost", "runnable", "budget").count() == 0


def test_budget_maps_against_every_budget(spark):
    """Maps of random calls, composed, against charging each budget call by call."""
    rng = random.Random(51)
    for costs in ([1] * 30, [1, 5] * 8, [3, 7, 2, 2, 9, 1, 30], [64, 32, 16, 8, 4, 2, 1, 100], []):
        rng.shuffle(costs)
        cut = len(costs) // 2
        whole = F.array(ss._piece(F.lit(0).cast("long"), F.lit(200).cast("long"), F.lit(0).cast("long"), F.lit(1)))
        one, two = whole, whole
        df = spark.range(1).select(F.array(*[F.lit(c).cast("long") for c in costs[:cut]]).cast("array<bigint>").alias("a"), F.array(*[F.lit(c).cast("long") for c in costs[cut:]]).cast("array<bigint>").alias("b"))
        df = df.select(ss._merged(F.aggregate("a", one, ss._after_call)).alias("m"), ss._merged(F.aggregate("b", two, ss._after_call)).alias("n"))
        df = df.select(ss._followed(F.col("m"), F.col("n")).alias("m"))
        got = df.select("m", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(199).cast("long")), lambda b: ss._left_after(F.col("m"), b)).alias("left")).first()
        want = []
        for left in range(200):
            for c in costs:
                left -= c if c <= left else 0
            want.append(left)
        assert list(got["left"]) == want
        if set(costs) == {1}:
            assert len(got["m"]) == 2  # used up, or all paid


@pytest.mark.parametrize("rows", [4, 1_000_000])
def test_bottom_rows_and_balanced_draws_equal_full_ranking(spark, monkeypatch, rows):
    """Few rows a bucket (more digits are counted) or one pass: the same rows as ranking everything."""
    monkeypatch.setattr(sp.key_buckets, "__defaults__", (rows,))
    df = spark.range(700).select("id", F.when(F.col("id") % 50 == 0, 2).when(F.col("id") % 3 == 0, 1).when(F.col("id") % 101 == 7, None).otherwise(0).alias("label"))
    ranked = sp.stratified_rank(df, ["label"], 9, ["id"], "r").where("label IS NOT NULL").collect()
    for k in (1, 20, 10 ** 6):
        assert {r["id"] for r in sp.bottom_rows(df, ["label"], k, 9, ["id"]).collect()} == {r["id"] for r in ranked if r["r"] <= k}
    place = {(r["label"], r["r"]): r["id"] for r in ranked}
    got = sp.balanced_sample(df, "label", 4, 205, 9, ["id"]).collect()
    assert len(got) == 205 and sorted(r["position"] for r in got) == list(range(205))
    by = {}
    for r in got:
        by.setdefault(r["label"], []).append(r["id"])
    base = 205 // 4
    assert set(by[1]) == {place[1, i + 1] for i in range(base)} and len(by[1]) == base
    assert {place[0, i + 1] for i in range(base)} <= set(by[0]) and len(by[0]) == 205 - 2 * base  # label 3 has no rows: 0 is the largest pool
    assert set(by[2]) == {i for (label, _), i in place.items() if label == 2} and len(by[2]) == base
    twice = spark.createDataFrame([(1, 0)] * 5 + [(2, 0), (3, 1)], "id long, label int")
    assert sp.bottom_rows(twice, ["label"], 3, 9, ["id"]).groupBy("label").count().orderBy("label").collect()[0]["count"] == 3
