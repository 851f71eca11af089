"""Sessions, experiments, alignment, density-scaled error, trees and streams.

Conversations are sessions: user turns ask for experiments, assistant turns evaluate theories,
system turns call an unknown tool. Events of a user are a client's connection log.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignment as al
from ..operators import experiments as ex
from ..operators import lsee as ls
from ..operators import properties as pr
from ..operators import sampling as sp
from ..operators import search as se
from ..operators import sessions as ss
from ..operators import tree as tr
from ..functions import text as tx
from ..sources.storage import fresh_path, stored
from ..streaming import sessions as st
from .bridge import (MODEL, SEED, SQL_ORDERS, TONE, TONE_LABELS, VARS, cats, order_samples, sql_key, sql_model, sql_scores,
                     sql_u01, table, values, with_scores)
from .registry import query
from .sampling_queries import labelled

S = repr(str(SEED))


def r6(c):
    return F.round(c, 6)


TOOL = "CASE role WHEN 'user' THEN 'run_experiment' WHEN 'assistant' THEN 'evaluate_theory' ELSE 'nothing_known' END"


def calls(spark, sf):
    c = table(spark, sf, "conversations")
    tool = F.expr(TOOL)
    return c.select("conv_id", F.col("turn").alias("pos"), "role", "text", tool.alias("tool"), ss.tool_cost(tool).alias("cost"),
                    ((F.col("role") != "system") & (F.length("text") % 13 != 0)).alias("runnable"), (F.col("conv_id") % 9).alias("budget"))


LEDGER = f"""RECURSIVE c AS (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 5 ELSE 1 END AS cost, role <> 'system' AND length(text) % 13 <> 0 AS runnable FROM conversations),
f(conv_id, turn, left_, outcome, charged) AS (SELECT conv_id, min(turn) - 1, conv_id % 9, '', CAST(0 AS BIGINT) FROM c GROUP BY conv_id
  UNION ALL SELECT f.conv_id, c.turn, CASE WHEN runnable AND cost <= left_ THEN left_ - cost ELSE left_ END, CASE WHEN NOT runnable THEN 'free' WHEN cost <= left_ THEN 'charged' ELSE 'rejected' END,
    CASE WHEN runnable AND cost <= left_ THEN CAST(cost AS BIGINT) ELSE 0 END FROM f JOIN c ON c.conv_id = f.conv_id AND c.turn = f.turn + 1)"""


@query("tool_cost", f"SELECT conv_id, turn, {TOOL} AS tool, CASE role WHEN 'assistant' THEN 5 ELSE 1 END AS cost FROM conversations")
def _(spark, sf):
    return calls(spark, sf).select("conv_id", F.col("pos").alias("turn"), "tool", "cost")


@query("budget_ledger", f"WITH {LEDGER} SELECT conv_id, turn AS pos, outcome, charged, left_ AS left FROM f WHERE outcome <> ''".replace("AS left ", 'AS "left" '))
def _(spark, sf):
    return ss.budget_ledger(calls(spark, sf), ["conv_id"], "pos", "cost", "runnable", "budget").select("conv_id", "pos", "outcome", "charged", "left")


@query("experiment_index", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS experiment_index FROM conversations WHERE role = 'user'")
def _(spark, sf):
    return ss.experiment_index(table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn"), ["conv_id"], "turn")


@query("submission_gate", """SELECT conv_id, turn, completed, greatest(0, 2 - completed) AS remaining, completed >= 2 AS accepted FROM (SELECT conv_id, turn, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS completed FROM conversations)""")
def _(spark, sf):
    return ss.submission_gate(table(spark, sf, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", F.col("role") == "user", 2).drop("role")


@query("turn_status", """SELECT conv_id, turn, 8 - turn AS turns_left, 8 - turn = 1 AS final_turn, '[Session status] Turns left: ' || (8 - turn) || '; Experiments left: ' || CASE WHEN conv_id % 4 = 0 THEN 'unlimited' ELSE CAST(greatest(conv_id % 9 - turn, 0) AS VARCHAR) END || '.'
 || CASE WHEN turn = 7 THEN ' This is the final turn; your answer to this message will be interpreted as the final theory.' ELSE '' END AS status FROM conversations""")
def _(spark, sf):
    left = F.when(F.col("conv_id") % 4 != 0, F.col("conv_id") % 9 - F.col("turn"))
    return ss.turn_status(table(spark, sf, "conversations").select("conv_id", "turn"), "turn", 8, left)


@query("first_seen_ids", "SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS sample_id, min(event_id) AS event_id FROM events GROUP BY ALL")
def _(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", F.get_json_object("props", "$.k").cast("long").alias("sample_id"))
    return ss.first_seen_ids(e, ["user_id"], ["event_id"], "sample_id")


@query("shared_samples_join", "SELECT user_id, k AS doc_id, event_id, quality AS label FROM (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) * 7 AS k, min(event_id) AS event_id FROM events GROUP BY ALL) JOIN labels ON doc_id = k")
def _(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", (F.get_json_object("props", "$.k").cast("long") * 7).alias("doc_id"))
    samples = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return ss.shared_samples(ss.first_seen_ids(e, ["user_id"], ["event_id"], "doc_id"), samples, "doc_id")


@query("fetch_sample_text", """SELECT event_id, CASE WHEN id < 0 THEN 'invalid' WHEN doc_id IS NULL THEN 'unknown' WHEN lang = 'en' THEN 'no_text' ELSE 'text' END AS status, CASE WHEN id < 0 THEN 'Invalid sample_id. Please provide a non-negative integer.'
 WHEN doc_id IS NULL THEN 'Unknown sample_id. Please choose an ID from the reference samples (0-' || ((SELECT count(*) FROM documents) - 1) || ').' WHEN lang = 'en' THEN 'No textual description is available for this sample. You may rely on the assignment/label information.' ELSE text END AS reply
FROM (SELECT event_id, CAST(floor(value * 20) AS BIGINT) - 40 AS id FROM events) LEFT JOIN documents ON doc_id = id""")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.floor(F.col("value") * 20) - 40).alias("doc_id"))
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("lang") != "en", F.col("text")).alias("text"))
    return ss.fetch_sample_text(e, d, "doc_id").drop("doc_id")


@query("tool_call_pairing", """WITH c AS (SELECT conv_id, turn + 1 AS call_id, 'tool_' || turn AS name FROM conversations WHERE role = 'user')
SELECT r.conv_id, r.turn AS call_id, name FROM (SELECT * FROM conversations WHERE role <> 'user') r JOIN c ON c.conv_id = r.conv_id AND c.call_id = r.turn""")
def _(spark, sf):
    asked, answers = tool_logs(spark, sf)
    return ss.tool_call_pairing(asked, answers, ["conv_id"], "call_id")


@query("unpaired_tool_responses", """SELECT r.conv_id, r.turn AS call_id, 'Could not find function name for tool_call_id ' || r.turn AS warning FROM conversations r
 WHERE role <> 'user' AND NOT EXISTS (SELECT 1 FROM conversations c WHERE c.role = 'user' AND c.conv_id = r.conv_id AND c.turn + 1 = r.turn)""")
def _(spark, sf):
    asked, answers = tool_logs(spark, sf)
    return ss.unpaired_responses(asked, answers, ["conv_id"], "call_id")


def tool_logs(spark, sf):
    c = table(spark, sf, "conversations")
    asked = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("call_id"), F.concat(F.lit("tool_"), F.col("turn").cast("string")).alias("name"), F.col("turn").alias("pos"))
    return asked, c.where("role <> 'user'").select("conv_id", F.col("turn").alias("call_id"))


@query("session_counts", "SELECT conv_id, least(3, count(*) FILTER (role = 'assistant')) AS num_turns, CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) % 3 END), 0) AS BIGINT) AS num_tool_calls FROM conversations GROUP BY conv_id")
def _(spark, sf):
    return ss.session_counts(table(spark, sf, "conversations"), ["conv_id"], "role", F.when(F.col("role") == "assistant", F.length("text") % 3), 3)


@query("session_termination", """WITH t AS (SELECT conv_id, turn, length(text) % 5 > 1 AS err, length(text) % 5 IN (0, 3) AS calls, length(text) % 2 = 0 AS sub FROM conversations),
n AS (SELECT *, err AND NOT calls AS e, sum(CASE WHEN err AND NOT calls THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS errs FROM t),
r AS (SELECT conv_id, turn, CASE WHEN e AND errs > 1 THEN 'llm_error' WHEN NOT calls AND NOT e THEN 'no_tool_calls' WHEN calls AND sub THEN 'theory_submitted' END AS reason FROM n WHERE turn < 5)
SELECT conv_id, coalesce(arg_min(reason, turn) FILTER (reason IS NOT NULL), 'max_turns_reached') AS reason, min(turn) FILTER (reason IS NOT NULL) AS end_turn FROM (SELECT * FROM r UNION ALL SELECT DISTINCT conv_id, NULL, NULL FROM conversations) GROUP BY conv_id""")
def _(spark, sf):
    n = F.length("text")
    t = table(spark, sf, "conversations").select("conv_id", "turn", (n % 5 > 1).alias("err"), (n % 5).isin(0, 3).alias("calls"), (n % 2 == 0).alias("sub"))
    return ss.session_termination(t, ["conv_id"], "turn", F.col("err"), F.col("calls"), F.col("sub"), 5, max_errors=1)


@query("experiment_total", "SELECT user_id, count(*) FILTER (event_type IN ('click', 'view')) AS experiments FROM events GROUP BY user_id HAVING experiments > 0")
def _(spark, sf):
    e = table(spark, sf, "events")
    one = lambda t: e.where(F.col("event_type") == t).groupBy("user_id").agg(F.count("*").alias("n"))
    return ss.experiment_totals([one("click"), one("view")], ["user_id"])


@query("theory_history", "SELECT conv_id, turn, text AS theory, regexp_extract(text, '[A-Za-z]+') AS code, conv_id % 11 / 10 AS accuracy, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS evaluation FROM conversations WHERE role IN ('assistant', 'system')")
def _(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.col("text").alias("theory"), F.regexp_extract("text", "[A-Za-z]+", 0).alias("code"), (F.col("conv_id") % 11 / 10).alias("accuracy"))
    return ss.theory_history([c.where("role = 'assistant'").drop("role"), c.where("role = 'system'").drop("role")], ["conv_id"], "turn")


# -- experiments -----------------------------------------------------------------------------------

_REQUEST = """CASE WHEN custkey % 13 = 0 THEN 'no json' WHEN custkey % 17 = 0 THEN '{"V0": 7}' WHEN custkey % 19 = 0 THEN '{"V1": 1, "V2": "x"}' ELSE '{"0": ' || V0 || ', "V1": ' || V1 || ', "V2": "' || V2 || '", "V3": ' || V3 || ', "V4": ' || V4 || ', "Z": 1}' END"""
_ASKED = SQL_ORDERS
_RUN = f"""WITH {_ASKED}, {sql_model(MODEL)}, {sql_scores(numeric=False)}, {sql_model(TONE, 't')}, {sql_scores('t', numeric=False)},
x AS (SELECT smp.sid, custkey, V0, V1, V2, V3, V4, lab.label AS lb, lab.score AS scr, labt.label AS tn, CASE WHEN custkey % 13 = 0 THEN 'assignment must be an object, got no json' WHEN custkey % 17 = 0 THEN 'Assignment value 7 out of range for V0'
 WHEN custkey % 19 = 0 THEN 'assignment value for V2 must be int-like' END AS message FROM smp JOIN lab USING (sid) JOIN labt USING (sid))"""


def requests(spark, sf):
    return order_samples(spark, sf).select("sid", "custkey", F.expr(_REQUEST).alias("request"))


def ran(spark, sf, **supports):
    """Experiments with the property "tone" under one or several names, each with its labels."""
    return ex.run_experiments(requests(spark, sf), MODEL, "request", F.create_map(F.lit(0), F.lit("Accept")),
                              {name: (TONE, labels) for name, labels in (supports or {"tone": TONE_LABELS}).items()})


@query("run_experiments", f"""{_RUN} SELECT sid, CASE WHEN message IS NULL THEN 'Success' ELSE 'Error' END AS status, message, CASE WHEN message IS NULL THEN lb END AS label, CASE WHEN message IS NULL THEN CASE lb WHEN 0 THEN 'Accept' ELSE 'Label ' || lb END END AS label_name,
 CASE WHEN message IS NULL THEN round(scr, 6) END AS score FROM x""")
def _(spark, sf):
    return ran(spark, sf).select("sid", "status", "message", "label", "label_name", r6("score").alias("score"))


@query("experiment_properties", f"{_RUN} SELECT sid, CASE WHEN message IS NULL AND lb IN (0, 2) THEN tn END AS gated, CASE WHEN message IS NULL THEN tn END AS open FROM x")
def _(spark, sf):
    return ran(spark, sf, gated=TONE_LABELS, open=[]).select("sid", "gated", "open")


@query("experiment_line", f"""{_RUN} SELECT sid, 'Labels: ' || CASE lb WHEN 0 THEN 'Accept' ELSE 'Label ' || lb END || CASE WHEN lb IN (0, 2) THEN ', tone=' || tn ELSE '' END || ' | V0=' || V0 || ', V1=' || V1 || ', V2=' || V2 || ', V3=' || V3 || ', V4=' || V4 || ', Z=1' AS line FROM x WHERE message IS NULL""")
def _(spark, sf):
    from ..functions.parsing import normalize_assignment
    r = ran(spark, sf).where("status = 'Success'")
    raw = tx.render_raw(normalize_assignment(F.col("request"))["assignment"])
    block = tx.label_block(F.col("label_name"), F.create_map(F.lit("tone"), F.col("tone")), tx.phrase_map({"tone": {99: "x"}}), False)
    return r.select("sid", tx.example_line(block, raw).alias("line"))


@query("experiment_history", f"""{_RUN} SELECT custkey, sid, row_number() OVER (PARTITION BY custkey ORDER BY sid) AS experiment_index, 'What about ' || sid || '?' AS query, CASE WHEN message IS NULL THEN 'Success' ELSE 'Error' END AS status, CASE WHEN message IS NULL THEN lb END AS label,
 CASE WHEN message IS NULL THEN CASE lb WHEN 0 THEN 'Accept' ELSE 'Label ' || lb END END AS label_name, CASE WHEN message IS NULL AND lb IN (0, 2) THEN tn END AS tone, {_REQUEST} AS input_values FROM x""")
def _(spark, sf):
    asked = F.concat(F.lit("What about "), F.col("sid").cast("string"), F.lit("?"))
    r = ran(spark, sf).select("custkey", "sid", asked.alias("query"), "status", "label", "label_name", "tone", F.col("request").alias("input_values"))
    return ss.experiment_index(r, ["custkey"], "sid")


# -- samples with properties, subsets, alignment --------------------------------------------------------

@query("build_property_udd", f"""WITH p AS (SELECT s_suppkey AS cand, list_filter([0, 1, 2], lambda l: {sql_u01(S, "'support'", 's_suppkey', 'l')} < 0.5) AS on_, CAST(floor({sql_u01(S, "'guard'", 's_suppkey')} * 3) AS INTEGER) AS guard FROM supplier)
SELECT cand, array_to_string(CASE WHEN len(on_) = 0 THEN [guard] ELSE on_ END, ',') AS support, round(list_sum(list_transform(range(18), lambda i: {sql_u01("'7-tone'", 'cand', "'s'", 'i')})), 6) AS scores FROM p""")
def _(spark, sf):
    from .sampling_queries import SHAPE
    ids = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("cand"))
    p = se.property_models(ids, SHAPE, 2, 3, SEED, "tone")
    return p.select("cand", F.array_join(F.col("support").cast("array<string>"), ",").alias("support"), r6(F.aggregate("s", F.lit(0.0), lambda a, x: a + x)).alias("scores"))


@query("label_and_build_dataset", f"""{with_scores()}, {sql_model(TONE, 't')}, {sql_scores('t')},
r AS (SELECT sid, label, score, row_number() OVER (PARTITION BY label ORDER BY {sql_key(S, 'sid')}) AS rank FROM lab), pool AS (SELECT label, count(*) AS n FROM lab GROUP BY label),
dr AS (SELECT draw, draw // 100 AS label, draw % 100 AS nth FROM range(300) t(draw)),
pk AS (SELECT draw, label, CASE WHEN nth < n THEN nth + 1 ELSE CAST(floor({sql_u01(S, "'again'", 'draw')} * n) AS BIGINT) + 1 END AS rank FROM dr JOIN pool USING (label))
SELECT row_number() OVER (ORDER BY {sql_key(f"'{SEED}-order'", 'draw')}) - 1 AS sample_idx, r.sid, r.label, round(r.score, 6) AS score, CASE WHEN r.label IN (0, 2) THEN labt.label END AS tone, n AS available
FROM pk JOIN r USING (label, rank) JOIN labt ON labt.sid = r.sid JOIN pool ON pool.label = r.label""")
def _(spark, sf):
    base = labelled(spark, sf)
    with_tone = pr.categorical_property(base, TONE, cats(), values(), "tone")
    pool = with_tone.select("sid", "label", "score", pr.gate(F.col("tone"), F.col("label"), F.array(*[F.lit(x) for x in TONE_LABELS])).alias("tone"))
    picked = sp.balanced_sample(pool, "label", MODEL.labels, 300, SEED, ["sid"])
    available = base.groupBy("label").agg(F.count("*").alias("available"))
    return picked.join(available, "label").select(F.col("position").alias("sample_idx"), "sid", "label", r6("score").alias("score"), "tone", "available")


@query("subset_dataset", f"""WITH c AS (SELECT least(least(count(*) FILTER (quality = 0), count(*) FILTER (quality = 1)), 20) AS cap FROM labels),
p AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY quality ORDER BY {sql_key(S, 'doc_id')}) AS r FROM labels), c WHERE r <= cap)
SELECT inst, doc_id, length(text) AS n, 40 AS requested FROM documents JOIN p USING (doc_id), (VALUES ('raw'), ('text')) i(inst)""")
def _(spark, sf):
    chosen = sp.subset_rows(table(spark, sf, "labels"), "quality", 40, SEED, ["doc_id"])
    d = table(spark, sf, "documents").select("doc_id", F.length("text").cast("long").alias("n"), F.explode(F.array(F.lit("raw"), F.lit("text"))).alias("inst"))
    return al.subset_dataset(chosen, d, "doc_id", {"requested": F.lit(40)}).select("inst", "doc_id", "n", "subset_info.requested")


@query("align_by_sample_id", """WITH w AS (SELECT o_custkey AS id, o_orderkey AS pos, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders), a AS (SELECT user_id AS id, event_id AS pos, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events)
SELECT w.id, w.pos, a.pos AS matched_pos, a.pos IS NULL AS missing FROM w LEFT JOIN a ON a.id = w.id AND a.nth = w.nth""")
def _(spark, sf):
    w = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("pos"))
    return al.align_by_sample_id(w, table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("pos")), "id", "pos")


@query("align_by_position", "SELECT doc_id, lang, length(text) AS n FROM documents")
def _(spark, sf):
    d = table(spark, sf, "documents")
    return al.align_by_position(d.select("doc_id", "lang"), d.select("doc_id", F.length("text").cast("long").alias("n")), "doc_id")


@query("validate_text_mapping", """WITH e AS (SELECT p_partkey, p_brand, p_type, unnest(range(p_size % 4 + 1))::INTEGER AS cat, p_size FROM part)
SELECT p_partkey, 'V0' AS var, cat, CASE WHEN cat = 0 THEN p_brand WHEN p_type = 'ECONOMY' THEN '' ELSE CASE WHEN p_size > 25 THEN p_type ELSE 'V0' END || ' category ' || cat END AS phrase, cat <> 0 AS filled FROM e""")
def _(spark, sf):
    p = table(spark, sf, "part")
    kind = F.when(F.col("p_type") == "ECONOMY", "numerical").otherwise("categorical")
    expected = p.select("p_partkey", F.lit("V0").alias("var"), F.explode(F.sequence(F.lit(0), F.col("p_size") % 4)).alias("cat"), kind.alias("kind"), F.when(F.col("p_size") > 25, F.col("p_type")).alias("role"))
    given = p.select("p_partkey", F.lit("V0").alias("var"), F.lit(0).alias("cat"), F.col("p_brand").alias("phrase"))
    return al.fill_phrases(expected, given, ["p_partkey"])


@query("validate_label_names", """SELECT p_partkey, i AS label, CASE WHEN i = 0 THEN p_brand ELSE 'Label ' || i END AS name, i <> 0 AS filled FROM (SELECT p_partkey, p_brand, unnest(range(p_size % 4 + 1))::INTEGER AS i FROM part)""")
def _(spark, sf):
    p = table(spark, sf, "part")
    given = p.select("p_partkey", F.lit(0).alias("label"), F.col("p_brand").alias("name"))
    return al.fill_label_names(p, F.col("p_size") % 4 + 1, given, ["p_partkey"])


def part_properties(spark, sf):
    """Property "tone" with labels, "mass" with a range for every second part."""
    p = table(spark, sf, "part")
    text, real = F.lit(None).cast("string"), F.lit(None).cast("double")
    even = F.col("p_partkey") % 2 == 0
    tone = F.struct(F.lit("tone").alias("property"), text.alias("type"), (F.col("p_size") % 3 + 1).alias("num_output_labels"), real.alias("min_value"), real.alias("max_value"), text.alias("unit"), text.alias("description"))
    mass = F.struct(F.lit("mass").alias("property"), F.lit("Numerical").alias("type"), F.lit(None).cast("int").alias("num_output_labels"), F.when(even, F.lit(1.0)).alias("min_value"),
                    F.when(even, F.col("p_retailprice")).alias("max_value"), F.when(even, "kg").alias("unit"), F.when(F.col("p_size") > 25, "load").alias("description"))
    return p, p.select("p_partkey", F.explode(F.array(tone, mass)).alias("x")).select("p_partkey", "x.*")


@query("validate_property_labels", """SELECT p_partkey, 'tone' AS property, i AS label, CASE WHEN i = 0 THEN p_brand ELSE 'tone label ' || i END AS text, i <> 0 AS filled FROM (SELECT p_partkey, p_brand, unnest(range(p_size % 3 + 1))::INTEGER AS i FROM part)""")
def _(spark, sf):
    p, expected = part_properties(spark, sf)
    given = p.select("p_partkey", F.lit("tone").alias("property"), F.lit(0).alias("label"), F.col("p_brand").alias("text"))
    return al.fill_property_labels(expected, given, ["p_partkey"])


@query("validate_property_ranges", """SELECT p_partkey, 'mass' AS property, CASE WHEN p_partkey % 5 = 0 THEN 2 WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END::DOUBLE AS low, CASE WHEN p_partkey % 5 = 0 THEN 9 WHEN p_partkey % 2 = 0 THEN p_retailprice ELSE 1 END::DOUBLE AS high,
 CASE WHEN p_partkey % 5 = 0 THEN 't' WHEN p_partkey % 2 = 0 THEN 'kg' END AS unit, CASE WHEN p_size > 25 THEN 'load' ELSE 'mass value' END AS description FROM part""")
def _(spark, sf):
    p, expected = part_properties(spark, sf)
    given = p.where("p_partkey % 5 = 0").select("p_partkey", F.lit("mass").alias("property"), F.lit(2.0).alias("low"), F.lit(9.0).alias("high"), F.lit("t").alias("range_unit"), F.lit(None).cast("string").alias("note"))
    return al.fill_property_ranges(expected, given, ["p_partkey"])


# -- density-scaled error ---------------------------------------------------------------------------------

_SIGMA = """WITH q AS (SELECT DISTINCT CAST(o_totalprice AS DOUBLE) / 400 AS x FROM orders), t AS (SELECT list(CAST(p_retailprice AS DOUBLE)) AS vs FROM part),
g AS (SELECT x, list_avg(list_sort(list_transform(vs, lambda v: abs(v - x)))[1:5]) AS sigma FROM q, t)"""


def lsee_rows(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice").cast("double") / 400).alias("truth"))
    return o.withColumn("guess", F.col("truth") + F.col("o_orderkey") % 7 * 0.01)


@query("knn_1d_join", f"{_SIGMA} SELECT x, round(sigma, 6) AS sigma FROM g")
def _(spark, sf):
    s = ls.knn_scale(table(spark, sf, "part"), "p_retailprice", lsee_rows(spark, sf), "truth", 5)
    return s.select("x", r6("sigma").alias("sigma"))


@query("lsee_score", f"{_SIGMA} SELECT o_orderkey, round(1 - exp(-(abs(x - (x + o_orderkey % 7 * 0.01::DOUBLE)) * 3) / greatest(sigma, 1e-6)), 6) AS lsee FROM orders JOIN g ON g.x = CAST(o_totalprice AS DOUBLE) / 400")
def _(spark, sf):
    return ls.lsee_score(table(spark, sf, "part"), "p_retailprice", lsee_rows(spark, sf), "truth", "guess").select("o_orderkey", r6("lsee").alias("lsee"))


# -- trees ----------------------------------------------------------------------------------------------------

@query("feature_matrix", "SELECT event_id, user_id::DOUBLE AS x2, CASE WHEN event_type = 'click' THEN value ELSE 0 END AS x10, event_type AS label FROM events")
def _(spark, sf):
    m = F.create_map(F.lit("10"), F.when(F.col("event_type") == "click", F.col("value")), F.lit("2"), F.col("user_id").cast("double"), F.lit("score"), F.lit(1.0))
    e = table(spark, sf, "events").select("event_id", "event_type", m.alias("m"))
    keys = e.orderBy("event_id").select(tr.digit_keys(F.col("m")).alias("k")).first()["k"]  # those of the first sample
    v = tr.feature_vector(F.col("m"), keys)
    return e.select("event_id", *[v[i].alias(f"x{k}") for i, k in enumerate(keys)], F.col("event_type").alias("label"))


def fitted_tree(spark, sf):
    df = stored(labelled(spark, sf).select("sid", *[F.col(v).cast("double").alias(v) for v in VARS], "label"), "tree")  # read on every pass
    return tr.derive_tree(df, VARS, "label")


@query("derive_tree", f"""{with_scores()}, n AS (SELECT label, count(*) AS n FROM lab GROUP BY label)
SELECT CAST(sum(n) AS BIGINT) AS sample_count, string_agg(CAST(label AS VARCHAR), ',' ORDER BY label) AS classes, TRUE AS shallow, TRUE AS beats_majority FROM n""")
def _(spark, sf):
    tree, out, classes = fitted_tree(spark, sf)
    majority = out.groupBy("label").agg(F.count("*").alias("n")).agg((F.max("n") / F.sum("n")).alias("share"))
    got = tr.training_accuracy(out, "label").withColumn("share", majority.select("share").scalar())
    return got.select("sample_count", F.lit(",".join(classes)).alias("classes"), F.lit(tree.depth <= 3).alias("shallow"), (F.col("accuracy") >= F.col("share")).alias("beats_majority"))


@query("tree_to_rules", f"""{with_scores()} SELECT count(*) AS "rows", TRUE AS one_leaf, TRUE AS same_class, TRUE AS few_leaves FROM lab""")
def _(spark, sf):
    tree, out, classes = fitted_tree(spark, sf)
    rules = tr.tree_rules(tree, VARS, classes)
    return tr.rule_check(out, rules).withColumn("few_leaves", F.lit(len(rules) <= 8))


@query("tree_text")
def _(spark, sf):
    tree, out, classes = fitted_tree(spark, sf)
    return out.agg(F.count("*").alias("sample_count")).withColumn("text", F.lit(tr.tree_to_text(tree, VARS, classes)))


# -- deliveries and streams -------------------------------------------------------------------------------------

_KIND = "CASE event_type WHEN 'click' THEN 'connect' WHEN 'error' THEN 'disconnect' WHEN 'signup' THEN 'turn' ELSE 'message' END"
DELIVERY = f"""e AS (SELECT user_id, event_id AS pos, {_KIND} AS kind FROM events),
a AS (SELECT *, count(*) FILTER (kind = 'turn') OVER w AS turns, max(CASE WHEN kind IN ('connect', 'disconnect') THEN pos END) OVER p AS seg FROM e WINDOW w AS (PARTITION BY user_id ORDER BY pos), p AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT a.*, coalesce(s.kind = 'disconnect', FALSE) AS off, a.turns - s.turns AS used FROM a LEFT JOIN a s ON s.user_id = a.user_id AND s.pos = a.seg),
c AS (SELECT *, min(CASE WHEN kind = 'connect' THEN pos END) OVER f AS conn, min(CASE WHEN kind = 'turn' AND off AND used = 2 THEN pos END) OVER f AS clr FROM b WINDOW f AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
d AS (SELECT *, kind = 'message' AND off AND used < 2 AND conn IS NOT NULL AND (clr IS NULL OR clr > conn) AS kept FROM c),
dv AS (SELECT user_id, pos, CASE WHEN kind = 'message' THEN CASE WHEN NOT off THEN 'delivered' WHEN kept THEN 'held' ELSE 'dropped' END WHEN kind = 'connect' AND off THEN 'notice' ELSE 'none' END AS outcome,
 CASE WHEN kind = 'message' AND NOT off OR kind = 'connect' AND off THEN pos WHEN kept THEN conn END AS delivered_at FROM d)"""


FILES_PER_TRIGGER = 1000
ANY_ORDER = 1 << 40  # positions that a row may come too late: files of a table have no order


def connection_log(df):
    return df.select("user_id", F.col("event_id").alias("pos"), F.expr(_KIND).alias("kind"))


@query("status_delivery", f"WITH {DELIVERY} SELECT user_id, pos, outcome, delivered_at FROM dv")
def _(spark, sf):
    return ss.status_delivery(connection_log(table(spark, sf, "events")), ["user_id"], "pos", "kind", 2, rows=500).drop("kind")


def stream_of(spark, sf, name):
    """The table, a file or a folder of files, as a stream (a pattern, as a stream's plain path must
    be a folder)."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_TRIGGER).parquet(f"{sf}/{name}.parque[t]")


@query("stream_status_delivery", f"WITH {DELIVERY} SELECT user_id, pos, outcome, delivered_at FROM dv WHERE delivered_at IS NOT NULL")
def _(spark, sf):
    path = fresh_path(spark, "delivery")
    log = connection_log(stream_of(spark, sf, "events"))
    sent = st.delivery_stream(st.ending(log, f"{path}/end"), "user_id", 2, disorder=ANY_ORDER)
    st.run_to_table(sent, path)
    st.close_log(spark, log.schema, f"{path}/end")
    st.run_to_table(sent, path)
    return spark.read.parquet(f"{path}/data")


@query("stream_budget_ledger", f"WITH {LEDGER} SELECT conv_id, turn AS pos, outcome, charged, left_ AS left FROM f WHERE outcome <> ''".replace("AS left ", 'AS "left" '))
def _(spark, sf):
    path = fresh_path(spark, "ledger")
    c = stream_of(spark, sf, "conversations")
    rows = c.select("conv_id", F.col("turn").alias("pos"), ss.tool_cost(F.expr(TOOL)).alias("cost"),
                    ((F.col("role") != "system") & (F.length("text") % 13 != 0)).alias("runnable"), (F.col("conv_id") % 9).alias("budget"))
    st.run_to_table(st.budget_stream(rows, "conv_id", "budget", first=0), path)
    return spark.read.parquet(f"{path}/data")


_DAYS = """smp0 AS (SELECT o_orderkey AS sid, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS V0, CAST(o_custkey % 2 AS INTEGER) AS V1, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS V2 FROM orders),
smp AS (SELECT *, NULL::INTEGER AS V3, NULL::INTEGER AS V4, NULL::DOUBLE AS x3, NULL::DOUBLE AS x4 FROM smp0)"""


@query("stream_score", f"WITH {_DAYS}, {sql_model(MODEL)}, {sql_scores()} SELECT sid, label, round(score, 6) AS score FROM lab")
def _(spark, sf):
    path = fresh_path(spark, "scores")
    o = stream_of(spark, sf, "orders")
    rows = o.select(F.col("o_orderkey").alias("sid"), F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("V0"),
                    (F.col("o_custkey") % 2).cast("int").alias("V1"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("V2"))
    scored = st.score_stream(rows, MODEL, {v: F.col(v) for v in ("V0", "V1", "V2")})
    st.run_to_table(scored.select("sid", "label", r6("score").alias("score")), path)
    return spark.read.parquet(f"{path}/data")
