"""Catalogue readers, sinks and set-up joins over files derived from the tables.

Every customer is a dataset folder; orders, events and suppliers give its files.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import configs as cf
from ..operators import reports as rp
from ..sources import catalog as ct
from ..sources import sinks as sk
from ..sources.storage import fresh_path
from .bridge import table
from .registry import query
from .sampling_queries import POP, candidates, r6

ROOT = "'/data/n' || c_nationkey || '/c' || c_custkey"


def roots(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", "c_acctbal", F.concat(F.lit("/data/n"), "c_nationkey", F.lit("/c"), "c_custkey").alias("root"))


def dataset_files(spark, sf):
    """(path) of every dataset: a model file, for some a nested copy and an instance."""
    r = roots(spark, sf)
    names = F.array_compact(F.array(F.lit("UDD.json"), F.when(F.col("c_acctbal") < 0, "old/UDD.json"), F.lit("instances/raw/a.json"),
                                    F.when(F.col("c_acctbal") > 5000, "evaluation_results/m/STATIC/raw/a/r1.json"), F.lit("notes.txt")))
    return r.select("root", F.explode(names).alias("name")).select(F.concat("root", F.lit("/"), "name").alias("path"))


@query("dataset_root_discovery", f"SELECT {ROOT} AS root FROM customer")
def _(spark, sf):
    return ct.dataset_roots(dataset_files(spark, sf))


@query("resolve_paths", f"""SELECT {ROOT} AS root, min(o_orderkey) AS first_pos FROM customer JOIN (SELECT *, CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END AS exact FROM orders)
  ON (exact = 1 AND o_custkey = c_custkey) OR (exact = 0 AND c_nationkey = o_custkey % 20) GROUP BY ALL""")
def _(spark, sf):
    r = roots(spark, sf)
    o = table(spark, sf, "orders")
    exact = o.where("o_orderpriority <> '1-URGENT'").join(r, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("pos"), F.col("root").alias("path"))
    wide = o.where("o_orderpriority = '1-URGENT'").select(
        F.col("o_orderkey").alias("pos"), F.concat(F.lit("/data/n"), (F.col("o_custkey") % 20).cast("string")).alias("path"))
    return ct.resolve_paths(exact.unionByName(wide), r.select("root"))


@query("load_all_datasets", f"""SELECT root AS dataset_id, kind, count(*) AS files FROM (SELECT {ROOT} AS root, unnest(CASE WHEN c_acctbal < 0 THEN ['model', 'model', 'instance'] WHEN c_acctbal > 5000 THEN ['model', 'instance', 'run'] ELSE ['model', 'instance'] END) AS kind FROM customer) GROUP BY ALL""")
def _(spark, sf):
    files = dataset_files(spark, sf).withColumn("content", F.lit("{}"))
    return ct.load_all(files).groupBy("dataset_id", "kind").agg(F.count("*").alias("files"))


# -- models of the supplier candidates, written to JSON text and read back -------------------------

def model_tables(spark, sf):
    c = candidates(spark, sf)
    var = F.array(*[F.struct(F.lit(v).alias("var"), F.lit(n).alias("categories"), F.lit(k).alias("kind"), F.lit(o).alias("o")) for v, n, k, o in (
        ("V0", 3, "categorical", 0), ("V1", 2, "categorical", 3), ("V2", 4, "numerical", 5))])
    heads = c.select(F.col("cand").alias("dataset_id"), F.lit(2).alias("labels"), F.explode(var).alias("v")).select("dataset_id", "labels", "v.var", "v.categories", "v.kind")
    grid = c.select("cand", "w", "s", "falling", F.explode(var).alias("v")).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("label"))
    at = F.col("label") * 9 + F.col("v.o")
    cells = grid.where("v.kind = 'categorical'").select("*", F.explode(F.sequence(F.lit(0), F.col("v.categories") - 1)).alias("cat"))
    categories = cells.select(F.col("cand").alias("dataset_id"), "v.var", "label", "cat", F.get("w", at + F.col("cat")).alias("weight"), F.get("s", at + F.col("cat")).alias("score"))
    numeric = grid.where("v.kind = 'numerical'").select(
        F.col("cand").alias("dataset_id"), "v.var", "label", F.get("w", at).alias("low"), F.get("w", at + 1).alias("high"),
        (~F.get("falling", F.col("label") * 3 + 2)).alias("rising"), F.get("s", at).alias("score"))
    spans = c.select(F.col("cand").alias("dataset_id"), F.lit("V2").alias("var"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("idx")).select(
        "dataset_id", "var", "idx", (F.col("idx") / 4).alias("lo"), ((F.col("idx") + 1) / 4).alias("hi"), (F.col("idx") == 3).alias("is_last"))
    rules = c.select(F.col("cand").alias("dataset_id"), F.explode(F.array(
        F.struct(F.lit(0).alias("ord"), F.lit("R_0").alias("name"), F.lit("V0").alias("var_a"), F.col("ra")[0].alias("val_a"), F.lit("V1").alias("var_b"), F.lit(0).alias("val_b"), F.col("rw")[0].alias("weight"), F.col("rs")[0].alias("score")),
        F.struct(F.lit(1).alias("ord"), F.lit("R_1").alias("name"), F.lit("V1").alias("var_a"), F.col("ra")[1].alias("val_a"), F.lit("V2").alias("var_b"), F.lit(3).alias("val_b"), F.col("rw")[1].alias("weight"), F.col("rs")[1].alias("score")))).alias("r")).select("dataset_id", "r.*")
    return {"models": heads, "categories": categories, "numeric": numeric, "spans": spans, "rules": rules}


@query("write_udd", f"""WITH {POP} SELECT cand AS dataset_id, 2 AS labels, round(w[2], 6) AS w_v0_l0_c1, round(s[14], 6) AS s_v1_l1_c1, round(w[7], 6) AS high_v2_l0, NOT falling[6] AS rising_v2_l1, round(rw[2], 6) AS rule_1 FROM pop""")
def _(spark, sf):
    j = sk.model_json(model_tables(spark, sf))
    g = lambda p, t="double": F.get_json_object("content", p).cast(t)
    return j.select("dataset_id", g("$.num_output_labels", "int").alias("labels"), r6(g("$.variables.V0.weights.0.1")).alias("w_v0_l0_c1"),
                    r6(g("$.variables.V1.scores.1.1")).alias("s_v1_l1_c1"), r6(g("$.variables.V2.max_weight.0")).alias("high_v2_l0"),
                    g("$.variables.V2.direction.1", "boolean").alias("rising_v2_l1"), r6(g("$.rules[1].weight")).alias("rule_1"))


@query("read_udd", f"""WITH {POP}, g AS (SELECT cand, w, s, falling, unnest([0, 1]) AS label FROM pop)
SELECT cand AS dataset_id, 'V0' AS var, label, c AS cat, round(w[label * 9 + c + 1], 6) AS a, round(s[label * 9 + c + 1], 6) AS b FROM (SELECT *, unnest([0, 1, 2]) AS c FROM g)
UNION ALL SELECT cand, 'V1', label, c, round(w[label * 9 + 4 + c], 6), round(s[label * 9 + 4 + c], 6) FROM (SELECT *, unnest([0, 1]) AS c FROM g)
UNION ALL SELECT cand, 'V2', label, -1, round(w[label * 9 + 6], 6), round(w[label * 9 + 7], 6) FROM g
UNION ALL SELECT cand, 'V2', -1, i, round(i / 4, 6), round((i + 1) / 4, 6) FROM (SELECT cand, unnest([0, 1, 2, 3]) AS i FROM pop)
UNION ALL SELECT cand, 'R_' || i, i, ra[i + 1], round(rw[i + 1], 6), round(rs[i + 1], 6) FROM (SELECT *, unnest([0, 1]) AS i FROM pop)""")
def _(spark, sf):
    t = ct.read_models(sk.model_json(model_tables(spark, sf)))
    rows = [t["categories"].select("dataset_id", "var", "label", "cat", F.col("weight").alias("a"), F.col("score").alias("b")),
            t["numeric"].select("dataset_id", "var", "label", F.lit(-1).alias("cat"), F.col("low").alias("a"), F.col("high").alias("b")),
            t["spans"].select("dataset_id", "var", F.lit(-1).alias("label"), F.col("idx").alias("cat"), F.col("lo").alias("a"), F.col("hi").alias("b")),
            t["rules"].select("dataset_id", F.col("name").alias("var"), F.col("ord").alias("label"), F.col("val_a").alias("cat"), F.col("weight").alias("a"), F.col("score").alias("b"))]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.withColumns({"a": r6("a"), "b": r6("b")})


# -- samples and instances: one small file per order ------------------------------------------------

def sample_docs(spark, sf):
    o = table(spark, sf, "orders")
    a = F.to_json(F.struct(F.create_map(F.lit("V0"), (F.col("o_custkey") % 3).cast("int")).alias("assignment"), F.round(F.col("o_totalprice") / 1000000, 6).alias("score"),
                           (F.col("o_custkey") % 2).cast("int").alias("label"), F.col("o_orderpriority").alias("instance_text"),
                           F.create_map(F.lit("V3"), F.lit(0.25)).alias("numerical_values")))
    b = F.to_json(F.struct(F.col("o_orderstatus").alias("note")))
    return o.select(F.col("o_orderkey").alias("dataset_id"), "o_custkey", "o_orderstatus", F.concat(F.lit("["), a, F.lit(", "), b, F.lit("]")).alias("content"), a.alias("sample"))


@query("read_raw_samples", """SELECT o_orderkey AS dataset_id, 0 AS sample_idx, CAST(o_custkey % 3 AS INTEGER) AS v0, round(o_totalprice / 1000000, 6) AS score, CAST(o_custkey % 2 AS INTEGER) AS label, o_orderpriority AS text, 0.25::DOUBLE AS v3, NULL AS opaque FROM orders
UNION ALL SELECT o_orderkey, 1, NULL, 0, 0, NULL, NULL, '{"note":"' || o_orderstatus || '"}' FROM orders""")
def _(spark, sf):
    s = ct.read_raw_samples(sample_docs(spark, sf))
    return s.select("dataset_id", "sample_idx", F.try_element_at("assignment", F.lit("V0")).alias("v0"), "score", "label", F.col("instance_text").alias("text"),
                    F.try_element_at("numerical_values", F.lit("V3")).alias("v3"), "opaque")


@query("normalize_samples", "SELECT 'V0=' || o_custkey % 3 AS assignment, CAST(o_custkey % 2 AS INTEGER) AS label, round(o_totalprice / 1000000, 6) AS score, TRUE AS no_type FROM orders")
def _(spark, sf):
    s = ct.read_raw_samples(sample_docs(spark, sf)).where("opaque IS NULL").select("assignment", "score", "label", "instance_text")
    n = ct.normalize_samples(s)
    return n.select(F.concat(F.lit("V0="), F.col("assignment")["V0"].cast("string")).alias("assignment"), "label", "score", F.col("instance_type").isNull().alias("no_type"))


@query("variable_order", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'V0,V1' ELSE 'a,b,c' END AS names FROM part")
def _(spark, sf):
    own = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("V1"), F.lit("V0"))).otherwise(F.expr("CAST(array() AS ARRAY<STRING>)"))
    first = F.create_map(F.lit("c"), F.lit(1), F.lit("a"), F.lit(2), F.lit("b"), F.lit(0))
    return table(spark, sf, "part").select("p_partkey", F.array_join(ct.variable_order(own, first), ",").alias("names"))


_INST = "CASE WHEN o_orderstatus = 'F' THEN '/data/o' || o_orderkey || '/instances/raw/in_' || o_custkey || '.json' WHEN o_orderstatus = 'O' THEN '/data/o' || o_orderkey || '/instances/files/b.json' ELSE '/data/o' || o_orderkey || '/instances/old.json' END"


def instance_files(spark, sf):
    d = sample_docs(spark, sf)
    path = F.concat(F.lit("/data/o"), "dataset_id", F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("/instances/raw/in_"), F.col("o_custkey").cast("string"), F.lit(".json")))
                    .when(F.col("o_orderstatus") == "O", "/instances/files/b.json").otherwise("/instances/old.json"))
    head = F.when(F.col("o_orderstatus") == "F", '{"version": 1, "name": "ignored", "instance_hint_used": "h"').when(
        F.col("o_orderstatus") == "O", '{"version": 3, "name": "Named", "textualization_level": "free_text", "instance_hint_used": "h", "rendered_documents": [{"path": "d.pdf"}, {"path": "e.pdf"}]'
    ).otherwise('{"version": 2, "name": "Older"')
    content = F.concat(head, F.lit(', "udd": {"rules": []}, "dataset": ['), "sample", F.lit("]}"))
    return d.select("dataset_id", path.alias("path"), content.alias("content"))


@query("read_instances", """SELECT o_orderkey AS dataset_id, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 3 ELSE 2 END AS version, CASE o_orderstatus WHEN 'F' THEN 'in_' || o_custkey WHEN 'O' THEN 'Named' ELSE 'Older' END AS name,
 CASE o_orderstatus WHEN 'F' THEN 'raw' WHEN 'O' THEN 'free_text' ELSE 'unknown' END AS level, CASE WHEN o_orderstatus = 'O' THEN 'h' END AS hint, CAST(o_custkey % 3 AS INTEGER) AS v0, CASE WHEN o_orderstatus = 'O' THEN 2 ELSE 0 END AS documents FROM orders""")
def _(spark, sf):
    i = ct.read_instances(instance_files(spark, sf)).withColumn("documents", F.coalesce(F.size("rendered_documents"), F.lit(0)))
    i = i.withColumn("documents", F.greatest("documents", F.lit(0)))
    return ct.instance_samples(i, ["dataset_id", "version", "name", "level", "hint", "documents"]).select(
        "dataset_id", "version", "name", "level", "hint", F.col("assignment")["V0"].alias("v0"), "documents")


@query("distinct_instance_names", "SELECT DISTINCT CASE o_orderstatus WHEN 'F' THEN 'in_' || o_custkey WHEN 'O' THEN 'Named' ELSE 'Older' END AS name FROM orders")
def _(spark, sf):
    return ct.distinct_instance_names(ct.read_instances(instance_files(spark, sf)), [])


@query("files_alias_union", """SELECT o_orderkey AS dataset_id, name, level, documents FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'in_' || o_custkey WHEN 'O' THEN 'Named' ELSE 'Older' END AS name,
 unnest(CASE o_orderstatus WHEN 'F' THEN ['raw'] WHEN 'O' THEN ['free_text', 'files'] ELSE ['unknown'] END) AS level, CASE WHEN o_orderstatus = 'O' THEN 2 ELSE 0 END AS documents FROM orders)""")
def _(spark, sf):
    i = ct.read_instances(instance_files(spark, sf)).select("dataset_id", "name", "level", F.greatest(F.coalesce(F.size("rendered_documents"), F.lit(0)), F.lit(0)).alias("documents"))
    return ct.files_alias_union(i)


def metadata_docs(spark, sf):
    """Metadata of every part: label counts, rendered documents for some."""
    p = table(spark, sf, "part")
    docs = F.concat(F.lit('{"raw": {"A": [{"path": "r/'), F.col("p_partkey").cast("string"), F.lit('.pdf", "mode": "PDF"}, {"path": ""}, {"path": "/abs/x.xlsx"}], "B": [{"path": "b.pdf"}]}}'))
    content = F.concat(F.lit('{"analysis": {"total_combinations": '), F.col("p_size").cast("string"), F.lit(', "label_counts": {"0": '), (F.col("p_size") - 1).cast("string"),
                       F.lit(', "1": 1}}, "num_output_labels": 2, "main_name": "'), F.col("p_brand"), F.lit('", "rendered_instances": '),
                       F.when(F.col("p_size") % 2 == 0, docs).otherwise(F.lit("{}")), F.lit("}"))
    return p.select(F.concat(F.lit("/data/p"), F.col("p_partkey").cast("string")).alias("dataset_id"), "p_size", content.alias("content"))


@query("read_metadata_stats", """SELECT '/data/p' || p_partkey AS dataset_id, p_brand AS main_name, CAST(p_size AS BIGINT) AS total, CAST(p_size - 1 AS BIGINT) AS n0, 2 AS labels, 25 AS iterations, p_size - 1 AS per_label_0, 0 AS per_label_9 FROM part""")
def _(spark, sf):
    d = metadata_docs(spark, sf)
    m = ct.read_metadata(d).select("dataset_id", "main_name", F.col("analysis.total_combinations").alias("total"), F.col("analysis.label_counts")["0"].alias("n0"), F.col("num_output_labels").alias("labels"))
    stats = d.select("dataset_id", F.concat(F.lit('{"udd_search_iterations": 25, "samples_per_label": {"0": '), (F.col("p_size") - 1).cast("string"), F.lit("}}")).alias("content"))
    s = ct.read_statistics(stats).select("dataset_id", F.col("udd_search_iterations").alias("iterations"), F.try_element_at("samples_per_label", F.lit(0)).alias("per_label_0"),
                                         F.coalesce(F.try_element_at("total_samples_per_label", F.lit(9)), F.lit(0)).alias("per_label_9"))
    return m.join(s, "dataset_id")


@query("read_rendered_documents", """SELECT '/data/p' || p_partkey AS dataset_id, 'raw' AS level, 'A' AS name, pos, CASE pos WHEN 0 THEN '/data/p' || p_partkey || '/r/' || p_partkey || '.pdf' ELSE '/abs/x.xlsx' END AS absolute_path, CASE pos WHEN 0 THEN 'PDF' ELSE 'XLSX' END AS mode
FROM (SELECT p_partkey, unnest([0, 2]) AS pos FROM part WHERE p_size % 2 = 0)""")
def _(spark, sf):
    from ..functions.text import render_mode
    m = ct.read_metadata(metadata_docs(spark, sf))
    have = m.select("dataset_id", F.lit("raw").alias("level"), F.lit("A").alias("name"))
    d = ct.read_rendered_documents(m, have)
    return d.select("dataset_id", "level", "name", "pos", "absolute_path", render_mode(F.col("mode"), F.col("path")).alias("mode"))


def theory_docs(spark, sf):
    e = table(spark, sf, "events")
    full = F.concat(F.lit('{"accuracy": 0.5, "llm": "m", "textual_llm_theory": "t'), F.col("user_id").cast("string"), F.lit('", "textual_dt_theory": "d", "textualized_versions": {"raw": "x"}}'))
    content = F.when(F.col("event_type") == "error", '{"accuracy": 0.1, "llm": "m"}').when(F.col("event_type") == "view", "not json").otherwise(full)
    return e.select(F.col("user_id").alias("dataset_id"), F.concat(F.lit("/d/noise_theories/a b "), F.col("event_id").cast("string"), F.lit(".json")).alias("path"), content.alias("content"))


@query("read_noise_theories", """SELECT user_id AS dataset_id, 'a_b_' || event_id AS name, CASE event_type WHEN 'error' THEN 'textual_dt_theory,textual_llm_theory' WHEN 'view' THEN 'accuracy,llm,textual_dt_theory,textual_llm_theory' ELSE '' END AS missing,
 CASE event_type WHEN 'error' THEN 0.1 WHEN 'view' THEN NULL ELSE 0.5 END::DOUBLE AS accuracy, CASE WHEN event_type NOT IN ('error', 'view') THEN 't' || user_id END AS theory FROM events""")
def _(spark, sf):
    t = ct.read_noise_theories(theory_docs(spark, sf))
    return t.select("dataset_id", "name", F.array_join("missing", ",").alias("missing"), "accuracy", F.col("textual_llm_theory").alias("theory"))


@query("write_noise_theories", "SELECT user_id AS dataset_id, count(*) AS theories, CAST(count(*) FILTER (event_id % 3 = 0) AS BIGINT) AS replaced FROM events WHERE event_type NOT IN ('error', 'view') GROUP BY 1")
def _(spark, sf):
    path = fresh_path(spark, "theories")
    t = ct.read_noise_theories(theory_docs(spark, sf))
    sk.write_theories(t, path)
    again = t.where(F.regexp_extract("name", "([0-9]+)$", 1).cast("long") % 3 == 0).withColumn("accuracy", F.lit(0.9))
    sk.write_theories(again, path)  # some theories come once more, under their old names
    return spark.read.parquet(path).groupBy(F.col("dataset_id").cast("long").alias("dataset_id")).agg(
        F.count("*").alias("theories"), F.count_if(F.col("accuracy") == 0.9).alias("replaced"))


def property_docs(spark, sf):
    s = table(spark, sf, "supplier")
    n = F.col("s_nationkey").cast("string")
    file = F.concat(F.lit('{"tone": {"type": "categorical", "num_output_labels": '), n, F.lit(', "available_for_labels": [0, 2]}, "mass": {"type": "numerical", "min_value": 1}}'))
    meta = F.concat(F.lit('{"tone": {"num_output_labels": 99, "description": "d'), n, F.lit('"}, "mass": {"max_value": 5, "unit": "kg"}, "only": {"num_categories": 3}}'))
    return s.select(F.col("s_suppkey").alias("dataset_id"), file.alias("file"), meta.alias("meta"))


@query("read_output_properties", """SELECT s_suppkey AS dataset_id, p AS property, CASE p WHEN 'tone' THEN 'categorical' WHEN 'mass' THEN 'numerical' END AS type, CASE WHEN p = 'tone' THEN s_nationkey END AS num_output_labels, CASE WHEN p = 'mass' THEN 1 END::DOUBLE AS min_value,
 CASE WHEN p = 'mass' THEN 5 END::DOUBLE AS max_value, CASE WHEN p = 'mass' THEN 'kg' END AS unit, CASE WHEN p = 'tone' THEN 'd' || s_nationkey END AS description, CASE p WHEN 'tone' THEN '0,2' WHEN 'mass' THEN '' END AS support
FROM (SELECT *, unnest(['tone', 'mass', 'only']) AS p FROM supplier)""")
def _(spark, sf):
    d = property_docs(spark, sf)
    m = ct.merge_properties(ct.property_rows(d.select("dataset_id", F.col("file").alias("content"))), ct.property_rows(d.select("dataset_id", F.col("meta").alias("content"))))
    return m.withColumn("support", F.array_join(F.col("support").cast("array<string>"), ","))


@query("property_metadata_merge", """SELECT s_suppkey AS dataset_id, p AS property, 'categorical' AS type, CASE p WHEN 'tone' THEN 99 WHEN 'only' THEN 3 WHEN 'mass' THEN 4 ELSE 7 END AS num_output_labels FROM (SELECT *, unnest(['tone', 'mass', 'only', 'extra']) AS p FROM supplier)""")
def _(spark, sf):
    d = property_docs(spark, sf)
    meta = ct.property_rows(d.select("dataset_id", F.col("meta").alias("content")))
    models = d.select("dataset_id", F.explode(F.expr("map('mass', 4, 'extra', 7, 'tone', 1)")).alias("property", "labels"))
    return ct.property_metadata_merge(meta, models).select("dataset_id", "property", "type", "num_output_labels")


RUNS = """rn AS (SELECT event_id, user_id, 'run' || event_id AS run_id, CASE WHEN event_type = 'click' THEN 'm_named' ELSE 'm' || user_id % 3 END AS model, CASE WHEN value > 30 THEN 'STATIC' ELSE 'SYMBOLIC_REGRESSION' END AS mode,
 CASE WHEN event_type = 'signup' THEN 'free_text' WHEN event_type = 'purchase' THEN 'unknown' ELSE 'raw' END AS level, 'inst' || user_id % 7 AS instance FROM events WHERE event_type <> 'error' AND NOT (event_type = 'view' AND value < 5))"""


def run_files(spark, sf):
    e = table(spark, sf, "events")
    mode = F.when(F.col("event_type") == "error", "bogus").when(F.col("value") > 30, "STATIC").otherwise("SYMBOLIC_REGRESSION")
    level = F.when(F.col("event_type") == "purchase", "odd level").otherwise("raw")
    path = F.concat_ws("/", F.lit("/d/evaluation_results"), F.concat(F.lit("m"), F.col("user_id") % 3), mode, level, F.concat(F.lit("inst"), F.col("user_id") % 7), F.concat(F.lit("run"), "event_id", F.lit(".json")))
    content = (F.when((F.col("event_type") == "view") & (F.col("value") < 5), "broken {")
               .when(F.col("event_type") == "click", F.concat(F.lit('{"model_name": "m_named", "created_at": "'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('Z"}')))
               .when(F.col("event_type") == "signup", '{"representation_level": "FREE_TEXT"}').otherwise("{}"))
    return e.select(F.col("user_id").alias("dataset_id"), path.alias("path"), content.alias("content"))


@query("read_eval_runs", f"WITH {RUNS} SELECT user_id AS dataset_id, run_id, model, mode, level, instance, model = 'm_named' AS dated FROM rn")
def _(spark, sf):
    return ct.read_eval_runs(run_files(spark, sf)).select("dataset_id", "run_id", "model", "mode", "level", "instance", F.col("created_at").isNotNull().alias("dated"))


@query("append_eval_runs", f"WITH {RUNS} SELECT model, mode, level, count(*) AS runs FROM rn GROUP BY ALL")
def _(spark, sf):
    path = fresh_path(spark, "runs")
    runs = ct.read_eval_runs(run_files(spark, sf)).select("run_id", "dataset_id", "model", "mode", "level", "instance")
    sk.append_runs(spark, runs, path)
    sk.append_runs(spark, runs, path)  # the second append finds every id stored
    return spark.read.parquet(path).groupBy("model", "mode", "level").agg(F.count("*").alias("runs"))


@query("ingest_eval_runs", f"WITH {RUNS} SELECT model, mode, level, count(*) AS runs FROM rn GROUP BY ALL")
def _(spark, sf):
    path = fresh_path(spark, "runs")
    runs = ct.read_eval_runs(run_files(spark, sf)).select("run_id", "dataset_id", "model", "mode", "level", "instance")
    runs.write.parquet(f"{path}/log")
    for writer in ("one", "two"):  # two writers of the same runs
        sk.ingest_runs(spark.readStream.schema(runs.schema).parquet(f"{path}/log"), f"{path}/catalogue", f"{path}/progress-{writer}", writer)
    return sk.read_runs(spark, f"{path}/catalogue").groupBy("model", "mode", "level").agg(F.count("*").alias("runs"))


CONFIGS = """cg AS (SELECT o_orderkey, '/data/o' || o_orderkey AS dataset_id, CAST(o_custkey % 6 AS INTEGER) AS udd_complexity, CAST(10 + o_custkey % 4 * 10 AS INTEGER) AS num_samples,
 CASE o_orderstatus WHEN 'F' THEN 'raw' WHEN 'O' THEN 'files' END AS level, CASE o_orderpriority WHEN '1-URGENT' THEN 'static' WHEN '5-LOW' THEN NULL ELSE 'direct_experiment' END AS mode FROM orders WHERE o_orderpriority <> '2-HIGH')"""


def config_files(spark, sf):
    o = table(spark, sf, "orders")
    level = F.when(F.col("o_orderstatus") == "F", F.lit(', "textualization_level": "raw"')).when(F.col("o_orderstatus") == "O", F.lit(', "representation_level": "files"')).otherwise(F.lit(', "textualization_level": null'))
    mode = F.when(F.col("o_orderpriority") == "1-URGENT", "static").when(F.col("o_orderpriority") == "5-LOW", "nonsense").otherwise("DIRECT_EXPERIMENT")
    n = F.when(F.col("o_orderpriority") == "2-HIGH", F.lit('"many"')).otherwise((10 + F.col("o_custkey") % 4 * 10).cast("string"))
    content = F.concat(F.lit('{"udd_complexity": '), (F.col("o_custkey") % 6).cast("string"), F.lit(', "num_samples": '), n, level, F.lit(', "dynamic": "'), mode, F.lit('", "llm_model": "M"}'))
    return o.select(F.concat(F.lit("/data/o"), F.col("o_orderkey").cast("string"), F.lit("/paper_dataset_instance.json")).alias("path"), content.alias("content"))


def configs(spark, sf):
    return ct.read_dataset_configs(config_files(spark, sf))


@query("read_dataset_configs", f"WITH {CONFIGS} SELECT dataset_id, udd_complexity, num_samples, level, mode FROM cg")
def _(spark, sf):
    return configs(spark, sf).select("dataset_id", "udd_complexity", "num_samples", "level", "mode")


@query("config_match_with_reasons", f"""WITH {CONFIGS} SELECT dataset_id, coalesce(level, '') = 'raw' AND coalesce(mode, '') IN ('static', 'direct_experiment') AND udd_complexity IN (1, 2, 3) AS matches,
 array_to_string(list_filter([CASE WHEN level IS DISTINCT FROM 'raw' THEN 'textualization_level=' || coalesce(level, 'None') END, CASE WHEN mode IS NULL THEN 'dynamic=None' END, CASE WHEN udd_complexity NOT IN (1, 2, 3) THEN 'udd_complexity=' || udd_complexity END], lambda x: x IS NOT NULL), ';') AS reasons FROM cg""")
def _(spark, sf):
    m = cf.match_with_reasons(configs(spark, sf), ["raw"], ["static", "direct_experiment"], [1, 2, 3])
    return m.select("dataset_id", F.col("matches"), F.array_join("reasons", ";").alias("reasons"))


@query("pending_vs_completed", f"""WITH {CONFIGS}, rr AS (SELECT DISTINCT '/data/o' || o_orderkey AS dataset_id FROM orders WHERE (o_orderstatus IN ('F', 'P') AND o_custkey % 3 = 0 AND o_orderpriority = '1-URGENT') OR (o_custkey % 3 = 1))
SELECT dataset_id, dataset_id IN (SELECT dataset_id FROM rr) AS completed FROM cg""")
def _(spark, sf):
    # stored files: current layout for a third of the orders, a legacy layout for another third
    o = table(spark, sf, "orders")
    base = F.concat(F.lit("/data/o"), F.col("o_orderkey").cast("string"))
    path = F.when(F.col("o_custkey") % 3 == 0, F.concat(base, F.lit("/evaluation_results/M/STATIC/raw/a/r.json"))).when(
        F.col("o_custkey") % 3 == 1, F.concat(base, F.lit("/evaluation_results/M_1/a/r.json"))).otherwise(F.concat(base, F.lit("/evaluation_results/Other/STATIC/raw/a/r.json")))
    return cf.completed(configs(spark, sf), o.select(path.alias("path")), ["M", "M 1"], lenient=["M 1"]).select("dataset_id", "completed")


@query("existing_config_anti_join", f"WITH {CONFIGS} SELECT DISTINCT udd_complexity, num_samples, level, mode FROM cg WHERE NOT EXISTS (SELECT 1 FROM cg e WHERE e.o_orderkey % 40 = 0 AND e.udd_complexity = cg.udd_complexity AND e.num_samples = cg.num_samples AND e.level IS NOT DISTINCT FROM cg.level AND e.mode IS NOT DISTINCT FROM cg.mode)")
def _(spark, sf):
    c = configs(spark, sf)
    stored = c.where(F.regexp_extract("dataset_id", "([0-9]+)$", 1).cast("long") % 40 == 0)
    return cf.missing_configs(c, stored).select("udd_complexity", "num_samples", "level", "mode").distinct()


@query("pending_config_groups", f"""WITH {CONFIGS}, g AS (SELECT coalesce(level, 'raw') AS level, coalesce(mode, 'static') AS mode, num_samples, dataset_id FROM cg),
r AS (SELECT *, (row_number() OVER (PARTITION BY level, mode, num_samples ORDER BY dataset_id) - 1) // 200 AS block FROM g)
SELECT level, mode, num_samples, block, string_agg(dataset_id, ',' ORDER BY dataset_id) AS paths, CASE WHEN mode = 'static' THEN num_samples ELSE 10 END AS intro, CASE WHEN mode = 'static' THEN 0 ELSE greatest(0, num_samples - 10) END AS budget FROM r GROUP BY ALL""")
def _(spark, sf):
    g = cf.pending_groups(configs(spark, sf), block=200)
    return g.withColumn("paths", F.array_join("paths", ","))


@query("complexity_lookup", f"""WITH {CONFIGS} SELECT dataset_id, CASE WHEN udd_complexity BETWEEN 1 AND 5 THEN [2, 3, 4, 4, 4][udd_complexity] END AS labels, CASE WHEN udd_complexity BETWEEN 1 AND 5 THEN [5, 6, 8, 8, 10][udd_complexity] END AS rules,
 CASE WHEN udd_complexity = 4 THEN 'property_1:3' WHEN udd_complexity = 5 THEN 'property_1:3,property_2:3' WHEN udd_complexity > 0 THEN '' END AS properties,
 CASE WHEN udd_complexity = 0 THEN 'Unrecognized UDD complexity level: 0' END AS error, CASE WHEN level = 'files' AND coalesce(mode, 'static') <> 'static' THEN 10 END AS render_cap FROM cg""")
def _(spark, sf):
    named = F.array_join(F.transform("output_properties", lambda p: F.concat(p["name"], F.lit(":"), p["labels"].cast("string"))), ",")
    return cf.complexity(configs(spark, sf)).select("dataset_id", "labels", "rules", named.alias("properties"), "error", "render_cap")


@query("json_safe_config", f"WITH {CONFIGS} SELECT dataset_id, udd_complexity, coalesce(level, 'none') AS level, 'M' AS model FROM cg")
def _(spark, sf):
    j = cf.json_safe(configs(spark, sf), "dataset_id")
    g = lambda p: F.get_json_object("config", p)
    return j.select("dataset_id", g("$.udd_complexity").cast("int").alias("udd_complexity"), F.coalesce(g("$.level"), F.lit("none")).alias("level"), g("$.model").alias("model"))


@query("category_domain", """SELECT event_id, CASE event_type WHEN 'click' THEN array_to_string(range(user_id % 5), ',') WHEN 'view' THEN '0,1' WHEN 'purchase' THEN '1,4' WHEN 'signup' THEN '0,1,2' ELSE '0,1' END AS domain FROM events""")
def _(spark, sf):
    d = F.when(F.col("event_type") == "click", (F.col("user_id") % 5).cast("string")).when(F.col("event_type") == "view", '["a", "b"]').when(
        F.col("event_type") == "purchase", '{"4": "x", "1": "y"}').when(F.col("event_type") == "signup", '{"a": 1, "b": 2, "c": 3}')
    return table(spark, sf, "events").select("event_id", F.array_join(cf.category_domain(d).cast("array<string>"), ",").alias("domain"))


@query("config_sweep", "SELECT p_partkey, c AS complexity, n AS num_samples, l AS level, m AS mode FROM part, (VALUES (1), (2)) a(c), (VALUES (10), (20), (30)) b(n), (VALUES ('raw'), (NULL)) d(l), (VALUES ('static'), ('direct_experiment')) e(m)")
def _(spark, sf):
    return cf.sweep(table(spark, sf, "part").select("p_partkey"), {"complexity": [1, 2], "num_samples": [10, 20, 30], "level": ["raw", None], "mode": ["static", "direct_experiment"]})


@query("task_grid", "SELECT doc_id, lang AS level, m AS model, i AS iteration FROM documents, (VALUES ('A'), ('B')) a(m), (VALUES (0), (1), (2)) b(i)")
def _(spark, sf):
    return cf.task_grid(table(spark, sf, "documents").select("doc_id", F.col("lang").alias("level")), ["A", "B"], 3)


@query("expand_targets", """WITH d AS (SELECT source AS dataset_id, lang AS level, 'd' || doc_id % 9 AS name FROM documents), r AS (SELECT DISTINCT dataset_id, l AS level, n AS name FROM d, (VALUES ('en'), ('xx')) a(l), (VALUES ('d1'), ('d8'), ('zz')) b(n))
SELECT DISTINCT r.*, CASE WHEN NOT EXISTS (SELECT 1 FROM d WHERE d.dataset_id = r.dataset_id AND d.level = r.level) THEN 'missing level' WHEN NOT EXISTS (SELECT 1 FROM d WHERE d.dataset_id = r.dataset_id AND d.level = r.level AND d.name = r.name) THEN 'missing instance' ELSE 'ok' END AS status FROM r""")
def _(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("dataset_id"), F.col("lang").alias("level"), F.concat(F.lit("d"), (F.col("doc_id") % 9).cast("string")).alias("name"))
    return cf.expand_targets(d.distinct(), ["en", "xx"], ["d1", "d8", "zz"])


@query("legacy_parent_path", """SELECT c_custkey, '/data/c' || c_custkey || CASE c_custkey % 4 WHEN 0 THEN '/instances/raw/My name.json' WHEN 1 THEN '/instances/files/My_name.json' WHEN 2 THEN '/instances/My name.json' ELSE '/instances/raw/My_name.json' END AS path FROM customer""")
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("/data/c"), F.col("c_custkey").cast("string")).alias("root"))
    m = F.col("c_custkey") % 4
    names = F.when(m == 0, F.array(F.lit("raw/My name"), F.lit("raw/My_name"), F.lit("files/My name"))).when(m == 1, F.array(F.lit("files/My_name"), F.lit("My name"))).when(
        m == 2, F.array(F.lit("My name"), F.lit("My_name"))).otherwise(F.array(F.lit("raw/My_name"), F.lit("other/My name")))
    files = c.select("root", F.explode(names).alias("f")).select(F.concat("root", F.lit("/instances/"), "f", F.lit(".json")).alias("path"))
    return ct.legacy_parent_path(c.select("c_custkey", "root", F.lit("My name").alias("name"), F.lit("raw").alias("level")), files, ["c_custkey"])


@query("scan_tree", "SELECT CAST(c_nationkey AS INTEGER) AS nation, count(*) AS customers, CAST(sum(c_custkey) AS BIGINT) AS keys, count(DISTINCT c_nationkey) AS folders FROM customer GROUP BY c_nationkey")
def _(spark, sf):
    # a tree of JSON files, a folder per nation, written and found again
    path = fresh_path(spark, "tree")
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.to_json(F.struct("c_custkey")).alias("value"))
    c.write.partitionBy("nation").text(path)
    files = ct.scan(spark, [path], "*.txt")
    lines = files.select("path", F.explode(F.split("content", "\n")).alias("line")).where("line <> ''")
    nation = F.regexp_extract("path", "/nation=([0-9]+)/[^/]*$", 1).cast("int")
    return lines.groupBy(nation.alias("nation")).agg(
        F.count("*").alias("customers"), F.sum(F.get_json_object("line", "$.c_custkey").cast("long")).alias("keys"), F.count_distinct(ct.parent(F.col("path"))).alias("folders"))


# -- sinks -------------------------------------------------------------------------------------------

@query("write_dataset", "SELECT o_orderpriority AS dataset_id, 'raw' AS level, o_orderstatus AS instance, count(*) AS samples, CAST(sum(o_custkey % 2) AS BIGINT) AS ones FROM orders GROUP BY ALL")
def _(spark, sf):
    path = fresh_path(spark, "dataset")
    o = table(spark, sf, "orders")
    samples = o.select(F.col("o_orderpriority").alias("dataset_id"), F.lit("raw").alias("level"), F.col("o_orderstatus").alias("instance"), F.col("o_orderkey").alias("sample_idx"), (F.col("o_custkey") % 2).alias("label"))
    instances = samples.select("dataset_id", "level", "instance").distinct()
    for part in ("dataset_id < '3'", "dataset_id >= '3'"):  # the second save leaves the datasets of the first alone
        sk.write_dataset({"samples": samples.where(part), "instances": instances.where(part)}, path)
    return spark.read.parquet(f"{path}/samples").groupBy("dataset_id", "level", "instance").agg(F.count("*").alias("samples"), F.sum("label").alias("ones"))


@query("write_dataset_clustered", "SELECT o_orderpriority AS dataset_id, o_orderstatus AS instance, count(*) AS samples FROM orders WHERE o_orderpriority <> '1-URGENT' OR o_orderstatus = 'F' GROUP BY ALL")
def _(spark, sf):
    path = fresh_path(spark, "clustered")
    samples = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("dataset_id"), F.col("o_orderstatus").alias("instance"), "o_orderkey")
    sk.save_datasets({"samples": samples}, path)
    sk.save_datasets({"samples": samples.where("dataset_id = '1-URGENT' AND instance = 'F'")}, path)  # a new version of one dataset
    return sk.read_datasets(spark, path, "samples").groupBy("dataset_id", "instance").agg(F.count("*").alias("samples"))


@query("upsert_instance", "SELECT o_orderstatus AS level, o_orderpriority AS instance, CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN 'new' ELSE 'old' END AS state, count(*) AS samples FROM orders GROUP BY ALL")
def _(spark, sf):
    path = fresh_path(spark, "instances")
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("level"), F.col("o_orderpriority").alias("instance"), "o_orderkey")
    sk.write_partitioned(o.withColumn("state", F.lit("old")), path, ["level", "instance"], "overwrite")
    changed = o.where("level = 'F' AND instance = '5-LOW'").withColumn("state", F.lit("new"))
    sk.upsert_instances(spark, changed, path, ["level", "instance"], must_exist=True)
    return spark.read.parquet(path).groupBy("level", "instance", "state").agg(F.count("*").alias("samples"))


_STATS = """SELECT o_orderpriority AS dataset_id, count(*) FILTER (o_orderstatus = 'F' AND o_custkey % 2 = 0) AS picked_0, count(*) FILTER (o_orderstatus = 'F' AND o_custkey % 2 = 1) AS picked_1, count(*) FILTER (o_custkey % 2 = 0) AS pool_0, count(*) AS total FROM orders GROUP BY 1"""


def statistics(spark, sf):
    pool = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("dataset_id"), "o_orderstatus", (F.col("o_custkey") % 2).alias("label"))
    return sk.creation_statistics(pool.where("o_orderstatus = 'F'"), pool, ["dataset_id"], 2)


def _stat_view(s):
    return s.select("dataset_id", F.col("samples_per_label")["0"].alias("picked_0"), F.col("samples_per_label")["1"].alias("picked_1"), F.col("total_samples_per_label")["0"].alias("pool_0"), F.col("total_number_of_assignments").alias("total"))


@query("creation_statistics", _STATS)
def _(spark, sf):
    return _stat_view(statistics(spark, sf))


@query("write_creation_stats", _STATS)
def _(spark, sf):
    path = fresh_path(spark, "stats")
    sk.write_partitioned(statistics(spark, sf), path, ["dataset_id"], "append")
    return _stat_view(spark.read.parquet(path))


@query("write_failures", "SELECT event_type AS model, 'raw' AS level, CAST(user_id % 3 AS INTEGER) AS iteration, count(*) AS failures FROM events WHERE value < 3 GROUP BY ALL")
def _(spark, sf):
    path = fresh_path(spark, "failures")
    e = table(spark, sf, "events").where("value < 3")
    rows = e.select(F.col("event_type").alias("model"), F.lit("raw").alias("level"), F.col("user_id").cast("string").alias("instance"), (F.col("user_id") % 3).cast("int").alias("iteration"),
                    F.struct(F.lit("compile").alias("stage"), F.concat(F.lit("value "), F.col("value").cast("string")).alias("message")).alias("error"))
    sk.write_failures(rows, path)
    return spark.read.parquet(path).groupBy("model", "level", "iteration").agg(F.count("error.message").alias("failures"))


@query("register_rendered_artifacts", """SELECT p_partkey, batch, pos, '/r/' || f || '.pdf' AS path, mode FROM (SELECT p_partkey, unnest([0, 0, 1]) AS batch, unnest([0, 1, 1]) AS pos, unnest(['a', 'b', 'c']) AS f, unnest(['old', 'new', 'new']) AS mode FROM part)""")
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey")

    def docs(names, mode):
        rows = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(f"/r/{n}.pdf" if n else "").alias("path"), F.lit(f"/abs/r/{n}.pdf" if n else None).cast("string").alias("absolute_path"), F.lit(mode).alias("mode")) for i, n in enumerate(names)])
        return p.select("p_partkey", F.explode(rows).alias("d")).select("p_partkey", "d.*")

    return sk.register_rendered(docs(["a", "b"], "old"), docs(["b", "c", ""], "new"), ["p_partkey"]).select("p_partkey", "batch", "pos", "path", "mode")


# -- reports ------------------------------------------------------------------------------------------

@query("corpus_statistics", """WITH i AS (SELECT o_custkey AS d, CASE o_orderstatus WHEN 'F' THEN 'raw' WHEN 'O' THEN 'files' ELSE 'free_text' END AS level, o_orderkey FROM orders), p AS (SELECT d, bool_and(level = 'raw') AS raw_only, count(*) FILTER (level = 'files') > 1 AS multi FROM i GROUP BY d)
SELECT 'level:' || level AS item, count(*) AS n FROM i GROUP BY level UNION ALL SELECT 'raw_only', count(*) FILTER (raw_only) FROM p UNION ALL SELECT 'multi_files', count(*) FILTER (multi) FROM p UNION ALL SELECT 'runs:' || event_type, count(*) FROM events GROUP BY event_type""")
def _(spark, sf):
    level = F.when(F.col("o_orderstatus") == "F", "raw").when(F.col("o_orderstatus") == "O", "files").otherwise("free_text")
    inst = table(spark, sf, "orders").select(F.col("o_custkey").alias("dataset_id"), level.alias("level"), F.col("o_orderkey").alias("name"))
    return rp.corpus_statistics(inst, table(spark, sf, "events").select(F.col("event_type").alias("model")))


@query("run_rollup", """SELECT CASE WHEN grouping(event_type) = 0 THEN event_type END AS config, CASE WHEN grouping(user_id) = 0 THEN user_id END AS dataset, count(*) FILTER (value >= 2) AS successes, count(*) FILTER (value < 2) AS failures,
 arg_min('low ' || user_id, event_id) FILTER (value < 2) AS first_error FROM events GROUP BY ROLLUP (event_type, user_id)""")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("config"), F.col("user_id").alias("dataset"), (F.col("value") >= 2).alias("ok"),
                                          F.concat(F.lit("low "), F.col("user_id").cast("string")).alias("error"), F.col("event_id").alias("pos"))
    return rp.run_rollup(e)


@query("leaderboard", """SELECT row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank, c_name AS model_name, format('{:.1f}', round_even(greatest(c_acctbal, 0) / 10000 * 100, 1)) || '%' AS accuracy FROM customer""")
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_name").alias("model_name"), (F.greatest("c_acctbal", F.lit(0)) / 10000).alias("accuracy"), "c_acctbal", "c_custkey")
    return rp.leaderboard(c, "c_acctbal", "c_custkey", "accuracy").select("rank", "model_name", "accuracy")


@query("failure_top8", "SELECT event_id AS pos, user_id, substr(repeat(event_type || ' ' || value || ' ', 30), 1, 160) AS error FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 8")
def _(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'error'")
    rows = e.select(F.col("event_id").alias("pos"), "user_id", F.repeat(F.concat("event_type", F.lit(" "), F.col("value").cast("string"), F.lit(" ")), 30).alias("error"))
    return rp.first_failures(rows, 8, 160)
