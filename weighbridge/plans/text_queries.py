"""Text columns over samples, documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import blocks as bl
from ..operators import scoring as sc
from ..operators.model import small_table
from .bridge import (MODEL, SEED, SQL_ORDERS, VARS, cats, order_samples, sql_u01, table, values, with_scores)
from .registry import query

S = repr(str(SEED))
PHRASES = {"V0": {0: "closed", 1: "open"}, "V1": {0: "an even customer", 1: "an odd customer"},
           "V2": {0: "top urgency", 1: "high urgency", 2: "medium urgency", 3: "no stated urgency", 4: "low urgency"}}
TEMPLATE = "An order ({var.V0}) from {var.V1} with {var.V2}, span {var.V3}/{var.V4} of {var.V9}."
LABEL_NAMES = {0: "Accept", 1: "Review"}
SQL_LABEL = "CASE label WHEN 0 THEN 'Accept' WHEN 1 THEN 'Review' ELSE 'Label ' || label END"
SQL_RAW = "'V0=' || V0 || ', V1=' || V1 || ', V2=' || V2 || ', V3=' || V3 || ', V4=' || V4"


def _sql_phrase(v):
    arms = " ".join(f"WHEN {c} THEN '{t}'" for c, t in PHRASES[v].items())
    return f"CASE {v} {arms} ELSE CAST({v} AS VARCHAR) END"


SQL_TEXT = f"'An order (' || {_sql_phrase('V0')} || ') from ' || {_sql_phrase('V1')} || ' with ' || {_sql_phrase('V2')} || ', span ' || V3 || '/' || V4 || ' of {{var.V9}}.'"


def assignment():
    return F.create_map(*[x for v in VARS for x in (F.lit(v), F.col(v))])


def names():
    return F.create_map(*[F.lit(x) for kv in LABEL_NAMES.items() for x in kv])


def labelled(spark, sf):
    return sc.score_wide(order_samples(spark, sf), MODEL, cats(), values()).select("sid", "custkey", "status", *VARS, "x4", "label", "score")


def docs(spark, sf):
    return table(spark, sf, "documents")


@query("render_raw", f"WITH {SQL_ORDERS} SELECT sid, {SQL_RAW} AS text FROM smp")
def _(spark, sf):
    return order_samples(spark, sf).select("sid", tx.render_raw(assignment()).alias("text"))


@query("render_template", f"WITH {SQL_ORDERS} SELECT sid, {SQL_TEXT} AS text FROM smp")
def _(spark, sf):
    return order_samples(spark, sf).select("sid", tx.render_template(F.lit(TEMPLATE), assignment(), tx.phrase_map(PHRASES)).alias("text"))


@query("phrase_join", f"""WITH {SQL_ORDERS}, l AS (SELECT sid, unnest(['V0','V1','V2']) AS var, unnest([V0, V1, V2]) AS cat FROM smp), p(var, cat, phrase) AS (VALUES {', '.join(f"('{v}', {c}, '{t}')" for v, m in PHRASES.items() for c, t in m.items())})
SELECT sid, var, cat, phrase, phrase IS NULL AS missing FROM l LEFT JOIN p USING (var, cat)""")
def _(spark, sf):
    phrases = small_table(spark, [(v, c, t) for v, m in PHRASES.items() for c, t in m.items()], "var string, cat int, phrase string")
    long = sc.unpivot_assignment(order_samples(spark, sf), ["sid"], {v: F.col(v) for v in ("V0", "V1", "V2")})
    return long.join(phrases, ["var", "cat"], "left").select("sid", "var", "cat", "phrase", F.col("phrase").isNull().alias("missing"))


@query("format_number", """SELECT l_orderkey, l_linenumber, CASE WHEN abs(x - round_even(x, 0)) < 1e-6 THEN CAST(CAST(round_even(x, 0) AS BIGINT) AS VARCHAR) ELSE regexp_replace(format('{:.2f}', x), '\\.?0+$', '') END AS text
FROM (SELECT *, l_extendedprice / 7 + l_quantity * 0.125 AS x FROM lineitem)""")
def _(spark, sf):
    x = F.col("l_extendedprice") / 7 + F.col("l_quantity") * 0.125
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", tx.format_number(x).alias("text"))


_NUM = "CASE WHEN abs({x} - round_even({x}, 0)) < 1e-6 THEN CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR) ELSE regexp_replace(format('{{:.2f}}', {x}), '\\.?0+$', '') END"


@query("format_with_unit", f"""SELECT l_orderkey, l_linenumber, {_NUM.format(x='l_quantity / 4')} || CASE l_returnflag WHEN 'A' THEN '%' WHEN 'N' THEN ' km' ELSE '' END || CASE l_linestatus WHEN 'F' THEN ' (load)' ELSE '' END AS text FROM lineitem""")
def _(spark, sf):
    unit = F.when(F.col("l_returnflag") == "A", "%").when(F.col("l_returnflag") == "N", "km")
    desc = F.when(F.col("l_linestatus") == "F", "load")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", tx.format_with_unit(F.col("l_quantity") / 4, unit, desc).alias("text"))


@query("inject_numeric_phrase", f"""WITH {SQL_ORDERS}, v AS (SELECT sid, V2, V0, 10 + 20 / 5::DOUBLE * V2 + {sql_u01(S, 'sid')} * (20 / 5::DOUBLE) AS x FROM smp),
n AS (SELECT *, {_NUM.format(x='x')} || CASE WHEN V0 = 0 THEN '%' ELSE ' kg' END AS num FROM v)
SELECT sid, CASE WHEN V2 = 4 THEN 'low' WHEN V2 = 3 THEN CASE WHEN V0 = 2 THEN num ELSE 'load: ' || num END ELSE CASE WHEN contains('about 12 kg', num) THEN 'about 12 kg' ELSE 'about 12 kg (' || num || ')' END END AS phrase FROM n""")
def _(spark, sf):
    phrase = F.when(F.col("V2") == 4, "low").when(F.col("V2") == 3, "").otherwise("about 12 kg")
    role = F.when(F.col("V0") != 2, "load")
    high = F.when(F.col("V2") != 4, F.lit(30.0))
    return order_samples(spark, sf).select("sid", tx.inject_numeric_phrase(
        phrase, role, F.col("V2"), F.lit(5), F.lit(10.0), high, F.when(F.col("V0") == 0, "%").otherwise("kg"), SEED, F.col("sid")).alias("phrase"))


PROPS = {"tone": {0: "calm"}}


def prop_labels():
    return F.create_map(F.lit("tone"), F.when(F.col("label") != 1, F.col("V1")), F.lit("area"), F.col("V0"))


SQL_BLOCK = "{head} || ', ' || 'area=' || V0 || CASE WHEN label <> 1 THEN ', tone=' || CASE V1 WHEN 0 THEN 'calm' ELSE CAST(V1 AS VARCHAR) END ELSE '' END"


@query("label_text", f"""{with_scores()} SELECT sid, {SQL_LABEL} AS label_text, CASE WHEN label <> 1 THEN CASE V1 WHEN 0 THEN 'calm' ELSE CAST(V1 AS VARCHAR) END END AS tone,
 CASE WHEN V0 = 2 THEN CASE V2 WHEN 4 THEN NULL ELSE V2 || ' kg (load)' END ELSE {_NUM.format(x='x4 * 30')} || ' kg (load)' END AS mass, {SQL_BLOCK.format(head=SQL_LABEL)} AS block FROM lab JOIN smp USING (sid)""")
def _(spark, sf):
    texts = tx.phrase_map(PROPS)
    none, calm = F.expr("CAST(map() AS MAP<INT, STRING>)"), F.create_map(F.lit(0), F.lit("calm"))
    tone = tx.property_text(F.lit(None).cast("string"), F.when(F.col("label") != 1, F.col("V1")), F.lit(None).cast("double"), calm, F.lit(None).cast("string"), F.lit(None).cast("string"))
    # a numerical property shows its score, else its label
    mass = tx.property_text(F.lit("numerical"), F.when(F.col("V2") != 4, F.col("V2")), F.when(F.col("V0") != 2, F.col("x4") * 30), none, F.lit("kg"), F.lit("load"))
    name = tx.label_name(names(), F.col("label"))
    return labelled(spark, sf).select("sid", name.alias("label_text"), tone.alias("tone"), mass.alias("mass"), tx.label_block(name, prop_labels(), texts, False).alias("block"))


@query("label_names", f"{with_scores()} SELECT status, label, {SQL_LABEL} AS name, count(*) AS n FROM lab JOIN smp USING (sid) GROUP BY status, label")
def _(spark, sf):
    return labelled(spark, sf).groupBy("status", "label").agg(F.count("*").alias("n")).withColumn("name", tx.label_name(names(), F.col("label")))


@query("label_display", f"""{with_scores()} SELECT sid, CASE WHEN custkey % 7 = 0 THEN 'Unknown' ELSE CAST(label AS VARCHAR) END || CASE label WHEN 0 THEN ' (Accept)' WHEN 1 THEN ' (Review)' ELSE '' END || ' | tone: '
 || CASE WHEN label = 1 THEN 'N/A' WHEN V1 = 0 THEN 'calm' ELSE CAST(V1 AS VARCHAR) END || '; area: ' || V0 AS display FROM lab JOIN smp USING (sid)""")
def _(spark, sf):
    text = F.when(F.col("V1") == 0, F.when(F.col("label") != 1, F.create_map(F.lit("tone"), F.lit("calm"))))
    text = F.coalesce(text, F.expr("CAST(map() AS MAP<STRING, STRING>)"))
    idx = F.when(F.col("custkey") % 7 != 0, F.col("label"))
    return labelled(spark, sf).select("sid", tx.label_display(idx, F.try_element_at(names(), F.col("label")), prop_labels(), text).alias("display"))


@query("label_line", """SELECT p_partkey, 'Output labels (' || n || ' categories): ' || array_to_string(list_transform(range(n), lambda i: i || ': ' || 'L' || (i + p_size)), ', ') AS line,
 'Output labels (' || n || ' categories): ' || array_to_string(list_transform(range(n), lambda i: 'L' || (i + p_size)), ', ') AS textual FROM (SELECT *, p_size % 4 + 1 AS n FROM part)""")
def _(spark, sf):
    n = F.col("p_size") % 4 + 1
    m = F.map_from_entries(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i, F.concat(F.lit("L"), (i + F.col("p_size")).cast("string")))))
    return table(spark, sf, "part").select("p_partkey", tx.label_line(m, False).alias("line"), tx.label_line(m, True).alias("textual"))


@query("schema_lines", f"""WITH {SQL_ORDERS}, l AS (SELECT DISTINCT custkey, unnest(['V0','V1','V2']) AS var, unnest([V0, V1, V2]) AS cat FROM smp)
SELECT custkey, string_agg(line, chr(10) ORDER BY var) AS lines FROM (SELECT custkey, var, '- ' || var || CASE var WHEN 'V0' THEN ' (order state)' ELSE '' END || ': categories={{ ' || string_agg(cat || ':c' || cat, ', ' ORDER BY cat) || ' }}' AS line FROM l GROUP BY custkey, var) GROUP BY custkey""")
def _(spark, sf):
    from ..operators.properties import infer_schema
    long = sc.unpivot_assignment(order_samples(spark, sf), ["custkey"], {v: F.col(v) for v in ("V0", "V1", "V2")})
    s = infer_schema(long, ["custkey"], {"V0": "order state"})
    named = F.array_join(F.transform("values", lambda c: F.concat(c.cast("string"), F.lit(":c"), c.cast("string"))), ", ")
    line = F.concat(F.lit("- "), F.col("var"), F.coalesce(F.concat(F.lit(" ("), F.col("role"), F.lit(")")), F.lit("")),
                    F.lit(": categories={ "), named, F.lit(" }"))
    return bl.join_lines(s, ["custkey"], "var", line, "lines")


@query("examples_block", f"""{with_scores()}, f AS (SELECT *, row_number() OVER (PARTITION BY custkey ORDER BY sid) AS r FROM lab JOIN smp USING (sid))
SELECT custkey, CASE WHEN custkey % 5 = 0 OR custkey % 5 = 1 AND custkey % 3 = 0 THEN '{tx.FILES_NOTE}' WHEN custkey % 7 = 0 THEN '' ELSE 'Labeled examples:' || chr(10) || string_agg('Labels: ' || {SQL_BLOCK.format(head=SQL_LABEL)} || ' | ' || {SQL_TEXT}, chr(10) ORDER BY sid) END AS block FROM f WHERE r <= 3 GROUP BY custkey""")
def _(spark, sf):
    first = bl.first_n(labelled(spark, sf), ["custkey"], ["sid"], 3)
    text = tx.render_template(F.lit(TEMPLATE), assignment(), tx.phrase_map(PHRASES))
    level = F.when(F.col("custkey") % 5 == 0, "files").when(F.col("custkey") % 5 == 1, "free_text").otherwise("raw")
    line = tx.example_line(tx.label_block(tx.label_name(names(), F.col("label")), prop_labels(), tx.phrase_map(PROPS), False), text)
    return bl.join_lines(first, ["custkey"], "sid", line, "lines").select("custkey", tx.examples_block(level, F.col("custkey") % 3 == 0, F.when(F.col("custkey") % 7 != 0, F.col("lines"))).alias("block"))


@query("reference_lines", f"{with_scores()} SELECT sid, sid || '. Label: ' || {SQL_LABEL} || ' | Assignment: ' || {SQL_RAW} AS line, sid || '. Labels: ' || {SQL_BLOCK.format(head=SQL_LABEL)} || ' | ' || {SQL_TEXT} AS text_line FROM lab JOIN smp USING (sid)")
def _(spark, sf):
    name = tx.label_name(names(), F.col("label"))
    text = tx.render_template(F.lit(TEMPLATE), assignment(), tx.phrase_map(PHRASES))
    block = tx.label_block(name, prop_labels(), tx.phrase_map(PROPS), False)
    return labelled(spark, sf).select(
        "sid", F.concat(F.col("sid").cast("string"), F.lit(". Label: "), name, F.lit(" | Assignment: "), tx.render_raw(assignment())).alias("line"),
        F.concat(F.col("sid").cast("string"), F.lit(". "), tx.example_line(block, text)).alias("text_line"))


@query("missing_keywords", """SELECT doc_id, array_to_string(list_filter(['The', 'und', 'les', lang || 'x', ''], lambda k: k <> '' AND NOT contains(lower(text), lower(k))), ',') AS missing FROM documents""")
def _(spark, sf):
    kws = F.array(F.lit("The"), F.lit("und"), F.lit("les"), F.concat("lang", F.lit("x")), F.lit(""))
    return docs(spark, sf).select("doc_id", F.array_join(tx.missing_keywords(F.col("text"), kws), ",").alias("missing"))


@query("required_keywords", "SELECT doc_id, CASE WHEN n_chars > 1000 THEN lang || ',' || source ELSE lang END AS required FROM documents")
def _(spark, sf):
    phrases = F.create_map(F.lit("V0"), F.col("lang"), F.lit("V1"), F.col("source"), F.lit("V2"), F.lit(None).cast("string"))
    types = F.create_map(F.lit("V1"), F.when(F.col("n_chars") > 1000, "categorical").otherwise("numerical"))
    return docs(spark, sf).select("doc_id", F.array_join(tx.required_keywords(phrases, types), ",").alias("required"))


@query("infer_variable_types", """SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'categorical' WHEN TRY_CAST(CASE WHEN p_brand = 'Brand#1' THEN 'many' ELSE CAST(p_size AS VARCHAR) END AS DOUBLE) > 20 THEN 'numerical' ELSE 'categorical' END AS kind FROM part""")
def _(spark, sf):
    given = F.when(F.col("p_type") == "ECONOMY", "categorical").when(F.col("p_type") == "PROMO", "odd")
    high = F.when(F.col("p_brand") == "Brand#1", "many").otherwise(F.col("p_size").cast("string"))
    return table(spark, sf, "part").select("p_partkey", tx.infer_variable_type(given, F.lit("20"), high).alias("kind"))


@query("chunk_text", "SELECT doc_id, i AS chunk, substr(text, (i - 1) * 600 + 1, 600) AS slice FROM (SELECT doc_id, text, unnest(range(1, CAST(greatest(ceil(length(text) / 600), 1) AS BIGINT) + 1))::INTEGER AS i FROM documents)")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", F.posexplode(tx.chunk_text(F.col("text"), 600)).alias("pos", "slice")).select("doc_id", (F.col("pos") + 1).alias("chunk"), "slice")


@query("chunker_udtf", "SELECT conv_id, turn, i AS chunk, CASE WHEN i = 1 THEN role ELSE '' END AS shown, substr(text, (i - 1) * 100 + 1, 100) AS slice FROM (SELECT *, unnest(range(1, CAST(greatest(ceil(length(text) / 100), 1) AS BIGINT) + 1))::INTEGER AS i FROM conversations)")
def _(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.posexplode(tx.chunk_text(F.col("text"), 100)).alias("pos", "slice"))
    return rows.select("conv_id", "turn", (F.col("pos") + 1).alias("chunk"), F.when(F.col("pos") == 0, F.col("role")).otherwise("").alias("shown"), "slice")


@query("excerpt", "SELECT doc_id, substr(text, 1, 280) AS excerpt FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", F.substring("text", 1, 280).alias("excerpt"))


@query("clean_cell_text", r"SELECT doc_id, md5(regexp_replace(translate(text, chr(10) || chr(13), '  '), '[\p{C}\p{Zl}\p{Zp}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]', '', 'g')) AS cleaned FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(tx.clean_cell_text(F.col("text"))).alias("cleaned"))


@query("safe_title", r"""SELECT page_id, CASE WHEN t = '' THEN 'Sheet' ELSE t END AS title FROM (SELECT page_id, substr(trim(regexp_replace(url, '[\\/*?:\[\]]', ' ', 'g')), 1, 31) AS t FROM pages)""")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.safe_title(F.col("url")).alias("title"))


_NOTE = "'Score {{score}} for {{index}}: the Mapping of VARIABLE {{secret}} / {{label}} ' || text"


@query("redact_terms", f"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(t, '\\{{score\\}}|score|assignment|variable|mapping', '', 'gi'), '\\{{(index|label|instance_text)\\}}', '<<\\1>>', 'g'), '\\{{[^}}]+\\}}', '', 'g')) AS redacted,
 length(t) AS before FROM (SELECT doc_id, {_NOTE.replace('{{', '{').replace('}}', '}')} AS t FROM documents)""")
def _(spark, sf):
    t = F.expr(_NOTE.replace("{{", "{").replace("}}", "}"))
    out = tx.redact_terms(t, ["index", "label", "instance_text"])
    marked = F.regexp_replace(out, r"\{(index|label|instance_text)\}", "<<$1>>")
    return docs(spark, sf).select("doc_id", F.md5(marked).alias("redacted"), F.length(t).cast("long").alias("before"))


@query("safe_format", r"""SELECT p_partkey, 'Part ' || p_name || ' of ' || p_brand || ' {unknown} ' || p_name AS text FROM part""")
def _(spark, sf):
    ctx = F.create_map(F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand"))
    return table(spark, sf, "part").select("p_partkey", tx.safe_format(F.lit("Part {name} of {brand.upper()} {unknown.x} {name}"), ctx).alias("text"))


@query("render_transcript", """SELECT conv_id, CAST(0 AS BIGINT) AS part, string_agg(CASE role WHEN 'system' THEN '[SYSTEM]' WHEN 'user' THEN '[USER]' ELSE '[ASSISTANT]' END || chr(10) || trim(text, ' ') || chr(10), chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id""")
def _(spark, sf):
    return bl.transcript(table(spark, sf, "conversations"), ["conv_id"], "turn", "role", "text")


@query("latest_user_message", "SELECT conv_id, coalesce(arg_max(text, turn) FILTER (role = 'user'), '') AS message FROM conversations GROUP BY conv_id")
def _(spark, sf):
    from ..operators.sessions import latest_user_message
    return latest_user_message(table(spark, sf, "conversations"), ["conv_id"], "turn", "role", "text", "message")


@query("translate_result", f"{with_scores()} SELECT sid, CASE WHEN custkey % 7 <> 0 THEN CASE label WHEN 0 THEN 'Accept' WHEN 1 THEN 'Review' ELSE 'Label 2' END END AS label_text, CASE WHEN label <> 1 THEN CASE V1 WHEN 0 THEN 'calm' ELSE '1' END END AS tone FROM lab JOIN smp USING (sid)")
def _(spark, sf):
    plain = F.create_map(*[F.lit(x) for i in range(3) for x in (i, f"Label {i}")])
    tone = F.create_map(F.lit(0), F.lit("calm"))
    digits = F.create_map(F.lit(0), F.lit("0"), F.lit(1), F.lit("1"))
    return labelled(spark, sf).select(
        "sid", tx.translate_label(names(), plain, F.when(F.col("custkey") % 7 != 0, F.col("label"))).alias("label_text"),
        tx.translate_label(tone, digits, F.when(F.col("label") != 1, F.col("V1"))).alias("tone"))


# -- tables of text ------------------------------------------------------------------------------

@query("rolling_avg_length", "SELECT doc_id, source, length(text) AS n, round(avg(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS rolling FROM documents")
def _(spark, sf):
    d = docs(spark, sf).select("doc_id", "source", F.length("text").cast("long").alias("n"))
    return bl.rolling_mean(d, ["source"], "doc_id", F.col("n"), 5, "rolling").withColumn("rolling", F.round("rolling", 6))


@query("first_n_per_instance", "SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 10")
def _(spark, sf):
    return bl.first_n(docs(spark, sf).select("source", "doc_id"), ["source"], ["doc_id"], 10)


@query("even_odd_split", "SELECT event_id, CAST(event_id % 2 AS INTEGER) AS part FROM events")
def _(spark, sf):
    return bl.even_odd_split(table(spark, sf, "events").select("event_id"), "event_id")


@query("unique_title", """SELECT p_partkey, p_brand, CASE WHEN r = 1 THEN t ELSE substr(t, 1, 31 - length('_' || r)) || '_' || r END AS unique_title
FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, t ORDER BY p_partkey) AS r FROM (SELECT *, substr('Overview of every ' || p_type || ' item', 1, 31) AS t FROM part))""")
def _(spark, sf):
    t = table(spark, sf, "part").select("p_partkey", "p_brand", F.concat(F.lit("Overview of every "), F.col("p_type"), F.lit(" item")).alias("title"))
    return bl.unique_titles(t, ["p_brand"], "title", "p_partkey").drop("title")


@query("label_summary", f"{with_scores()} SELECT label, count(*) AS count, format('{{:.1f}}%', count(*) / sum(count(*)) OVER () * 100) AS percent, CASE WHEN count(*) / sum(count(*)) OVER () > 0.4 THEN 'High volume' ELSE 'Balanced' END AS note FROM lab GROUP BY label")
def _(spark, sf):
    return bl.label_summary(labelled(spark, sf), "label")


@query("indices_by_label", "SELECT label, (r - 1) // 100 AS block, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY r) AS indices FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings) GROUP BY label, block")
def _(spark, sf):
    b = bl.indices_by_label(table(spark, sf, "embeddings").select("label", "vec_id"), "label", "vec_id", 100)
    return b.withColumn("indices", F.array_join(F.col("indices").cast("array<string>"), ","))


@query("side_by_side", """WITH e AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS pair FROM events)
SELECT pair, a.event_id AS "left", b.event_id AS "right" FROM (SELECT * FROM e WHERE event_type = 'click') a FULL JOIN (SELECT * FROM e WHERE event_type = 'error') b USING (pair)""")
def _(spark, sf):
    e = table(spark, sf, "events").where("event_type IN ('click', 'error')")
    e = e.select(F.when(F.col("event_type") == "click", 0).otherwise(1).alias("label"), "event_id")
    return bl.side_by_side(e.withColumn("value", F.col("event_id")), "label", 0, 1, "event_id", "value")


@query("sample_roster", f"""{with_scores()} SELECT sid, CAST(label AS VARCHAR) || CASE label WHEN 0 THEN ' (Accept)' WHEN 1 THEN ' (Review)' ELSE '' END AS label_display, {SQL_LABEL} AS label_name, {SQL_RAW} AS text FROM lab JOIN smp USING (sid)""")
def _(spark, sf):
    none = F.expr("CAST(map() AS MAP<STRING, STRING>)")
    show = tx.label_display(F.col("label"), F.try_element_at(names(), F.col("label")), none, none)
    return labelled(spark, sf).select("sid", show.alias("label_display"), tx.label_name(names(), F.col("label")).alias("label_name"), tx.render_raw(assignment()).alias("text"))


@query("label_check", f"{with_scores()} SELECT sid, label, V0 AS expected FROM lab JOIN smp USING (sid) WHERE label <> V0")
def _(spark, sf):
    return labelled(spark, sf).where(~F.col("label").eqNullSafe(F.col("V0"))).select("sid", "label", F.col("V0").alias("expected"))


@query("select_by_label", f"{with_scores()} SELECT sid, label, length({SQL_RAW}) AS n FROM lab JOIN smp USING (sid) WHERE label = 1 AND V3 >= 2")
def _(spark, sf):
    d = labelled(spark, sf).where((F.col("label") == 1) & (F.col("V3") >= 2))
    return d.select("sid", "label", F.length(tx.render_raw(assignment())).cast("long").alias("n"))


@query("filtered_range", "SELECT d.doc_id, lang FROM documents d ANTI JOIN labels USING (doc_id) WHERE d.doc_id >= 50 AND lang IN ('en', 'de')")
def _(spark, sf):
    d = docs(spark, sf).where((F.col("doc_id") >= 50) & F.col("lang").isin("en", "de")).select("doc_id", "lang")
    return d.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("block_assignment", """WITH c AS (SELECT p_partkey AS sample, min(CAST(l_linenumber AS INTEGER)) AS block FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT p_partkey AS sample, CASE WHEN block <= 5 THEN block ELSE 5 END AS block FROM part LEFT JOIN c ON sample = p_partkey""")
def _(spark, sf):
    # line numbers are blocks that claim parts; block 5 takes all that remain by then
    li = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("block"), F.col("l_partkey").alias("sample"))
    claims = li.unionByName(li.select(F.lit(5).alias("block"), F.lit(None).cast("long").alias("sample")).limit(1))
    return bl.block_assignment(claims, table(spark, sf, "part").select(F.col("p_partkey").alias("sample")), "sample")


@query("coverage_check", "SELECT lang, count(*) AS total, count(l.doc_id) AS used, count(*) - count(l.doc_id) AS missing, count(*) = count(l.doc_id) AS covered FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang")
def _(spark, sf):
    d = docs(spark, sf).select("lang", "doc_id")
    used = table(spark, sf, "labels").select("doc_id").join(d, "doc_id")
    return bl.coverage(d, used, "doc_id", ["lang"])


@query("coverage_union", "SELECT DISTINCT doc_id FROM (SELECT doc_id FROM labels WHERE quality = 1 UNION SELECT doc_id FROM labels WHERE toxic = 1)")
def _(spark, sf):
    lb = table(spark, sf, "labels")
    return lb.where("quality = 1").select("doc_id").union(lb.where("toxic = 1").select("doc_id")).distinct()


@query("missing_except", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def _(spark, sf):
    return docs(spark, sf).select("doc_id").subtract(table(spark, sf, "labels").select("doc_id"))


@query("property_matrix", "SELECT event_id, CASE WHEN event_type = 'view' THEN value ELSE 0 END AS views, CASE WHEN event_type = 'click' THEN value ELSE 0 END AS clicks, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, 0::DOUBLE AS other FROM events")
def _(spark, sf):
    m = F.create_map(F.when(F.col("event_type") == "view", "views").when(F.col("event_type") == "click", "clicks").otherwise("none"), F.col("value").cast("string"),
                     F.lit("k"), F.get_json_object("props", "$.k"), F.lit("other"), F.lit("n/a"))
    e = table(spark, sf, "events").select("event_id", m.alias("scores"))
    return bl.property_matrix(e, "event_id", "scores", ["views", "clicks", "k", "other"])


@query("parse_level", """SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'raw' WHEN 'N' THEN 'free_text_long' ELSE 'unknown' END AS level FROM lineitem""")
def _(spark, sf):
    given = F.when(F.col("l_returnflag") == "A", " RAW ").when(F.col("l_returnflag") == "N", "Free_Text_Long").when(F.col("l_linestatus") == "F", "no such")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", tx.parse_level(given).alias("level"))


@query("parse_mode", """SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'direct_experiment' WHEN 'N' THEN 'symbolic_regression' END AS mode, CASE l_returnflag WHEN 'A' THEN 'direct_experiment' WHEN 'N' THEN 'symbolic_regression' ELSE 'static' END AS filled FROM lineitem""")
def _(spark, sf):
    given = F.when(F.col("l_returnflag") == "A", "direct_experiment").when(F.col("l_returnflag") == "N", "SYMBOLIC_REGRESSION").when(F.col("l_linestatus") == "F", "Static")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", tx.parse_mode(given).alias("mode"), tx.parse_mode(given, F.lit("static")).alias("filled"))


@query("slug", r"""SELECT page_id, CASE WHEN s = '' THEN 'unnamed' ELSE s END AS slug, CASE WHEN s2 = '' THEN 'unnamed' ELSE s2 END AS host FROM (SELECT page_id, trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '_') AS s, trim(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '[^A-Za-z0-9._-]+', '_', 'g'), '_') AS s2 FROM pages)""")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.slug(F.col("url")).alias("slug"), tx.slug(F.regexp_extract("url", "([^/]*)$", 1)).alias("host"))


@query("dataset_key", "SELECT p_partkey, 'data_ns' || p_size || '_nv5_nr4_c2-' || (p_size % 5 + 2) || '_nnv1_ol3_props0' AS key FROM part")
def _(spark, sf):
    n = lambda x: F.lit(str(x))
    size = F.col("p_size").cast("string")
    return table(spark, sf, "part").select("p_partkey", tx.dataset_key(F.lit("data"), size, n(5), n(4), n(2), (F.col("p_size") % 5 + 2).cast("string"), n(1), n(3), n(0)).alias("key"))


@query("detect_render_mode", """SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'RANDOM' WHEN url LIKE '%/%2%' THEN 'PDF' WHEN page_id % 2 = 1 THEN 'XLSX' END AS mode FROM pages""")
def _(spark, sf):
    path = F.concat("url", F.when(F.col("url").like("%/%2%"), ".PDF").when(F.col("page_id") % 2 == 1, ".xlsx").otherwise(".txt"))
    return table(spark, sf, "pages").select("page_id", tx.render_mode(F.when(F.col("page_id") % 5 == 0, "RANDOM"), path).alias("mode"))


@query("most_common", "SELECT row_number() OVER (ORDER BY n DESC, l_suppkey) AS place, l_suppkey, n FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1)")
def _(spark, sf):
    from ..operators.reports import most_common
    return most_common(table(spark, sf, "lineitem"), "l_suppkey")
