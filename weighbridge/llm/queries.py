"""One query per operator over its whole table, with production parameters, and its SQL where there is one."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, divergence, grams, jaccard, language, mixing, passages, periodic, pieces, quality, resample, toxicity
from .common import remainder, table
from .lines import LineStore

PIECES = "piece_bpe_32k.model"
TRUSTED = 20_000  # labelled rows that stand for good text, at most


def piece_model(name: str = PIECES) -> pieces.Model:
    """A model file of the tokenizer folder (TOKENIZERS_DIR, else the installed package's)."""
    folder = os.environ.get("TOKENIZERS_DIR")
    if folder:
        return pieces.Model.read(os.path.join(folder, name))
    import public_tokenizers

    return pieces.Model.read(public_tokenizers.path(name))


def op1_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    rest = remainder(F.col("doc_id"), 5)
    model = language.learn(docs, rest != 0)
    return language.identify(docs.select("doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), "text"), model).drop("text")


def op2_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    targets = grams.target_ids(table(spark, sf, "labels"), F.col("quality") == 1, "doc_id", TRUSTED)
    return quality.judge(docs, grams.fit(docs, targets)).drop("text")


def op3_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    coded = pieces.encode(docs, piece_model(), decoded=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"), F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).alias("last_byte"))


def op4_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rest = remainder(F.col("doc_id"), 7)
    scored = mixing.score_texts(docs, rest != 2, ["doc_id"])
    return scored.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op6_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    store = LineStore(spark)
    store.insert(docs)
    return store.kept(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op7_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(r"\### Assistant: </turn> ok").alias("text"))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard)
    # a row is a message, also where a turn repeats
    again = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    events = rows.select("conv_id", F.col("turn").alias("seq"), again.alias("message"), F.lit("message").alias("kind"), "role", "text")
    events = events.withColumn("message", F.struct("seq", "message"))
    return chat.digests(chat.render(chat.fold(events))).withColumnRenamed("conv", "conv_id")


def op8_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.join(table(spark, sf, "documents"))


def op9_quality_resampling(spark: SparkSession, sf: str) -> DataFrame:
    """Documents to keep: as large a share as good rows have among the labelled."""
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels")
    good = F.col("quality") == 1
    share = labels.agg(F.avg(F.when(good, 1.0).otherwise(0.0)).alias("s")).first()["s"]
    model = grams.fit(docs, grams.target_ids(labels, good, "doc_id", TRUSTED))
    return resample.sample(resample.weigh(docs, model).drop("text"), 1.0 if share is None else share)


def op10_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return passages.shared(table(spark, sf, "documents"))


def repeated_tail(h: int | None, n: int) -> np.ndarray | None:
    """Of every tenth document (by the hash of its id), the words from place a on repeat their first p."""
    if h is None or h % 10 or not n:
        return None
    g, at = h // 10, np.arange(n)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.where(at < a, at, a + (at - a) % p)


def op11_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    found = periodic.collapse(docs, rearrange=("h", repeated_tail), leave_out=("text", "h"))
    best = F.try_element_at("runs", F.col("strongest") + 1)
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return (found.withColumn("best", best)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{x}").alias(x) for x in ("start", "length", "period")],
                    F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                    F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))


def op12_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = toxicity.learn(docs, labels, remainder(F.col("doc_id"), 5) != 0)
    held = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    scored = toxicity.score(docs.select("doc_id", held.alias("held_out"), "text"), model, leave_out=("text",))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op13_source_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return divergence.audit(table(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_quality_rules, op3_sentencepiece, op4_lm_scoring, op5_benchmark_decontamination, op6_line_dedup,
                                   op7_chat_formatting, op8_ngram_jaccard, op9_quality_resampling, op10_substring_dedup, op11_periodic_runs, op12_toxicity,
                                   op13_source_divergence)}

_ESCAPED = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"

ORACLE = {
    "op6_line_dedup": r"""
WITH split AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM split),
shared AS (SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT k.*, s.owner IS NOT NULL AND s.owner <> k.doc_id AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id""",
    "op7_chat_formatting": rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
d AS (SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS learned,
  '<turn ' || {_ESCAPED.format('role')} || '>' || chr(10) || {_ESCAPED.format('text')} || '</turn>' || chr(10) AS formatted FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(length(learned)) AS BIGINT) AS loss_chars, sha256(string_agg(learned, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars FROM d GROUP BY conv_id""",
    "op11_periodic_runs": r"""
WITH hashed AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, xor(4294967295::BIGINT,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda s, b:
      list_reduce(list_prepend(xor(s, b), list_value(0::BIGINT, 0, 0, 0, 0, 0, 0, 0)), lambda v, _: xor(v >> 1, 3988292384::BIGINT * (v & 1))))) AS h FROM documents),
placed AS (SELECT *, (h // 10) % greatest(len(w), 1) AS a FROM hashed),
dealt AS (SELECT doc_id, CASE WHEN h % 10 = 0 THEN list_transform(range(len(w)), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (len(w) - a) // (3 + (h // 10) % 8)) END])
    ELSE w END AS w FROM placed),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i, len(w) AS n FROM dealt),
alike AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // 4),
ranked AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM alike),
stretch AS (SELECT doc_id, q, min(i) AS s, max(i) + 1 + q AS e FROM ranked GROUP BY doc_id, q, island HAVING count(*) >= greatest(3 * q, 6 - q)),
run AS (SELECT * FROM stretch r WHERE NOT EXISTS (SELECT 1 FROM stretch o WHERE o.doc_id = r.doc_id AND o.q < r.q AND o.s <= r.s AND o.e >= r.e)),
summary AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM run GROUP BY doc_id),
best AS (SELECT doc_id, s AS start, e - s AS length, q AS period FROM run r WHERE NOT EXISTS (SELECT 1 FROM run o WHERE o.doc_id = r.doc_id
    AND ((o.e - o.s) * r.q > (r.e - r.s) * o.q OR ((o.e - o.s) * r.q = (r.e - r.s) * o.q AND (o.s < r.s OR (o.s = r.s AND o.q < r.q)))))),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words w
    WHERE NOT EXISTS (SELECT 1 FROM run r WHERE r.doc_id = w.doc_id AND w.i >= r.s + r.q AND w.i < r.e) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM documents d LEFT JOIN summary ON d.doc_id = summary.doc_id LEFT JOIN best ON d.doc_id = best.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id""",
    "op13_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
used AS (SELECT t.lang, t.source, t.term, count(*) AS c FROM t JOIN kept k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
vocab AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT g.lang, g.source, coalesce(sum(u.c), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source GROUP BY ALL),
prices AS (SELECT g.lang, g.source, k.term, coalesce(u.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(u.c, 0) + 5)) // (g.n + 5 * v.v) AS p
  FROM groups g JOIN vocab v ON v.lang = g.lang JOIN kept k ON k.lang = g.lang LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source AND u.term = k.term),
whole AS (SELECT k.lang, k.term, 1 + (1000000000::HUGEINT * (sum(u.c) + 5)) // (any_value(n.n) + 5 * any_value(v.v)) AS q
  FROM kept k JOIN used u ON u.lang = k.lang AND u.term = k.term JOIN vocab v ON v.lang = k.lang JOIN (SELECT lang, sum(n) AS n FROM groups GROUP BY lang) n ON n.lang = k.lang GROUP BY ALL),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM prices a JOIN prices b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, p.p - w.q AS value FROM prices p JOIN whole w ON w.lang = p.lang AND w.term = p.term WHERE p.c > 0 AND p.p > w.q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50""",
}
