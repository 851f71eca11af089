"""Parsing of stored answers; the raw texts are derived from documents, conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing as ps
from .bridge import table
from .registry import query


def both(sql: str):
    """An expression written once for both engines."""
    return F.expr(sql.replace("VARCHAR", "STRING"))


_ID = "CAST(doc_id AS VARCHAR)"
_OBJ = f"""'{{"id": ' || {_ID} || ', "sub": {{"lang": "' || lang || '"}}}}'"""
_BRACED = f"""CASE WHEN doc_id % 4 = 0 THEN {_OBJ} WHEN doc_id % 4 = 1 THEN text || chr(10) || {_OBJ} || ' and {{"id": 0}}' WHEN doc_id % 4 = 2 THEN text || ' {{ open' ELSE text END"""
_FENCED = f"""CASE WHEN doc_id % 4 = 0 THEN text || chr(10) || '```json' || chr(10) || {_OBJ} || chr(10) || '```' || chr(10) || text WHEN doc_id % 4 = 1 THEN text || {_OBJ} || text
  WHEN doc_id % 4 = 2 THEN text || '```' || chr(10) || {_OBJ} || '``` {{x}}' ELSE 'no json here' END"""


@query("extract_json_object", f"SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN {_OBJ} END AS object FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", ps.extract_json_object(both(_BRACED)).alias("object"))


@query("extract_fenced_json", f"SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'no json here' ELSE {_OBJ} END AS json, doc_id % 4 <> 3 AS valid FROM documents")
def _(spark, sf):
    j = table(spark, sf, "documents").select("doc_id", ps.extract_fenced_json(both(_FENCED)).alias("json"))
    return j.select("doc_id", "json", ps.is_object(F.col("json")).alias("valid"))


_CODE = "CASE WHEN turn % 2 = 0 THEN text || chr(10) || '```python' || chr(10) || 'x = 1```' || text || '```' || chr(10) || 'def classify(x): return ' || CAST(turn AS VARCHAR) || chr(10) || '``` ok' ELSE text END"


@query("last_code_block", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'def classify(x): return ' || turn || chr(10) ELSE '' END AS code FROM conversations")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", ps.last_code_block(both(_CODE)).alias("code"))


_E, _U = "CAST(event_id AS VARCHAR)", "CAST(user_id AS VARCHAR)"
_ANSWER = f"""CASE event_type WHEN 'click' THEN '{{"return_msg": "m' || {_E} || '", "shared_sample_ids": [' || {_U} || ', "' || CAST(event_id % 7 AS VARCHAR) || '", -3, "x"]}}'
 WHEN 'view' THEN 'Sure:' || chr(10) || '```json' || chr(10) || '{{"return_msg": "f' || {_E} || '", "shared_sample_ids": [2]}}' || chr(10) || '``` bye'
 WHEN 'purchase' THEN 'plain {{' || {_U} || '}} text' WHEN 'signup' THEN '[1, 2]' ELSE '{{"shared_sample_ids": 4}}' END"""


@query("parse_oracle_response", f"""SELECT event_id, CASE event_type WHEN 'click' THEN 'm' || event_id WHEN 'view' THEN 'f' || event_id ELSE {_ANSWER} END AS return_msg,
  CASE event_type WHEN 'click' THEN user_id || ',' || event_id % 7 WHEN 'view' THEN '2' ELSE '' END AS ids FROM events""")
def _(spark, sf):
    r = table(spark, sf, "events").select("event_id", ps.parse_oracle_response(both(_ANSWER)).alias("r"))
    return r.select("event_id", "r.return_msg", F.array_join(F.col("r.shared_sample_ids").cast("array<string>"), ",").alias("ids"))


_ASSIGN = f"""CASE event_type WHEN 'click' THEN '{{"V0": ' || {_U} || ', "1": "2", "V2": true}}' WHEN 'view' THEN '{{"0": 3.7, "name": -1}}'
 WHEN 'purchase' THEN '{{"V0": "a' || {_E} || '"}}' WHEN 'signup' THEN 'none' ELSE '{{"V0": "2.5"}}' END"""


@query("normalize_assignment", """SELECT event_id, CASE event_type WHEN 'click' THEN 'V0=' || user_id || ',V1=2,V2=1' WHEN 'view' THEN 'V0=3,name=-1' END AS assignment,
 CASE event_type WHEN 'signup' THEN 'assignment must be an object, got none' WHEN 'purchase' THEN 'assignment value for V0 must be int-like' WHEN 'error' THEN 'assignment value for V0 must be int-like' END AS error FROM events""")
def _(spark, sf):
    r = table(spark, sf, "events").select("event_id", ps.normalize_assignment(both(_ASSIGN)).alias("r"))
    pairs = F.transform(F.array_sort(F.map_entries("r.assignment")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return r.select("event_id", F.array_join(pairs, ",").alias("assignment"), "r.error")


_REPLY = f"""CASE event_type WHEN 'click' THEN '{{"V0": 1, "V1": ' || {_U} || '}}' WHEN 'view' THEN '{{''V0'': 2, ''V1'': True}}' WHEN 'purchase' THEN 'Use this: {{0: ' || {_U} || ', 1: 0}} please'
 WHEN 'signup' THEN 'no idea' ELSE 'try {{"V0": "x"}}' END"""


@query("parse_assignment_response", """SELECT event_id, CASE event_type WHEN 'click' THEN 'V0=1,V1=' || user_id WHEN 'view' THEN 'V0=2,V1=1' WHEN 'purchase' THEN 'V0=' || user_id || ',V1=0' END AS assignment,
 event_type IN ('signup', 'error') AS failed FROM events""")
def _(spark, sf):
    r = table(spark, sf, "events").select("event_id", ps.parse_assignment_response(both(_REPLY)).alias("r"))
    pairs = F.transform(F.array_sort(F.map_entries("r.assignment")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return r.select("event_id", F.array_join(pairs, ",").alias("assignment"), F.col("r.error").isNotNull().alias("failed"))


_CALL = f"""CASE event_type WHEN 'click' THEN '{{"id": "c' || {_E} || '", "function": {{"name": "run_experiment", "arguments": "{{\\\\"V0\\\\": ' || {_U} || '}}"}}}}'
 WHEN 'view' THEN '{{"id": "c1", "function": {{"name": "evaluate_theory", "arguments": {{"theory": "t' || {_U} || '"}}}}}}' WHEN 'purchase' THEN '{{"function": {{"name": "run", "arguments": "oops"}}}}'
 WHEN 'signup' THEN '{{"function": {{"arguments": "{{}}"}}}}' ELSE '{{"function": "f"}}' END"""


@query("parse_tool_call", """SELECT event_id, CASE event_type WHEN 'click' THEN 'run_experiment' WHEN 'view' THEN 'evaluate_theory' WHEN 'purchase' THEN 'run' END AS name,
 CASE event_type WHEN 'click' THEN 'V0=' || user_id WHEN 'view' THEN 'theory=t' || user_id ELSE '' END AS args,
 CASE event_type WHEN 'purchase' THEN 'Failed to parse tool call arguments as JSON. Raw: oops' WHEN 'signup' THEN 'Malformed tool call: ''function.name'' is missing.'
  WHEN 'error' THEN 'Malformed tool call: ''function'' field is missing or not an object.' END AS error FROM events""")
def _(spark, sf):
    r = table(spark, sf, "events").select("event_id", ps.parse_tool_call(both(_CALL)).alias("r"))
    args = F.array_join(F.transform(F.map_entries("r.args"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return r.select("event_id", "r.name", args.alias("args"), "r.error")


_MESSAGE = f"""CASE event_type WHEN 'click' THEN '{{"choices": [{{"message": {{"content": "a' || {_E} || '", "tool_calls": [{{"id": "x", "function": {{"name": "run", "arguments": "{{}}"}}}}, {{"tool_name": "t' || {_U} || '"}}]}}}}]}}'
 WHEN 'view' THEN '{{"message": "b' || {_E} || '"}}' WHEN 'purchase' THEN '{{"output_text": "c' || {_E} || '", "text": 4}}' WHEN 'signup' THEN '{{"choices": [{{"text": "d' || {_E} || '"}}]}}' ELSE '{{"other": 1}}' END"""


@query("normalize_message", """SELECT event_id, CASE event_type WHEN 'click' THEN 'a' || event_id WHEN 'view' THEN 'b' || event_id WHEN 'purchase' THEN 'c' || event_id WHEN 'signup' THEN 'd' || event_id END AS content,
 CASE WHEN event_type = 'click' THEN 'x:function:run:{};call_1:function:t' || user_id || ':{}' ELSE '' END AS calls FROM events""")
def _(spark, sf):
    r = table(spark, sf, "events").select("event_id", ps.normalize_message(both(_MESSAGE)).alias("r"))
    calls = F.transform("r.tool_calls", lambda c: F.concat_ws(":", c["id"], c["type"], c["name"], c["arguments"]))
    return r.select("event_id", "r.content", F.coalesce(F.array_join(calls, ";"), F.lit("")).alias("calls"))


_PAYLOAD = f"""CASE event_type WHEN 'click' THEN '{{"choices": [{{"message": {{"content": "def classify(x): ' || {_E} || '"}}}}], "usage": {{"error": "late"}}}}' WHEN 'view' THEN '{{"choices": []}}'
 WHEN 'purchase' THEN '{{"choices": [{{"message": "m"}}]}}' WHEN 'signup' THEN '{{"choices": [{{"message": {{"content": " Error: ' || {_U} || '"}}}}]}}' ELSE '{{"choices": [{{"message": {{"content": null, "tool_calls": []}}}}]}}' END"""


@query("response_checks", """SELECT event_id, CASE event_type WHEN 'click' THEN 'usage contains error: late' WHEN 'view' THEN 'response must include a non-empty choices list' WHEN 'purchase' THEN 'choices[0].message must be an object'
 WHEN 'signup' THEN CASE WHEN event_id % 3 = 0 THEN '' ELSE 'assistant content must not be an Error response' END || CASE WHEN event_id % 3 = 1 THEN ';classifier codegen response must include def classify' ELSE '' END
 ELSE CASE WHEN event_id % 3 = 0 THEN 'tool-call response must include content or tool_calls' ELSE 'assistant content must be a non-empty string' END || CASE WHEN event_id % 3 = 1 THEN ';classifier codegen response must include def classify' ELSE '' END END AS reasons FROM events""")
def _(spark, sf):
    kind = F.when(F.col("event_id") % 3 == 0, "tool_call").when(F.col("event_id") % 3 == 1, "classifier_codegen").otherwise("chat")
    return table(spark, sf, "events").select("event_id", F.array_join(ps.response_checks(both(_PAYLOAD), kind), ";").alias("reasons"))


_RANGE = f"""CASE event_type WHEN 'click' THEN '{{"min": 1, "max": ' || {_U} || ', "unit": "km"}}' WHEN 'view' THEN '[0, "' || {_U} || '", "m"]' WHEN 'purchase' THEN '[1]' WHEN 'signup' THEN '{{"min": "a", "max": 2}}' END"""


@query("normalize_value_range", """SELECT event_id, CASE WHEN event_type = 'click' AND user_id > 1 THEN 1 WHEN event_type = 'view' AND user_id > 0 THEN 0 END::DOUBLE AS min,
 CASE WHEN event_type = 'click' AND user_id > 1 OR event_type = 'view' AND user_id > 0 THEN user_id END::DOUBLE AS max, CASE WHEN event_type = 'click' AND user_id > 1 THEN 'km' WHEN event_type = 'view' AND user_id > 0 THEN 'm' END AS unit,
 CASE event_type WHEN 'error' THEN 'value_range missing' WHEN 'purchase' THEN 'value_range list must have at least two entries' WHEN 'signup' THEN 'value_range min/max must be numeric'
  WHEN 'click' THEN CASE WHEN user_id <= 1 THEN 'value_range max must be greater than min' END ELSE CASE WHEN user_id <= 0 THEN 'value_range max must be greater than min' END END AS error FROM events""")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", ps.normalize_value_range(both(_RANGE)).alias("r")).select("event_id", "r.*")
