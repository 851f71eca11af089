"""Parsing stored responses, tool calls and JSON fragments as columns; nothing here raises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import let

def extract_json_object(text: Column) -> Column:
    """The whole text when it is braced, else its first balanced ``{...}``; null when there is none.

    From the first opening brace on, the text is cut behind every closing one. A piece has so many
    openings and one closing; the object ends with the first piece up to which they balance.
    """
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")

    def cut(t: Column) -> Column:
        pieces = F.regexp_extract_all(F.substr(t, F.greatest(F.locate("{", t), F.lit(1))), F.lit(r"([^}]*\})"), 1)
        start = F.struct(F.lit(0).alias("depth"), F.lit(0).cast("int").alias("pieces"), F.lit(False).alias("done"))

        def step(a: Column, p: Column) -> Column:
            depth = a["depth"] + F.length(F.regexp_replace(p, r"[^{]", "")) - 1
            return F.when(a["done"], a).otherwise(F.struct(depth.alias("depth"), (a["pieces"] + 1).alias("pieces"), (depth == 0).alias("done")))

        found = F.aggregate(pieces, start, step)
        body = F.when(found["done"], F.array_join(F.slice(pieces, F.lit(1), found["pieces"]), ""))
        whole = t.startswith("{") & t.endswith("}")
        return F.when(whole, t).when(F.locate("{", t) > 0, body)

    return let(trimmed, cut)


def is_object(text: Column) -> Column:
    t = F.trim(text)
    return F.coalesce(t.startswith("{") & F.try_parse_json(text).isNotNull(), F.lit(False))


def extract_fenced_json(text: Column) -> Column:
    """A fenced JSON object, else the part from the first ``{`` to the last ``}``, else the text."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    first = F.locate("{", text)
    last = F.length(text) - F.locate("}", F.reverse(text)) + 1
    braced = F.when((first > 0) & F.contains(text, F.lit("}")), F.substring(text, first, F.greatest(last - first + 1, F.lit(0))))
    return F.when(fenced != "", fenced).otherwise(F.coalesce(braced, F.trim(text)))


def last_code_block(text: Column) -> Column:
    """Content of the last fenced block, '' if there is none."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?is)```(?:python)?\s*(.*?)```"), 1)
    return F.coalesce(F.try_element_at(blocks, F.lit(-1)), F.lit(""))


def _whole(text: Column) -> Column:
    t = F.trim(text)
    return F.when(t.rlike(r"^[+-]?[0-9]+(\.[0-9]*)?$"), F.regexp_replace(t, r"\..*$", "").try_cast("int"))


def parse_oracle_response(raw: Column) -> Column:
    """struct<return_msg, shared_sample_ids>: a JSON answer (plain or fenced), else the raw text.

    Ids that are not whole and non-negative are dropped.
    """
    fenced = F.trim(F.regexp_extract(raw, r"(?is)```(?:json)?\s*(.*?)```", 1))
    answer = F.when(F.try_parse_json(raw).isNotNull(), F.when(is_object(raw), raw)).when(is_object(fenced), fenced)

    def build(body: Column) -> Column:
        p = F.from_json(body["answer"], "return_msg STRING, shared_sample_ids ARRAY<STRING>")
        ids = F.filter(F.transform(p["shared_sample_ids"], _whole), lambda i: i >= 0)
        return F.struct(F.coalesce(p["return_msg"], body["raw"]).alias("return_msg"),
                        F.coalesce(ids, F.expr("CAST(array() AS ARRAY<INT>)")).alias("shared_sample_ids"))

    return let(F.struct(raw.alias("raw"), answer.alias("answer")), build)


def normalize_assignment(text: Column) -> Column:
    """struct<assignment, error>: JSON text of an assignment as map<string, int>.

    Keys ``0``, ``"0"`` and ``V0`` mean ``V0``; values are whole numbers, booleans, digits in
    quotes, or fractions cut to their whole part; any other value is an error.
    """
    def number(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        s = F.trim(F.try_variant_get(v, "$", "string"))
        return (F.when(kind == "STRING", F.when(s.rlike("^[+-]?[0-9]+$"), s.try_cast("int")))
                .when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("int"))
                .otherwise(F.try_variant_get(v, "$", "double").try_cast("int")))

    def key(k: Column) -> Column:
        n = F.when(k.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(k).try_cast("long"))
        return F.when(n.isNotNull(), F.concat(F.lit("V"), n.cast("string"))).otherwise(k)

    def build(b: Column) -> Column:
        entries = F.transform(F.map_entries(b["m"]), lambda e: F.struct(key(e["key"]).alias("key"), number(e["value"]).alias("value")))
        return let(F.struct(b["t"].alias("t"), entries.alias("e")), finish)

    def finish(b: Column) -> Column:
        bad = F.filter(b["e"], lambda e: e["value"].isNull())
        error = (F.when(b["e"].isNull(), F.concat(F.lit("assignment must be an object, got "), F.coalesce(b["t"], F.lit("null"))))
                 .when(F.size(bad) > 0, F.concat(F.lit("assignment value for "), F.get(bad, F.lit(0))["key"], F.lit(" must be int-like"))))
        return F.struct(F.when(F.size(bad) == 0, F.map_from_entries(b["e"])).alias("assignment"), error.alias("error"))

    parsed = F.when(is_object(text), F.from_json(text, "MAP<STRING, VARIANT>"))
    return let(F.struct(text.alias("t"), parsed.alias("m")), build)


def parse_assignment_response(raw: Column) -> Column:
    """As normalize_assignment, of an answer that is JSON, a quoted literal, or holds one in braces."""
    def as_json(t: Column) -> Column:
        swapped = F.regexp_replace(F.regexp_replace(F.replace(t, F.lit("'"), F.lit('"')), r"\bTrue\b", "true"), r"\bFalse\b", "false")
        bare = F.regexp_replace(swapped, r"([{,]\s*)(-?[0-9]+)(\s*:)", '$1"$2"$3')
        return F.when(is_object(t), t).when(is_object(bare), bare)

    inner = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    return normalize_assignment(F.coalesce(as_json(raw), as_json(inner)))


TOOL_CALL = ("STRUCT<id STRING, call_id STRING, type STRING, name STRING, tool_name STRING, arguments STRING, "
             "function STRUCT<name STRING, arguments STRING>>")


def parse_tool_call(call: Column) -> Column:
    """struct<name, args, error> of a tool call's JSON; args is JSON text with double encoding undone."""
    fn = F.get_json_object(call, "$.function")
    name = F.get_json_object(call, "$.function.name")
    raw = F.coalesce(F.get_json_object(call, "$.function.arguments"), F.lit("{}"))

    def build(b: Column) -> Column:
        broken = b["fn"].isNull() | ~F.trim(b["fn"]).startswith("{")
        text = F.when(b["raw"] == "", F.lit("{}")).otherwise(b["raw"])
        ok = is_object(text)
        no_name = F.when(b["name"].isNull() | (b["name"] == ""), F.lit("Malformed tool call: 'function.name' is missing."))
        no_json = F.when(~ok, F.concat(F.lit("Failed to parse tool call arguments as JSON. Raw: "), text))
        both = F.concat_ws(" | ", no_name, no_json)
        error = F.when(broken, F.lit("Malformed tool call: 'function' field is missing or not an object.")).when(both != "", both)
        inner = F.transform_values(F.from_json(text, "MAP<STRING, STRING>"), lambda k, v: v)
        return F.struct(F.when(~broken, b["name"]).alias("name"),
                        F.when(broken | ~ok, F.expr("CAST(map() AS MAP<STRING, STRING>)")).otherwise(inner).alias("args"), error.alias("error"))

    return let(F.struct(fn.alias("fn"), name.alias("name"), raw.alias("raw")), build)


def normalize_tool_calls(calls: Column) -> Column:
    """array<struct<id, type, name, arguments>> of a tool_calls JSON array; null when empty."""
    parsed = F.from_json(calls, f"ARRAY<{TOOL_CALL}>")
    rows = F.transform(F.filter(parsed, lambda c: c.isNotNull()), lambda c, i: F.struct(
        F.coalesce(c["id"], c["call_id"], F.concat(F.lit("call_"), i.cast("string"))).alias("id"),
        F.coalesce(c["type"], F.lit("function")).alias("type"),
        F.when(c["function"].isNotNull(), c["function"]["name"]).otherwise(F.coalesce(c["name"], c["tool_name"])).alias("name"),
        F.coalesce(F.when(c["function"].isNotNull(), c["function"]["arguments"]).otherwise(c["arguments"]), F.lit("{}")).alias("arguments")))
    return F.when(F.size(rows) > 0, rows)


def _string_at(body: Column, path: str) -> Column:
    """The value at a path when it is JSON text (a string), else null."""
    v = F.try_variant_get(F.try_parse_json(body), path, "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def normalize_message(response: Column) -> Column:
    """struct<content, tool_calls> of a stored response of any supported shape.

    The first of choices[0].message, choices[0].text, message (object or text), reply, content,
    text, response and output_text counts.
    """
    def build(b: Column) -> Column:
        r = b["r"]
        chosen, message = F.get_json_object(r, "$.choices[0].message"), F.get_json_object(r, "$.message")
        obj = F.when(is_object(chosen), chosen).when(
            _string_at(r, "$.choices[0].text").isNull() & is_object(message), message)
        loose = F.coalesce(_string_at(r, "$.choices[0].text"), _string_at(r, "$.message"))
        plain = F.coalesce(*[_string_at(r, f"$.{k}") for k in ("reply", "content", "text", "response", "output_text")])
        content = F.when(obj.isNotNull(), F.get_json_object(obj, "$.content")).otherwise(F.coalesce(loose, plain))
        calls = F.when(obj.isNotNull(), F.get_json_object(obj, "$.tool_calls")).when(loose.isNull(), F.get_json_object(r, "$.tool_calls"))
        return F.struct(content.alias("content"), normalize_tool_calls(calls).alias("tool_calls"))

    return let(F.struct(response.alias("r")), build)


def response_checks(payload: Column, kind: Column) -> Column:
    """Reasons why a stored response is malformed; an empty list means it is fine."""
    def build(b: Column) -> Column:
        first = F.get_json_object(b["p"], "$.choices[0]")
        message = F.get_json_object(b["p"], "$.choices[0].message")
        content = F.get_json_object(b["p"], "$.choices[0].message.content")
        calls = F.get_json_object(b["p"], "$.choices[0].message.tool_calls")
        has_message = is_object(message)
        tool = b["k"] == "tool_call"
        reasons = F.array(
            F.when(first.isNull(), F.lit("response must include a non-empty choices list")),
            F.when(first.isNotNull() & ~has_message, F.lit("choices[0].message must be an object")),
            F.when(has_message & tool & content.isNull() & (calls.isNull() | (calls == "[]")),
                   F.lit("tool-call response must include content or tool_calls")),
            F.when(has_message & ~tool & (F.trim(F.coalesce(content, F.lit(""))) == ""), F.lit("assistant content must be a non-empty string")),
            F.when(has_message & ~tool & F.trim(content).startswith("Error:"), F.lit("assistant content must not be an Error response")),
            F.when(has_message & F.get_json_object(b["p"], "$.usage.error").isNotNull(),
                   F.concat(F.lit("usage contains error: "), F.get_json_object(b["p"], "$.usage.error"))),
            F.when(has_message & (b["k"] == "classifier_codegen") & ~F.coalesce(F.contains(content, F.lit("def classify")), F.lit(False)),
                   F.lit("classifier codegen response must include def classify")))
        return F.filter(reasons, lambda r: r.isNotNull())

    return let(F.struct(payload.alias("p"), kind.alias("k")), build)


def normalize_value_range(raw: Column) -> Column:
    """struct<min, max, unit, error> of a range given as an object or as a list of two or three."""
    def build(b: Column) -> Column:
        r = b["r"]
        listed = F.trim(r).startswith("[")
        o = F.from_json(r, "min STRING, max STRING, unit STRING")
        a = F.from_json(r, "ARRAY<STRING>")
        lo = F.when(listed, F.get(a, F.lit(0))).otherwise(o["min"]).try_cast("double")
        hi = F.when(listed, F.get(a, F.lit(1))).otherwise(o["max"]).try_cast("double")
        unit = F.when(listed, F.get(a, F.lit(2))).otherwise(o["unit"])
        error = (F.when(r.isNull(), F.lit("value_range missing"))
                 .when(listed & (F.size(a) < 2), F.lit("value_range list must have at least two entries"))
                 .when(lo.isNull() | hi.isNull(), F.lit("value_range min/max must be numeric"))
                 .when(hi <= lo, F.lit("value_range max must be greater than min")))
        return F.struct(F.when(error.isNull(), lo).alias("min"), F.when(error.isNull(), hi).alias("max"),
                        F.when(error.isNull() & (unit != ""), unit).alias("unit"), error.alias("error"))

    return let(F.struct(raw.alias("r")), build)
