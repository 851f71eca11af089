"""Chats from event logs: fold streamed deltas, edits and regenerations into final messages, render
them with a turn template, and read the template back. DataFrame functions only.

An event is (conversation, sequence number, message, kind, role, text). Kinds: ``message`` and
``edit`` set the message's text, ``regenerate`` empties it (a null text), ``delta`` adds to it. A
message stands where its first event stands. Its role is the last one that an event names.

Template: ``<turn ROLE>`` newline, text, ``</turn>`` newline. Inside role and text the characters
``& < >`` are written as entities, so no text can open or close a turn, and the template can be
read back exactly.

Cases: a null text or role is empty; an unknown kind counts as ``message``; a null conversation,
sequence number or message is a value of its own (sequence numbers: before all others). Events with equal
sequence numbers are taken by kind, text and role, so repeated rows of one message set the same
text again (and repeat a delta). Folding goes by blocks of the sequence and rendering by
parts of a conversation, so a conversation or message of any length is spread over tasks; only a digest over
a whole conversation needs its text in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64   # sequence numbers folded or rendered together
OPEN, SHUT, CLOSE = "<turn ", ">\n", "</turn>\n"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">"))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def _folded(steps: Column) -> Column:
    """Fold sorted steps (sets, text, role): texts from the last setting step on, joined."""
    last = F.coalesce(F.array_max(F.transform(steps, lambda s, i: F.when(s["sets"], i + 1))), F.lit(0))
    tail = F.slice(steps, F.greatest(last, F.lit(1)), F.size(steps))
    roles = F.filter(steps, lambda s: s["role"].isNotNull())
    return F.struct((last > 0).alias("sets"), F.array_join(F.transform(tail, lambda s: s["text"]), "").alias("text"),
                    F.when(F.size(roles) > 0, F.element_at(roles, -1)["role"]).alias("role"))


def fold(events: DataFrame, conv: str = "conv_id", seq: str = "seq", message: str = "message", kind: str = "kind",
         role: str = "role", text: str = "text") -> DataFrame:
    """(conv, position, message, role, text): one row per final message."""
    block = F.floor(F.col(seq) / BLOCK)
    event = F.struct(F.col(seq).alias("seq"), F.coalesce(F.col(kind), F.lit("message")).alias("kind"),
                     F.when(F.col(kind) == "regenerate", F.lit("")).otherwise(F.coalesce(F.col(text), F.lit(""))).alias("text"), F.col(role).alias("role"))
    blocks = (events.select(F.col(conv).alias("conv"), F.col(message).alias("message"), block.alias("block"), event.alias("event"))
              .groupBy("conv", "message", "block").agg(F.sort_array(F.collect_list("event")).alias("events"))
              .select("conv", "message", "block", F.col("events")[0]["seq"].alias("seq"),
                      _folded(F.transform("events", lambda e: F.struct((e["kind"] != "delta").alias("sets"), e["text"].alias("text"), e["role"].alias("role")))).alias("step")))
    return (blocks.groupBy("conv", "message").agg(F.sort_array(F.collect_list(F.struct("block", "seq", "step"))).alias("blocks"))
            .select("conv", F.col("blocks")[0]["seq"].alias("position"), "message", _folded(F.transform("blocks", lambda b: b["step"])).alias("done"))
            .select("conv", "position", "message", F.coalesce("done.role", F.lit("")).alias("role"), F.col("done.text").alias("text")))


def render(messages: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv, part, formatted, loss): a conversation's text in parts that follow each other, and the
    spans (start, size in characters) of the texts to learn from, within the part."""
    turn = F.struct("position", "message", F.col("role").isin(*learn).alias("learn"), escape(F.col("role")).alias("role"), escape(F.col("text")).alias("text"))
    parts = (messages.select("conv", F.floor(F.col("position") / BLOCK).alias("part"), turn.alias("turn"))
             .groupBy("conv", "part").agg(F.sort_array(F.collect_list("turn")).alias("turns")))
    head = lambda t: F.length(t["role"]) + len(OPEN) + len(SHUT)
    sizes = F.transform("turns", lambda t: head(t) + F.length(t["text"]) + len(CLOSE))
    parts = parts.withColumn("sizes", sizes)
    before = lambda i: F.aggregate(F.slice("sizes", 1, i), F.lit(0), lambda a, x: a + x)
    spans = F.transform("turns", lambda t, i: F.struct((before(i) + head(t)).alias("start"), F.length(t["text"]).alias("size"), t["learn"].alias("learn")))
    return parts.select("conv", "part",
                        F.array_join(F.transform("turns", lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(SHUT), t["text"], F.lit(CLOSE))), "").alias("formatted"),
                        F.transform(F.filter(spans, lambda s: s["learn"]), lambda s: F.struct(s["start"].alias("start"), s["size"].alias("size"))).alias("loss"))


def read_back(rendered: DataFrame) -> DataFrame:
    """(conv, part, turns, learned): turns (role, text) parsed from the formatted text, and the
    unescaped texts under the loss spans."""
    whole = F.split("formatted", CLOSE, -1)
    turns = rendered.withColumn("__turns", F.slice(whole, 1, F.size(whole) - 1))
    parse = lambda t: F.struct(
        unescape(F.substr(F.substring_index(t, SHUT, 1), F.lit(len(OPEN) + 1))).alias("role"),
        unescape(F.substr(t, F.length(F.substring_index(t, SHUT, 1)) + F.lit(len(SHUT) + 1))).alias("text"))
    learned = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["size"])))
    return turns.select("conv", "part", F.transform("__turns", parse).alias("turns"), learned.alias("learned"), F.length("formatted").alias("chars"))


def digests(rendered: DataFrame) -> DataFrame:
    """Per conversation, from what is read back: turns, characters and digests."""
    back = read_back(rendered).select(
        "conv", "part", F.size("turns").alias("n"), "chars",
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        F.array_join("learned", "").alias("learned"))
    whole = back.groupBy("conv").agg(F.sum("n").cast("long").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"),
                                     F.sort_array(F.collect_list(F.struct("part", "said", "learned"))).alias("parts"))
    joined = lambda name: F.array_join(F.transform("parts", lambda p: p[name]), "")
    return whole.select("conv", "n_turns", F.sha2(joined("said"), 256).alias("turns_sha256"), F.length(joined("learned")).cast("long").alias("loss_chars"),
                        F.sha2(joined("learned"), 256).alias("loss_sha256"), "formatted_chars")
