"""Conversations and logged tool calls: counts, endings, budgets, deliveries.

A session may hold any share of the rows, so per-session state is expressed as running
aggregates over chunks and never as a fold over a whole session.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import cut_lineage, stored
from .ordered import position_chunk, running


def latest_user_message(df: DataFrame, keys: Sequence[str], turn: str, role: str, text: str, name: str) -> DataFrame:
    """Text of the last user turn of each conversation, '' if there is none."""
    user = F.col(role) == "user"
    latest = F.max_by(F.when(user, F.col(text)), F.when(user, F.col(turn)))
    return df.groupBy(*keys).agg(F.coalesce(latest, F.lit("")).alias(name))


# fixed values: cost of a tool call by tool name; any other tool costs 1
TOOL_COSTS = {"run_experiment": 1, "run_textual_experiment": 1, "evaluate_theory": 5,
              "derive_numerical_regression": 1, "derive_categorical_logic": 1}


def tool_cost(name: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TOOL_COSTS.items() for x in kv]), name), F.lit(1))


def _piece(lo: Column, hi: Column, v: Column, k: Column) -> Column:
    """Budgets lo <= b < hi of a budget map, which leaves v + k * (b - lo) of them (k is 0 or 1)."""
    return F.struct(lo.alias("lo"), hi.alias("hi"), v.alias("v"), k.alias("k"))


def _merged(pieces: Column) -> Column:
    """Neighbours that leave the same constant as one piece; a single budget is a constant."""
    flat = F.transform(pieces, lambda p: F.when(p["hi"] - p["lo"] == 1, _piece(p["lo"], p["hi"], p["v"], F.lit(0))).otherwise(p))

    def add(done: Column, p: Column) -> Column:
        last = F.element_at(done, -1)
        same = (F.size(done) > 0) & (p["k"] == 0) & (F.try_element_at(done, F.lit(-1))["k"] == 0) & (F.try_element_at(done, F.lit(-1))["v"] == p["v"])
        return F.when(same, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(_piece(last["lo"], p["hi"], p["v"], F.lit(0))))).otherwise(F.concat(done, F.array(p)))

    return F.aggregate(flat, F.slice(flat, 1, 0), add)


def _after_call(pieces: Column, cost: Column) -> Column:
    """A budget map followed by one call: who has as much as the cost pays it."""
    def part(p: Column) -> Column:
        turn = p["lo"] + cost - p["v"]  # the first budget that can pay
        pays = _piece(p["lo"], p["hi"], p["v"] - cost, p["k"])
        split = F.array(_piece(p["lo"], turn, p["v"], p["k"]), _piece(turn, p["hi"], F.lit(0).cast("long"), p["k"]))
        return F.when(p["v"] >= cost, F.array(pays)).when((p["k"] == 0) | (turn >= p["hi"]), F.array(p)).otherwise(split)

    return F.flatten(F.transform(pieces, part))


def _followed(first: Column, then: Column) -> Column:
    """One budget map after the other."""
    def part(p: Column) -> Column:
        end = p["v"] + F.when(p["k"] == 0, 1).otherwise(p["hi"] - p["lo"])  # what it leaves lies in [v, end)
        meet = F.filter(then, lambda q: (q["lo"] < end) & (q["hi"] > p["v"]))
        begin = lambda q: F.greatest(q["lo"], p["v"])
        return F.transform(meet, lambda q: _piece(
            p["lo"] + begin(q) - p["v"], F.when(p["k"] == 0, p["hi"]).otherwise(p["lo"] + F.least(q["hi"], end) - p["v"]),
            q["v"] + q["k"] * (begin(q) - q["lo"]), p["k"] * q["k"]))

    return _merged(F.flatten(F.transform(first, part)))


def _left_after(pieces: Column, budget: Column) -> Column:
    """What a map leaves of a budget; none is unlimited, and a negative one pays nothing."""
    mine = F.filter(pieces, lambda p: (p["lo"] <= budget) & (budget < p["hi"]))
    return F.coalesce(F.get(F.transform(mine, lambda p: p["v"] + p["k"] * (budget - p["lo"])), F.lit(0)), budget)


def budget_ledger(calls: DataFrame, keys: Sequence[str], pos: str, cost: str, runnable: str, budget: str,
                  costs: Sequence[int] | None = None, rows: int = 64) -> DataFrame:
    """Charge calls in order against a budget per session; add ``outcome``, ``charged`` and ``left``.

    A call that is not runnable is free; one dearer than what is left is rejected and costs
    nothing; a null budget is unlimited. Positions are whole numbers, each once in a session. If
    ``costs`` is given, a positive cost of a runnable call that it does not list ends the job with an error.

    The rule is no prefix sum, but what a stretch of calls does is a map from the budget before to the budget
    after, and maps compose. ``rows`` positions make a stretch, ``rows`` stretches a longer one, and so on up to the
    whole session: maps are composed on the way up, and on the way down each stretch learns what it begins with,
    until the calls of the shortest are charged. So any costs, any budgets and sessions of any length need
    two passes over stretches (one, without maps, if all positions fit into one), and nothing holds more
    than ``rows`` calls or maps. A map is a list of ranges of budgets that fare alike, never more than budget + 1.
    """
    keys = list(keys)
    pays = F.coalesce(F.col(runnable) & (F.col(cost) > 0), F.lit(False))
    price = F.when(pays, F.col(cost).cast("long"))
    if costs is not None:
        price = F.when(pays & ~F.col(cost).isin(*costs), F.raise_error(F.concat(F.lit("a cost that is not listed: "), F.col(cost).cast("string"))).cast("long")).otherwise(price)
    low, high = calls.agg(F.min(pos), F.max(pos)).first()
    levels, reach = 1, rows
    while low is not None and high - low >= reach:
        levels, reach = levels + 1, reach * rows
    up = lambda at: F.call_function("div", at, F.lit(rows).cast("long"))
    place = F.col(pos).cast("long") - F.lit(low or 0).cast("long")
    in_order = lambda items: F.array_sort(items, lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0))
    call = F.struct(place.alias("at"), price.alias("c"), F.struct(*[F.col(x) for x in calls.columns]).alias("row"))
    leaves = (calls.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], up(place).alias("__node"), call.alias("__call"), F.col(budget).cast("long").alias("__budget"))
              .groupBy(*[f"__k{i}" for i in range(len(keys))], "__node").agg(in_order(F.collect_list("__call")).alias("__calls"), F.max("__budget").alias("__budget")))
    owner = [f"__k{i}" for i in range(len(keys))]
    if levels == 1:
        started = leaves.withColumn("__start", F.col("__budget"))
    else:
        leaves = stored(leaves, "calls")
        whole = F.array(_piece(F.lit(0).cast("long"), F.col("__budget") + 1, F.lit(0).cast("long"), F.lit(1)))
        fold = F.aggregate("__calls", whole, lambda m, x: F.when(x["c"].isNull(), m).otherwise(_after_call(m, x["c"])))
        maps = leaves.where("__budget >= 0").withColumn("__map", fold).select(*owner, "__node", "__budget", _merged(F.col("__map")).alias("__map"))
        steps = []  # per level: (owner, parent, children in order with their maps)
        for level in range(1, levels):
            parent = (maps.select(*owner, up(F.col("__node")).alias("__parent"), F.struct(F.col("__node").alias("at"), F.col("__map").alias("m")).alias("__child"), "__budget")
                      .groupBy(*owner, "__parent").agg(in_order(F.collect_list("__child")).alias("__children"), F.max("__budget").alias("__budget")))
            steps.append(stored(parent, "stretches"))
            if level < levels - 1:
                joined = F.aggregate(F.slice("__children", F.lit(2), F.size("__children")), F.col("__children")[0]["m"], lambda m, x: _followed(m, x["m"]))
                maps = steps[-1].select(*owner, F.col("__parent").alias("__node"), "__budget", joined.alias("__map"))
        start = None
        for level in reversed(steps):  # what each stretch begins with, from the whole session down
            known = level.withColumn("__start", F.col("__budget")) if start is None else _same(level, start, owner, "__parent")
            empty = F.struct(F.col("__start").alias("b"), F.array().cast("array<struct<at:bigint,b:bigint>>").alias("out"))
            begins = F.aggregate("__children", empty, lambda s, x: F.struct(_left_after(x["m"], s["b"]).alias("b"), F.concat(
                s["out"], F.array(F.struct(x["at"].alias("at"), s["b"].alias("b")))).alias("out")), lambda s: s["out"])
            start = known.select(*owner, F.explode(begins).alias("__s")).select(*owner, F.col("__s.at").alias("__parent"), F.col("__s.b").alias("__start"))
        # unlimited and negative budgets have no maps: they stay as they are
        started = _same(leaves, start, owner, "__node", "left").withColumn("__start", F.when(F.col("__budget") >= 0, F.col("__start")).otherwise(F.col("__budget")))
    dear = lambda s, x: F.coalesce(x["c"] > s["b"], F.lit(False))
    entry = lambda s, x: F.struct(
        x["row"].alias("row"), F.when(x["c"].isNull(), "free").when(dear(s, x), "rejected").otherwise("charged").alias("outcome"),
        F.when(x["c"].isNull() | dear(s, x), 0).otherwise(x["c"]).cast("long").alias("charged"))
    paid = lambda s, x: s["b"] - entry(s, x)["charged"]
    line = lambda s, x: F.struct(entry(s, x)["row"].alias("row"), entry(s, x)["outcome"].alias("outcome"), entry(s, x)["charged"].alias("charged"), paid(s, x).alias("left"))
    none = F.slice(F.transform("__calls", lambda x: F.struct(x["row"].alias("row"), F.lit("").alias("outcome"), F.lit(0).cast("long").alias("charged"), F.col("__start").alias("left"))), 1, 0)
    done = F.aggregate("__calls", F.struct(F.col("__start").alias("b"), none.alias("out")),
                       lambda s, x: F.struct(paid(s, x).alias("b"), F.concat(s["out"], F.array(line(s, x))).alias("out")), lambda s: s["out"])
    return started.select(F.explode(done).alias("__d")).select("__d.row.*", "__d.outcome", "__d.charged", "__d.left")


def _same(nodes: DataFrame, starts: DataFrame, owner: Sequence[str], node: str, how: str = "inner") -> DataFrame:
    """Nodes with what they begin with; null keys match."""
    left, right = nodes.alias("__l"), starts.alias("__r")
    cond = F.col(f"__l.{node}") == F.col("__r.__parent")
    for k in owner:
        cond = cond & F.col(f"__l.{k}").eqNullSafe(F.col(f"__r.{k}"))
    return left.join(right, cond, how).select("__l.*", F.col("__r.__start").alias("__start"))


def experiment_index(experiments: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """Running experiment number per session."""
    return running(experiments, keys, [pos], position_chunk(F.col(pos)), {"experiment_index": ("sum", F.lit(1).cast("long"))})


def submission_gate(rows: DataFrame, keys: Sequence[str], pos: str, is_experiment: Column, minimum: int) -> DataFrame:
    """For every row: experiments done so far, how many are missing, and whether a theory is accepted."""
    counted = running(rows, keys, [pos], position_chunk(F.col(pos)), {"completed": ("sum", is_experiment.cast("long"))})
    missing = F.greatest(F.lit(0).cast("long"), F.lit(minimum) - F.col("completed"))
    return counted.withColumn("remaining", missing).withColumn("accepted", missing == 0)


def turn_status(turns: DataFrame, turn: str, max_turns: int, left: Column) -> DataFrame:
    """Turns left, final-turn flag and the status line of every turn (0-based turn numbers)."""
    remaining = F.lit(max_turns) - F.col(turn)
    line = F.concat(F.lit("[Session status] Turns left: "), remaining.cast("string"), F.lit("; Experiments left: "),
                    F.when(left.isNull(), F.lit("unlimited")).otherwise(F.greatest(left, F.lit(0)).cast("string")), F.lit("."))
    last = (" This is the final turn; your answer to this message will be interpreted as the final theory.")
    return turns.withColumns({"turns_left": remaining, "final_turn": remaining == 1,
                              "status": F.concat(line, F.when(remaining == 1, F.lit(last)).otherwise(F.lit("")))})


def first_seen_ids(shared: DataFrame, keys: Sequence[str], order: Sequence[str], id_: str) -> DataFrame:
    """First occurrence of every shared id per session."""
    return shared.groupBy(*keys, id_).agg(F.min(F.struct(*order)).alias("f")).select(*keys, id_, "f.*")


def session_termination(turns: DataFrame, keys: Sequence[str], turn: str, error: Column, has_calls: Column,
                        submitted: Column, max_turns: int, end_without_calls: bool = True, max_errors: int = 3) -> DataFrame:
    """Why each session ended, and at which turn.

    An error turn (an error text and no calls) ends the session only beyond ``max_errors``.
    """
    counted = running(turns.withColumn("__e", error & ~has_calls), keys, [turn], position_chunk(F.col(turn)),
                      {"__errors": ("sum", F.col("__e").cast("long"))})
    quiet = ~has_calls & ~F.col("__e")
    reason = F.when(F.col("__e") & (F.col("__errors") > max_errors), "llm_error").when(
        quiet & F.lit(end_without_calls), "no_tool_calls").when(has_calls & submitted, "theory_submitted")
    inside = F.when(F.col(turn) < max_turns, reason)
    return counted.groupBy(*keys).agg(
        F.coalesce(F.min_by(inside, F.when(inside.isNotNull(), F.col(turn))), F.lit("max_turns_reached")).alias("reason"),
        F.min(F.when(inside.isNotNull(), F.col(turn))).alias("end_turn"))


def session_counts(messages: DataFrame, keys: Sequence[str], role: str, calls: Column, max_turns: int) -> DataFrame:
    """Assistant turns (capped) and tool calls per session."""
    return messages.groupBy(*keys).agg(F.least(F.lit(max_turns), F.count_if(F.col(role) == "assistant")).cast("long").alias("num_turns"),
                                       F.coalesce(F.sum(calls), F.lit(0)).cast("long").alias("num_tool_calls"))


def tool_call_pairing(calls: DataFrame, responses: DataFrame, keys: Sequence[str], call_id: str) -> DataFrame:
    """Responses with the tool name of their call; those without a call drop out."""
    return responses.join(_call_names(calls, keys, call_id), [*keys, call_id])


def _call_names(calls: DataFrame, keys: Sequence[str], call_id: str) -> DataFrame:
    return calls.groupBy(*keys, call_id).agg(F.max_by("name", "pos").alias("name"))


def unpaired_responses(calls: DataFrame, responses: DataFrame, keys: Sequence[str], call_id: str) -> DataFrame:
    """The responses that pairing drops, with a warning."""
    lost = responses.join(_call_names(calls, keys, call_id), [*keys, call_id], "left_anti")
    return lost.withColumn("warning", F.concat(F.lit("Could not find function name for tool_call_id "), F.col(call_id).cast("string")))


def shared_samples(shared: DataFrame, samples: DataFrame, id_: str) -> DataFrame:
    """Shared ids with their sample rows; ids without a sample and unlabelled samples drop out."""
    return shared.join(samples.where(F.col("label").isNotNull()), id_)


def fetch_sample_text(requests: DataFrame, samples: DataFrame, id_: str) -> DataFrame:
    """Text of the requested sample, or the reason why there is none."""
    total = samples.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    j = requests.join(samples.select(F.col(id_).alias("__id"), "text"), F.col(id_) == F.col("__id"), "left")
    status = (F.when(F.col(id_).isNull() | (F.col(id_) < 0), "invalid").when(F.col("__id").isNull(), "unknown")
              .when(F.length(F.coalesce("text", F.lit(""))) == 0, "no_text").otherwise("text"))
    reply = (F.when(status == "invalid", F.lit("Invalid sample_id. Please provide a non-negative integer."))
             .when(status == "unknown", F.concat(F.lit("Unknown sample_id. Please choose an ID from the reference samples (0-"), (total - 1).cast("string"), F.lit(").")))
             .when(status == "no_text", F.lit("No textual description is available for this sample. You may rely on the assignment/label information."))
             .otherwise(F.col("text")))
    return j.select(*requests.columns, status.alias("status"), reply.alias("reply"))


def experiment_totals(sources: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Experiments counted over all combined sources (keys..., n)."""
    both = sources[0]
    for s in sources[1:]:
        both = both.unionByName(s)
    return both.groupBy(*keys).agg(F.sum("n").cast("long").alias("experiments"))


def theory_history(sources: Sequence[DataFrame], keys: Sequence[str], pos: str) -> DataFrame:
    """Evaluated theories of all sources, numbered per session in order."""
    both = sources[0]
    for s in sources[1:]:
        both = both.unionByName(s)
    return running(both, keys, [pos], position_chunk(F.col(pos)), {"evaluation": ("sum", F.lit(1).cast("long"))})


def status_delivery(events: DataFrame, keys: Sequence[str], pos: str, kind: str, grace: int, rows: int = 100_000) -> DataFrame:
    """What happens to every event of a client: kind is connect, disconnect, message or turn.

    A message is delivered at once while connected, held while grace turns are left, dropped
    otherwise; using up the grace drops everything held; a reconnect delivers a notice and then
    the held messages. Adds ``outcome`` and ``delivered_at``.
    """
    k, p = F.col(kind), F.col(pos)
    link = k.isin("connect", "disconnect")
    chunk = position_chunk(p, rows)
    one = running(events, keys, [pos], chunk, {"__turns": ("sum", (k == "turn").cast("long"))})
    # __seg is the latest connection event before the row with the turns counted until then
    two = running(one, keys, [pos], chunk, {"__seg": ("max", F.when(link, F.struct(p.alias("p"), k.alias("k"), F.col("__turns").alias("t"))))}, before_row=True)
    offline = F.coalesce(F.col("__seg.k") == "disconnect", F.lit(False))
    used = F.col("__turns") - F.col("__seg.t")
    two = two.withColumns({"__off": offline, "__clear": offline & (k == "turn") & (used == grace), "__held": offline & (k == "message") & (used < grace)})
    two = cut_lineage(two)  # each running aggregate reads its input twice
    back = running(two, keys, [F.col(pos).desc()], -chunk, {
        "__connect": ("min", F.when(k == "connect", p)), "__cleared": ("min", F.when(F.col("__clear"), p))}, before_row=True)
    kept = F.col("__held") & F.col("__connect").isNotNull() & (F.col("__cleared").isNull() | (F.col("__cleared") > F.col("__connect")))
    outcome = (F.when(k == "message", F.when(~F.col("__off"), "delivered").when(kept, "held").otherwise("dropped"))
               .when((k == "connect") & F.col("__off"), "notice").otherwise("none"))
    at = F.when(outcome.isin("delivered", "notice"), p).when(kept, F.col("__connect"))
    return back.select(*events.columns, outcome.alias("outcome"), at.alias("delivered_at"))
