"""Streams: stateless scoring, budgets and message delivery with state per session.

State lives in the state store, row by row: one small record per session, a list of rows that wait for an
earlier one, and a list of held messages. A row at or below the last position handled is late: it is marked
and leaves the state alone. Rows of a session are taken in one of three orders:

* ``first`` given: positions begin there and have no gaps; a row waits for its predecessors, in
  whatever order files come.
* ``disorder`` given: positions may have gaps; a watermark runs that many positions behind the greatest one read, and
  rows wait until it passes them, then go in order. Rows that arrive behind the watermark are dropped by Spark. Positions
  serve as event times (a millisecond each), are not negative and lie below ``END``. What still waits when a log ends is released
  by a marker (``ending``, ``close_log``), or by later rows.
* neither: rows of a session must not go back in position across micro-batches.

``keep`` lets the state of sessions that are over expire: with ``disorder`` when the watermark is so many positions
beyond a session's last row, else so many seconds after the last change. A row after that begins the session anew.
Null keys are a session of their own; null positions are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.model import Model
from ..operators.scoring import score_wide

END = 1 << 42  # the position of a marker
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def score_stream(stream: DataFrame, model: Model, cats, values=None) -> DataFrame:
    """Score every arriving row; no state, no shuffle."""
    return score_wide(stream, model, cats, values)


def _at(pos):
    """The event time of a position, in milliseconds: positive, as the watermark begins at 0."""
    return pos + 1


class InOrder(StatefulProcessor):
    """Hands a session's rows to ``step`` in order of position. ``row`` names and types the columns after pos,
    ``record`` those of the session's record, which begins as ``fresh()``."""

    row: tuple[tuple[str, str], ...]
    record: str

    def __init__(self, output: list[str], first: int | None, disorder: int | None, keep: int | None):
        self.make, self.first, self.disorder, self.keep = Row(*output), first, disorder, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        ttl = None if self.disorder is not None or self.keep is None else self.keep * 1000
        self.state = handle.getValueState("state", f"last long, {self.record}", ttl)
        self.waiting = handle.getListState("waiting", ", ".join(["pos long", *(f"{n} {t}" for n, t in self.row)]), ttl)
        self.more(handle, ttl)

    def more(self, handle: StatefulProcessorHandle, ttl: int | None) -> None:
        """Further state of a kind of session."""

    def fresh(self) -> list:
        raise NotImplementedError

    def step(self, pos: int, values: tuple, record: list) -> Iterator[tuple]:
        """Handle a row: change the record, yield what follows the key in output rows."""
        raise NotImplementedError

    def late(self, pos: int, record: list) -> tuple:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(r.pos, *(r[n] for n, _ in self.row)) for r in rows if r.pos is not None and r.pos < END]
        if self.disorder is None:
            yield from self.handle_rows(key, new)
            return
        if new:  # they wait for the watermark
            self.waiting.appendList(new)
            self.handle.registerTimer(_at(min(r[0] for r in new)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        due, rest = [r for r in rows if _at(r[0]) <= mark], [r for r in rows if _at(r[0]) > mark]
        if due:
            self.put(rest)
            yield from self.handle_rows(key, due)
        if rest:
            self.handle.registerTimer(_at(min(r[0] for r in rest)))
        elif self.keep is not None and self.state.exists():
            over = _at(self.state.get()[0]) + self.keep
            if over <= mark:
                self.state.clear()
                self.forget()
            else:
                self.handle.registerTimer(over)

    def forget(self) -> None:
        """Drop further state of a session that is over."""

    def put(self, rest: list) -> None:
        if rest:
            self.waiting.put(rest)
        elif self.waiting.exists():
            self.waiting.clear()

    def handle_rows(self, key, rows: list) -> Iterator[Row]:
        last, *record = self.state.get() if self.state.exists() else (None, *self.fresh())
        if self.first is not None:
            rows = rows + (list(self.waiting.get()) if self.waiting.exists() else [])
            want = self.first - 1 if last is None else last
            for pos in sorted({r[0] for r in rows if r[0] > want}):
                if pos > want + 1:
                    break
                want = pos
            self.put([r for r in rows if r[0] > want])
            rows = [r for r in rows if r[0] <= want]
        rows.sort(key=lambda r: r[0])
        self.begin()
        for pos, *values in rows:
            if last is not None and pos <= last or self.first is not None and pos < self.first:
                yield self.make(key[0], *self.late(pos, record))
                continue
            last = pos
            for out in self.step(pos, tuple(values), record):
                yield self.make(key[0], *out)
        self.end()
        if last is not None:
            self.state.update((last, *record))

    def begin(self) -> None:
        """Before some rows of a session."""

    def end(self) -> None:
        """Behind them."""


class Charges(InOrder):
    row = (("cost", "long"), ("runnable", "boolean"), ("budget", "long"))
    record = "started boolean, left long"

    def fresh(self) -> list:
        return [False, None]

    def late(self, pos, record):
        return pos, "late", 0, record[1]

    def step(self, pos, values, record):
        cost, runnable, budget = values
        if not record[0]:
            record[:] = True, budget
        left = record[1]
        if not runnable or cost is None or cost <= 0:
            yield pos, "free", 0, left
        elif left is not None and cost > left:
            yield pos, "rejected", 0, left
        else:
            record[1] = None if left is None else left - cost
            yield pos, "charged", cost, record[1]


class Deliveries(InOrder):
    row = (("kind", "string"),)
    record = "connected boolean, remaining int"

    def __init__(self, grace: int, *rest):
        super().__init__(*rest)
        self.grace = grace

    def more(self, handle, ttl):
        self.held = handle.getListState("held", "pos long", ttl)

    def forget(self):
        self.held.clear()

    # a call of the state store costs more than a row: held messages are read and written once for all rows handled
    def begin(self):
        self.kept = self.stored = None

    def messages(self) -> list:
        if self.kept is None:
            self.stored = [m for (m,) in self.held.get()] if self.held.exists() else []
            self.kept = list(self.stored)
        return self.kept

    def end(self):
        if self.kept == self.stored:
            return
        if not self.kept:
            self.held.clear()
        elif self.kept[:len(self.stored)] == self.stored:
            self.held.appendList([(m,) for m in self.kept[len(self.stored):]])
        else:
            self.held.put([(m,) for m in self.kept])

    def fresh(self) -> list:
        return [True, 0]

    def late(self, pos, record):
        return pos, None, "late"

    def step(self, pos, values, record):
        kind, (connected, remaining) = values[0], record
        if kind == "message":
            if connected:
                yield pos, pos, "delivered"
            elif remaining > 0:
                self.messages().append(pos)
        elif kind == "turn" and not connected and remaining > 0:
            record[1] = remaining - 1
            if not record[1]:
                self.messages().clear()
        elif kind == "connect":
            if not connected:
                yield pos, pos, "notice"
                for message in self.messages():
                    yield message, pos, "held"
                self.messages().clear()
            record[:] = True, 0
        elif kind == "disconnect":
            record[:] = False, self.grace


def _run(stream: DataFrame, key: str, processor: InOrder, schema: str) -> DataFrame:
    mode = "none"
    if processor.disorder is not None:
        stream = stream.withColumn("__at", F.timestamp_millis(_at(F.col("pos")))).withWatermark("__at", f"{processor.disorder} milliseconds")
        mode = "eventTime"
    elif processor.keep is not None:
        mode = "processingTime"
    return stream.groupBy(key).transformWithState(processor, schema, "append", mode)


def budget_stream(stream: DataFrame, key: str, budget: str, first: int | None = None, disorder: int | None = None, keep: int | None = None) -> DataFrame:
    """Columns (key, pos, cost, runnable, budget) in; outcome, charged and left out, per session."""
    rows = stream.select(key, F.col("pos").cast("long").alias("pos"), F.col("cost").cast("long").alias("cost"), "runnable", F.col(budget).cast("long").alias("budget"))
    kind = stream.schema[key].dataType.simpleString()
    return _run(rows, key, Charges([key, "pos", "outcome", "charged", "left"], first, disorder, keep), f"{key} {kind}, pos long, outcome string, charged long, left long")


def delivery_stream(stream: DataFrame, key: str, grace: int, first: int | None = None, disorder: int | None = None, keep: int | None = None) -> DataFrame:
    """Columns (key, pos, kind) in; one row per delivery out: (key, pos of the message, delivered_at, outcome)."""
    rows = stream.select(key, F.col("pos").cast("long").alias("pos"), "kind")
    type_ = stream.schema[key].dataType.simpleString()
    return _run(rows, key, Deliveries(grace, [key, "pos", "delivered_at", "outcome"], first, disorder, keep), f"{key} {type_}, pos long, delivered_at long, outcome string")


def ending(stream: DataFrame, folder: str) -> DataFrame:
    """The stream and, behind it, the markers that ``close_log`` writes to ``folder``."""
    spark = stream.sparkSession
    schema = _nullable(stream.schema)
    spark.createDataFrame([], schema).write.mode("append").parquet(folder)
    return stream.unionByName(spark.readStream.schema(schema).parquet(folder))


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])


def close_log(spark: SparkSession, schema: T.StructType, folder: str) -> None:
    """Say that nothing more will come: the watermark passes all rows when the stream runs on."""
    spark.createDataFrame([tuple(END if f.name == "pos" else None for f in schema.fields)], _nullable(schema)).write.mode("append").parquet(folder)


def run_to_table(stream: DataFrame, path: str, clock: bool = False) -> None:
    """Process everything there is now into parquet files, exactly once, and stop; a later call goes on where
    this one ended. State is kept in RocksDB, so it may exceed memory. ``clock`` says that state expires by the
    clock (``keep`` without ``disorder``): Spark would then go on with empty batches for ever, so they are off."""
    conf = stream.sparkSession.conf
    wanted = {STATE_STORE: ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": str(not clock).lower()}
    before = {name: conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        conf.set(name, value)
    try:
        (stream.writeStream.format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/progress")
         .outputMode("append").trigger(availableNow=True).start().awaitTermination())
    finally:
        for name, value in before.items():
            conf.set(name, value) if value is not None else conf.unset(name)
