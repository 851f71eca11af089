"""Streams over several micro-batches give what the batch operators give."""

import random

from pyspark.sql import functions as F

from weighbridge.operators import sessions as ss
from weighbridge.streaming import sessions as st


def feed(spark, path, df, parts, key="pos"):
    """Write the rows as files in order of position and read them one file per micro-batch."""
    top = df.agg(F.max(key)).first()[0] + 1
    for i in range(parts):
        lo, hi = top * i // parts, top * (i + 1) // parts
        df.where((F.col(key) >= lo) & (F.col(key) < hi)).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_budget_stream_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    budget = {k: rng.randrange(4, 25) for k in range(4)}
    rows = [(k := rng.randrange(4), i, rng.choice([0, 1, 5]), rng.random() < 0.9, budget[k]) for i in range(90)]
    df = spark.createDataFrame(rows, "k long, pos long, cost int, runnable boolean, budget long")
    stream = feed(spark, str(tmp_path / "in"), df, 3)
    st.run_to_table(st.budget_stream(stream, "k", "budget"), str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out/data"))
    want = ss.budget_ledger(df, ["k"], "pos", "cost", "runnable", "budget", [1, 5], rows=10).select("k", "pos", "outcome", "charged", "left")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_delivery_stream_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randrange(3), i, rng.choice(["connect", "disconnect", "message", "message", "turn"])) for i in range(90)]
    df = spark.createDataFrame(rows, "k long, pos long, kind string")
    stream = feed(spark, str(tmp_path / "in"), df, 3)
    st.run_to_table(st.delivery_stream(stream, "k", 2), str(tmp_path / "out"))
    got = {(r["k"], r["pos"], r["delivered_at"], r["outcome"]) for r in spark.read.parquet(str(tmp_path / "out/data")).collect()}
    batch = ss.status_delivery(df, ["k"], "pos", "kind", 2).where("delivered_at IS NOT NULL")
    assert got == {(r["k"], r["pos"], r["delivered_at"], r["outcome"]) for r in batch.collect()}


def test_late_rows_change_nothing(spark, tmp_path):
    path = str(tmp_path / "in")
    first = spark.createDataFrame([(1, 0, "disconnect"), (1, 5, "message")], "k long, pos long, kind string")
    late = spark.createDataFrame([(1, 3, "connect"), (1, 6, "connect")], first.schema)
    for df in (first, late):
        df.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(path)
    st.run_to_table(st.delivery_stream(stream, "k", 2), str(tmp_path / "out"))
    got = {(r["pos"], r["delivered_at"], r["outcome"]) for r in spark.read.parquet(str(tmp_path / "out/data")).collect()}
    assert got == {(3, None, "late"), (6, 6, "notice"), (5, 6, "held")}


def shuffled_files(spark, path, df, parts, seed):
    """The rows dealt out at random over several files, one per micro-batch."""
    for i in range(parts):
        df.where(F.pmod(F.xxhash64(F.lit(seed), "k", "pos"), F.lit(parts)) == i).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_streams_in_any_order_equal_batch(spark, tmp_path):
    rng = random.Random(6)
    rows = [(k, i, rng.choice([0, 1, 5]), rng.random() < 0.9, 5 * k + 4, rng.choice(["connect", "disconnect", "message", "turn"])) for k in range(3) for i in range(30)]
    df = spark.createDataFrame(rows, "k long, pos long, cost int, runnable boolean, budget long, kind string")
    charged = st.budget_stream(shuffled_files(spark, str(tmp_path / "a"), df.drop("kind"), 5, 1), "k", "budget", first=0)
    st.run_to_table(charged, str(tmp_path / "ledger"))
    want = ss.budget_ledger(df.drop("kind"), ["k"], "pos", "cost", "runnable", "budget", rows=10).select("k", "pos", "outcome", "charged", "left")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "ledger/data")).collect())) == sorted(map(tuple, want.collect()))
    sent = st.delivery_stream(shuffled_files(spark, str(tmp_path / "b"), df.select("k", "pos", "kind"), 5, 2), "k", 2, first=0)
    st.run_to_table(sent, str(tmp_path / "delivery"))
    got = {(r["k"], r["pos"], r["delivered_at"], r["outcome"]) for r in spark.read.parquet(str(tmp_path / "delivery/data")).collect()}
    batch = ss.status_delivery(df.select("k", "pos", "kind"), ["k"], "pos", "kind", 2).where("delivered_at IS NOT NULL")
    assert got == {(r["k"], r["pos"], r["delivered_at"], r["outcome"]) for r in batch.collect()}


def test_queries_stream_tables_in_folders(spark, sf, tmp_path):
    from weighbridge.plans import QUERIES

    for name in ("conversations", "orders", "events"):
        spark.read.parquet(f"{sf}/{name}.parquet").repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name in ("stream_budget_ledger", "stream_score", "stream_status_delivery"):
        want = sorted(map(str, QUERIES[name](spark, sf).collect()))
        assert want and sorted(map(str, QUERIES[name](spark, str(tmp_path)).collect())) == want


def test_delivery_of_a_thousand_files_in_mixed_order(spark, tmp_path, monkeypatch):
    """More files than a micro-batch takes, in no order, positions with gaps: as the batch operator."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from weighbridge.plans import QUERIES, session_queries

    rng = random.Random(8)
    rows = [(rng.randrange(5) if rng.random() < 0.8 else 5, 3 * i + rng.randrange(3), rng.choice(["click", "error", "signup", "view", "purchase"])) for i in range(2600)]
    rng.shuffle(rows)
    schema = pa.schema([("event_id", pa.int64()), ("user_id", pa.int64()), ("event_type", pa.string())])
    (tmp_path / "events.parquet").mkdir()
    for n in range(1300):
        u, p, k = zip(*rows[2 * n:2 * n + 2])
        pq.write_table(pa.table([p, u, k], schema=schema), str(tmp_path / f"events.parquet/part-{n:05}.parquet"))
    got = QUERIES["stream_status_delivery"](spark, str(tmp_path))
    batch = ss.status_delivery(session_queries.connection_log(spark.read.parquet(str(tmp_path / "events.parquet"))), ["user_id"], "pos", "kind", 2)
    want = batch.where("delivered_at IS NOT NULL").select("user_id", "pos", "delivered_at", "outcome")
    assert want.count() > 500 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_rows_wait_for_the_watermark_and_state_expires(spark, tmp_path):
    path = str(tmp_path / "in")
    files = [[(1, 2, "message"), (1, 0, "disconnect")], [(1, 1, "message"), (2, 10, "connect")], [(2, 30, "message"), (None, 31, "message")], [(2, 60, "message")], [(1, 70, "message")], [(2, 99, "message")]]
    for rows in files:
        spark.createDataFrame(rows, "k long, pos long, kind string").coalesce(1).write.mode("append").parquet(path)
    for keep, last in ((None, []), (20, [(1, 70, 70, "delivered")])):
        stream = spark.readStream.schema("k long, pos long, kind string").option("maxFilesPerTrigger", 1).parquet(path)
        out = str(tmp_path / f"out{keep}")
        log = st.ending(stream, f"{out}/end")
        sent = st.delivery_stream(log, "k", 3, disorder=9, keep=keep)
        st.run_to_table(sent, out)
        before = sorted(map(tuple, spark.read.parquet(f"{out}/data").collect()), key=str)
        st.close_log(spark, stream.schema, f"{out}/end")
        st.run_to_table(sent, out)
        after = sorted(map(tuple, spark.read.parquet(f"{out}/data").collect()), key=str)
        # session 1 is offline without a reconnect: nothing is delivered, unless its state has expired by row 70
        assert after == sorted([(2, 30, 30, "delivered"), (None, 31, 31, "delivered"), (2, 60, 60, "delivered"), (2, 99, 99, "delivered"), *last], key=str)
        assert (2, 99, 99, "delivered") not in before and (2, 60, 60, "delivered") in before


def test_time_to_live_leaves_results_alone(spark, tmp_path):
    rows = [(k, i, 1 + i % 3, True, 7) for k in range(2) for i in range(12)]
    df = spark.createDataFrame(rows, "k long, pos long, cost int, runnable boolean, budget long")
    st.run_to_table(st.budget_stream(shuffled_files(spark, str(tmp_path / "a"), df, 3, 5), "k", "budget", first=0, keep=3600), str(tmp_path / "out"), clock=True)
    want = ss.budget_ledger(df, ["k"], "pos", "cost", "runnable", "budget").select("k", "pos", "outcome", "charged", "left")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out/data")).collect())) == sorted(map(tuple, want.collect()))


def test_held_messages_cost_one_call_of_the_store(monkeypatch):
    """However many messages and reconnects a session has, its held messages are read and written once."""
    calls = []

    class Store:
        def __init__(self):
            self.rows = None

        def exists(self):
            return self.rows is not None

        def get(self):
            calls.append("get")
            return self.rows if isinstance(self.rows, tuple) else iter(self.rows)

        def update(self, row):
            self.rows = row

        def clear(self):
            calls.append("clear")
            self.rows = None

        def appendValue(self, row):
            self.appendList([row])

        def appendList(self, rows):
            calls.append("append")
            self.rows = [*(self.rows or []), *rows]

        def put(self, rows):
            calls.append("put")
            self.rows = list(rows)

    class Handle:
        getValueState = getListState = lambda *_: Store()

    d = st.Deliveries(3, ["k", "pos", "delivered_at", "outcome"], None, None, None)
    d.init(Handle())
    kinds = ["disconnect", *["message"] * 30, "connect", *["disconnect", "message", "connect"] * 20, "disconnect", "message", "message"]
    got = [tuple(r) for r in d.handle_rows((1,), [(i, k) for i, k in enumerate(kinds)])]
    assert len([r for r in got if r[3] == "held"]) == 50 and len(calls) <= 2
    calls.clear()
    got = [tuple(r) for r in d.handle_rows((1,), [(1000, "message"), (1001, "turn"), (1002, "connect"), (1003, "message")])]
    assert got == [(1, 1002, 1002, "notice"), (1, len(kinds) - 2, 1002, "held"), (1, len(kinds) - 1, 1002, "held"), (1, 1000, 1002, "held"), (1, 1003, 1003, "delivered")]
    assert len(calls) <= 4 and d.held.rows is None
