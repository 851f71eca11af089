"""Trees of JSON files written, scanned and read; tables written and replaced."""

import json

import pytest
from pyspark.sql import functions as F

from weighbridge.sources import catalog as ct
from weighbridge.sources import sinks as sk

SAMPLE = {"assignment": {"V0": 1}, "score": 0.5, "label": 1, "numerical_values": {}, "property_labels": {"p": None}}


def put(root, name, value):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value, indent=2))


@pytest.fixture
def tree(tmp_path):
    for d in ("a", "b"):
        root = tmp_path / "data" / d
        put(root, "UDD.json", {"num_output_labels": 2, "variables": {}, "rules": []})
        put(root, "raw_samples.json", [SAMPLE, {"odd": 1}])
        put(root, "metadata.json", {"num_output_labels": 2, "main_name": d, "rendered_instances": {"raw": {"one": [{"path": "x.pdf"}, {"path": ""}]}}})
        put(root, "instances/raw/one.json", {"version": 3, "name": "one", "udd": {}, "dataset": [SAMPLE], "textualization_level": "raw"})
        put(root, "instances/old.json", {"udd": {}, "dataset": [SAMPLE, SAMPLE]})
        put(root, "instances/raw/bad.json", {"name": "no samples"})
        put(root, "evaluation_results/m/STATIC/raw/one/r1.json", {"results": {"accuracy": 1}})
        put(root, "evaluation_results/m/nonsense/raw/one/r2.json", {})
        put(root, "evaluation_results/m/STATIC/raw/one/r3.json", "{ broken")
        put(root, "noise_theories/some name.json", {"accuracy": 1, "llm": "m", "textual_llm_theory": "a", "textual_dt_theory": "b"})
        put(root, "paper_dataset_instance.json", {"udd_complexity": 1, "num_samples": 10, "textualization_level": "raw", "dynamic": "static"})
    put(tmp_path / "data" / "a", "nested/UDD.json", {"variables": {}, "rules": []})
    return tmp_path


def test_scan_and_load(spark, tree):
    files = ct.scan(spark, [str(tree)])
    roots = sorted(r["root"] for r in ct.dataset_roots(files).collect())
    assert roots == [f"{tree}/data/a", f"{tree}/data/b"]
    everything = ct.load_all(files).cache()
    kind = lambda k: everything.where(F.col("kind") == k)
    samples = ct.read_raw_samples(kind("raw_samples")).orderBy("dataset_id", "sample_idx").collect()
    assert [(s["label"], s["opaque"] is None) for s in samples] == [(1, True), (0, False)] * 2
    inst = {(i["name"], i["level"], len(i["dataset"])) for i in ct.read_instances(kind("instance")).collect()}
    assert inst == {("one", "raw", 1), ("old", "unknown", 2)}
    runs = ct.read_eval_runs(kind("run")).collect()
    assert [(r["run_id"], r["mode"], r["level"]) for r in runs] == [("r1", "STATIC", "raw")] * 2
    theories = ct.read_noise_theories(kind("noise_theory")).collect()
    assert {t["name"] for t in theories} == {"some_name"} and all(not t["missing"] for t in theories)
    docs = ct.read_rendered_documents(ct.read_metadata(kind("metadata")), ct.read_instances(kind("instance")).select("dataset_id", "level", "name"))
    assert sorted(d["absolute_path"] for d in docs.collect()) == [f"{tree}/data/a/x.pdf", f"{tree}/data/b/x.pdf"]
    cfg = ct.read_dataset_configs(kind("config")).collect()
    assert {(c["num_samples"], c["level"], c["mode"]) for c in cfg} == {(10, "raw", "static")}


def test_resolve_keeps_the_first_request(spark, tree):
    roots = ct.dataset_roots(ct.scan(spark, [str(tree)], "UDD.json"))
    req = spark.createDataFrame([(0, f"{tree}/data/b"), (1, str(tree)), (2, f"{tree}/data/b"), (3, "/nowhere")], "pos long, path string")
    got = {r["root"][-1]: r["first_pos"] for r in ct.resolve_paths(req, roots).collect()}
    assert got == {"b": 0, "a": 1}


def test_upsert_replaces_only_its_partition(spark, tmp_path):
    path = str(tmp_path / "inst")
    old = spark.createDataFrame([("raw", "a", 1), ("raw", "b", 2), ("files", "a", 3)], "level string, instance string, v int")
    sk.write_partitioned(old, path, ["level", "instance"], "overwrite")
    new = spark.createDataFrame([("raw", "b", 9)], "level string, instance string, v int")
    sk.upsert_instances(spark, new, path, ["level", "instance"], must_exist=True)
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [1, 3, 9]
    with pytest.raises(ValueError):
        sk.upsert_instances(spark, new.withColumn("instance", F.lit("z")), path, ["level", "instance"], must_exist=True)


def test_append_runs_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "runs")
    runs = spark.createDataFrame([(f"r{i}", "m", "STATIC", "raw") for i in range(5)], "run_id string, model string, mode string, level string")
    for _ in range(2):
        sk.append_runs(spark, runs, path)
    sk.append_runs(spark, spark.createDataFrame([("r9", "m", "STATIC", "raw"), ("r1", "m", "STATIC", "raw")], runs.schema), path)
    assert spark.read.parquet(path).count() == 6


def test_export_json(spark, tmp_path):
    df = spark.createDataFrame([('{"a": 1}',), ('{"a": 2}',)], "content string")
    sk.export_json(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).agg(F.sum("a")).first()[0] == 3


def test_saving_leaves_other_datasets_alone(spark, tmp_path):
    path = str(tmp_path / "data")
    rows = lambda *x: spark.createDataFrame(x, "dataset_id string, v int")
    sk.write_dataset({"samples": rows(("d1", 1), ("d1", 2), ("d2", 3)), "instances": rows(("d1", 4))}, path)
    sk.write_dataset({"samples": rows(("d1", 9)), "instances": rows(("d3", 5))}, path)
    read = lambda t: sorted((r["dataset_id"], r["v"]) for r in spark.read.parquet(f"{path}/{t}").collect())
    assert read("samples") == [("d1", 9), ("d2", 3)] and read("instances") == [("d1", 4), ("d3", 5)]


def test_theories_of_one_slug(spark, tmp_path):
    path = str(tmp_path / "theories")

    def docs(*rows):
        return ct.read_noise_theories(spark.createDataFrame([
            (d, f"/x/noise_theories/{f}.json", json.dumps({"accuracy": a, "llm": "m", "textual_llm_theory": "t", "textual_dt_theory": "d"})) for d, f, a in rows],
            "dataset_id string, path string, content string"))

    sk.write_theories(docs(("d1", "a b", 0.1), ("d1", "a_b", 0.2), ("d2", "c", 0.3)), path)
    sk.write_theories(docs(("d1", "a b", 0.4), ("d1", "e", 0.5)), path)
    got = sorted((r["dataset_id"], r["name"], r["accuracy"]) for r in spark.read.parquet(path).collect())
    assert got == [("d1", "a_b", 0.4), ("d1", "e", 0.5), ("d2", "c", 0.3)]


def test_bad_keys_do_not_end_a_scan(spark):
    model = {"num_output_labels": 2, "variables": {"V0": {"name": "V0", "categories": 2, "variable_type": "categorical",
             "weights": {"0": {"0": 0.1, "x": 0.2}, "oops": {"0": 1.0}}, "scores": {"0": {"0": 0.3}}}}, "rules": []}
    docs = spark.createDataFrame([("d", json.dumps(model))], "dataset_id string, content string")
    cells = {(r["label"], r["cat"]): (r["weight"], r["score"]) for r in ct.read_models(docs)["categories"].collect()}
    assert set(cells) == {(0, 0), (0, 1), (1, 0), (1, 1)} and cells[0, 0] == (0.1, 0.3)  # the others are drawn
    assert all(0 <= x <= 1 for c in cells.values() for x in c)
    stats = spark.createDataFrame([("d", json.dumps({"samples_per_label": {"0": 3, "many": 4}}))], "dataset_id string, content string")
    assert ct.read_statistics(stats).first()["samples_per_label"] == {0: 3}


def files_below(path):
    return {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_clustered_datasets(spark, tmp_path):
    """Many datasets in few files; a save replaces its datasets in all tables and leaves other buckets alone."""
    path = str(tmp_path / "all")
    rows = spark.range(6000).select((F.col("id") % 3000).cast("string").alias("dataset_id"), F.col("id").alias("x"))
    sk.save_datasets({"samples": rows, "notes": rows.where("x < 40")}, path, buckets=16)
    before = files_below(tmp_path / "all/samples")
    assert len(before) <= 3 * 16 and sk.read_datasets(spark, path, "samples").count() == 6000
    new = spark.createDataFrame([("7", 1), ("new", 2)], rows.schema)
    sk.save_datasets({"samples": new, "notes": new.where("x = 2")}, path, buckets=16)
    after = files_below(tmp_path / "all/samples")
    assert len(set(before) & set(after)) >= 14 and all(before[p] == after[p] for p in set(before) & set(after))
    got = sk.read_datasets(spark, path, "samples").groupBy("dataset_id").agg(F.sort_array(F.collect_list("x")).alias("xs")).collect()
    assert {r["dataset_id"]: r["xs"] for r in got} == {**{str(i): [i, i + 3000] for i in range(3000)}, "7": [1], "new": [2]}
    assert {r["dataset_id"] for r in sk.read_datasets(spark, path, "notes").collect()} == {str(i) for i in range(40)} - {"7"} | {"new"}  # 7 has no notes any more
    some = sk.read_datasets(spark, path, "samples", only=["7", "11"], buckets=16)
    assert sorted((r["dataset_id"], r["x"]) for r in some.collect()) == [("11", 11), ("11", 3011), ("7", 1)]
    assert "PartitionFilters: [isnotnull(__bucket" in some._jdf.queryExecution().toString() or "__bucket" in some._jdf.queryExecution().executedPlan().toString()
    sk.save_datasets({"samples": spark.createDataFrame([("7", 5)], rows.schema), "notes": spark.createDataFrame([("7", 6)], rows.schema)}, path, buckets=16)
    assert [r["x"] for r in sk.read_datasets(spark, path, "notes", only=["7"], buckets=16).collect()] == [6]


def test_runs_of_replayed_batches_and_two_writers(spark, tmp_path):
    import shutil

    path, schema = str(tmp_path / "runs"), "run_id string, model string, value int"
    feeds = {"a": [[("r1", "m", 1), ("r2", "m", 2)], [("r3", "m", 3), ("r1", "m", 9)]], "b": [[("r2", "m", 7), ("r4", "m", 4)], [("r3", "m", 8)]]}

    def run(writer):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"in-{writer}"))
        sk.ingest_runs(stream, path, str(tmp_path / f"progress-{writer}"), writer)

    for n in range(2):  # the writers take turns
        for writer, batches in feeds.items():
            spark.createDataFrame(batches[n], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in-{writer}"))
            run(writer)
    want = [("r1", "m", 1), ("r2", "m", 2), ("r3", "m", 3), ("r4", "m", 4)]
    assert sorted(map(tuple, sk.read_runs(spark, path).collect())) == want
    commits = sorted((tmp_path / "progress-a/commits").glob("[0-9]*"))
    (tmp_path / "kept").mkdir()
    shutil.copy(commits[-1], tmp_path / "kept")
    commits[-1].unlink()  # as if the last batch had failed behind its write: it runs again
    crc = commits[-1].with_name(f".{commits[-1].name}.crc")
    if crc.exists():
        crc.unlink()
    rows = spark.read.parquet(path).count()
    run("a")
    assert spark.read.parquet(path).count() == rows and sorted(map(tuple, sk.read_runs(spark, path).collect())) == want


def test_theories_of_many_datasets_share_folders(spark, tmp_path):
    path = str(tmp_path / "theories")
    fields = "dataset_id long, name string, missing array<string>, accuracy double"
    sk.write_theories(spark.createDataFrame([(i, "a", [], 0.1) for i in range(600)] + [(None, "a", [], 0.1), (None, "b", [], 0.1), (7, None, [], 0.1)], fields), path)
    folders = [p for p in (tmp_path / "theories").iterdir() if p.is_dir()]
    assert len(folders) <= sk.BUCKETS
    sk.write_theories(spark.createDataFrame([(1, "a", [], 0.2), (1, "b", [], 0.2), (2, "a", ["llm"], 0.2)], fields), path)
    rows = {(r["dataset_id"], r["name"]): r["accuracy"] for r in spark.read.parquet(path).collect()}
    assert len(rows) == 604 and rows[1, "a"] == rows[1, "b"] == 0.2 and rows[2, "a"] == rows[None, "a"] == rows[7, None] == 0.1
    sk.write_theories(spark.createDataFrame([(None, "c", [], 0.3)], fields), path)
    names = [r["name"] for r in spark.read.parquet(path).where("dataset_id IS NULL").collect()]
    assert names == ["c"] and spark.read.parquet(path).count() == 603


def test_appended_runs_are_compared_in_many_tasks(spark, tmp_path, monkeypatch):
    written = []
    monkeypatch.setattr(sk, "RUN_ROWS", 10, raising=False)
    monkeypatch.setattr(sk, "write_partitioned", lambda df, *_: written.append(df))
    runs = spark.range(1000).selectExpr("'r' || (id % 400) AS run_id", "'m' || id AS model", "'STATIC' AS mode", "'raw' AS level")
    sk.append_runs(spark, runs, str(tmp_path / "runs"))
    assert written[0].rdd.getNumPartitions() >= 100 and written[0].count() == 400
    assert {r["model"] for r in written[0].where("run_id = 'r7'").collect()} == {"m407"}
