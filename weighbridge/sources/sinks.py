"""Writing datasets, runs, theories, failures and rendered documents.

Tables are partitioned by their identifying columns and rebalanced before the write, which
splits a hot partition over several tasks and files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import stored


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], mode: str = "append") -> None:
    """Append rows, or overwrite those partitions that the rows belong to."""
    rows = df.hint("rebalance", *[F.col(c) for c in by])
    rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_dataset(tables: dict[str, DataFrame], path: str, key: str = "dataset_id") -> None:
    """Every table of some datasets below one folder, one partition per dataset.

    Saving a dataset replaces what was stored of it and leaves the others alone. A table without
    a row of a dataset keeps the rows stored before.
    """
    for name, df in tables.items():
        write_partitioned(df, f"{path}/{name}", [key], "overwrite")


BUCKETS = 256  # folders of a clustered table; a few hundred files hold any number of small datasets


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def save_datasets(tables: dict[str, DataFrame], path: str, key: str = "dataset_id", buckets: int = BUCKETS) -> None:
    """Every table of some datasets below one folder, clustered: datasets share hash buckets, inside which rows
    are sorted by dataset, so neither 100,000 small datasets nor one with most of the rows make bad files.

    Saving replaces the datasets that have a row in any of the tables, in all of them; buckets of the new datasets
    are rewritten with their other datasets' rows, the rest is left alone. A dataset whose new version has no rows in a
    table gets a row there that says so (``__gone``), as a bucket left without rows would keep its old file. One writer at a time.
    """
    spark = next(iter(tables.values())).sparkSession
    ids = None
    for df in tables.values():
        mine = df.select(F.col(key).alias("__id"))
        ids = mine if ids is None else ids.unionByName(mine)
    ids = stored(ids.where("__id IS NOT NULL").distinct(), "saved")
    touched = ids.select(_bucket(F.col("__id"), buckets).alias("__bucket")).distinct()
    for name, df in tables.items():
        new = df.where(F.col(key).isNotNull()).select("*", F.lit(False).alias("__gone"), _bucket(F.col(key), buckets).alias("__bucket"))
        old = _read(spark, f"{path}/{name}")
        if old is not None:
            near = old.join(touched, "__bucket", "left_semi")
            replaced = near.join(ids, F.col(key) == F.col("__id"), "left_semi").select(key, "__bucket").distinct()
            empty = replaced.join(new.select(key).distinct(), key, "left_anti").withColumn("__gone", F.lit(True))
            others = near.join(ids, F.col(key) == F.col("__id"), "left_anti")
            new = stored(new.unionByName(others).unionByName(empty, allowMissingColumns=True), "datasets")  # read before its buckets are replaced
        rows = new.hint("rebalance", F.col("__bucket")).sortWithinPartitions("__bucket", key)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__bucket").parquet(f"{path}/{name}")


def read_datasets(spark: SparkSession, path: str, name: str, key: str = "dataset_id", only: Sequence | None = None, buckets: int = BUCKETS) -> DataFrame:
    """A clustered table; with ``only``, the rows of those datasets, read from their buckets alone."""
    rows = spark.read.parquet(f"{path}/{name}").where(~F.col("__gone"))
    if only is not None:
        wanted = [r[0] for r in spark.range(1).select(F.explode(F.array(*[_bucket(F.lit(x), buckets) for x in only]))).distinct().collect()] if only else []
        rows = rows.where(F.col("__bucket").isin(wanted) & F.col(key).isin(list(only)))
    return rows.drop("__gone", "__bucket")


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, None if nothing is there yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def export_json(df: DataFrame, path: str) -> None:
    """One JSON text per row (column ``content``), for readers that want files."""
    df.select(F.col("content").alias("value")).write.mode("overwrite").text(path)


def upsert_instances(spark: SparkSession, new: DataFrame, path: str, by: Sequence[str], must_exist: bool = False) -> None:
    """Add or replace whole (level, name) instances; only the partitions of the new rows change."""
    if must_exist:
        have = spark.read.parquet(path).select(*by).distinct()
        if not new.select(*by).distinct().join(have, list(by), "left_anti").isEmpty():
            raise ValueError("an instance to update does not exist")
    new.hint("rebalance", *[F.col(c) for c in by]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


RUN_ROWS = 100_000  # runs compared in one task, about


def append_runs(spark: SparkSession, runs: DataFrame, path: str) -> None:
    """Append runs whose id is not stored yet; appending twice changes nothing.

    Of repeated ids the row whose JSON text comes first is taken. One writer at a time: two that
    look before either has written may both store an id.
    """
    whole = F.struct(*runs.columns)
    runs = stored(runs, "new-runs")  # read and counted once; so many rows a task that its sorts stay small
    tasks = max(runs.sparkSession.sparkContext.defaultParallelism, -(-runs.count() // RUN_ROWS))
    one_each = runs.repartition(tasks, "run_id").groupBy("run_id").agg(F.min_by(whole, F.to_json(whole)).alias("r")).select("r.*")
    stored_runs = _read(spark, path)
    if stored_runs is not None:
        one_each = one_each.join(stored_runs.select("run_id"), "run_id", "left_anti")
    write_partitioned(one_each, path, [c for c in ("model", "mode", "level", "instance") if c in runs.columns])


def ingest_runs(stream: DataFrame, path: str, checkpoint: str, writer: str = "main") -> None:
    """Add a stream of runs to a catalogue, up to what there is now. A micro-batch overwrites its own folder
    (writer, batch), so one that is replayed after a failure changes nothing, and writers of different names never touch
    each other's files. Which row stands for a run id is decided when the catalogue is read (``read_runs``)."""
    def add(batch: DataFrame, number: int) -> None:
        whole = F.struct(*batch.columns)
        one_each = batch.groupBy("run_id").agg(F.min_by(whole, F.to_json(whole)).alias("r")).select("r.*")
        rows = one_each.select("*", F.lit(writer).alias("__writer"), F.lit(number).cast("long").alias("__batch"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__writer", "__batch").parquet(path)

    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """One row per run id: of the lowest batch number, then the first writer by name, whatever the order of writing."""
    rows = spark.read.parquet(path).withColumns({"__writer": F.col("__writer").cast("string"), "__batch": F.col("__batch").cast("long")})
    columns = [c for c in rows.columns if c not in ("__writer", "__batch")]
    return rows.groupBy("run_id").agg(F.min_by(F.struct(*columns), F.struct("__batch", "__writer")).alias("r")).select("r.*")


def write_theories(theories: DataFrame, path: str) -> None:
    """Add valid theories; one of the same dataset and name replaces the stored one.

    Of equal names among the new ones the row whose JSON text comes last is taken. Datasets share hash buckets
    (``__bucket``), so many small ones make no more folders and files; only the buckets of the new theories are
    written. Theories without a dataset are replaced together.
    """
    new = theories.where(F.size("missing") == 0).drop("missing")
    whole, keys = F.struct(*new.columns), ["dataset_id", "name"]
    new = new.groupBy(*keys).agg(F.max_by(whole, F.to_json(whole)).alias("t")).select("t.*")
    new = new.withColumn("__bucket", _bucket(F.col("dataset_id"), BUCKETS))
    old = _read(theories.sparkSession, path)
    if old is not None:
        new = stored(new, "new-theories")
        nowhere = F.col("dataset_id").isNull()
        same = ["__nowhere", "__dataset", "__name"]
        ident = [nowhere.alias(same[0]), F.when(nowhere, "").otherwise(F.col("dataset_id").cast("string")).alias(same[1]), F.when(nowhere, "").otherwise(F.col("name")).alias(same[2])]
        near = old.join(F.broadcast(new.select("__bucket").distinct()), "__bucket", "left_semi")
        kept = near.select("*", *ident).join(new.select(*ident), same, "left_anti").select(*new.columns)
        new = stored(new.unionByName(kept), "theories")  # read before its buckets are replaced
    write_partitioned(new, path, ["__bucket"], "overwrite")


def write_failures(failures: DataFrame, path: str) -> None:
    """One error record per failed task."""
    write_partitioned(failures, path, ["model", "level", "iteration"])


def _label_map(cells: Column) -> Column:
    return F.map_from_entries(F.transform(F.array_sort(cells), lambda e: F.struct(e["label"].cast("string"), e["value"])))


def model_json(tables: dict[str, DataFrame], key: str = "dataset_id") -> DataFrame:
    """Long model tables back to one JSON text per model; its size is fixed by the model."""
    def nested(what: str) -> DataFrame:
        per_label = tables["categories"].groupBy(key, "var", "label").agg(
            F.array_sort(F.collect_list(F.struct("cat", F.col(what).alias("x")))).alias("c"))
        per_var = per_label.groupBy(key, "var").agg(F.array_sort(F.collect_list(F.struct("label", "c"))).alias("l"))
        cells = F.transform("l", lambda e: F.struct(e["label"].cast("string"), F.map_from_entries(
            F.transform(e["c"], lambda x: F.struct(x["cat"].cast("string"), x["x"])))))
        return per_var.select(key, "var", F.map_from_entries(cells).alias(f"{what}s"))

    numeric = tables["numeric"].groupBy(key, "var").agg(*[
        _label_map(F.collect_list(F.struct("label", F.col(c).alias("value")))).alias(n)
        for c, n in (("low", "min_weight"), ("high", "max_weight"), ("rising", "direction"), ("score", "variable_score"))])
    spans = tables["spans"].groupBy(key, "var").agg(F.array_sort(F.collect_list(F.struct("idx", F.array("lo", "hi").alias("s")))).alias("s")).select(
        key, "var", F.transform("s", lambda e: e["s"]).alias("spans"))
    v = tables["models"].join(nested("weight"), [key, "var"], "left").join(nested("score"), [key, "var"], "left").join(
        numeric, [key, "var"], "left").join(spans, [key, "var"], "left")
    body = F.struct(F.col("var").alias("name"), "categories", F.col("labels").alias("num_output_labels"), "weights", "scores",
                    F.col("kind").alias("variable_type"), F.coalesce("spans", F.expr("CAST(array() AS ARRAY<ARRAY<DOUBLE>>)")).alias("spans"),
                    "min_weight", "max_weight", "direction", "variable_score")
    variables = v.groupBy(key, "labels").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("var").alias("var"), F.to_json(body).alias("v"))))).alias("variables"))
    rules = tables["rules"].groupBy(key).agg(F.array_sort(F.collect_list(F.struct(
        "ord", "name", "var_a", "val_a", "var_b", "val_b", "weight", "score"))).alias("r")).select(key, F.transform("r", lambda e: e.dropFields("ord")).alias("rules"))
    j = variables.join(rules, key, "left")
    parts = F.transform(F.map_entries("variables"), lambda e: F.concat(F.lit('"'), e["key"], F.lit('": '), e["value"]))
    return j.select(key, F.concat(
        F.lit('{"num_output_labels": '), F.col("labels").cast("string"), F.lit(', "variables": {'), F.array_join(parts, ", "),
        F.lit('}, "rules": '), F.coalesce(F.to_json("rules"), F.lit("[]")), F.lit("}")).alias("content"))


def register_rendered(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Existing documents (keys..., pos, ...) with new ones merged by absolute path, else path.

    A known document is replaced in place, a new one goes to the end; without a path it is dropped.
    """
    def ident(df: DataFrame, age: int) -> DataFrame:
        path = F.coalesce(F.nullif(F.col("absolute_path"), F.lit("")), F.nullif(F.col("path"), F.lit("")))
        return df.withColumns({"__id": path, "__age": F.lit(age)}).where("__id IS NOT NULL")

    rows = ident(existing, 0).unionByName(ident(new, 1))
    fields = [c for c in existing.columns if c not in (*keys, "pos")]
    merged = rows.groupBy(*keys, "__id").agg(
        F.max_by(F.struct(*fields), F.struct("__age", "pos")).alias("d"), F.min(F.struct("__age", "pos")).alias("first"))
    return merged.select(*keys, "d.*", F.col("first.__age").alias("batch"), F.col("first.pos").alias("pos")).drop("absolute_path")


def creation_statistics(samples: DataFrame, pool: DataFrame, keys: Sequence[str], labels: int) -> DataFrame:
    """Samples selected and available per label, and totals, one row per dataset."""
    def counts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.map_from_arrays(
            F.array(*[F.lit(str(i)) for i in range(labels)]),
            F.array(*[F.count_if(F.col("label") == i) for i in range(labels)])).alias(name), F.count(F.lit(1)).alias(f"{name}_total"))

    j = counts(samples, "samples_per_label").join(counts(pool, "total_samples_per_label"), list(keys), "full_outer")
    return j.select(*keys, "samples_per_label", F.col("samples_per_label_total").alias("num_samples"), "total_samples_per_label",
                    F.col("total_samples_per_label_total").alias("total_number_of_assignments"))
