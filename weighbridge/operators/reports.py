"""Rankings and roll-ups of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import number_by_value


def most_common(df: DataFrame, column: str) -> DataFrame:
    """Counts of a numeric column by descending frequency, with their place; ties in value order."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return number_by_value(counts, "n", column, "place", descending=True).select("place", column, "n")


def corpus_statistics(instances: DataFrame, runs: DataFrame) -> DataFrame:
    """Instances per level, raw-only datasets, datasets with several files instances, runs per model."""
    levels = instances.groupBy(F.concat(F.lit("level:"), F.col("level")).alias("item")).agg(F.count(F.lit(1)).alias("n"))
    per = instances.groupBy("dataset_id").agg(F.bool_and(F.col("level") == "raw").alias("raw_only"), (F.count_if(F.col("level") == "files") > 1).alias("multi"))
    flags = per.agg(F.count_if("raw_only").alias("raw_only"), F.count_if("multi").alias("multi_files"))
    flat = flags.select(F.explode(F.create_map(F.lit("raw_only"), F.col("raw_only"), F.lit("multi_files"), F.col("multi_files"))).alias("item", "n"))
    per_model = runs.groupBy(F.concat(F.lit("runs:"), F.col("model")).alias("item")).agg(F.count(F.lit(1)).alias("n"))
    return levels.unionByName(flat).unionByName(per_model)


def run_rollup(results: DataFrame) -> DataFrame:
    """Successes, failures and the first error overall, per config, and per config and dataset."""
    failed = ~F.col("ok")
    return results.rollup("config", "dataset").agg(
        F.count_if("ok").alias("successes"), F.count_if(failed).alias("failures"),
        F.min_by(F.when(failed, F.col("error")), F.when(failed, F.col("pos"))).alias("first_error"))


def leaderboard(entries: DataFrame, score: str, tie: str, accuracy: str) -> DataFrame:
    """Entries ranked by descending score, accuracy as a percent text with one decimal."""
    shown = F.concat(F.call_function("format_number", F.bround(F.col(accuracy) * 100, 1), F.lit("0.0")), F.lit("%"))
    return number_by_value(entries, score, tie, "rank", descending=True).withColumn(accuracy, shown)


def first_failures(failures: DataFrame, n: int, width: int) -> DataFrame:
    """The first n failures with their error text cut to a width."""
    return failures.orderBy("pos").limit(n).withColumn("error", F.substring("error", 1, width))
