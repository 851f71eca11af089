"""Dataset and evaluation set-up: sweeps, matching, pending work, task grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import is_object
from ..functions.text import parse_mode, slug
from .blocks import list_blocks
from .model import small_table
from .ordered import chunked, running

# fixed values: presets by complexity (labels, rules, variables, categories from/to, numerical variables, spans, properties)
COMPLEXITIES = {
    1: (2, 5, 4, 3, 4, 0, 4, 0),
    2: (3, 6, 5, 3, 4, 1, 4, 0),
    3: (4, 8, 6, 3, 5, 1, 4, 0),
    4: (4, 8, 6, 3, 5, 1, 4, 1),
    5: (4, 10, 7, 3, 5, 2, 4, 2),
}
_PRESET = ["labels", "rules", "variables", "min_categories", "max_categories", "numerical_variables", "spans", "properties"]
PROPERTY_LABELS = 3  # labels of each categorical output property of a preset
INTRO_SAMPLES = 10


def complexity(configs: DataFrame) -> DataFrame:
    """Preset columns of a config's complexity, an error for unknown ones, and the sample cap of
    rendered interactive datasets."""
    presets = small_table(configs.sparkSession, [(k, *v) for k, v in COMPLEXITIES.items()], "udd_complexity int, " + ", ".join(f"{c} int" for c in _PRESET))
    interactive = (F.col("level") == "files") & (F.coalesce("mode", F.lit("static")) != "static")
    return configs.join(presets, "udd_complexity", "left").withColumns({
        "error": F.when(F.col("labels").isNull(), F.concat(F.lit("Unrecognized UDD complexity level: "), F.col("udd_complexity").cast("string"))),
        "output_properties": F.transform(F.filter(F.sequence(F.lit(0), F.col("properties")), lambda i: i > 0), lambda i: F.struct(
            F.concat(F.lit("property_"), i.cast("string")).alias("name"), F.lit(PROPERTY_LABELS).alias("labels"))),
        "render_cap": F.when(interactive, F.lit(INTRO_SAMPLES))})


def match_with_reasons(configs: DataFrame, levels: Sequence, modes: Sequence, complexities: Sequence) -> DataFrame:
    """Add ``reasons`` (why a config is not wanted) and ``matches``; an empty allow-list passes all."""
    def check(column: str, allowed: Sequence, word: str) -> Column:
        if not allowed:
            return F.lit(None).cast("string")
        inside = F.coalesce(F.col(column).isin([a for a in allowed if a is not None]), F.lit(None in list(allowed)))
        return F.when(~inside, F.concat(F.lit(f"{word}="), F.coalesce(F.col(column).cast("string"), F.lit("None"))))

    found = F.filter(F.array(check("level", levels, "textualization_level"), check("mode", modes, "dynamic"),
                             check("udd_complexity", complexities, "udd_complexity")), lambda r: r.isNotNull())
    return configs.withColumn("reasons", found).withColumn("matches", F.size("reasons") == 0)


def completed(configs: DataFrame, files: DataFrame, model_names: Sequence[str], lenient: Sequence[str] | None = None) -> DataFrame:
    """Add ``completed``: result files exist for a config under one of the model's names.

    Looked for are <model>/<mode>/<level>, then <model>/<level>; with lenient names (all, by
    default) any file below the model's folder counts.
    """
    lenient = list(model_names) if lenient is None else list(lenient)
    tail = r"^(.*)/evaluation_results/([^/]+)/(?:([^/]+)/)?(?:([^/]+)/)?.*\.json$"
    f = files.select(*[F.regexp_extract("path", tail, i).alias(n) for i, n in ((1, "dataset_id"), (2, "model"), (3, "a"), (4, "b"))]).where("dataset_id <> ''").distinct()
    slugs = F.array(*[slug(F.lit(m)) for m in model_names])
    c = configs.select("dataset_id", F.upper(F.col("mode")).alias("mode_name"), F.col("mode").alias("mode_value"),
                       F.explode(F.when(F.col("level").isNull(), F.array(F.lit("raw"), F.lit("unknown"))).otherwise(F.array("level"))).alias("lvl"))
    c = c.select("*", F.explode(slugs).alias("model"))
    j = c.join(f, ["dataset_id", "model"])
    current = (F.col("a") == F.col("mode_name")) | (F.col("a") == F.col("mode_value"))
    hit = (current & (F.col("b") == F.col("lvl"))) | (F.col("a") == F.col("lvl"))
    any_file = F.array_contains(F.array(*[slug(F.lit(m)) for m in lenient]), F.col("model")) if lenient else F.lit(False)
    done = j.where(F.coalesce(hit, F.lit(False)) | any_file).select("dataset_id").distinct().withColumn("__done", F.lit(True))
    return configs.join(done, "dataset_id", "left").withColumn("completed", F.coalesce("__done", F.lit(False))).drop("__done")


CORE = ["udd_complexity", "num_samples", "level", "mode", "model", "max_genetic_search_configurations", "genetic_search_max_iterations"]


def missing_configs(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Configs whose core settings are not stored yet; null settings equal null settings."""
    w, s = wanted.alias("w"), stored.select(*CORE).distinct().alias("s")
    cond = F.lit(True)
    for c in CORE:
        cond = cond & F.col(f"w.{c}").eqNullSafe(F.col(f"s.{c}"))
    return w.join(s, cond, "left_anti")


def pending_groups(configs: DataFrame, block: int = 10_000) -> DataFrame:
    """Datasets to evaluate by (level, mode, size), paths sorted, in lists of bounded length.

    Interactive groups show 10 samples and may experiment on the rest; static ones show all.
    """
    keys = ["level", "mode", "num_samples"]
    rows = configs.select(F.coalesce("level", F.lit("raw")).alias("level"), parse_mode(F.col("mode"), F.lit("static")).alias("mode"),
                          "num_samples", F.col("dataset_id").alias("path"))
    ranked = running(chunked(rows, ["path", *keys]), keys, ["path"], F.col("__part"), {"__rank": ("sum", F.lit(1).cast("long"))})
    static = F.col("mode") == "static"
    return list_blocks(ranked, keys, "__rank", F.col("path"), block, "paths").withColumns({
        "intro": F.when(static, F.col("num_samples")).otherwise(F.lit(INTRO_SAMPLES)),
        "budget": F.when(static, F.lit(0)).otherwise(F.greatest(F.lit(0), F.col("num_samples") - INTRO_SAMPLES))})


def json_safe(df: DataFrame, key: str) -> DataFrame:
    """The row as one JSON text."""
    return df.select(key, F.to_json(F.struct(*[c for c in df.columns if c != key])).alias("config"))


def category_domain(definition: Column) -> Column:
    """Category ids of a definition given as text: a count, a list, or a map; [0, 1] otherwise.

    A map with a key that is not a number counts its entries.
    """
    keys = F.json_object_keys(definition)
    numbered = F.transform(keys, lambda k: k.try_cast("int"))
    count = F.when(definition.rlike("^[0-9]+$"), definition.try_cast("int")).when(
        F.trim(definition).startswith("["), F.json_array_length(definition))
    plain = lambda n: F.when(n <= 0, F.expr("CAST(array() AS ARRAY<INT>)")).otherwise(F.sequence(F.lit(0), n - 1))
    from_map = F.when(F.exists(numbered, lambda k: k.isNull()), plain(F.size(keys))).otherwise(F.array_sort(F.array_distinct(numbered)))
    return F.when(is_object(definition), from_map).when(count.isNotNull(), plain(count)).otherwise(F.array(F.lit(0), F.lit(1)))


def sweep(df: DataFrame, options: Mapping[str, Sequence]) -> DataFrame:
    """Every combination of the options for every row, in option order."""
    for name, choices in options.items():
        df = df.select("*", F.explode(F.array(*[F.lit(c) for c in choices])).alias(name))
    return df


def task_grid(targets: DataFrame, models: Sequence[str], iterations: int) -> DataFrame:
    """target x model x iteration."""
    return sweep(targets, {"model": list(models)}).select("*", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("iteration"))


def expand_targets(instances: DataFrame, levels: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Wanted (dataset, level, name) with a status: ok, missing level or missing instance."""
    wanted = sweep(instances.select("dataset_id").distinct(), {"level": list(levels), "name": list(names)})
    have_level = instances.select("dataset_id", "level").distinct().withColumn("__level", F.lit(1))
    have = instances.select("dataset_id", "level", "name").distinct().withColumn("__name", F.lit(1))
    j = wanted.join(have_level, ["dataset_id", "level"], "left").join(have, ["dataset_id", "level", "name"], "left")
    status = F.when(F.col("__level").isNull(), "missing level").when(F.col("__name").isNull(), "missing instance").otherwise("ok")
    return j.select("dataset_id", "level", "name", status.alias("status"))
