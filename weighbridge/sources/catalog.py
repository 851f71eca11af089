"""Datasets, instances and runs read from trees of JSON files.

A tree is scanned into (path, content) rows, one per file, and every reader below turns such
rows into typed tables; the same readers work on any table that holds files as rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import clamp01
from ..functions.parsing import is_object
from ..functions.seeded import u01
from ..functions.text import LEVELS, MODES, parse_level, parse_mode
from . import schema

ROOT_FILE = "UDD.json"


def scan(spark: SparkSession, roots: Sequence[str], name: str = "*.json") -> DataFrame:
    """(path, content) of every matching file below the roots; listing and reading are distributed."""
    files = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name)
             .text(list(roots), wholetext=True))
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return files.select(F.regexp_replace(path, "^file:/*", "/").alias("path"), F.col("value").alias("content"))


# -- paths ---------------------------------------------------------------------------------------

def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"\.[^.]*$", "")


def depths(df: DataFrame, path: str) -> list[int]:
    """How many parts the paths of a column have: as many numbers as folders are ever nested."""
    return sorted(r["d"] for r in df.select(F.size(F.split(path, "/")).alias("d")).distinct().collect())


def ancestors(path: Column, at: Sequence[int], include_self: bool = True) -> Column:
    """The leading folders of a path that have one of the given depths, so prefix questions become
    equality joins. Folders above all that is looked for, which many files share, are left out."""
    parts = F.split(path, "/")
    depth = F.size(parts) if include_self else F.size(parts) - 1
    wanted = F.array(*[F.lit(d) for d in at]).cast("array<int>")
    return F.transform(F.filter(wanted, lambda d: d <= depth), lambda d: F.array_join(F.slice(parts, F.lit(1), d), "/"))


def dataset_roots(files: DataFrame) -> DataFrame:
    """Folders that hold a model file and lie below no other such folder."""
    hits = files.where(F.col("path").endswith(f"/{ROOT_FILE}")).select(parent(F.col("path")).alias("root")).distinct()
    above = hits.select("root", F.explode(ancestors(F.col("root"), depths(hits, "root"), include_self=False)).alias("up"))
    nested = above.join(hits.withColumnRenamed("root", "up"), "up", "left_semi").select("root")
    return hits.join(nested.distinct(), "root", "left_anti")


def resolve_paths(requests: DataFrame, roots: DataFrame) -> DataFrame:
    """Requested paths (pos, path) expanded to the roots at or below them, each root once, with
    the position of the first request that found it."""
    first = requests.groupBy(F.col("path").alias("up")).agg(F.min("pos").alias("pos"))
    reach = roots.select("root", F.explode(ancestors(F.col("root"), depths(first, "up"))).alias("up"))
    return reach.join(first, "up").groupBy("root").agg(F.min("pos").alias("first_pos"))


def with_dataset(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Add the dataset root a file belongs to; files outside all roots drop out."""
    up = files.select("*", F.explode(ancestors(F.col("path"), depths(roots, "root"), include_self=False)).alias("__up"))
    return up.join(roots.select(F.col("root").alias("__up")), "__up").withColumnRenamed("__up", "dataset_id")


# fixed values: file names of a dataset folder
KINDS = {"UDD.json": "model", "raw_samples.json": "raw_samples", "metadata.json": "metadata",
         "dataset_creation_statistics.json": "statistics", "output_properties.json": "output_properties",
         "paper_dataset_instance.json": "config"}


def file_kind(path: Column) -> Column:
    kind = F.when(path.rlike("/instances/([^/]+/)?[^/]+\\.json$"), "instance").when(
        path.rlike("/evaluation_results/.+\\.json$"), "run").when(path.rlike("/noise_theories/[^/]+\\.json$"), "noise_theory")
    for name, word in KINDS.items():
        kind = F.when(path.endswith(f"/{name}"), word).otherwise(kind)
    return kind


def load_all(files: DataFrame) -> DataFrame:
    """(dataset_id, kind, path, content) of every known file of every dataset."""
    known = files.withColumn("kind", file_kind(F.col("path"))).where("kind IS NOT NULL")
    return with_dataset(known, dataset_roots(files.select("path"))).select("dataset_id", "kind", "path", "content")


# -- models --------------------------------------------------------------------------------------

def read_models(docs: DataFrame, key: str = "dataset_id", seed: int = 7) -> dict[str, DataFrame]:
    """Model files (key, content) to long tables: models, categories, numeric, spans, rules.

    Categorical tables are brought to the model's labels and categories: cells that the file lacks are
    drawn by ``seed``, and entries under other keys are left out.
    """
    m = docs.select(key, F.from_json("content", schema.MODEL).alias("m"))
    variables = m.select(key, F.coalesce("m.num_output_labels", F.lit(2)).alias("labels"), F.explode("m.variables").alias("var", "v"))

    none = F.expr("CAST(map() AS MAP<STRING, MAP<STRING, DOUBLE>>)")
    plain = variables.where(F.coalesce("v.variable_type", F.lit("categorical")) == "categorical").select(
        key, "var", "labels", F.coalesce("v.weights", none).alias("w"), F.coalesce("v.scores", none).alias("s"), F.col("v.categories").alias("n"))
    numbered = F.transform(F.flatten(F.transform(F.concat(F.map_values("w"), F.map_values("s")), lambda m: F.map_keys(m))), lambda k: k.try_cast("int"))
    plain = plain.withColumn("n", F.coalesce("n", F.array_max(numbered) + 1, F.lit(0))).where((F.col("n") > 0) & (F.col("labels") > 0))
    grid = plain.select("*", F.explode(F.sequence(F.lit(0), F.col("labels") - 1)).alias("label")).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("cat"))

    def cell(table: str) -> Column:
        row = F.try_element_at(F.col(table), F.col("label").cast("string"))
        drawn = u01(f"{seed}-{table}", F.col(key), F.col("var"), F.col("label"), F.col("cat"))
        return F.coalesce(clamp01(F.try_element_at(row, F.col("cat").cast("string"))), drawn)

    categories = grid.select(key, "var", "label", "cat", cell("w").alias("weight"), cell("s").alias("score"))
    numbers = variables.where("v.variable_type = 'numerical'")
    numeric = numbers.select(key, "var", "v", F.explode(F.sequence(F.lit(0), F.col("labels") - 1)).alias("label"))
    at = lambda name: F.try_element_at(F.col(f"v.{name}"), F.col("label").cast("string"))
    numeric = numeric.select(key, "var", "label", F.least(at("min_weight"), at("max_weight")).alias("low"),
                             F.greatest(at("min_weight"), at("max_weight")).alias("high"),
                             at("direction").alias("rising"), at("variable_score").alias("score"))
    spans = numbers.select(key, "var", F.size("v.spans").alias("n"), F.posexplode("v.spans").alias("idx", "s")).select(
        key, "var", "idx", F.col("s")[0].alias("lo"), F.col("s")[1].alias("hi"), (F.col("idx") == F.col("n") - 1).alias("is_last"))
    rules = m.select(key, F.posexplode("m.rules").alias("ord", "r")).select(key, "ord", "r.*")
    heads = variables.select(key, "labels", "var", F.coalesce("v.categories", F.size("v.spans")).alias("categories"),
                             F.coalesce("v.variable_type", F.lit("categorical")).alias("kind"))
    return {"models": heads, "categories": categories, "numeric": numeric, "spans": spans, "rules": rules}


# -- samples and instances -------------------------------------------------------------------------

def _sample_columns(s: Column, index: Column) -> list[Column]:
    empty = lambda t: F.expr(f"CAST(map() AS MAP<STRING, {t}>)")
    return [index.alias("sample_idx"), F.coalesce(s["assignment"], empty("INT")).alias("assignment"),
            F.coalesce(s["score"], F.lit(0.0)).alias("score"), F.coalesce(s["label"], F.lit(0)).alias("label"),
            s["instance_text"].alias("instance_text"), s["instance_label_text"].alias("instance_label_text"),
            s["instance_type"].alias("instance_type"), F.coalesce(s["numerical_values"], empty("DOUBLE")).alias("numerical_values"),
            F.coalesce(s["property_labels"], empty("INT")).alias("property_labels"),
            F.coalesce(s["property_scores"], empty("DOUBLE")).alias("property_scores")]


def read_raw_samples(docs: DataFrame, keys: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Sample arrays to rows; an entry without assignment, score and label stays opaque JSON text."""
    rows = docs.select(*keys, F.posexplode(F.from_json("content", "ARRAY<STRING>")).alias("sample_idx", "raw"))
    complete = F.size(F.array_intersect(F.json_object_keys("raw"), F.array(F.lit("assignment"), F.lit("score"), F.lit("label")))) == 3
    s = F.from_json("raw", schema.SAMPLE)
    parsed = rows.withColumn("opaque", ~F.coalesce(complete, F.lit(False))).withColumn("s", F.when(~F.col("opaque"), s))
    return parsed.select(*keys, *_sample_columns(F.col("s"), F.col("sample_idx")), F.when(F.col("opaque"), F.col("raw")).alias("opaque"))


def normalize_samples(df: DataFrame) -> DataFrame:
    """Any sample-like table to the nine sample columns, missing ones null."""
    wanted = {"assignment": "map<string,int>", "label": "int", "score": "double", "instance_text": "string",
              "instance_label_text": "struct<label:string,properties:map<string,string>>", "instance_type": "string",
              "numerical_values": "map<string,double>", "property_labels": "map<string,int>", "property_scores": "map<string,double>"}
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in wanted.items()])


def variable_order(model_variables: Column, first_assignment: Column) -> Column:
    """Sorted variable names of the model, else of the first sample."""
    return F.when(F.size(model_variables) > 0, F.array_sort(model_variables)).otherwise(F.array_sort(F.map_keys(first_assignment)))


def read_instances(files: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Instance files (key, path, content), at instances/<level>/<name>.json or instances/<name>.json.

    Version 1 has neither name, mapping nor hint; the level comes from the file, under its
    present or its older key, else from the folder.
    """
    p = files.select(key, "path", F.from_json("content", schema.INSTANCE).alias("i"))
    folder = F.regexp_extract("path", "/instances/([^/]+)/[^/]+$", 1)
    version = F.coalesce("i.version", F.lit(1))
    modern = lambda c: F.when(version >= 2, F.col(f"i.{c}"))
    stated = F.coalesce("i.representation_level", "i.textualization_level")
    from_file = F.when(parse_level(stated) != "unknown", parse_level(stated))
    return p.where(F.col("i.udd").isNotNull() & F.col("i.dataset").isNotNull()).select(
        key, "path", version.alias("version"), F.coalesce(modern("name"), file_stem(F.col("path"))).alias("name"),
        F.coalesce(from_file, parse_level(folder), F.lit("unknown")).alias("level"), parse_level(folder).alias("folder_level"),
        modern("text_mapping").alias("text_mapping"), modern("instance_hint_used").alias("hint"),
        F.col("i.metadata").alias("metadata"), F.col("i.dataset").alias("dataset"), F.col("i.rendered_documents").alias("rendered_documents"))


def instance_samples(instances: DataFrame, keys: Sequence[str]) -> DataFrame:
    rows = instances.select(*keys, F.posexplode("dataset").alias("sample_idx", "s"))
    return rows.select(*keys, *_sample_columns(F.col("s"), F.col("sample_idx")))


def distinct_instance_names(instances: DataFrame, keys: Sequence[str]) -> DataFrame:
    return instances.select(*keys, "name").distinct()


# -- metadata, statistics, properties, theories ----------------------------------------------------

def read_metadata(docs: DataFrame, key: str = "dataset_id") -> DataFrame:
    return docs.select(key, F.from_json("content", schema.METADATA).alias("m")).select(key, "m.*")


def read_statistics(docs: DataFrame, key: str = "dataset_id") -> DataFrame:
    s = docs.select(key, F.from_json("content", schema.STATISTICS).alias("s"))
    ints = lambda c: F.coalesce(F.transform_keys(F.map_filter(F.col(f"s.{c}"), lambda k, v: k.try_cast("int").isNotNull()), lambda k, v: k.try_cast("int")), F.expr("CAST(map() AS MAP<INT, INT>)")).alias(c)
    return s.select(key, F.coalesce("s.udd_search_iterations", F.lit(0)).alias("udd_search_iterations"), ints("samples_per_label"),
                    ints("total_samples_per_label"), F.coalesce("s.total_number_of_assignments", F.lit(0)).alias("total_number_of_assignments"),
                    F.col("s.analysis_results").alias("analysis_results"))


REQUIRED_THEORY_KEYS = ["accuracy", "llm", "textual_dt_theory", "textual_llm_theory"]


def read_noise_theories(docs: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Theories (key, path, content) with a ``missing`` list; a row is valid when it is empty."""
    from ..functions.text import slug
    need = F.array(*[F.lit(k) for k in REQUIRED_THEORY_KEYS])
    missing = F.coalesce(F.array_except(need, F.json_object_keys("content")), need)
    t = docs.select(key, slug(file_stem(F.col("path"))).alias("name"), missing.alias("missing"), F.from_json("content", schema.THEORY).alias("t"))
    return t.select(key, "name", "missing", "t.accuracy", "t.target_accuracy", "t.llm", "t.textual_llm_theory", "t.textual_dt_theory",
                    F.coalesce("t.textualized_versions", F.expr("CAST(map() AS MAP<STRING, STRING>)")).alias("textualized_versions"))


_PROPERTY_FIELDS = ["type", "num_output_labels", "min_value", "max_value", "unit", "description"]


def property_rows(docs: DataFrame, key: str = "dataset_id") -> DataFrame:
    """A JSON object of properties to rows (key, property, fields...)."""
    rows = docs.select(key, F.explode(F.from_json("content", f"MAP<STRING, {schema.PROPERTY}>")).alias("property", "p"))
    return rows.select(key, "property", *[F.col(f"p.{c}").alias(c) for c in _PROPERTY_FIELDS],
                       F.col("p.num_categories").alias("num_categories"),
                       F.coalesce("p.available_for_labels", F.expr("CAST(array() AS ARRAY<INT>)")).alias("support"), F.col("p.udd").alias("udd"))


def merge_properties(from_file: DataFrame, from_metadata: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Property file over metadata: a field given in the file wins, metadata fills the rest."""
    f, m = from_file.alias("f"), from_metadata.alias("m")
    j = f.join(m, (F.col(f"f.{key}") == F.col(f"m.{key}")) & (F.col("f.property") == F.col("m.property")), "full_outer")
    both = lambda c: F.coalesce(F.col(f"f.{c}"), F.col(f"m.{c}")).alias(c)
    return j.select(both(key), both("property"), *[both(c) for c in _PROPERTY_FIELDS], F.col("f.support").alias("support"))


def property_metadata_merge(metadata: DataFrame, models: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Metadata against attached property models (key, property, labels): metadata wins, models fill."""
    j = metadata.join(models.withColumnRenamed("labels", "__labels"), [key, "property"], "full_outer")
    count = F.coalesce("num_output_labels", "num_categories", "__labels")
    return j.select(key, "property", F.coalesce(F.lower("type"), F.lit("categorical")).alias("type"), count.alias("num_output_labels"),
                    "min_value", "max_value", "unit", "description")


# -- runs and configs ------------------------------------------------------------------------------

def read_eval_runs(files: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Runs at evaluation_results/<model>/<mode>/<level>/<instance>/<run>.json.

    Path parts stand in for absent fields; unknown modes and unreadable files are left out.
    """
    tail = r"/evaluation_results/([^/]+)/([^/]+)/([^/]+)/([^/]+)/([^/]+)\.json$"
    part = lambda i: F.regexp_extract("path", tail, i)
    r = files.where(F.col("path").rlike(tail)).select(
        key, part(1).alias("p_model"), part(2).alias("p_mode"), part(3).alias("p_level"), part(4).alias("p_instance"), part(5).alias("p_run"),
        is_object(F.col("content")).alias("readable"), F.from_json("content", schema.RUN).alias("r"))
    kept = r.where(F.col("p_mode").isin([m.upper() for m in MODES]) & F.col("readable"))
    return kept.select(
        key, F.coalesce("r.run_id", "p_run").alias("run_id"), F.coalesce("r.model_name", "p_model").alias("model"),
        F.coalesce("r.interactive_mode", "p_mode").alias("mode"), parse_level(F.coalesce("r.representation_level", "p_level")).alias("level"),
        F.coalesce("r.instance_name", "p_instance").alias("instance"), F.to_timestamp("r.created_at").alias("created_at"),
        F.col("r.results").alias("results"), F.col("r.session_data").alias("session_data"))


def read_dataset_configs(files: DataFrame) -> DataFrame:
    """Config files to rows; a file whose counts are not whole numbers is dropped.

    The level is read from its present and from its older key.
    """
    whole = lambda c: F.col(f"c.{c}").try_cast("int").alias(c)
    level = parse_level(F.coalesce("c.representation_level", "c.textualization_level"))
    return files.select(parent(F.col("path")).alias("dataset_id"), F.from_json("content", schema.CONFIG).alias("c")).select(
        "dataset_id", whole("udd_complexity"), whole("num_samples"), F.when(level != "unknown", level).alias("level"),
        parse_mode(F.col("c.dynamic")).alias("mode"), F.coalesce("c.llm_model", F.lit("GPT_4O")).alias("model"),
        F.col("c.file_rendering").alias("file_rendering"), whole("max_genetic_search_configurations"),
        whole("genetic_search_max_iterations")).dropna(subset=["udd_complexity", "num_samples"])


def read_rendered_documents(metadata: DataFrame, instances: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Documents listed in metadata, attached to existing instances, with absolute paths rebuilt."""
    by_level = metadata.select(key, F.explode("rendered_instances").alias("level", "by_name"))
    by_name = by_level.select(key, parse_level(F.col("level")).alias("level"), F.explode("by_name").alias("name", "docs"))
    rows = by_name.select(key, "level", "name", F.posexplode("docs").alias("pos", "d")).where(F.length("d.path") > 0)
    absolute = F.when(F.length("d.absolute_path") > 0, F.col("d.absolute_path")).when(
        F.col("d.path").startswith("/"), F.col("d.path")).otherwise(F.concat(F.col(key), F.lit("/"), F.col("d.path")))
    rows = rows.select(key, "level", "name", "pos", "d.path", absolute.alias("absolute_path"), "d.created_at", "d.mode")
    return rows.join(instances.select(key, "level", "name").distinct(), [key, "level", "name"], "left_semi")


def files_alias_union(instances: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Instances with documents get a ``files`` twin unless one of that name exists.

    Of several levels that could give the twin, the first in level order does.
    """
    rank = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("level"))
    source = instances.where((F.col("level") != "files") & (F.col("documents") > 0))
    first = source.groupBy(key, "name").agg(F.min_by(F.struct(*[c for c in instances.columns if c not in (key, "name")]), rank).alias("s"))
    twins = first.select(key, "name", "s.*").withColumn("level", F.lit("files"))
    have = instances.where("level = 'files'").select(key, "name")
    return instances.unionByName(twins.join(have, [key, "name"], "left_anti").select(*instances.columns))


def legacy_parent_path(wanted: DataFrame, files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Path of a wanted instance (keys..., root, name, level): in its level, then in any level, then
    flat; the exact name before the slugged one."""
    from ..functions.text import slug
    tail = F.regexp_extract("path", "^(.*)/instances/(?:([^/]+)/)?([^/]+)\\.json$", 1)
    f = files.select("path", tail.alias("root"), F.regexp_extract("path", "/instances/([^/]+)/[^/]+$", 1).alias("folder"),
                     file_stem(F.col("path")).alias("stem"))
    names = F.array_distinct(F.array(F.col("name"), slug(F.col("name"))))
    w = wanted.select("*", F.posexplode(names).alias("form", "stem"))
    j = w.join(f, ["root", "stem"])
    place = F.when(F.col("folder") == F.col("level"), 0).when(F.col("folder") != "", 1).otherwise(2)
    return j.groupBy(*keys).agg(F.min_by("path", F.struct(place.alias("a"), F.when(F.col("folder") == F.col("level"), "").otherwise(F.col("folder")).alias("b"),
                                                          F.col("form").alias("c"))).alias("path"))
