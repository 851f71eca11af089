"""Known results of two stored models (fixed values in tests/golden): read, enumerate, score, analyse."""

import json
import os

import pytest
from pyspark.sql import functions as F

from weighbridge.operators import analysis as an
from weighbridge.operators import scoring as sc
from weighbridge.operators.model import model_from_tables
from weighbridge.sources import catalog as ct

HERE = os.path.join(os.path.dirname(__file__), "golden")


def load(spark, tmp_path, name):
    golden = json.load(open(f"{HERE}/{name}.json"))
    root = tmp_path / "data" / name
    root.mkdir(parents=True)
    (root / "UDD.json").write_text(json.dumps(golden["model"], indent=2))
    (root / "raw_samples.json").write_text(json.dumps(golden["samples"], indent=2))
    files = ct.load_all(ct.scan(spark, [str(tmp_path)]))
    tables = ct.read_models(files.where("kind = 'model'"))
    heads = tables["models"].orderBy("var").collect()
    model = model_from_tables(*[tables[t].collect() for t in ("categories", "numeric", "spans", "rules")],
                              labels=heads[0]["labels"], order=[h["var"] for h in heads])
    return golden, model, files


@pytest.mark.parametrize("name", ["raw", "files"])
def test_analysis_matches_stored_values(spark, tmp_path, name):
    golden, model, _ = load(spark, tmp_path, name)
    want = golden["analysis"]
    names = [v.name for v in model.variables]
    everything = an.enumerate_assignments(spark, names, model.sizes)
    scored = sc.score_wide(everything, model, {n: F.col(n) for n in names}).cache()
    got = an.analyze(scored, model.labels).first()
    assert got["total"] == want["total_combinations"]
    assert got["label_counts"] == [want["label_counts"][str(i)] for i in range(model.labels)]
    assert got["avg_decisiveness"] == pytest.approx(want["avg_decisiveness"], abs=1e-12)
    assert got["avg_top_score"] == pytest.approx(want["avg_top_score"], abs=1e-12)
    assert got["max_gap"] == pytest.approx(want["max_fraction_gap_from_uniform"], abs=1e-12)
    early = scored.agg(an.early_stop_minimum(F.col("decisiveness"), F.col("aid"), 0.75).alias("m")).first()["m"]
    assert early == pytest.approx(want["min_decisiveness_overall"], abs=1e-12)
    assert scored.agg(F.min("decisiveness")).first()[0] < early


@pytest.mark.parametrize("name", ["raw", "files"])
def test_stored_samples_score_alike(spark, tmp_path, name):
    _, model, files = load(spark, tmp_path, name)
    samples = ct.read_raw_samples(files.where("kind = 'raw_samples'"))
    names = [v.name for v in model.variables]
    rows = samples.select("sample_idx", F.col("score").alias("stored"), F.col("label").alias("stored_label"),
                          *[F.col("assignment")[n].alias(n) for n in names])
    scored = sc.score_wide(rows, model, {n: F.col(n) for n in names}).collect()
    assert len(scored) == 10
    for r in scored:
        assert r["label"] == r["stored_label"]
        assert r["score"] == pytest.approx(r["stored"], abs=1e-14)
