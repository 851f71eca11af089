"""Registered queries against their SQL. QUICK=1 runs a cross-section only."""

import os

import pytest

import __spark_entry__ as entry

from compare import connect, diff

SAMPLE = ["clamp01", "udd_score", "predict_label", "analyze_distribution", "per_label_metrics", "eval_report", "stratified_rank",
          "balanced_sample", "score_population", "render_template", "rolling_avg_length", "parse_tool_call", "read_udd",
          "append_eval_runs", "budget_ledger", "run_experiments", "knn_1d_join", "stream_score"]
ORACLE = entry.oracle_sql()
NAMES = SAMPLE if os.environ.get("QUICK") else sorted(n for n in ORACLE if not n.startswith("op"))


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, sf, name):
    assert diff(spark, con, sf, name, entry.queries()[name], ORACLE[name]) is None


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and sum(r["total"] for r in rows) > 1000
