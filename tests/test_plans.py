"""Physical-plan shape checks: the exchanges, joins and scans each job is
meant to have (see README, "Plan shapes and scale")."""

import re

import pytest

from paths import SF_SMALL
from rightsize.plans.jobs import JOBS


def plan(spark, name) -> str:
    return JOBS[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()


def shuffles(p: str) -> int:
    return len(re.findall(r"Exchange (hash|range|single|round|Single)", p)) + p.count("Exchange SinglePartition")


@pytest.mark.parametrize("name,expected", [
    ("sla_search", 1),         # spreads the workloads; no candidate rows
    ("curve_gain", 1),
    ("profile_compare", 0),    # three column sets of one row
    ("profile_plan", 0),       # projections and broadcast lookups only
    ("wave_plan_typed", 0),
    ("node_pack", 0),
    ("cost_estimate", 0),
])
def test_shuffle_count(spark, name, expected):
    assert shuffles(plan(spark, name)) == expected


def test_search_is_hash_aggregated(spark):
    assert "Generate" not in plan(spark, "sla_search") and "Aggregate" not in plan(spark, "sla_search")
    for name in ("curve_gain", "cheapest", "model_spread"):
        p = plan(spark, name)
        assert "SortAggregate" not in p and "HashAggregate" in p


def test_no_pairwise_joins(spark):
    for name in JOBS:
        if name == "read_task_metrics":
            continue
        p = plan(spark, name)
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_telemetry_is_scanned_and_shuffled_once(spark):
    """The raw tasks meet one exchange, hash aggregated, of the columns that count."""
    from rightsize.operators.calibrate import last_attempts
    from rightsize.sources.fixtures import fixture
    p = last_attempts(fixture(spark, SF_SMALL, "task_metrics"))._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet [^\n]*", p)
    assert len(scans) == 1 and shuffles(p) == 1 and "SortAggregate" not in p
    read_cols = re.search(r"FileScan parquet [^\[]*\[([^\]]*)\]", scans[0]).group(1)
    for unused in ("l_tax", "l_discount", "l_linestatus", "l_shipdate"):
        assert unused not in read_cols
    for name in ("stage_summary", "calibrate", "backtest"):
        assert "l_extendedprice" not in plan(spark, name) or name == "backtest"


def test_dims_are_broadcast(spark):
    p = plan(spark, "profile_plan")
    assert p.count("BroadcastHashJoin") >= 4


@pytest.mark.parametrize("name", ["profile_plan", "wave_plan_typed", "node_pack", "cost_estimate",
                                  "pick_shape", "wave_rejects"])
def test_projections_stay_in_whole_stage_codegen(spark, name):
    """No lambda-based (CodegenFallback) expression splits a model's projection
    out of whole-stage codegen."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = plan(spark, name)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    for line in p.splitlines():
        node = line.lstrip(" :+-")
        if node.startswith(("Project [", "Filter ")):
            assert False, f"{name}: outside whole-stage codegen: {node[:80]}"
