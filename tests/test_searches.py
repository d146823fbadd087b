"""Searches, fits and keys against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paths import SF_SMALL
from rightsize.operators import calibrate as K
from rightsize.operators import compare as X
from rightsize.operators import cost as C
from rightsize.operators import fit
from rightsize.operators import unique as U
from rightsize.operators.staircase import first_step
from rightsize.plans.jobs import JOBS
from rightsize.sources import sinks
from rightsize.sources.fixtures import fixture


# ---- least squares -------------------------------------------------------------

def test_fit_against_numpy(spark):
    rng = random.Random(1)
    rows = []
    for app in (1, 2):
        for _ in range(400):
            a, b, c = rng.randint(1, 300), rng.choice([0, 0, rng.randint(1, 90)]), rng.randint(0, 200)
            rows.append((app, int(900 * app + 11 * a + 25 * b + 5 * c + rng.randint(-50, 50)), a << 20, b << 20, c << 20))
    df = spark.createDataFrame(rows, "app_id int, duration_ms bigint, input_bytes bigint, disk_spill_bytes bigint, shuffle_bytes bigint")
    got = {r.app_id: r for r in fit.solve(fit.normal_equations(df, ["app_id"]), ["app_id"]).collect()}
    for app in (1, 2):
        x = np.array([(1, a >> 20, b >> 20, c >> 20) for k, _, a, b, c in rows if k == app], float)
        want = np.linalg.lstsq(x, np.array([y for k, y, *_ in rows if k == app], float), rcond=None)[0]
        g = got[app]
        assert (g.overhead_ms, g.input_ms_mb, g.spill_ms_mb, g.shuffle_ms_mb) == pytest.approx(tuple(want), rel=1e-5, abs=1e-5)


def test_a_measure_that_does_not_vary_has_no_rate(spark):
    rows = [(1, 500 + 10 * a, a << 20, 0, (2 * a) << 20) for a in range(1, 80)] + [(2, 70, 5 << 20, 0, 0)] * 3 + [(3, 1000 - a, a << 20, 0, 0) for a in range(1, 80)]
    df = spark.createDataFrame(rows, "app_id int, duration_ms bigint, input_bytes bigint, disk_spill_bytes bigint, shuffle_bytes bigint")
    got = {r.app_id: r for r in fit.fitted_rates(df, ["app_id"]).collect()}
    assert (got[1].cpu_throughput_mb_s_per_core, got[1].task_overhead_s) == pytest.approx((100.0, 0.5))
    for app, r in got.items():
        assert r.disk_throughput_mb_s_per_executor is None and r.network_throughput_mb_s_per_executor is None
    assert got[2].cpu_throughput_mb_s_per_core is None and got[2].task_overhead_s == pytest.approx(0.07)
    assert got[3].cpu_throughput_mb_s_per_core is None


def test_both_models_are_back_tested(spark):
    rows = JOBS["backtest_models"](spark, SF_SMALL).collect()
    apps = fixture(spark, SF_SMALL, "task_metrics").select("app_id").distinct().count()
    assert len(rows) == apps and all(r.cost_sec > 0 for r in rows)
    assert {r.closer for r in rows} <= {"wave", "cost"}
    assert all(r.closer == "cost" for r in rows if r.wave_sec is None)


# ---- search within the row ------------------------------------------------------

def smallest_by_trying(spark, workloads):
    tried = C.candidates(spark, workloads, search_only=True).where("in_search AND target_runtime_min > 0 AND runtime_min <= target_runtime_min")
    return {r.workload_id: (r.n, r.t) for r in tried.groupBy("workload_id").agg(F.min("n").alias("n"), F.min_by("runtime_min", "n").alias("t")).collect()}


def test_halving_equals_trying_every_count(spark):
    wl = fixture(spark, SF_SMALL, "cost_workloads")
    got = C.sla_search(C.search_base(spark, wl)).collect()
    assert {r.workload_id: (r.best_executors, r.runtime_at_best_min) for r in got if r.status == "met"} == smallest_by_trying(spark, wl)
    assert len(got) == wl.count() and {r.status for r in got} == {"met", "disabled", "unreachable"}


def test_a_runtime_that_may_rise_is_searched_count_by_count(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([-0.9, -0.2, 0.65]), rng.choice([-0.8, 0.9]), rng.choice([1.3, 0.5]), rng.randint(1, 9), rng.randint(1, 60), rng.uniform(5, 200)) for i in range(300)]
    wl = spark.createDataFrame(rows, "workload_id int, spill_penalty_per_100pct double, gc_penalty_sensitivity double, spark_storage_fraction double,"
                                     " min_executors int, max_executors int, target_runtime_min double").withColumn("team", F.lit("t"))
    got = {r.workload_id: (r.best_executors, r.runtime_at_best_min) for r in C.sla_search(C.search_base(spark, wl)).collect() if r.status == "met"}
    assert got == smallest_by_trying(spark, wl) and got


def test_a_wide_range_needs_no_candidates(spark):
    wl = spark.createDataFrame([(1, "t", 2_000_000_000, 1e-1), (2, "t", 2_000_000_000, 240.0)], "workload_id int, team string, max_executors int, target_runtime_min double")
    got = {r.workload_id: r for r in C.sla_search(C.search_base(spark, wl)).collect()}
    assert got[1].status == "unreachable" and got[2].status == "met" and got[2].runtime_at_best_min <= 240.0


# ---- staircase -------------------------------------------------------------------

@pytest.mark.parametrize("n", [0, 1, 2, 5, 64, 65, 1000, 1_000_000])
def test_first_step_against_brute_force(spark, n):
    steps = spark.range(n).selectExpr("1024D + id / 1000D AS h")
    rows = spark.range(3000).selectExpr("id", f"CASE WHEN id % 100 <> 0 THEN 1023D + pmod(xxhash64(id), {n + 3000}) / 1000D END AS need")
    got = first_step(rows, "need", steps, "h", "found").toPandas().set_index("id").sort_index()
    h = 1024.0 + np.arange(n) / 1000.0
    for need, found in zip(got["need"], got["found"]):
        at = np.searchsorted(h, need) if need == need else n
        assert (found == h[at]) if at < n else found != found


def test_steps_inside_one_power_of_two_meet_one_pack_each(spark):
    steps = spark.range(200_000).selectExpr("1024D + id / 1000D AS h")
    p = first_step(spark.range(10).selectExpr("id", "1100D + id AS need"), "need", steps, "h", "found")
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Generate" not in plan


# ---- keys that must be unique -----------------------------------------------------

def test_duplicates_are_split_off(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (3, "d"), (None, "e")] + [(7, "hot")] * 50, "workload_id int, v string")
    assert sorted(r.v for r in U.unique_rows(df, "workload_id").collect()) == ["a", "d"]
    got = [(r.workload_id, r.copies, r.reject_reason) for r in U.duplicate_rejects(df, "workload_id").collect()]
    assert sorted(set(got), key=str) == [(2, 2, "duplicate_key"), (7, 50, "duplicate_key"), (None, None, "no_key")]
    assert len(got) == 53


def test_reductions_leave_duplicate_workloads_out(spark):
    one = fixture(spark, SF_SMALL, "cost_workloads")
    twice = one.where("workload_id % 7 = 0").withColumn("executors", F.col("executors") + 1).withColumn("max_executors", F.lit(9))
    both, gone = one.unionByName(twice), {r.workload_id for r in twice.collect()}
    for search in (lambda w: C.curve_gain(C.candidates(spark, w, with_prev=True)), lambda w: C.cheapest_two_pass(spark, w)):
        want = {tuple(r) for r in search(one).collect() if r.workload_id not in gone}
        assert {tuple(r) for r in search(both).collect()} == want and want
    assert C.sla_search(C.search_base(spark, both)).count() == both.count()


def test_spread_counts_plans_and_leaves_duplicates_out(spark):
    rows = [(1, "wave", 4, "ok"), (1, "cost", 8, "ok"), (2, "wave", 2, "ok"), (2, "cost", None, "unreachable"),
            (3, "wave", None, "sla_too_tight"), (4, "wave", 1, "ok"), (4, "wave", 9, "ok"), (4, "cost", 5, "ok")]
    df = spark.createDataFrame(rows, "workload_id bigint, model string, executors bigint, status string")
    got = [(r.workload_id, r.models, r.min_executors, r.max_executors) for r in X.model_spread(df).collect()]
    assert got == [(1, 2, 4, 8), (2, 1, 2, 2)]


def test_every_model_answers_for_every_workload(spark):
    got = JOBS["compare_models"](spark, SF_SMALL).groupBy("model").agg(F.count("*").alias("n"), F.count("executors").alias("plans"),
                                                                      F.count(F.when(F.col("status") == "ok", 1)).alias("ok")).collect()
    n = fixture(spark, SF_SMALL, "workloads").count()
    assert {r.model for r in got} == set(X.MODELS) and all(r.n == n and r.plans == r.ok < n for r in got if r.model != "node")
    assert all(r.plans == r.ok for r in got)


# ---- bucketed plan tables -----------------------------------------------------------

def test_plan_tables_are_joined_without_an_exchange(spark):
    old = spark.createDataFrame([(i, i % 5, i % 3) for i in range(300)], "workload_id int, executors int, heap int")
    new = old.where("workload_id >= 10").withColumn("executors", F.expr("CASE WHEN workload_id % 50 = 0 THEN 99 ELSE executors END")).unionByName(
        spark.createDataFrame([(1000, 1, None)], "workload_id int, executors int, heap int"))
    a, b = (sinks.write_bucketed(spark, df, "plans", "workload_id", 8) for df in (old, new))
    out = sinks.plan_changes(spark, a, b, "workload_id", ("executors", "heap"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    got = {r.workload_id: (r.change, r.old_executors, r.new_executors) for r in out.collect()}
    want = {i: ("removed", i % 5, None) for i in range(10)} | {i: ("changed", i % 5, 99) for i in range(50, 300, 50)} | {1000: ("added", None, 1)}
    assert got == want


def test_plan_tables_get_narrow_rows_and_buckets_as_an_exchange_has_parts(spark, monkeypatch):
    df = spark.range(500).selectExpr("id * 7 % 500 AS workload_id")
    table = sinks.write_bucketed(spark, df, "plans", "workload_id", 4, then=lambda d: d.withColumn("wide", F.expr("repeat('x', 100)")))
    assert sorted(r.workload_id for r in spark.table(table).where("wide = repeat('x', 100)").collect()) == list(range(500))
    files = spark.table(table).groupBy(F.input_file_name().alias("f")).agg(F.collect_list("workload_id").alias("ids")).collect()
    assert len(files) == 4 and all(r.ids == sorted(r.ids) for r in files)
    seen = []
    monkeypatch.setattr("rightsize.plans.jobs.write_bucketed", lambda spark, df, name, key, buckets, then: seen.append((df.columns, buckets)) or sinks.write_bucketed(spark, df, name, key, buckets, then))
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        assert JOBS["plan_changes"](spark, SF_SMALL).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert [b for _, b in seen] == [24, 24] and not any("spark_submit" in c for c, _ in seen)
