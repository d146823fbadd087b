"""Telemetry jobs against brute force: selection, sketches, as-of join, sweep line, re-run stages."""

import random
import re
from collections import defaultdict
from statistics import median

import pytest
from pyspark.sql import functions as F

from paths import SF_SMALL
from rightsize.operators import calibrate as K
from rightsize.operators import selection as S
from rightsize.operators.asof import asof_join
from rightsize.operators.parallelism import parallelism, running_counts
from rightsize.plans.jobs import JOBS


def test_exact_median_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([rng.randint(-50, 50), rng.randint(-(10**9), 10**9), 7])) for k in (1, 2, 2, 3, 3, 3, 4, None) * 90]
    rows += [(5, None), (6, 10), (7, 3), (7, 4), (8, 4095), (8, 4096)]
    df = spark.createDataFrame(rows, "k int, v bigint")
    got = {r.k: r.m for r in S.exact_median(df, ["k"], "v", "m").collect()}
    held = defaultdict(list)
    for k, v in rows:
        if v is not None:
            held[k].append(v)
    assert got == {k: median(v) for k, v in held.items()}
    assert {r.k: r.m for r in S.exact_median(df, ["k"], "v", "m", width=3).collect()} == got
    assert S.exact_median(df.limit(0), ["k"], "v", "m").collect() == []


def test_a_hot_stage_is_work_of_several_tasks(spark):
    hot = spark.range(0, 400_000, 1, 8).selectExpr("id div 400000 AS app_id", "id div 400000 AS stage_id", "pmod(xxhash64(id), 5000) + 1000 AS duration_ms")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keys = ["app_id", "stage_id"]
        values = S.middle_values(hot, keys, "duration_ms", 4096)
        tasks = values.groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) > 4 and max(r["count"] for r in tasks) < 2 * 4096 / 4
        assert S.middle_buckets(hot, keys, "duration_ms", 4096).count() <= 2
        exact = hot.agg(F.median("duration_ms")).first()[0]
        assert S.exact_median(hot, keys, "duration_ms", "m").first().m == exact
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 << 20))


def exchanges(p: str) -> tuple[int, int]:
    """Exchanges that move rows, and those read a second time."""
    reused = p.count("ReusedExchange")
    return len(re.findall(r"\bExchange hashpartitioning", p)) - reused, reused


def planned(df) -> str:
    """The plan with its exchanges merged, as it runs without adaptive changes."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 << 20))


def test_the_median_moves_a_value_once(spark):
    rows = spark.range(1000).selectExpr("id % 7 AS app_id", "id % 3 AS stage_id", "id AS duration_ms")
    p = planned(S.exact_median(rows, ["app_id", "stage_id"], "duration_ms", "m"))
    # the values, their histogram, the middle buckets, what is left of a group; no sort of the values for the join
    assert exchanges(p) == (4, 1)
    assert "SortMergeJoin" not in p and "ShuffledHashJoin" in p


def test_medians_of_null_and_text_keys(spark):
    rows = [(a, d, v) for a, d in (("0", 0), (None, 0), ("0", None), (None, None), ("b", 1)) for v in (len(str(a)), 9, 90 + len(str(d)), None)]
    df = spark.createDataFrame(rows, "a string, d int, v bigint")
    got = {(r.a, r.d): r.m for r in S.exact_median(df, ["a", "d"], "v", "m").collect()}
    assert got == {(a, d): 9.0 for a, d, _ in rows}
    dates = df.selectExpr("date_add(DATE'1970-01-01', d) AS day", "v")
    assert {str(r.day) for r in S.exact_median(dates, ["day"], "v", "m").collect()} == {"1970-01-01", "1970-01-02", "None"}
    values = S.middle_values(df, ["a", "d"], "v", 4096)
    assert {(r.a, r.d, r.value, r.n) for r in values.collect()} == {(*r, 1) for r in rows if r[2] is not None}
    assert {(r.a, r.d, r.bucket, r.before, r.low, r.high) for r in S.middle_buckets(df, ["a", "d"], "v", 4096).collect()} == {(a, d, 0, 0, 1, 1) for a, d, _ in rows}


@pytest.mark.parametrize("name", ["stage_summary", "calibrate", "backtest"])
def test_no_median_aggregate_in_the_plan(spark, name):
    p = JOBS[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "median(" not in p and "percentile" not in p


def test_merged_sketches_keep_their_bound(spark):
    rows = spark.range(200_000).selectExpr("id % 40 AS day", "id % 3 AS stage", "pmod(xxhash64(id), 90000) * (1 + id % 3) AS v")
    daily = S.duration_sketches(rows, ["day", "stage"], "v", k=200)
    assert daily.count() == 120
    medians = S.sketch_median(S.merge_sketches(daily, ["stage"], k=200), ["stage"], "m")
    got = S.rank_errors(rows, medians, ["stage"], "v", "m", k=200).collect()
    assert len(got) == 3 and all(r.within_bound and r.rank_error <= S.sketch_error(200) for r in got)
    far = medians.withColumn("m", F.col("m") * 2)
    assert not any(r.within_bound for r in S.rank_errors(rows, far, ["stage"], "v", "m", k=200).collect())


def test_asof_join_against_brute_force(spark):
    rng = random.Random(2)
    left = [(rng.randint(0, 4), rng.randint(0, 50), i) for i in range(200)] + [(None, 5, 900), (1, None, 901)]
    right = [(rng.randint(0, 3), rng.randint(0, 50), rng.randint(0, 9)) for _ in range(60)] + [(None, 1, 1), (2, None, 1)]
    l, r = spark.createDataFrame(left, "app int, at int, id int"), spark.createDataFrame(right, "app int, run int, base int")
    got = {x.id: (x.run, x.base) for x in asof_join(l, r, "app", "at", "run", ["run", "base"]).collect()}
    assert len(got) == len(left)
    for app, at, i in left:
        past = [(run, base) for a, run, base in right if a is not None and a == app and run is not None and at is not None and run <= at]
        assert got[i] == (max(past) if past else (None, None)), i


def test_sweep_line_against_brute_force(spark):
    rng = random.Random(3)
    tasks = [(a, rng.randint(0, 900), rng.randint(0, 200)) for a in (1, 1, 1, 2) for _ in range(60)] + [(3, 0, 10), (3, 10, 10), (4, None, 5), (5, 7, 0)]
    df = spark.createDataFrame(tasks, "app_id int, launch_ms bigint, duration_ms bigint")
    want = {}
    for app in (1, 2, 3):
        counts = [sum(1 for a, s, d in tasks if a == app and s <= t < s + d) for t in range(1200)]
        want[app] = (max(counts), sum(c > 0 for c in counts), sum(counts))
    for range_ms in (600_000, 100, 7):
        got = {r.app_id: (r.peak_tasks, r.busy_ms, r.task_ms) for r in parallelism(df, range_ms).collect()}
        assert got == want


def test_the_sweep_moves_an_event_once(spark):
    tasks = spark.range(1000).selectExpr("id % 7 AS app_id", "id * 50 AS launch_ms", "id % 9 * 100 AS duration_ms")
    p = planned(running_counts(tasks, 10_000))
    # the events, an application's ranges, the sums before a range
    assert exchanges(p) == (3, 1)


def test_attempts_without_an_application_are_one(spark):
    rows = [(a, s, 10) for a in (None, "0", "x") for s in (0, 5, 1000, 1000)]
    for range_ms in (600_000, 100, 7):
        got = parallelism(spark.createDataFrame(rows, "app_id string, launch_ms bigint, duration_ms bigint"), range_ms).collect()
        assert sorted((str(r.app_id), r.peak_tasks, r.busy_ms, r.task_ms) for r in got) == [(a, 2, 25, 40) for a in ("0", "None", "x")]


def test_a_hot_application_is_dealt_over_its_time_ranges(spark):
    hot = spark.range(100_000).selectExpr("1 AS app_id", "id * 37 AS launch_ms", "CAST(5000 AS BIGINT) AS duration_ms")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tasks = running_counts(hot, 10_000).groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) > 4 and max(r["count"] for r in tasks) < 0.5 * sum(r["count"] for r in tasks)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 << 20))


ROW = ("SELECT 1 AS app_id, 2 AS stage_id, {}L AS task_index, {} AS duration_ms, 10L AS run_ms, 0L AS mem_spill_bytes,"
       " 0L AS disk_spill_bytes, 100L AS input_bytes, 0L AS shuffle_bytes, {}L AS stage_attempt, {} AS failed,"
       " {} AS killed, {} AS speculative, {}L AS launch_ms")


def test_a_partly_rerun_stage_keeps_the_partitions_it_did_not_lose(spark):
    rows = [(0, 1000, 0, "false", "false", "false", 10), (1, 2000, 0, "false", "false", "false", 10), (2, 6000, 0, "false", "false", "false", 10),
            (1, 4000, 1, "false", "NULL", "false", 9000),                       # only partition 1 ran again
            (2, 5, 1, "true", "false", "false", 9000), (2, 5, 1, "true", "false", "true", 9000), (0, 5, 1, "false", "true", "true", 9000),
            (3, 7, 0, "true", "false", "false", 20)]                             # never succeeded
    df = spark.sql(" UNION ALL ".join(ROW.format(*r) for r in rows))
    for exact in (True, False):
        got = K.stage_summary(df, exact).first()
        assert (got.tasks, got.median_ms, got.max_ms, got.retried_tasks, got.input_bytes) == (3, 4000.0, 6000, 2, 300)
        assert (got.stage_attempt, got.first_launch_ms, got.last_finish_ms) == (1, 10, 13000)


def test_the_latest_attempt_by_task_id(spark):
    rows = [(0, 1000, 0, "false", "false", "false", 50), (0, 3000, 0, "false", "false", "false", 40)]
    df = spark.sql(" UNION ALL ".join(ROW.format(*r) for r in rows))
    assert K.stage_summary(df).first().max_ms == 1000                     # by launch
    ids = df.withColumn("task_id", F.when(F.col("duration_ms") == 3000, 9).otherwise(4))
    assert K.stage_summary(ids).first().max_ms == 3000                    # by the application's own count
    assert K.stage_summary(df.drop("task_index")).first().tasks == 2


def test_baseline_is_the_latest_run_before_the_application(spark):
    stages = spark.createDataFrame([(1, 0, 4, 8000.0, 9000, 0, 0, 1, 1, 1, 1, 0, 500, 900), (2, 0, 4, 8000.0, 9000, 0, 0, 1, 1, 1, 1, 0, 50, 900)],
        "app_id int, stage_id int, tasks bigint, median_ms double, max_ms bigint, mem_spill_bytes bigint, disk_spill_bytes bigint, input_bytes bigint,"
        " shuffle_bytes bigint, run_ms bigint, duration_ms bigint, retried_tasks bigint, first_launch_ms bigint, last_finish_ms bigint")
    tasks = spark.createDataFrame([(1, 100, 3000), (1, 100, 5000), (1, 400, 2000), (1, 600, 1), (2, 60, 7)], "app_id int, run_ms bigint, duration_ms bigint")
    got = {r.app_id: (r.baseline_run_ms, r.t_base_sec, r.k_comp) for r in K.calibrate(stages, K.baseline_medians(tasks)).collect()}
    assert got == {1: (400, 2.0, 4.0), 2: (None, None, None)}
