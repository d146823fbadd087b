"""Calibration: task telemetry -> sizing coefficients.

The coefficients the wave planner needs are read off per-stage task
statistics: the median task time of a plain read+write run (t_base), the
median of the heaviest stage relative to it (k_comp), max/median on that stage
(k_skew) and memory/disk spill of that stage (e_mem_rate).

Plan shape: one shuffle of tasks, keyed by (app_id, stage_id, task_index), which
keeps each partition's last successful attempt; a hot stage spreads over its
partitions. Its result, the rows that count, is stored once in the shared
folder and read by the aggregates per stage (partial aggregates) and by the
median's one exchange (``operators.selection``), none of which holds a stage's
values in one task. Everything after it works on one row per stage or
application. The baseline is a table of its own, matched by an as-of join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rightsize.functions.numeric import ceil_long, safe_div
from rightsize.operators.asof import asof_join
from rightsize.operators.cost import with_cost_at, with_invariants
from rightsize.operators.selection import duration_sketches, exact_median, same_keys, sketch_median
from rightsize.sources.defaults import COST_DEFAULTS, with_defaults
from rightsize.sources.sinks import write_and_read_back

# Thresholds stated for the coefficients.
SKEW_JOIN_THRESHOLD = 2.0          # k_skew above this -> enable AQE skew join
E_MEM_PLAUSIBLE = (2.0, 5.0)       # usual range of memory/disk spill
K_COMP_CLASSES = (                 # upper bound (exclusive) -> class
    (1.25, "simple"),              # ~1.0 plain filtering
    (2.0, "aggregate"),            # ~1.5 aggregations
    (3.0, "heavy"),                # 2.0-3.0 windows, sort-merge joins (3.0 included)
)


def _or(df: DataFrame, name: str, absent: object, kind: str) -> Column:
    """A telemetry column that may be missing or NULL."""
    value = F.lit(absent).cast(kind)
    return F.coalesce(F.col(name), value) if name in df.columns else value


TASK_SUMS = ("mem_spill_bytes", "disk_spill_bytes", "input_bytes", "shuffle_bytes", "run_ms")


def last_attempts(task_metrics: DataFrame) -> DataFrame:
    """One row per (app_id, stage_id, task_index): the measures of the
    partition's last successful attempt, NULL where none succeeded.

    A stage that ran again after lost output ran only the lost partitions; the
    others keep the attempt they have. Attempts follow each other by task_id,
    which an application counts up, else by (stage attempt, attempt, launch).
    Failed attempts that were no speculative copies count as retries; the
    launch and finish bounds cover every attempt. Without a task_index every
    successful attempt is a partition of its own.

    Each measure is a ``max_by`` over a long, so the buffers have a fixed width
    and the aggregate hashes; equal orders do not occur within a partition.
    """
    failed = _or(task_metrics, "failed", False, "boolean")
    good = ~(failed | _or(task_metrics, "killed", False, "boolean"))
    retried = failed & ~_or(task_metrics, "speculative", False, "boolean")
    launch = _or(task_metrics, "launch_ms", None, "bigint")
    stage_attempt = _or(task_metrics, "stage_attempt", 0, "bigint")
    if "task_id" in task_metrics.columns:
        turn = F.col("task_id").cast("bigint")
    else:  # 10 bits each for the attempts, 43 for the milliseconds
        small = F.least(stage_attempt, F.lit(1023)) * 1024 + F.least(_or(task_metrics, "attempt", 0, "bigint"), F.lit(1023))
        turn = small * F.lit(1 << 43) + F.coalesce(launch, F.lit(0))
    index = F.col("task_index") if "task_index" in task_metrics.columns else F.monotonically_increasing_id()
    turn_if_good = F.when(good, turn)

    def last(name: str) -> Column:
        return F.max_by(F.col(name), turn_if_good).alias(name)

    return (task_metrics.groupBy("app_id", "stage_id", index.alias("task_index"))
            .agg(F.count(F.when(good, 1)).alias("good"),
                 last("duration_ms"), *[last(c) for c in TASK_SUMS],
                 F.max(F.when(good, stage_attempt)).alias("stage_attempt"),
                 F.count(F.when(retried, 1)).alias("retried_tasks"),
                 F.min(launch).alias("first_launch_ms"),
                 F.max(launch + F.col("duration_ms")).alias("last_finish_ms")))


def stage_summary(task_metrics: DataFrame, exact: bool = True) -> DataFrame:
    """K1: one row per (app_id, stage_id) over its partitions' last successful attempts.

    The exact median is selected in passes over the stored attempts;
    ``exact=False`` reads it off one KLL sketch per stage, in one pass.
    """
    keys = ["app_id", "stage_id"]
    held = last_attempts(task_metrics)
    if exact:
        held = write_and_read_back(task_metrics.sparkSession, held.drop("task_index"), "last-attempts", None, "zstd")
    counted = F.col("good") > 0
    stages = (held.groupBy(*keys)
              .agg(F.max("stage_attempt").alias("stage_attempt"),
                   F.count(F.when(counted, 1)).alias("tasks"),
                   F.max("duration_ms").alias("max_ms"),
                   *[F.sum(c).alias(c) for c in (*TASK_SUMS, "duration_ms")],
                   F.sum("retried_tasks").alias("retried_tasks"),
                   F.min("first_launch_ms").alias("first_launch_ms"),
                   F.max("last_finish_ms").alias("last_finish_ms")))
    if exact:
        median = exact_median(held, keys, "duration_ms", "median_ms")
    else:
        median = sketch_median(duration_sketches(held, keys, "duration_ms"), keys, "median_ms").drop("n")
    return (same_keys(stages, median, keys, "left")
            .withColumn("median_ms", F.col("median_ms").cast("double"))
            .withColumn("stage_skew", safe_div(F.col("max_ms"), F.col("median_ms"))))


def baseline_medians(baseline_tasks: DataFrame) -> DataFrame:
    """K2: (app_id, run_ms, base_median_ms), the median task time of every
    plain read+write run: one row a run of ``baseline_tasks`` (app_id, run_ms,
    duration_ms)."""
    held = write_and_read_back(baseline_tasks.sparkSession, baseline_tasks.select("app_id", "run_ms", "duration_ms"), "baseline", None, "zstd")
    return exact_median(held, ["app_id", "run_ms"], "duration_ms", "base_median_ms").withColumnRenamed("run_ms", "baseline_run_ms")


def skew_factor() -> Column:
    """K5: max / median task time on the heavy stage."""
    return safe_div(F.col("heavy_max_ms"), F.col("heavy_median_ms"))


def memory_expansion() -> Column:
    """K6: memory spill / disk spill of the heavy stage; NULL if nothing spilled."""
    return safe_div(F.col("heavy_mem_spill_bytes"), F.col("heavy_disk_spill_bytes"))


def _per_app(stages: DataFrame, baselines: DataFrame) -> DataFrame:
    """One aggregation per app over the stage summary: heaviest stage (K3) and
    the sums the measured profile (K10) needs; then the median of the app's
    latest baseline run that started no later than the app itself (K2)."""
    key = F.struct(F.col("median_ms"), (-F.col("stage_id")).alias("neg_stage"))
    heavy = F.max_by(F.struct("stage_id", "tasks", "median_ms", "max_ms",
                              "mem_spill_bytes", "disk_spill_bytes"), key)
    apps = (stages.groupBy("app_id")
            .agg(heavy.alias("h"), F.min("first_launch_ms").alias("started_ms"), *_profile_aggs())
            .select("*",
                    F.col("h.stage_id").alias("heavy_stage_id"),
                    F.col("h.tasks").alias("heavy_tasks"),
                    F.col("h.median_ms").alias("heavy_median_ms"),
                    F.col("h.max_ms").alias("heavy_max_ms"),
                    F.col("h.mem_spill_bytes").alias("heavy_mem_spill_bytes"),
                    F.col("h.disk_spill_bytes").alias("heavy_disk_spill_bytes")).drop("h"))
    return (asof_join(apps, baselines, "app_id", "started_ms", "baseline_run_ms", ["baseline_run_ms", "base_median_ms"])
            .withColumn("t_base_sec", F.col("base_median_ms") / F.lit(1000.0)))


def _calibration_columns() -> list[Column]:
    return [
        F.col("app_id"),
        F.col("baseline_run_ms"),
        F.col("t_base_sec"),
        F.col("heavy_stage_id"),
        F.col("heavy_tasks"),
        safe_div(F.col("heavy_median_ms"), F.col("base_median_ms")).alias("k_comp"),
        skew_factor().alias("k_skew"),
        memory_expansion().alias("e_mem_rate"),
        (skew_factor() > SKEW_JOIN_THRESHOLD).alias("skew_join_advised"),
    ]


def calibrate(stages: DataFrame, baselines: DataFrame) -> DataFrame:
    """K9: one calibration row per application (K2 + K3 + K4 + K5 + K6 + K7)
    from a stage summary (K1) and the medians of the baseline runs (K2).
    An application without an earlier baseline run has no t_base and no k_comp.
    """
    return _per_app(stages, baselines).select(*_calibration_columns())


def skew_advice(calibration: DataFrame) -> DataFrame:
    """K7: the applications that should run with AQE skew-join handling."""
    return (calibration.where(F.col("skew_join_advised"))
            .select("app_id", "heavy_stage_id", "k_skew",
                    F.lit("spark.sql.adaptive.skewJoin.enabled=true").alias("advice")))


def k_comp_class(c: Column) -> Column:
    expr = F.when(c.isNull(), F.lit("unknown"))
    for bound, name in K_COMP_CLASSES[:-1]:
        expr = expr.when(c < bound, F.lit(name))
    last_bound, last_name = K_COMP_CLASSES[-1]
    return expr.when(c <= last_bound, F.lit(last_name)).otherwise(F.lit("beyond_range"))


def e_mem_check(c: Column) -> Column:
    lo, hi = E_MEM_PLAUSIBLE
    return (F.when(c.isNull(), F.lit("no_spill"))
            .when((c >= lo) & (c <= hi), F.lit("plausible"))
            .when(c < lo, F.lit("below_range"))
            .otherwise(F.lit("above_range")))


def coefficient_check(calibration: DataFrame) -> DataFrame:
    """K8: how many apps fall in each k_comp class / e_mem_rate plausibility."""
    return (calibration
            .groupBy(k_comp_class(F.col("k_comp")).alias("k_comp_class"),
                     e_mem_check(F.col("e_mem_rate")).alias("e_mem_check"))
            .agg(F.count(F.lit(1)).alias("apps"),
                 F.sum(F.col("skew_join_advised").cast("int")).cast("bigint").alias("skewed_apps")))


def _profile_aggs() -> list[Column]:
    scan = F.col("shuffle_bytes") == 0
    return [F.count(F.lit(1)).alias("stages_count"),
            F.sum("tasks").alias("tasks"),
            F.max(F.when(scan, F.col("tasks"))).alias("input_partitions"),
            F.max("tasks").alias("widest_stage"),
            F.sum("retried_tasks").alias("retried_tasks"),
            F.sum("input_bytes").alias("input_bytes"),
            F.sum("shuffle_bytes").alias("shuffle_bytes"),
            F.sum("run_ms").alias("run_ms"),
            F.sum("duration_ms").alias("duration_ms"),
            (F.max("last_finish_ms") - F.min("first_launch_ms")).alias("span_ms")]


def _profile_columns() -> list[Column]:
    return [F.col("app_id"), F.col("stages_count"), F.col("tasks"), F.col("input_partitions"),
            safe_div(F.col("retried_tasks"), F.col("tasks")).alias("expected_retry_fraction"),
            safe_div(F.col("shuffle_bytes"), F.col("input_bytes")).alias("shuffle_ratio"),
            safe_div(F.col("input_bytes") / F.lit(1048576.0),
                     F.col("run_ms") / F.lit(1000.0)).alias("cpu_throughput_mb_s_per_core"),
            (F.col("input_bytes") / F.lit(1073741824.0)).alias("input_data_gb"),
            F.col("duration_ms"),
            (F.col("span_ms") / F.lit(1000.0)).alias("observed_sec"),
            # tasks that ran at once on average, in whole slots
            F.greatest(F.lit(1).cast("bigint"), ceil_long(safe_div(F.col("duration_ms"), F.col("span_ms")))).alias("slots")]


def measured_profile(stages: DataFrame) -> DataFrame:
    """Cost-model inputs measured per application.

    Built from the stage summary (one row per stage), so the distinct stage
    count needs no second pass over the tasks.
    """
    return stages.groupBy("app_id").agg(*_profile_aggs()).select(*_profile_columns())


def _prediction(per_app: DataFrame, slots: int | None, block_size_mb: int) -> DataFrame:
    at_once = F.col("slots") if slots is None else F.lit(slots).cast("bigint")
    tasks = F.ceil(F.col("input_data_gb") * F.lit(1024.0) / F.lit(float(block_size_mb)))
    waves = F.ceil(tasks / F.col("slots").cast("double"))
    t_eff = F.col("t_base_sec") * F.col("k_comp") * F.col("k_skew")
    return (per_app.withColumn("slots", at_once)
            .select("app_id", "observed_sec", "slots", tasks.cast("bigint").alias("tasks"),
                    waves.cast("bigint").alias("waves"), (waves * t_eff).alias("predicted_sec"))
            .withColumn("abs_error_sec", F.abs(F.col("predicted_sec") - F.col("observed_sec")))
            .withColumn("rel_error", safe_div(F.col("abs_error_sec"), F.col("observed_sec"))))


def backtest_from_stages(stages: DataFrame, baselines: DataFrame, peaks: DataFrame | None = None,
                         slots: int | None = None, block_size_mb: int = 128) -> DataFrame:
    """Predicted against observed runtime, one row per application.

    Observed: first launch to last finish in the telemetry (NULL without
    launch times). Predicted: the wave model with the app's own calibrated
    coefficients, tasks = input / block, waves = ceil(tasks / slots), each wave
    t_base*k_comp*k_skew. ``slots``, unless given, are the most tasks the app
    ran at once (``peaks``, from ``operators.parallelism``), without them the
    mean (K10).
    """
    both = _per_app(stages, baselines).select(
        *_calibration_columns(), *[c for c in _profile_columns() if str(c) != str(F.col("app_id"))])
    if peaks is not None:
        both = (same_keys(both, peaks.select("app_id", "peak_tasks"), ["app_id"], "left")
                .withColumn("slots", F.coalesce(F.greatest("peak_tasks", F.lit(1).cast("bigint")), "slots")))
    return _prediction(both, slots, block_size_mb)


# What the fitted rates already contain, or telemetry does not tell, is neutral in the cost model.
NEUTRAL_COST = {"compression_expand_factor": 1.0, "format_overhead_factor": 1.0, "transform_amplification_factor": 1.0,
                "skew_factor": 1.0, "join_multiplier": 1.0, "udf_complexity_factor": 1.0, "cluster_cpu_utilization": 1.0,
                "spill_penalty_per_100pct": 0.0, "gc_penalty_sensitivity": 0.0, "speculative_execution_gain": 0.0}


def backtest_models(stages: DataFrame, baselines: DataFrame, peaks: DataFrame, rates: DataFrame) -> DataFrame:
    """The wave model and the cost model beside the observed runtime, an application a row.

    The cost model runs on the app's measured profile and its fitted rates
    (``operators.fit``), a slot as an executor of one core, as many as ran at
    once. A rate the fit could not measure is the form's default. A stage's
    overhead is its tasks' fitted overhead as one slot meets it.
    """
    wave = backtest_from_stages(stages, baselines, peaks).select("app_id", "observed_sec", "slots", F.col("predicted_sec").alias("wave_sec"))
    aggs = stages.groupBy("app_id").agg(*_profile_aggs())
    profile = aggs.select(*_profile_columns(), "widest_stage").drop("cpu_throughput_mb_s_per_core", "duration_ms", "observed_sec", "slots")
    rates = rates.select("app_id", "cpu_throughput_mb_s_per_core", "disk_throughput_mb_s_per_executor", "network_throughput_mb_s_per_executor", "task_overhead_s")
    app = same_keys(same_keys(wave, profile, ["app_id"], "inner"), rates, ["app_id"], "left")
    per_slot = F.col("tasks") / (F.col("stages_count") * F.col("slots"))
    app = app.withColumns({"executors": F.col("slots"), "cores_per_executor": F.lit(1), "shuffle_partitions": F.coalesce("widest_stage", F.lit(1)),
                           "input_partitions": F.coalesce("input_partitions", F.lit(1)), "shuffle_ratio": F.coalesce("shuffle_ratio", F.lit(0.0)),
                           "expected_retry_fraction": F.coalesce("expected_retry_fraction", F.lit(0.0)),
                           "stage_scheduler_overhead_s": F.coalesce("task_overhead_s", F.lit(0.0)) * per_slot,
                           **{k: F.lit(v) for k, v in NEUTRAL_COST.items()}})
    cost = with_cost_at(with_invariants(with_defaults(app, COST_DEFAULTS)), "executors")
    error = {m: safe_div(F.abs(F.col(f"{m}_sec") - F.col("observed_sec")), F.col("observed_sec")).alias(f"{m}_rel_error") for m in ("wave", "cost")}
    both = cost.select("app_id", "observed_sec", "slots", "wave_sec", (F.col("estimated_runtime_min") * 60.0).alias("cost_sec")).select("*", *error.values())
    closer = F.when(F.col("wave_rel_error") < F.col("cost_rel_error"), "wave").when(F.col("cost_rel_error").isNotNull(), "cost")
    return both.withColumn("closer", closer)


def backtest_by_team(errors: DataFrame, app_teams: DataFrame) -> DataFrame:
    """K11 roll-up: error per team over the apps a team runs.

    ``app_teams`` is reduced to distinct (team, app_id) pairs first (map-side
    de-duplication), so a team holding a third of all workloads still ships
    one row per app through the exchange.
    """
    pairs = app_teams.select("team", "app_id").distinct()
    return (pairs.join(errors, "app_id")
            .groupBy("team")
            .agg(F.count(F.lit(1)).alias("apps"),
                 F.max("rel_error").alias("max_rel_error"),
                 F.sum(F.when(F.col("rel_error") <= 0.25, 1).otherwise(0)).cast("bigint").alias("apps_within_25pct"),
                 F.round(F.avg("rel_error"), 9).alias("mean_rel_error")))
