"""Registered jobs: (spark, sf_dir) -> DataFrame.

Each job reads the driver's parquet tables through a fixture block and runs
one operator chain on it; nothing is collected. The matching DuckDB SQL is in
``rightsize.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rightsize.operators import calibrate as K
from rightsize.operators import fit
from rightsize.operators import parallelism as L
from rightsize.operators import selection as S
from rightsize.sources.fixtures import fixture, forms_of_orders
from rightsize.operators import unique as U
from rightsize.sources.sinks import plan_changes as changes_between
from rightsize.sources.sinks import write_and_read_back, write_bucketed

Job = Callable[[SparkSession, str], DataFrame]
JOBS: dict[str, Job] = {}


def job(name: str):
    def register(fn: Job) -> Job:
        JOBS[name] = fn
        return fn
    return register


# ---- calibration (K) -------------------------------------------------------

def _stages(spark, sf_dir):
    return K.stage_summary(fixture(spark, sf_dir, "task_metrics"))


def _baselines(spark, sf_dir):
    return K.baseline_medians(fixture(spark, sf_dir, "baseline_tasks"))


def _calibration(spark, sf_dir):
    return K.calibrate(_stages(spark, sf_dir), _baselines(spark, sf_dir))


def _peaks(spark, sf_dir):
    return L.parallelism(fixture(spark, sf_dir, "task_metrics"))


def _errors(spark, sf_dir):
    return K.backtest_from_stages(_stages(spark, sf_dir), _baselines(spark, sf_dir), _peaks(spark, sf_dir))


@job("stage_summary")
def stage_summary(spark, sf_dir):
    return _stages(spark, sf_dir)


@job("calibrate")
def calibrate(spark, sf_dir):
    return _calibration(spark, sf_dir)


@job("skew_advice")
def skew_advice(spark, sf_dir):
    return K.skew_advice(_calibration(spark, sf_dir))


@job("coefficient_check")
def coefficient_check(spark, sf_dir):
    return K.coefficient_check(_calibration(spark, sf_dir))


@job("measured_profile")
def measured_profile(spark, sf_dir):
    return K.measured_profile(_stages(spark, sf_dir))


@job("parallelism")
def parallelism(spark, sf_dir):
    """How many tasks an application ran at once, by a sweep line."""
    return _peaks(spark, sf_dir)


@job("backtest")
def backtest(spark, sf_dir):
    return _errors(spark, sf_dir)


@job("backtest_by_team")
def backtest_by_team(spark, sf_dir):
    return K.backtest_by_team(_errors(spark, sf_dir), fixture(spark, sf_dir, "workloads"))


@job("fitted_rates")
def fitted_rates(spark, sf_dir):
    """The cost model's rates per application by least squares."""
    return fit.fitted_rates(fixture(spark, sf_dir, "task_metrics"), ["app_id"])


@job("backtest_models")
def backtest_models(spark, sf_dir):
    return K.backtest_models(_stages(spark, sf_dir), _baselines(spark, sf_dir), _peaks(spark, sf_dir), fitted_rates(spark, sf_dir))


@job("median_rank_error")
def median_rank_error(spark, sf_dir):
    """K1 approximate: sketches of task time per (day, stage) are stored, the
    fleet's medians per stage read off their merge, and their ranks checked."""
    tasks = fixture(spark, sf_dir, "task_metrics").selectExpr("floor(launch_ms / 86400000) AS day", "stage_id", "duration_ms")
    daily = write_and_read_back(spark, S.duration_sketches(tasks, ["day", "stage_id"], "duration_ms"), "duration-sketches", None)
    medians = S.sketch_median(S.merge_sketches(daily, ["stage_id"]), ["stage_id"], "median_ms")
    return S.rank_errors(tasks, medians, ["stage_id"], "duration_ms", "median_ms").select("stage_id", F.col("n").alias("tasks"), "within_bound")


# ---- wave planner (W) and its validation (V1, V2) ---------------------------

from rightsize.operators import waves as W  # noqa: E402

WAVE_KEYS = ["workload_id", "team", "app_id", "data_size_gb", "sla_seconds", "k_comp", "k_skew",
             "skew_memory_mode", "t_base_sec", "e_mem_rate"]


@job("wave_plan")
def wave_plan(spark, sf_dir):
    """Plans with coefficients from ``calibrate`` where the app has them."""
    wl = W.with_calibration(fixture(spark, sf_dir, "workloads"), _calibration(spark, sf_dir))
    return W.wave_plan(wl).select(*WAVE_KEYS, *[f"{short}_source" for short in W.COEFFICIENTS.values()], *W.WAVE_OUTPUTS)


@job("wave_plan_typed")
def wave_plan_typed(spark, sf_dir):
    """Plans with the typed coefficients and the planner's defaults."""
    return W.wave_plan(fixture(spark, sf_dir, "workloads")).select(*WAVE_KEYS, *W.WAVE_OUTPUTS)


@job("wave_rejects")
def wave_rejects(spark, sf_dir):
    return W.wave_rejects(fixture(spark, sf_dir, "workloads"))


@job("wave_fleet")
def wave_fleet(spark, sf_dir):
    return W.wave_fleet(W.wave_validate(fixture(spark, sf_dir, "workloads")))


@job("wave_sensitivity")
def wave_sensitivity(spark, sf_dir):
    return W.wave_sensitivity(fixture(spark, sf_dir, "workloads"))


K_SKEW_STEPS = (1.0, 1.5, 2.0, 2.5, 3.0)


@job("wave_skew_sensitivity")
def wave_skew_sensitivity(spark, sf_dir):
    """W13 over the k_skew range of the form, in steps of 0.5, x skew modes."""
    return W.wave_sensitivity(fixture(spark, sf_dir, "workloads"), k_skew_steps=K_SKEW_STEPS)


# ---- cost model (C) ---------------------------------------------------------

from rightsize.operators import cost as C  # noqa: E402


def _estimates(spark, sf_dir):
    return C.cost_estimate(spark, fixture(spark, sf_dir, "cost_workloads"))


def _candidates(spark, sf_dir, with_prev=False):
    return C.candidates(spark, fixture(spark, sf_dir, "cost_workloads"), with_prev=with_prev)


@job("cost_estimate")
def cost_estimate(spark, sf_dir):
    return _estimates(spark, sf_dir)


@job("runtime_curve")
def runtime_curve(spark, sf_dir):
    return C.runtime_curve(_candidates(spark, sf_dir))


@job("sla_search")
def sla_search(spark, sf_dir):
    return C.sla_search(C.search_base(spark, fixture(spark, sf_dir, "cost_workloads")))


@job("curve_gain")
def curve_gain(spark, sf_dir):
    return C.curve_gain(_candidates(spark, sf_dir, with_prev=True))


@job("cheapest")
def cheapest(spark, sf_dir):
    return C.cheapest_two_pass(spark, fixture(spark, sf_dir, "cost_workloads"))


@job("time_breakdown")
def time_breakdown(spark, sf_dir):
    return C.time_breakdown(_estimates(spark, sf_dir))


@job("memory_breakdown")
def memory_breakdown(spark, sf_dir):
    return C.memory_breakdown(_estimates(spark, sf_dir))


@job("cost_risks")
def cost_risks(spark, sf_dir):
    return C.cost_risks(_estimates(spark, sf_dir))


@job("recommendations")
def recommendations(spark, sf_dir):
    return C.recommendations(_estimates(spark, sf_dir))


@job("bottleneck_mix")
def bottleneck_mix(spark, sf_dir):
    return C.bottleneck_mix(_estimates(spark, sf_dir))


# ---- profile planner (P) and enum checks (V4) ------------------------------

from rightsize.operators import profiles as P  # noqa: E402

PROFILE_KEYS = ["workload_id", "team", "profile", "data_format", "complexity", "shuffle_intensity",
                "sla_minutes", "use_cache", "skew_risk", "safety_buffer_pct", "max_executors_cap",
                "data_volume_gb"]


def _profile_plans(spark, sf_dir):
    return P.profile_plan(spark, fixture(spark, sf_dir, "profile_workloads"))


@job("profile_plan")
def profile_plan(spark, sf_dir):
    return _profile_plans(spark, sf_dir).select(*PROFILE_KEYS, *P.PLAN_OUTPUTS)


@job("enum_rejects")
def enum_rejects(spark, sf_dir):
    return P.enum_rejects(spark, fixture(spark, sf_dir, "profile_workloads"))


@job("profile_compare")
def profile_compare(spark, sf_dir):
    return P.profile_compare(spark, fixture(spark, sf_dir, "profile_workloads"))


@job("profile_fleet")
def profile_fleet(spark, sf_dir):
    return P.profile_fleet(_profile_plans(spark, sf_dir))


# ---- node packer (N), domain rules (V3) ------------------------------------

from rightsize.operators import packing as N  # noqa: E402
from rightsize.operators import quality as V  # noqa: E402


def _packings(spark, sf_dir):
    return N.node_pack(spark, fixture(spark, sf_dir, "node_workloads"), fixture(spark, sf_dir, "cluster_shapes"))


@job("node_pack")
def node_pack(spark, sf_dir):
    return _packings(spark, sf_dir)


@job("alert_counts")
def alert_counts(spark, sf_dir):
    return N.alert_counts(spark, _packings(spark, sf_dir))


@job("pick_shape")
def pick_shape(spark, sf_dir):
    return N.pick_shape(spark, fixture(spark, sf_dir, "node_workloads"), fixture(spark, sf_dir, "cluster_shapes"))


# Struct columns beside each other, and the form whose ranges they are held against.
ORDER_FORMS = {"workloads": "workloads", "cost_workloads": "cost_workloads", "profile_workloads": "profile_workloads",
               "node_workloads": "node_workloads", "cost_forms": "cost_workloads", "wave_forms": "workloads"}


def _order_forms(spark, sf_dir):
    return forms_of_orders(spark, sf_dir, tuple(ORDER_FORMS))


def _shape_violations(spark, sf_dir):
    return V.violations(fixture(spark, sf_dir, "cluster_shapes"), "cluster_shapes")


@job("domain_violations")
def domain_violations(spark, sf_dir):
    return V.domain_violations(V.counts_side_by_side(_order_forms(spark, sf_dir), ORDER_FORMS), _shape_violations(spark, sf_dir))


@job("violation_rows")
def violation_rows(spark, sf_dir):
    """V3 by row: which row breaks which declared range."""
    return V.all_violations([V.violations_side_by_side(_order_forms(spark, sf_dir), ORDER_FORMS), _shape_violations(spark, sf_dir)])


# ---- cross-model (X), sources and sinks (S) --------------------------------

from rightsize.operators import compare as X  # noqa: E402
from rightsize.sources.manifest import dataset_sizes as _dataset_sizes  # noqa: E402


def _compared(spark, sf_dir):
    cw = fixture(spark, sf_dir, "cost_workloads")
    return X.compare_models(
        X.from_wave(W.wave_validate(fixture(spark, sf_dir, "workloads"))),
        X.from_cost(C.sla_search(C.search_base(spark, cw), keep=X.COST_KEEP)),
        X.from_profile(P.profile_validate(spark, fixture(spark, sf_dir, "profile_workloads"))),
        X.from_node(_packings(spark, sf_dir)))


@job("compare_models")
def compare_models(spark, sf_dir):
    return _compared(spark, sf_dir)


@job("model_spread")
def model_spread(spark, sf_dir):
    return X.model_spread(_compared(spark, sf_dir), k=20)


@job("dataset_sizes")
def dataset_sizes(spark, sf_dir):
    return _dataset_sizes(fixture(spark, sf_dir, "file_manifest"))


@job("write_plans")
def write_plans(spark, sf_dir):
    """Typed wave plans written as parquet partitioned by team, read back."""
    return write_and_read_back(spark, wave_plan_typed(spark, sf_dir), "wave_plans")


PLAN_BUCKETS = 16       # at least: as many as an exchange has partitions, so that a bucket stays small


@job("plan_changes")
def plan_changes(spark, sf_dir):
    """The typed plans of one run against those of a later run with the
    telemetry's coefficients, both as bucketed tables."""
    wl = fixture(spark, sf_dir, "workloads")
    buckets = max(PLAN_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    first = write_bucketed(spark, wl, "plans", "workload_id", buckets, then=W.wave_plan)
    later = W.with_calibration(wl, _calibration(spark, sf_dir))
    second = write_bucketed(spark, later, "plans", "workload_id", buckets, then=W.wave_plan)
    return changes_between(spark, first, second, "workload_id", ("executors", "executor_heap_mb"))


@job("duplicate_rejects")
def duplicate_rejects(spark, sf_dir):
    """V: submissions whose workload id is not unique."""
    return U.duplicate_rejects(fixture(spark, sf_dir, "resubmitted_workloads"), "workload_id")


# ---- streaming ---------------------------------------------------------------

import uuid  # noqa: E402

from rightsize.session import scratch_path  # noqa: E402
from rightsize.streaming import fleet_stream as ST  # noqa: E402


@job("wave_plan_stream")
def wave_plan_stream(spark, sf_dir):
    """The wave planner as a Structured Streaming query: the workloads table
    lands as parquet files in the shared folder, is planned as it lands
    (availableNow trigger, exactly-once parquet sink with a checkpoint) and
    the sink is read back -- valid plans and rejects with their reason."""
    base = scratch_path(spark, f"wave-stream-{uuid.uuid4().hex}")
    wl = fixture(spark, sf_dir, "workloads")
    wl.write.parquet(f"{base}/in")
    stream = ST.read_workload_stream(spark, f"{base}/in", wl.schema)
    q = ST.write_plans_stream(ST.plan_stream(stream), f"{base}/out", f"{base}/checkpoint")
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return spark.read.parquet(f"{base}/out").select(*WAVE_KEYS, "reject_reason", *W.WAVE_OUTPUTS)
