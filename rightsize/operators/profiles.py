"""Profile planner (P1-P18) over a table of workloads.

Each workload names a sizing profile, a storage format, a complexity class
and a shuffle intensity; the coefficients behind those names live in small
dimension tables (``rightsize.sources.dims``) joined with broadcast hints, so
the workload table is never shuffled for a lookup. An unknown name finds no
dimension row: the workload is rejected (V4) instead of failing the job.

``profile_compare`` evaluates each workload under every profile as three
column sets of its own row; ``profile_fleet`` is a CUBE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rightsize.functions.numeric import case_first, stage
from rightsize.sources.defaults import PROFILE_DEFAULTS as PROFILE_FORM_DEFAULTS
from rightsize.sources.defaults import with_defaults
from rightsize.sources.dims import PROFILE_DEFAULTS, SHUFFLE_MULTIPLIER, dim

# Multipliers, memory rules and driver sizes of the profile planner.
GB_IN_MB = 1024
MB_IN_BYTES = 1024 * 1024
CACHE_MULTIPLIER = 1.30
SKEW_MULTIPLIER = 1.15
MIN_EXECUTOR_MEMORY_MB = 4096
MEMORY_ROUNDING_MB = 512
JVM_RESERVE_HIGH_MB, JVM_RESERVE_MB = 1536, 1024
OVERHEAD_FRACTION, MIN_OVERHEAD_MB = 0.10, 384
AQE_PARTITION_SMALL_MB, AQE_PARTITION_MB = 96, 128
DRIVER_HIGH_MB, DRIVER_HIGH_SKEW_EXTRA_MB, DRIVER_HIGH_CORES = 8192, 2048, 2
DRIVER_MEDIUM_CACHED_MB, DRIVER_MEDIUM_MB, DRIVER_LOW_MB = 6144, 4096, 3072

PROFILES = tuple(p[0] for p in PROFILE_DEFAULTS)

PLAN_OUTPUTS = ("executors", "executor_cores", "executor_memory_mb", "executor_overhead_mb",
                "driver_memory_mb", "driver_cores", "total_cluster_cores", "total_cluster_ram_mb",
                "effective_data_mb", "aqe_partition_mb", "total_partitions", "required_parallel_tasks",
                "shuffle_partitions", "advisory_partition_bytes", "raw_executors", "cap_hit",
                "effective_data_gb", "spark_submit")


VOLUME_GB = "CAST(CASE WHEN volume_unit = 'TB' THEN data_volume * 1024.0D ELSE data_volume END AS DOUBLE)"


def resolve(spark: SparkSession, workloads: DataFrame) -> DataFrame:
    """P1 + P2 + P3: profile defaults, unit normalisation and coefficient lookups."""
    workloads = with_defaults(workloads, PROFILE_FORM_DEFAULTS)
    df = workloads.join(dim(spark, "profiles"), "profile", "left")
    over = "coalesce(manual_override, false)"
    typed = ("shuffle_intensity", "skew_risk", "safety_buffer_pct", "max_executors_cap")
    df = df.selectExpr(
        *[f"`{x}`" for x in workloads.columns if x not in typed],
        "profile_max_executors_cap IS NOT NULL AS profile_known",
        f"CASE WHEN {over} THEN shuffle_intensity ELSE profile_shuffle_intensity END AS shuffle_intensity",
        f"CASE WHEN {over} THEN skew_risk ELSE profile_skew_risk END AS skew_risk",
        f"CAST(CASE WHEN {over} THEN safety_buffer_pct ELSE profile_safety_buffer_pct END AS INT) AS safety_buffer_pct",
        f"CAST(CASE WHEN {over} THEN max_executors_cap ELSE profile_max_executors_cap END AS INT) AS max_executors_cap",
        f"{VOLUME_GB} AS data_volume_gb")
    return (df.join(dim(spark, "formats"), "data_format", "left")
              .join(dim(spark, "complexity"), "complexity", "left")
              .join(dim(spark, "shuffle"), "shuffle_intensity", "left"))


# V4 (unknown names) and a non-positive SLA, in lookup order.
PROFILE_RULES = [
    ("NOT profile_known", "unknown_profile"),
    ("format_factor IS NULL", "unknown_data_format"),
    ("task_memory_mb IS NULL", "unknown_complexity"),
    ("shuffle_factor IS NULL", "unknown_shuffle_intensity"),
    ("sla_minutes <= 0", "sla_not_positive"),
]

# The rules left for a workload planned under known profiles.
OWN_RULES = [(rule, code) for rule, code in PROFILE_RULES
             if code not in ("unknown_profile", "unknown_shuffle_intensity")]


def _plan_stages() -> list[dict[str, str]]:
    """P4-P15, P18 as projection stages (SQL over the resolved columns); each
    stage names its results (``_p_*`` for intermediates) for the next one.
    Small stages keep each generated method small enough for the JIT."""
    high = "complexity = 'High'"
    gb_flag = lambda x: f"CAST(greatest(1L, CAST(ceil({x} / {GB_IN_MB}) AS BIGINT)) AS STRING)"
    return [
        {"_p_cache": f"CASE WHEN use_cache THEN {CACHE_MULTIPLIER}D ELSE 1.0D END",
         "_p_skew": f"CASE WHEN skew_risk THEN {SKEW_MULTIPLIER}D ELSE 1.0D END",
         "_p_safety": "1.0D + safety_buffer_pct / 100",
         "aqe_partition_mb": (f"CASE WHEN {high} OR shuffle_intensity = 'Extreme' THEN {AQE_PARTITION_SMALL_MB}"
                              f" ELSE {AQE_PARTITION_MB} END"),
         "executor_cores": f"CASE WHEN {high} OR shuffle_intensity != 'Standard' THEN 4 ELSE 5 END",
         "_p_jvm": f"CASE WHEN {high} THEN {JVM_RESERVE_HIGH_MB} ELSE {JVM_RESERVE_MB} END",
         "driver_memory_mb": (f"CASE WHEN {high} THEN {DRIVER_HIGH_MB}"
                              f" + CASE WHEN skew_risk THEN {DRIVER_HIGH_SKEW_EXTRA_MB} ELSE 0 END"
                              f" WHEN complexity = 'Medium' THEN CASE WHEN use_cache THEN {DRIVER_MEDIUM_CACHED_MB}"
                              f" ELSE {DRIVER_MEDIUM_MB} END ELSE {DRIVER_LOW_MB} END"),
         "driver_cores": f"CASE WHEN {high} THEN {DRIVER_HIGH_CORES} ELSE 1 END"},
        {"effective_data_mb": (f"CAST(ceil(data_volume_gb * {GB_IN_MB} * format_factor * shuffle_factor"
                               f" * _p_safety) AS BIGINT)"),
         "_p_mem_tasks": "(executor_cores * task_memory_mb) * (_p_cache * shuffle_factor * _p_skew)"},
        {"total_partitions": "greatest(1L, CAST(ceil(effective_data_mb / aqe_partition_mb) AS BIGINT))",
         "_p_cores_sla": ("greatest(1L, CAST(ceil(try_divide(CAST(effective_data_mb AS DOUBLE),"
                          " CAST(sla_minutes * 60 AS DOUBLE)) / throughput_mbps) AS BIGINT))"),
         "_p_base_mem": f"greatest({MIN_EXECUTOR_MEMORY_MB}L, CAST(ceil(_p_mem_tasks + _p_jvm) AS BIGINT))"},
        {"required_parallel_tasks": ("greatest(_p_cores_sla,"
                                     " greatest(1L, CAST(ceil(total_partitions / partitions_per_core) AS BIGINT)))"),
         "executor_memory_mb": (f"CAST(ceil(_p_base_mem / {MEMORY_ROUNDING_MB}) AS BIGINT)"
                                f" * {MEMORY_ROUNDING_MB}")},
        {"raw_executors": "greatest(1L, CAST(ceil(required_parallel_tasks / executor_cores) AS BIGINT))",
         "executor_overhead_mb": (f"greatest({MIN_OVERHEAD_MB}L,"
                                  f" CAST(ceil(executor_memory_mb * {OVERHEAD_FRACTION}D) AS BIGINT))")},
        {"executors": "least(raw_executors, CAST(max_executors_cap AS BIGINT))"},
        {"total_cluster_cores": "executors * executor_cores",
         "total_cluster_ram_mb": "executors * (executor_memory_mb + executor_overhead_mb) + driver_memory_mb",
         "cap_hit": "raw_executors > executors",
         "advisory_partition_bytes": f"CAST(aqe_partition_mb AS BIGINT) * {MB_IN_BYTES}",
         "effective_data_gb": f"effective_data_mb / {float(GB_IN_MB)}D"},
        {"shuffle_partitions": "greatest(total_partitions, total_cluster_cores * 2)"},
        {"spark_submit": (
            "concat('--num-executors ', CAST(executors AS STRING), ' --executor-cores ', CAST(executor_cores AS STRING),"
            f" ' --executor-memory ', {gb_flag('executor_memory_mb')}, 'g --driver-cores ', CAST(driver_cores AS STRING),"
            f" ' --driver-memory ', {gb_flag('driver_memory_mb')},"
            " 'g --conf spark.executor.memoryOverhead=', CAST(executor_overhead_mb AS STRING),"
            " ' --conf spark.serializer=org.apache.spark.serializer.KryoSerializer"
            " --conf spark.sql.adaptive.enabled=true"
            " --conf spark.sql.adaptive.coalescePartitions.enabled=true"
            " --conf spark.sql.adaptive.advisoryPartitionSizeInBytes=', CAST(advisory_partition_bytes AS STRING),"
            " ' --conf spark.sql.shuffle.partitions=', CAST(shuffle_partitions AS STRING),"
            " ' --conf spark.default.parallelism=', CAST(shuffle_partitions AS STRING))")},
    ]


def _with_plan(df: DataFrame) -> DataFrame:
    for exprs in _plan_stages():
        df = stage(df, exprs)
    return df.drop(*[x for x in df.columns if x.startswith("_p_")])


def _resolved_with_reason(spark: SparkSession, workloads: DataFrame) -> DataFrame:
    return stage(resolve(spark, workloads), {"reject_reason": case_first(PROFILE_RULES)})


def profile_validate(spark: SparkSession, workloads: DataFrame) -> DataFrame:
    """Every workload with its plan (NULL when rejected) and reject reason."""
    df = _with_plan(_resolved_with_reason(spark, workloads))
    valid = F.col("reject_reason").isNull()
    keep = [x for x in df.columns if x not in PLAN_OUTPUTS]
    return df.select(*keep, *[F.when(valid, F.col(k)).alias(k) for k in PLAN_OUTPUTS])


def profile_plan(spark: SparkSession, workloads: DataFrame) -> DataFrame:
    """Valid workloads only: the filter runs before any plan arithmetic."""
    df = _resolved_with_reason(spark, workloads).where(F.col("reject_reason").isNull())
    return _with_plan(df).drop("reject_reason")


def enum_rejects(spark: SparkSession, workloads: DataFrame) -> DataFrame:
    """V4: workloads naming an unknown profile, format, complexity or shuffle level."""
    return (_resolved_with_reason(spark, workloads).where(F.col("reject_reason").isNotNull())
            .select("workload_id", "profile", "data_format", "complexity", "shuffle_intensity", "reject_reason"))


def profile_compare(spark: SparkSession, workloads: DataFrame) -> DataFrame:
    """Every workload under each profile's defaults, side by side.

    The profiles are literals, so their plans are three column sets of the
    workload's own row: two broadcast lookups, no exchange, no aggregate, and
    rows that share a workload id stay apart.
    """
    df = with_defaults(workloads, PROFILE_FORM_DEFAULTS)
    df = df.withColumn("data_volume_gb", F.expr(VOLUME_GB))
    df = df.join(dim(spark, "formats"), "data_format", "left").join(dim(spark, "complexity"), "complexity", "left")
    df = df.where(f"({case_first(OWN_RULES)}) IS NULL")
    shared = ["workload_id", "complexity", "use_cache", "sla_minutes", "data_volume_gb", "format_factor",
              "task_memory_mb", "throughput_mbps", "partitions_per_core"]
    factors, results = dict(SHUFFLE_MULTIPLIER), []
    for profile, intensity, skew_risk, safety, cap in PROFILE_DEFAULTS:
        plan = _with_plan(df.select(*shared, *results, F.lit(intensity).alias("shuffle_intensity"),
                                    F.lit(factors[intensity]).alias("shuffle_factor"),
                                    F.lit(skew_risk).alias("skew_risk"), F.lit(safety).alias("safety_buffer_pct"),
                                    F.lit(cap).alias("max_executors_cap")))
        df = plan.select(*shared, *results, F.col("executors").alias(f"{profile}_executors"),
                         F.col("total_cluster_cores").alias(f"{profile}_cores"),
                         F.col("total_cluster_ram_mb").alias(f"{profile}_ram_mb"))
        results += [f"{profile}_executors", f"{profile}_cores", f"{profile}_ram_mb"]
    base = "Balanced"
    extra = []
    for p in PROFILES:
        if p != base:
            extra.append((F.col(f"{p}_ram_mb") - F.col(f"{base}_ram_mb")).alias(f"{p}_ram_mb_vs_{base}"))
            extra.append((F.col(f"{p}_cores") - F.col(f"{base}_cores")).alias(f"{p}_cores_vs_{base}"))
    return df.select("workload_id", *results, *extra)


def profile_fleet(plans: DataFrame) -> DataFrame:
    """Fleet demand by profile x format x complexity with all subtotals (CUBE)."""
    return (plans.cube("profile", "data_format", "complexity")
            .agg(F.count(F.lit(1)).alias("workloads"),
                 F.sum("executors").alias("executors"),
                 F.sum("total_cluster_cores").alias("total_cluster_cores"),
                 F.sum("total_cluster_ram_mb").alias("total_cluster_ram_mb"),
                 F.sum(F.col("cap_hit").cast("int")).cast("bigint").alias("capped_workloads")))
