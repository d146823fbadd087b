"""Wave planner (W1-W13) over a table of workloads.

A workload needs ``tasks = ceil(GB*1024/block)`` tasks; each task takes
``t_eff = t_base*k_comp*k_skew`` seconds; the SLA leaves ``floor(sla/t_eff)``
waves, which fixes the cores, the executors and, through the unified-memory
model, the container size.

W1-W10 are a chain of small projections (each names its results for the
next): Catalyst collapses them into the scan's whole-stage-codegen span and
they need no shuffle. Validation (V1/V2) is a column, not a filter, so valid
plans and rejects come from the same pass. W11-W13 add one aggregation each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rightsize.functions.numeric import case_first, codes_array, safe_div, sql_literal, stage
from rightsize.sources.defaults import WAVE_DEFAULTS

# Memory constants and defaults of the wave planner.
RESERVED_MEMORY_MB = 300
MEMORY_FRACTION = 0.6
OVERHEAD_FRACTION = 0.10
MIN_OVERHEAD_MB = 384
SKEW_MEMORY_MODES = ("off", "sqrt", "linear")


@dataclass(frozen=True)
class WaveConstants:
    block_size_mb: int = 128
    t_base_sec: float = 25.0
    e_mem_rate: float = 3.0
    cores_per_exec: int = 5
    skew_memory_mode: str = "off"


def _wave_stages(block: str, t_base: str, e_mem: str, cores: str) -> list[dict[str, str]]:
    """W1-W10 as projection stages (SQL over the named input columns); each
    stage names its results for the next one. Operation order as specified."""
    d = lambda x: f"CAST({x} AS DOUBLE)"
    return [
        {"tasks": f"CAST(ceil({d('data_size_gb')} * 1024.0D / {d(block)}) AS BIGINT)",                      # W1
         "t_eff_sec": f"{d(t_base)} * {d('k_comp')} * {d('k_skew')}",                                       # W2
         "cores_per_executor": f"CAST({cores} AS BIGINT)",
         "memory_skew_factor": (f"CASE WHEN skew_memory_mode = 'linear' THEN {d('k_skew')}"                 # W5
                                f" WHEN skew_memory_mode = 'sqrt' THEN sqrt({d('k_skew')}) ELSE 1.0D END")},
        {"waves": f"CAST(floor(try_divide({d('sla_seconds')}, {d('t_eff_sec')})) AS BIGINT)",               # W3
         "m_task_mb": f"{d(block)} * {d(e_mem)} * {d('k_comp')} * memory_skew_factor"},                     # W6
        {"total_cores_needed": (f"CAST(ceil(try_divide({d('tasks')},"                                       # W4
                                f" {d('CASE WHEN waves >= 1 THEN waves END')})) AS BIGINT)"),
         "m_unified_mb": f"m_task_mb * {d('cores_per_executor')}"},
        {"executors": f"CAST(ceil(try_divide({d('total_cores_needed')}, {d('cores_per_executor')})) AS BIGINT)",
         "executor_heap_mb": (f"CAST(ceil(m_unified_mb / {MEMORY_FRACTION}D"                                # W7
                              f" + {float(RESERVED_MEMORY_MB)}D) AS BIGINT)")},
        {"total_cores": "executors * cores_per_executor",
         "executor_overhead_mb": (f"CAST(ceil(greatest({float(MIN_OVERHEAD_MB)}D,"
                                  f" executor_heap_mb * {OVERHEAD_FRACTION}D)) AS BIGINT)")},
        {"container_memory_mb": "executor_heap_mb + executor_overhead_mb"},
        {"container_memory_gb": "bround(container_memory_mb / 1024.0D, 2)",                                # W8
         "total_cluster_memory_gb": "bround(container_memory_mb * executors / 1024.0D, 2)",
         "total_cluster_memory_gb_legacy": "bround(bround(container_memory_mb / 1024.0D, 2) * executors, 2)",  # W9
         "spark_submit": ("concat('spark-submit --num-executors ', CAST(executors AS STRING),"               # W10
                          " ' --executor-cores ', CAST(cores_per_executor AS STRING),"
                          " ' --executor-memory ', CAST(executor_heap_mb AS STRING), 'm',"
                          " ' --conf spark.executor.memoryOverhead=', CAST(executor_overhead_mb AS STRING), 'm')")},
    ]


def wave_columns_df(df: DataFrame, block_size_mb="block_size_mb", t_base_sec="t_base_sec",
                    e_mem_rate="e_mem_rate", cores_per_exec="cores_per_exec") -> DataFrame:
    """``df`` with the W1-W10 columns added (no validation)."""
    for exprs in _wave_stages(block_size_mb, t_base_sec, e_mem_rate, cores_per_exec):
        df = stage(df, exprs)
    return df


WAVE_OUTPUTS = ("tasks", "t_eff_sec", "waves", "total_cores_needed", "executors", "total_cores",
                "cores_per_executor", "memory_skew_factor", "m_task_mb", "m_unified_mb",
                "executor_heap_mb", "executor_overhead_mb", "container_memory_mb",
                "container_memory_gb", "total_cluster_memory_gb",
                "total_cluster_memory_gb_legacy", "spark_submit")


def _with_coefficients(workloads: DataFrame, c: WaveConstants) -> DataFrame:
    """Columns the planner reads: the planner constants for its system
    parameters, the form defaults (S3) for any missing workload field."""
    defaults = {k: v for k, v in WAVE_DEFAULTS.items() if k not in workloads.columns or k in
                ("data_size_gb", "sla_seconds", "k_comp", "k_skew")}
    defaults.update({"block_size_mb": c.block_size_mb, "t_base_sec": float(c.t_base_sec),
                     "e_mem_rate": float(c.e_mem_rate), "cores_per_exec": c.cores_per_exec,
                     "skew_memory_mode": c.skew_memory_mode})
    types = {f.name: f.dataType.simpleString() for f in workloads.schema.fields}
    exprs = [f"`{x}`" for x in workloads.columns if x not in defaults]
    for name, value in defaults.items():
        lit = sql_literal(value)
        exprs.append(f"coalesce({name}, CAST({lit} AS {types[name]})) AS {name}" if name in types
                     else f"{lit} AS {name}")
    return workloads.selectExpr(*exprs)


WAVE_RULES = [
    ("data_size_gb <= 0", "data_size_not_positive"),
    ("sla_seconds <= 0", "sla_not_positive"),
    ("k_comp <= 0", "k_comp_not_positive"),
    ("k_skew <= 0", "k_skew_not_positive"),
    ("block_size_mb <= 0 OR t_base_sec <= 0 OR e_mem_rate <= 0 OR cores_per_exec <= 0", "system_param_not_positive"),
    ("coalesce(waves, 0) < 1", "sla_too_tight"),
]


def wave_validate(workloads: DataFrame, constants: WaveConstants = WaveConstants()) -> DataFrame:
    """V1 + V2 + W1-W10 in one pass: every input row, plus its reject reasons.

    Rule order is the order of the scalar checks; ``reject_reason`` is the
    first failing one, NULL for a valid plan (whose plan columns are then
    NULL as well).
    """
    base_cols = [x for x in workloads.columns if x not in WAVE_OUTPUTS]
    df = wave_columns_df(_with_coefficients(workloads.select(*base_cols), constants))
    df = stage(df, {"reject_reasons": codes_array(WAVE_RULES), "reject_reason": case_first(WAVE_RULES)})
    keep = [f"`{x}`" for x in df.columns if x not in WAVE_OUTPUTS]
    return df.selectExpr(*keep, *[f"CASE WHEN reject_reason IS NULL THEN {k} END AS {k}" for k in WAVE_OUTPUTS])


def wave_plan(workloads: DataFrame, constants: WaveConstants = WaveConstants()) -> DataFrame:
    """Valid plans only."""
    return wave_validate(workloads, constants).where(F.col("reject_reason").isNull()) \
        .drop("reject_reasons", "reject_reason")


def wave_rejects(workloads: DataFrame, constants: WaveConstants = WaveConstants()) -> DataFrame:
    return (wave_validate(workloads, constants).where(F.col("reject_reason").isNotNull())
            .select("workload_id", "reject_reason", "reject_reasons"))


# Calibrated coefficients and the prefix of the column that says where each came from.
COEFFICIENTS = {"t_base_sec": "t_base", "e_mem_rate": "e_mem", "k_comp": "k_comp", "k_skew": "k_skew"}


def with_calibration(workloads: DataFrame, calibration: DataFrame,
                     constants: WaveConstants = WaveConstants()) -> DataFrame:
    """Per coefficient the measured value, else the typed one, else the constant.

    A plain equi join on app_id: the calibration table has one row per app,
    so Spark (and AQE, from the runtime size) broadcasts it when it is small
    and shuffles both sides otherwise.
    """
    cal = calibration.select("app_id",
                             F.col("t_base_sec").alias("cal_t_base_sec"),
                             F.col("k_comp").alias("cal_k_comp"),
                             F.col("k_skew").alias("cal_k_skew"),
                             F.col("e_mem_rate").alias("cal_e_mem_rate"))
    j = workloads.join(cal, "app_id", "left")
    values, sources = [], []
    for name, short in COEFFICIENTS.items():
        typed = F.col(name) if name in workloads.columns else F.lit(None)
        measured, constant = F.col(f"cal_{name}"), getattr(constants, name, None)
        values.append(F.coalesce(measured, typed, F.lit(constant)).cast("double").alias(name))
        sources.append(F.when(measured.isNotNull(), F.lit("measured")).when(typed.isNotNull(), F.lit("typed"))
                       .otherwise(F.lit("constant")).alias(f"{short}_source"))
    return j.select(*[c for c in workloads.columns if c not in COEFFICIENTS], *values, *sources)


def wave_fleet(validated: DataFrame) -> DataFrame:
    """Demand per team and SLA class with subtotals (ROLLUP), rejects counted."""
    valid = F.col("reject_reason").isNull()
    return (validated.rollup("team", "sla_seconds")
            .agg(F.count(F.lit(1)).alias("workloads"),
                 F.sum(F.when(valid, 1).otherwise(0)).cast("bigint").alias("plans"),
                 F.sum(F.when(valid, 0).otherwise(1)).cast("bigint").alias("rejected"),
                 F.sum("executors").alias("executors"),
                 F.sum("total_cores").alias("total_cores"),
                 F.sum(F.col("container_memory_mb") * F.col("executors")).alias("total_memory_mb"),
                 F.max("executors").alias("max_executors"))
            .withColumn("rejected_share", safe_div(F.col("rejected"), F.col("workloads"))))


def wave_sensitivity(workloads: DataFrame, constants: WaveConstants = WaveConstants(),
                     modes: tuple[str, ...] = SKEW_MEMORY_MODES,
                     k_skew_steps: tuple[float, ...] | None = None) -> DataFrame:
    """Every workload under every skew-memory mode (and, optionally,
    every k_skew step in place of its own), demand per grid point.

    The grid is generated per row (``explode`` of literal arrays), so nothing
    is joined; the aggregate pre-combines map-side.
    """
    grid = workloads.withColumn("skew_memory_mode", F.explode(F.array(*[F.lit(m) for m in modes])))
    keys = ["skew_memory_mode"]
    if k_skew_steps is not None:
        grid = grid.withColumn("k_skew", F.explode(F.array(*[F.lit(float(k)) for k in k_skew_steps])))
        keys.append("k_skew")
    plans = wave_validate(grid, constants)
    valid = F.col("reject_reason").isNull()
    return (plans.groupBy(*keys)
            .agg(F.sum(F.when(valid, 1).otherwise(0)).cast("bigint").alias("plans"),
                 F.sum("executors").alias("executors"),
                 F.sum(F.col("container_memory_mb") * F.col("executors")).alias("total_memory_mb"),
                 F.max("container_memory_mb").alias("max_container_memory_mb")))


def wave_report(plans: DataFrame) -> DataFrame:
    """The planner's nested result as STRUCT columns (inputs, execution,
    cluster, memory, spark_submit); a projection over the flat plan table."""
    c = F.col
    return plans.select(
        "workload_id",
        F.struct("data_size_gb", "sla_seconds", "k_comp", "k_skew").alias("inputs"),
        F.struct("tasks", F.round("t_eff_sec", 2).alias("t_eff"), "waves").alias("execution"),
        F.struct("executors", "total_cores", c("cores_per_executor"),
                 c("container_memory_gb"), c("total_cluster_memory_gb")).alias("cluster"),
        F.struct(F.round("m_task_mb", 2).alias("m_task_mb"), F.round("m_unified_mb", 2).alias("m_unified_mb"),
                 c("executor_heap_mb"), c("executor_overhead_mb"), c("container_memory_mb"),
                 "skew_memory_mode", F.round("memory_skew_factor", 3).alias("memory_skew_factor")).alias("memory"),
        F.struct(c("executors").alias("num_executors"), c("cores_per_executor").alias("executor_cores"),
                 F.concat(c("executor_heap_mb").cast("string"), F.lit("m")).alias("executor_memory"),
                 F.concat(c("executor_overhead_mb").cast("string"), F.lit("m")).alias("memory_overhead"))
        .alias("spark_submit"))
