"""Node packer (N1-N10): workloads x physical cluster shapes.

Shape arithmetic (executors per node, memory split, unified memory) is done
once per shape on the shapes table; workloads join their shape by cluster id
(an equi join; the shapes side is a dimension that Spark broadcasts from its
own size estimate). Alerts are an array column, exploded only for counting.

``pick_shape`` (N9) finds, for every workload, the smallest feasible shape
(cluster cores, then RAM, then id) whose unified memory holds the inflated
data. No workload x shape pairs are formed: the shapes are reduced to a
staircase of capacities, and each workload finds its step by halving in a
packed index of it (``operators.staircase``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rightsize.functions.numeric import codes_array, stage
from rightsize.operators.staircase import first_step
from rightsize.sources.defaults import NODE_WORKLOAD_DEFAULTS, SHAPE_DEFAULTS, with_defaults
from rightsize.sources.dims import dim

# Node-packer constants and alert thresholds.
DRIVER_SLOTS = 1                  # one executor slot goes to the driver
MIN_OVERHEAD_GB = 0.384
OVERHEAD_FRACTION = 0.10
RESERVED_GB = 0.3
MIN_SHUFFLE_PARTITIONS = 200
COMPRESSED_OOPS_HEAP_GB = 32
FAT_EXECUTOR_CORES = 5
HIGH_MEMORY_USE = 0.7
G1_HEAP_GB = 8

# Alert code -> severity.
ALERT_SEVERITY = [
    ("compressed_oops_lost", "warning"),
    ("fat_executor", "warning"),
    ("tiny_executor", "warning"),
    ("spill_risk", "error"),
    ("high_memory_use", "info"),
    ("ok", "success"),
]

def shape_sizing(shapes: DataFrame) -> DataFrame:
    """N1, N2, N5, N10 and V5 per shape (missing fields: form defaults, S3)."""
    shapes = with_defaults(shapes, SHAPE_DEFAULTS)
    df = stage(shapes, {
        "executors_per_node": ("CAST(floor(try_divide(CAST(node_cores - os_cores AS DOUBLE),"
                               " CAST(target_exec_cores AS DOUBLE))) AS BIGINT)"),
        "cluster_cores": "CAST(node_cores * num_nodes AS BIGINT)",
        "cluster_ram_gb": "CAST(node_ram_gb * num_nodes AS BIGINT)"})
    df = stage(df, {
        "_n_total": f"executors_per_node * num_nodes - {DRIVER_SLOTS}",
        "_n_raw": "try_divide(CAST(node_ram_gb - os_ram_gb AS DOUBLE), CAST(executors_per_node AS DOUBLE))"})
    df = stage(df, {
        "status": ("CASE WHEN executors_per_node IS NULL OR executors_per_node < 1 THEN 'no_executor_fits'"
                   " WHEN _n_total < 1 THEN 'cluster_too_small' ELSE 'ok' END"),
        "_n_overhead": f"greatest({MIN_OVERHEAD_GB}D, _n_raw * {OVERHEAD_FRACTION}D)"})
    df = stage(df, {"_n_heap": "_n_raw - _n_overhead"})
    df = stage(df, {"_n_unified": f"(_n_heap - {RESERVED_GB}D) * memory_fraction"})
    ok = "status = 'ok'"
    out = stage(df, {
        "total_executors": f"CASE WHEN {ok} THEN _n_total END",
        "total_compute_cores": f"CASE WHEN {ok} THEN _n_total * target_exec_cores END",
        "raw_mem_per_exec_gb": f"CASE WHEN {ok} THEN _n_raw END",
        "overhead_gb": f"CASE WHEN {ok} THEN _n_overhead END",
        "heap_gb": f"CASE WHEN {ok} THEN _n_heap END",
        "unified_mem_per_exec_gb": f"CASE WHEN {ok} THEN _n_unified END",
        "cluster_unified_mem_gb": f"CASE WHEN {ok} THEN _n_unified * _n_total END",
        "g1_advised": f"CASE WHEN {ok} THEN _n_heap > {G1_HEAP_GB} END"})
    return out.drop(*[x for x in out.columns if x.startswith("_n_")])


def alert_codes_sql(heap: str, target: str, inflated: str, unified: str) -> str:
    """Alert codes in check order; ``ok`` when none is raised."""
    raised = codes_array([
        (f"{heap} > {COMPRESSED_OOPS_HEAP_GB}", "compressed_oops_lost"),
        (f"{target} > {FAT_EXECUTOR_CORES}", "fat_executor"),
        (f"{target} = 1", "tiny_executor"),
        (f"{inflated} > {unified}", "spill_risk"),
        (f"{inflated} <= {unified} AND {inflated} > {unified} * {HIGH_MEMORY_USE}D", "high_memory_use"),
    ])
    return f"CASE WHEN size({raised}) = 0 THEN array('ok') ELSE {raised} END"


# A workload whose format or size no factor answers for is rejected before any arithmetic.
DATA_STATUS = ("CASE WHEN inflation_factor IS NULL THEN 'unknown_format'"
               " WHEN NOT coalesce(data_size_gb > 0, false) THEN 'data_size_not_positive' END")


def node_pack(spark: SparkSession, workloads: DataFrame, shapes: DataFrame) -> DataFrame:
    """N1-N8, N10 for each workload on its cluster's shape."""
    sized = shape_sizing(shapes)
    workloads = with_defaults(workloads, NODE_WORKLOAD_DEFAULTS)
    j = (workloads.join(dim(spark, "inflation"), "data_format", "left")
         .join(sized, "cluster_id", "left"))
    j = j.withColumn("status", F.expr(f"coalesce({DATA_STATUS}, status, 'unknown_cluster')"))
    j = stage(j, {
        "_n_mb": "data_size_gb * inflation_factor * 1024",
        "_n_inflated": "data_size_gb * inflation_factor"})
    j = stage(j, {"_n_base": "CAST(ceil(try_divide(CAST(_n_mb AS DOUBLE), CAST(partition_size_mb AS DOUBLE))) AS BIGINT)"})
    j = stage(j, {"_n_shuffle": ("greatest(200L, CAST(ceil(try_divide(CAST(_n_base AS DOUBLE),"
                                 " CAST(total_compute_cores AS DOUBLE))) AS BIGINT) * total_compute_cores)")})
    ok = "status = 'ok'"
    submit = ("concat('--conf spark.executor.instances=', CAST(total_executors AS STRING),"
              " ' --conf spark.executor.cores=', CAST(target_exec_cores AS STRING),"
              " ' --conf spark.executor.memory=', CAST(CAST(floor(heap_gb) AS BIGINT) AS STRING), 'g',"
              " ' --conf spark.executor.memoryOverhead=', CAST(CAST(ceil(overhead_gb * 1024) AS BIGINT) AS STRING), 'm',"
              " ' --conf spark.sql.shuffle.partitions=', CAST(_n_shuffle AS STRING),"
              " ' --conf spark.default.parallelism=', CAST(_n_shuffle AS STRING),"
              " ' --conf spark.memory.fraction=', CAST(memory_fraction AS STRING),"
              " ' --conf spark.sql.adaptive.enabled=true')")
    return j.selectExpr(
        "workload_id", "cluster_id", "cluster", "data_size_gb", "data_format", "inflation_factor",
        "status",
        "executors_per_node", f"CASE WHEN {ok} THEN total_executors END AS total_executors", "target_exec_cores",
        *[f"CASE WHEN {ok} THEN {x} END AS {x}" for x in (
            "total_compute_cores", "raw_mem_per_exec_gb", "overhead_gb", "heap_gb", "cluster_unified_mem_gb")],
        f"CASE WHEN {ok} THEN _n_mb END AS data_in_memory_mb",
        f"CASE WHEN {ok} THEN _n_base END AS base_partitions",
        f"CASE WHEN {ok} THEN _n_shuffle END AS shuffle_partitions",
        f"CASE WHEN {ok} THEN {alert_codes_sql('heap_gb', 'target_exec_cores', '_n_inflated', 'cluster_unified_mem_gb')}"
        " END AS alerts",
        f"CASE WHEN {ok} THEN g1_advised END AS g1_advised",
        f"CASE WHEN {ok} THEN {submit} END AS spark_submit")


def alert_counts(spark: SparkSession, packings: DataFrame) -> DataFrame:
    """Alerts in long form, counted per cluster and code."""
    sev = F.create_map(*[F.lit(x) for pair in ALERT_SEVERITY for x in pair])
    return (packings.select("cluster", F.explode("alerts").alias("code"))
            .groupBy("cluster", "code").agg(F.count(F.lit(1)).alias("workloads"))
            .withColumn("severity", sev[F.col("code")]))


# ---- N9: smallest shape that holds the data --------------------------------

def capacity_steps(shapes: DataFrame) -> DataFrame:
    """The staircase: shapes ordered by (cores, RAM, id) whose capacity beats
    every smaller shape; each answers the needs above the previous step's
    capacity up to its own.

    The best of all smaller shapes is a prefix maximum in two steps: within the
    shapes of equal core count, and across core counts, so that the only window
    without a partition key runs over one row per core count.
    """
    sized = shape_sizing(shapes).where(F.col("status") == "ok")
    own = Window.partitionBy("cluster_cores").orderBy("cluster_ram_gb", "cluster_id")
    within = F.max("cluster_unified_mem_gb").over(own.rowsBetween(Window.unboundedPreceding, -1))
    across = F.max("best").over(Window.orderBy("cluster_cores").rowsBetween(Window.unboundedPreceding, -1))
    fewer = (sized.groupBy("cluster_cores").agg(F.max("cluster_unified_mem_gb").alias("best"))
             .select("cluster_cores", across.alias("fewer_best")))
    return (sized.withColumn("own_best", within).join(fewer, "cluster_cores")
            .select("cluster_id", "cluster", "cluster_cores", "cluster_ram_gb", "cluster_unified_mem_gb",
                    F.greatest("own_best", "fewer_best").alias("lo"))
            .where(F.col("lo").isNull() | (F.col("cluster_unified_mem_gb") > F.col("lo"))).drop("lo"))


def pick_shape(spark: SparkSession, workloads: DataFrame, shapes: DataFrame) -> DataFrame:
    """Per workload the smallest shape raising no spill alert (NULL: none)."""
    need = (with_defaults(workloads, NODE_WORKLOAD_DEFAULTS).join(dim(spark, "inflation"), "data_format", "left")
            .select("workload_id", "data_size_gb", "data_format",
                    F.expr(f"CASE WHEN {DATA_STATUS} IS NULL THEN data_size_gb * inflation_factor END")
                    .cast("double").alias("need_gb")))
    steps = capacity_steps(shapes)
    best = steps.select(*[F.col(c).alias(f"best_{c}") for c in steps.columns])
    found = first_step(need, "need_gb", steps, "cluster_unified_mem_gb", "best_cluster_unified_mem_gb")
    return (found.join(best, "best_cluster_unified_mem_gb", "left")
            .select("workload_id", "need_gb", "best_cluster_id", "best_cluster", "best_cluster_cores",
                    "best_cluster_ram_gb", "best_cluster_unified_mem_gb"))
