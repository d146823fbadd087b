"""Input tables of the sizing models, derived from the driver's test tables.

Each block is plain SQL that runs unchanged on Spark and on DuckDB (FIXTURES.md):
DOUBLE literals in exponent form, ``floor`` before every BIGINT cast. The Spark
side binds the ``{table}`` placeholders to DataFrames (``spark.sql(..., t=df)``),
so no global temp view is registered; the oracle side substitutes the bare view
names. Everything here is a scan + projection (and one equi join for the
orders-based blocks), so it grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rightsize.sources.tables import read_table

# Fixture definitions (FIXTURES.md), kept verbatim for both engines.
FIXTURE_SQL: dict[str, str] = {
    "task_metrics": """
SELECT l_suppkey AS app_id, l_linenumber AS stage_id,
  CAST(floor(l_extendedprice * (1e0 + (l_linenumber % 4) / 2e0)
    * CASE WHEN l_suppkey % 10 = 0 AND l_partkey % 50 = 0 THEN 3e0 ELSE 1e0 END) AS BIGINT) AS duration_ms,
  CAST(floor(l_extendedprice * 0.9e0) AS BIGINT) AS run_ms,
  CASE WHEN l_returnflag = 'R' THEN (CAST(floor(l_quantity) AS BIGINT) * 3 + l_partkey % 7) * 1048576 ELSE 0 END AS mem_spill_bytes,
  CASE WHEN l_returnflag = 'R' THEN CAST(floor(l_quantity) AS BIGINT) * 1048576 ELSE 0 END AS disk_spill_bytes,
  CAST(floor(l_extendedprice) AS BIGINT) * 2048 AS input_bytes,
  CASE WHEN l_linenumber > 1 THEN CAST(floor(l_extendedprice) AS BIGINT) * 1024 ELSE 0 END AS shuffle_bytes,
  CASE WHEN l_partkey % 33 = 0 THEN 1 ELSE 0 END AS attempt,
  CAST(CASE WHEN l_suppkey % 5 = 0 AND l_linenumber = 2 AND l_partkey % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS stage_attempt,
  l_partkey % 29 = 0 AS failed, l_partkey % 31 = 0 AS killed, l_partkey % 3 = 0 AS speculative,
  ((l_orderkey * 20000000 + CAST(floor(l_extendedprice * 100e0) AS BIGINT)) * 64 + CAST(floor(l_quantity) AS BIGINT)) * 64 + l_partkey % 64 AS task_id,
  CASE WHEN l_suppkey % 5 = 0 AND l_linenumber = 2 THEN l_orderkey % 64 ELSE l_orderkey END AS task_index,
  (9131 + l_suppkey % 1000) * 86400000 + l_linenumber * 100000 + l_orderkey % 100000 AS launch_ms
FROM {lineitem}
""",
    "baseline_tasks": """
SELECT l_suppkey AS app_id,
  (9131 + 91 * (l_partkey % 28) + CASE WHEN l_suppkey % 9 = 0 THEN 4000 ELSE 0 END) * 86400000 AS run_ms,
  CAST(floor(l_extendedprice * 0.8e0) AS BIGINT) AS duration_ms
FROM {lineitem}
""",
    "file_manifest": """
SELECT source AS dataset, doc_id AS file_id, n_chars * 1048576 AS bytes FROM {documents}
""",
    "workloads": """
SELECT o_orderkey AS workload_id, c_mktsegment AS team, o_custkey % 120 AS app_id,
  CASE WHEN o_orderkey % 500 = 0 THEN 0 ELSE CAST(floor(o_totalprice / 500e0) AS BIGINT) + 1 END AS data_size_gb,
  CASE o_orderpriority WHEN '1-URGENT' THEN 60 WHEN '2-HIGH' THEN 600 WHEN '3-MEDIUM' THEN 1200
    WHEN '4-NOT SPECIFIED' THEN 2400 ELSE 3600 END AS sla_seconds,
  1e0 + (o_orderkey % 21) / 10e0 AS k_comp,
  CASE WHEN o_orderkey % 777 = 0 THEN 0e0 ELSE 1e0 + (o_custkey % 21) / 10e0 END AS k_skew,
  CASE o_orderkey % 3 WHEN 0 THEN 'off' WHEN 1 THEN 'sqrt' ELSE 'linear' END AS skew_memory_mode
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
""",
    "cost_workloads": """
SELECT o_orderkey AS workload_id, c_mktsegment AS team,
  1e0 + floor(o_totalprice / 500e0) AS input_data_gb,
  CASE o_orderkey % 5 WHEN 0 THEN 'Broadcast hash join' WHEN 1 THEN 'Sort-merge join'
    WHEN 2 THEN 'Shuffle hash join' WHEN 3 THEN 'Mostly aggregations (few joins)' ELSE 'other' END AS join_strategy,
  (o_orderkey % 9) / 10e0 AS shuffle_ratio,
  1e0 + (o_custkey % 7) / 10e0 AS skew_factor,
  CAST(10 + o_custkey % 50 AS BIGINT) AS executors,
  CASE WHEN o_orderkey % 11 = 0 THEN 0e0 ELSE 10e0 + (o_custkey % 6) * 10e0 END AS target_runtime_min,
  4 AS min_executors, CASE WHEN o_orderkey % 13 = 0 THEN 6 ELSE 120 END AS max_executors
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
""",
    "resubmitted_workloads": """
SELECT o_orderkey AS workload_id, c_mktsegment AS team, CAST(10 + o_custkey % 50 AS BIGINT) AS executors, 1 AS submission
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
UNION ALL
SELECT o_orderkey - o_orderkey % 40 AS workload_id, c_mktsegment AS team, CAST(20 + o_custkey % 50 AS BIGINT) AS executors, 2 AS submission
FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE o_orderstatus = 'P'
""",
    "profile_workloads": """
SELECT o_orderkey AS workload_id, c_mktsegment AS team,
  CASE WHEN o_orderkey % 10 = 0 THEN 1e0 + floor(o_totalprice / 100000e0) ELSE 1e0 + floor(o_totalprice / 500e0) END AS data_volume,
  CASE WHEN o_orderkey % 10 = 0 THEN 'TB' ELSE 'GB' END AS volume_unit,
  CASE o_orderkey % 5 WHEN 0 THEN 'Parquet' WHEN 1 THEN 'Iceberg' WHEN 2 THEN 'ORC' WHEN 3 THEN 'CSV' ELSE 'Avro' END AS data_format,
  CASE o_custkey % 3 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' ELSE 'High' END AS complexity,
  CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 10 WHEN '3-MEDIUM' THEN 20
    WHEN '4-NOT SPECIFIED' THEN 40 ELSE 60 END AS sla_minutes,
  o_custkey % 2 = 0 AS use_cache,
  CASE o_orderstatus WHEN 'P' THEN 'Conservative' WHEN 'F' THEN 'Balanced' ELSE 'Aggressive' END AS profile,
  o_orderkey % 4 = 0 AS manual_override,
  CASE o_custkey % 4 WHEN 0 THEN 'Standard' WHEN 1 THEN 'Heavy' ELSE 'Extreme' END AS shuffle_intensity,
  o_custkey % 5 = 0 AS skew_risk,
  CAST(o_orderkey % 9 AS INTEGER) * 5 AS safety_buffer_pct,
  250 AS max_executors_cap
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
""",
    "cluster_shapes": """
SELECT n_nationkey AS cluster_id, n_name AS cluster,
  4 + 4 * (n_nationkey % 8) AS node_cores, 16 + 48 * (n_nationkey % 5) AS node_ram_gb, 2 + n_nationkey % 6 AS num_nodes,
  1 + n_nationkey % 7 AS target_exec_cores, 1 AS os_cores, 1 AS os_ram_gb, 128 AS partition_size_mb, 0.6e0 AS memory_fraction
FROM {nation}
""",
    "node_workloads": """
SELECT o_orderkey AS workload_id, c_nationkey AS cluster_id,
  CAST(floor(o_totalprice / 500e0) AS BIGINT) + 1 AS data_size_gb,
  CASE o_orderkey % 3 WHEN 0 THEN 'Parquet / ORC' WHEN 1 THEN 'Compressed CSV / JSON' ELSE 'Plain text' END AS data_format
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
""",
    "cost_forms": """
SELECT o_orderkey AS workload_id,
  CASE WHEN o_orderkey % 40 = 0 THEN 9e0 ELSE 3e0 END AS compression_expand_factor,
  CASE WHEN o_orderkey % 40 = 1 THEN 0.5e0 ELSE 1.25e0 END AS format_overhead_factor,
  CASE WHEN o_orderkey % 40 = 2 THEN 3.5e0 ELSE 1e0 END AS transform_amplification_factor,
  CASE WHEN o_orderkey % 40 = 3 THEN 0.25e0 ELSE 1e0 END AS udf_complexity_factor,
  CASE WHEN o_orderkey % 40 = 4 THEN 0 ELSE 18 END AS stages_count,
  CASE WHEN o_orderkey % 40 = 5 THEN 0 ELSE 1200 END AS input_partitions,
  CASE WHEN o_orderkey % 40 = 6 THEN 0 ELSE 2000 END AS shuffle_partitions,
  CASE WHEN o_orderkey % 40 = 7 THEN 0 ELSE 4 END AS cores_per_executor,
  CASE WHEN o_orderkey % 40 = 8 THEN 0.5e0 ELSE 16e0 END AS executor_memory_gb,
  CASE WHEN o_orderkey % 40 = 9 THEN 51e0 ELSE 12e0 END AS executor_memory_overhead_pct,
  CASE WHEN o_orderkey % 40 = 10 THEN 0.1e0 ELSE 0.75e0 END AS cluster_cpu_utilization,
  CASE WHEN o_orderkey % 40 = 11 THEN 0.5e0 ELSE 90e0 END AS cpu_throughput_mb_s_per_core,
  CASE WHEN o_orderkey % 40 = 12 THEN 9e0 ELSE 320e0 END AS disk_throughput_mb_s_per_executor,
  CASE WHEN o_orderkey % 40 = 13 THEN 9e0 ELSE 220e0 END AS network_throughput_mb_s_per_executor,
  CASE WHEN o_orderkey % 40 = 14 THEN 0.95e0 ELSE 0.6e0 END AS spark_memory_fraction,
  CASE WHEN o_orderkey % 40 = 15 THEN 0.05e0 ELSE 0.5e0 END AS spark_storage_fraction,
  CASE WHEN o_orderkey % 40 = 16 THEN 0.75e0 ELSE 0.2e0 END AS active_working_set_fraction,
  CASE WHEN o_orderkey % 40 = 17 THEN 1.5e0 ELSE 0.2e0 END AS cache_fraction_of_data,
  CASE WHEN o_orderkey % 40 = 18 THEN -1e0 ELSE 5e0 END AS broadcast_tables_gb,
  CASE WHEN o_orderkey % 40 = 19 THEN 0.01e0 ELSE 0.25e0 END AS concurrent_shuffle_fraction,
  CASE WHEN o_orderkey % 40 = 20 THEN -1e0 ELSE 8e0 END AS stage_scheduler_overhead_s,
  CASE WHEN o_orderkey % 40 = 21 THEN 2.5e0 ELSE 0.65e0 END AS spill_penalty_per_100pct,
  CASE WHEN o_orderkey % 40 = 22 THEN -0.5e0 ELSE 0.9e0 END AS gc_penalty_sensitivity,
  CASE WHEN o_orderkey % 40 = 23 THEN 0.6e0 ELSE 0.03e0 END AS expected_retry_fraction,
  CASE WHEN o_orderkey % 40 = 24 THEN 1.5e0 ELSE 0.35e0 END AS retry_cost_fraction,
  CASE WHEN o_orderkey % 40 = 25 THEN 0.4e0 ELSE 0.05e0 END AS speculative_execution_gain,
  CASE WHEN o_orderkey % 40 = 26 THEN 0.05e0 ELSE 500e0 END AS input_data_gb,
  CASE WHEN o_orderkey % 40 = 27 THEN 2.5e0 ELSE 0.8e0 END AS shuffle_ratio,
  CASE WHEN o_orderkey % 40 = 28 THEN 4.5e0 ELSE 1.2e0 END AS skew_factor,
  CASE WHEN o_orderkey % 40 = 29 THEN 0 ELSE 30 END AS executors,
  CASE WHEN o_orderkey % 40 = 30 THEN -5e0 ELSE 60e0 END AS target_runtime_min,
  CASE WHEN o_orderkey % 40 = 31 THEN 0 ELSE 4 END AS min_executors,
  CASE WHEN o_orderkey % 40 = 32 THEN 0 ELSE 120 END AS max_executors
FROM {orders}
""",
    "wave_forms": """
SELECT o_orderkey AS workload_id,
  CASE WHEN o_orderkey % 16 = 0 THEN 0.5e0 ELSE 500e0 END AS data_size_gb,
  CASE WHEN o_orderkey % 16 = 1 THEN 30 ELSE 1200 END AS sla_seconds,
  CASE WHEN o_orderkey % 16 = 2 THEN 3.5e0 ELSE 1.2e0 END AS k_comp,
  CASE WHEN o_orderkey % 16 = 3 THEN 0.5e0 ELSE 1.3e0 END AS k_skew,
  CASE WHEN o_orderkey % 16 = 4 THEN 100 ELSE 128 END AS block_size_mb,
  CASE WHEN o_orderkey % 16 = 5 THEN 0.5e0 ELSE 25e0 END AS t_base_sec,
  CASE WHEN o_orderkey % 16 = 6 THEN 7e0 ELSE 3e0 END AS e_mem_rate,
  CASE WHEN o_orderkey % 16 = 7 THEN 7 ELSE 5 END AS cores_per_exec,
  CASE WHEN o_orderkey % 16 = 8 THEN 'cubic' ELSE 'off' END AS skew_memory_mode
FROM {orders}
""",
}

# Which driver tables each block reads.
FIXTURE_TABLES: dict[str, tuple[str, ...]] = {
    "task_metrics": ("lineitem",),
    "baseline_tasks": ("lineitem",),
    "file_manifest": ("documents",),
    "workloads": ("orders", "customer"),
    "cost_workloads": ("orders", "customer"),
    "resubmitted_workloads": ("orders", "customer"),
    "profile_workloads": ("orders", "customer"),
    "cluster_shapes": ("nation",),
    "node_workloads": ("orders", "customer"),
    "cost_forms": ("orders",),
    "wave_forms": ("orders",),
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The fixture table ``name`` over the parquet tables in ``sf_dir``."""
    tables = {t: read_table(spark, sf_dir, t) for t in FIXTURE_TABLES[name]}
    return spark.sql(FIXTURE_SQL[name], **tables)


def forms_of_orders(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> DataFrame:
    """The order-based fixture tables ``names`` side by side: one row an order,
    one struct a table and beside it ``has_<name>`` (whether the table has a row
    for the order), from one scan of the orders and one join."""
    columns, sources = [], []
    for name in names:
        fields = FIXTURE_SQL[name].strip().rsplit("FROM", 1)[0]
        has = "c_custkey IS NOT NULL" if "customer" in FIXTURE_TABLES[name] else "true"
        columns.append(f"struct({name}.*) AS {name}, {has} AS has_{name}")
        sources.append(f"LATERAL ({fields}) AS {name}")
    tables = {t: read_table(spark, sf_dir, t) for t in ("orders", "customer")}
    return spark.sql(f"SELECT {', '.join(columns)} FROM {{orders}} LEFT JOIN {{customer}} ON o_custkey = c_custkey, {', '.join(sources)}", **tables)


def fixture_cte(name: str) -> str:
    """The same block for the DuckDB oracle (views carry the table names)."""
    return FIXTURE_SQL[name].format(**{t: t for t in FIXTURE_TABLES[name]}).strip()
