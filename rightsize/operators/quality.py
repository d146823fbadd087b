"""Declared input ranges as data (V3).

Each input form declares a range per field; here they are rules over the
workload tables. A violated rule becomes one row (explode of the failed rule
codes), so counting violations is an ordinary grouped aggregate with map-side
pre-aggregation, whatever the number of workloads.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rightsize.functions.numeric import codes_where

# Declared input ranges of the four input forms.
# (rule code, column, lowest allowed, highest allowed); a str bound names a column,
# a tuple in place of the lowest lists the only values allowed.
RULES: dict[str, list[tuple[str, str, object, object]]] = {
    "workloads": [
        ("data_size_below_min", "data_size_gb", 1.0, None),
        ("sla_below_one_minute", "sla_seconds", 60, None),
        ("k_comp_out_of_range", "k_comp", 1.0, 3.0),
        ("k_skew_out_of_range", "k_skew", 1.0, 3.0),
        ("block_size_not_offered", "block_size_mb", (64, 96, 128, 192, 256), None),
        ("t_base_below_min", "t_base_sec", 1.0, None),
        ("e_mem_out_of_range", "e_mem_rate", 1.0, 6.0),
        ("cores_per_exec_not_offered", "cores_per_exec", (2, 3, 4, 5, 6, 8), None),
        ("skew_mode_not_offered", "skew_memory_mode", ("off", "sqrt", "linear"), None),
    ],
    "cost_workloads": [
        ("input_below_min", "input_data_gb", 0.1, None),
        ("shuffle_ratio_out_of_range", "shuffle_ratio", 0.0, 2.0),
        ("skew_factor_out_of_range", "skew_factor", 1.0, 4.0),
        ("executors_below_min", "executors", 1, None),
        ("target_negative", "target_runtime_min", 0.0, None),
        ("min_executors_below_min", "min_executors", 1, None),
        ("max_executors_below_min", "max_executors", 1, None),
        ("compression_out_of_range", "compression_expand_factor", 1.0, 8.0),
        ("format_overhead_out_of_range", "format_overhead_factor", 1.0, 2.5),
        ("amplification_out_of_range", "transform_amplification_factor", 0.5, 3.0),
        ("udf_complexity_out_of_range", "udf_complexity_factor", 0.5, 4.0),
        ("stages_below_min", "stages_count", 1, None),
        ("input_partitions_below_min", "input_partitions", 1, None),
        ("shuffle_partitions_below_min", "shuffle_partitions", 1, None),
        ("cores_below_min", "cores_per_executor", 1, None),
        ("executor_memory_below_min", "executor_memory_gb", 1.0, None),
        ("memory_overhead_out_of_range", "executor_memory_overhead_pct", 5, 50),
        ("cpu_utilization_out_of_range", "cluster_cpu_utilization", 0.2, 1.0),
        ("cpu_throughput_below_min", "cpu_throughput_mb_s_per_core", 1.0, None),
        ("disk_throughput_below_min", "disk_throughput_mb_s_per_executor", 10.0, None),
        ("network_throughput_below_min", "network_throughput_mb_s_per_executor", 10.0, None),
        ("memory_fraction_out_of_range", "spark_memory_fraction", 0.2, 0.9),
        ("storage_fraction_out_of_range", "spark_storage_fraction", 0.1, 0.9),
        ("working_set_out_of_range", "active_working_set_fraction", 0.05, 0.7),
        ("cache_fraction_out_of_range", "cache_fraction_of_data", 0.0, 1.0),
        ("broadcast_negative", "broadcast_tables_gb", 0.0, None),
        ("in_flight_shuffle_out_of_range", "concurrent_shuffle_fraction", 0.05, 0.8),
        ("stage_overhead_negative", "stage_scheduler_overhead_s", 0.0, None),
        ("spill_penalty_out_of_range", "spill_penalty_per_100pct", 0.0, 2.0),
        ("gc_sensitivity_out_of_range", "gc_penalty_sensitivity", 0.0, 2.0),
        ("retry_fraction_out_of_range", "expected_retry_fraction", 0.0, 0.5),
        ("retry_cost_out_of_range", "retry_cost_fraction", 0.0, 1.0),
        ("speculation_gain_out_of_range", "speculative_execution_gain", 0.0, 0.35),
    ],
    "profile_workloads": [
        ("data_volume_below_min", "data_volume", 1.0, None),
        ("sla_out_of_range", "sla_minutes", 5, 720),
        ("safety_buffer_out_of_range", "safety_buffer_pct", 0, 40),
        ("executor_cap_below_min", "max_executors_cap", 1, None),
    ],
    "cluster_shapes": [
        ("node_cores_below_min", "node_cores", 2, None),
        ("node_ram_below_min", "node_ram_gb", 4, None),
        ("num_nodes_below_min", "num_nodes", 2, None),
        ("target_cores_out_of_range", "target_exec_cores", 1, "node_cores"),
        ("os_cores_negative", "os_cores", 0, None),
        ("os_ram_negative", "os_ram_gb", 0, None),
        ("partition_size_below_min", "partition_size_mb", 10, None),
        ("memory_fraction_out_of_range", "memory_fraction", 0.1, 0.9),
    ],
    "node_workloads": [
        ("data_size_below_min", "data_size_gb", 1, None),
    ],
}

KEYS = {"workloads": "workload_id", "cost_workloads": "workload_id", "profile_workloads": "workload_id",
        "cluster_shapes": "cluster_id", "node_workloads": "workload_id"}


def _bound(b) -> Column:
    return F.col(b) if isinstance(b, str) else F.lit(b)


def _violated(column: str, lo, hi) -> Column:
    v = F.col(column)
    if isinstance(lo, tuple):
        return F.coalesce(~v.isin(*lo), F.lit(False))
    cond = F.lit(False)
    if lo is not None:
        cond = cond | (v < _bound(lo))
    if hi is not None:
        cond = cond | (v > _bound(hi))
    return F.coalesce(cond, F.lit(False))


def violations(df: DataFrame, table: str, rules=None) -> DataFrame:
    """One row per (row, violated rule).

    A field the table lacks, or a NULL, takes the form's default (S3), which
    lies in its range, so its rules are not violated.
    """
    rules = rules if rules is not None else RULES[table]
    failed = codes_where(*[(_violated(col, lo, hi), code) for code, col, lo, hi in rules if col in df.columns])
    return df.select(F.lit(table).alias("table_name"), F.col(KEYS[table]).cast("bigint").alias("row_key"),
                     F.explode(failed).alias("rule"))


def _rules_side_by_side(df: DataFrame, forms: dict[str, str]) -> list[tuple[Column, str]]:
    """(condition that breaks it, "form:rule") for the struct columns ``forms`` of ``df``."""
    rules = []
    for column, form in forms.items():
        fields = set(df.schema[column].dataType.names)
        for code, field, lo, hi in RULES[form]:
            if field in fields:
                bound = f"{column}.{hi}" if isinstance(hi, str) else hi
                rules.append((F.col(f"has_{column}") & _violated(f"{column}.{field}", lo, bound), f"{form}:{code}"))
    return rules


def _named(found: DataFrame, *more: str) -> DataFrame:
    return found.select(F.substring_index("failed", ":", 1).alias("table_name"), *more, F.substring_index("failed", ":", -1).alias("rule"))


def violations_side_by_side(df: DataFrame, forms: dict[str, str]) -> DataFrame:
    """``violations`` of several forms that are struct columns of one row
    (column name -> form, where ``has_<column>`` holds): one scan, one
    projection, one explode, whatever the number of forms."""
    key = F.coalesce(*[F.col(f"{column}.{KEYS[form]}") for column, form in forms.items()])
    return _named(df.select(key.cast("bigint").alias("row_key"), F.explode(codes_where(*_rules_side_by_side(df, forms))).alias("failed")), "row_key")


def counts_side_by_side(df: DataFrame, forms: dict[str, str]) -> DataFrame:
    """The same counted per form and rule: one count a rule in one aggregate
    without keys, so a task ships one row and no violation becomes a row."""
    rules = _rules_side_by_side(df, forms)
    counted = df.agg(*[F.count(F.when(cond, 1)).alias(f"r{i}") for i, (cond, _) in enumerate(rules)])
    each = F.explode(F.array(*[F.struct(F.lit(code).alias("failed"), F.col(f"r{i}").alias("n")) for i, (_, code) in enumerate(rules)])).alias("e")
    return _named(counted.select(each).select("e.*"), "n").select("table_name", "rule", "n").where("n > 0")


def all_violations(parts: list[DataFrame]) -> DataFrame:
    """V3 by row, over all forms."""
    return reduce(DataFrame.unionByName, parts)


def domain_violations(counts: DataFrame, rows: DataFrame) -> DataFrame:
    """V3: violations per form and rule, of counts and of violation rows."""
    each = rows.select("table_name", "rule", F.lit(1).cast("bigint").alias("n"))
    return (counts.unionByName(each).groupBy("table_name", "rule")
            .agg(F.sum("n").alias("violations")))
