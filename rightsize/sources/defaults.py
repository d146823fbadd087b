"""S3: workload tables with the planner's default for every missing field.

A missing column becomes a literal; a NULL in a present column becomes the
default. Either way it is one projection over the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Defaults of the cost model's input form, in form order.
COST_DEFAULTS: dict[str, object] = {
    "input_data_gb": 500.0,
    "compression_expand_factor": 3.0,
    "format_overhead_factor": 1.25,
    "transform_amplification_factor": 1.0,
    "shuffle_ratio": 0.8,
    "skew_factor": 1.2,
    "join_strategy": "Sort-merge join",
    "udf_complexity_factor": 1.0,
    "stages_count": 18,
    "input_partitions": 1200,
    "shuffle_partitions": 2000,
    "executors": 30,
    "cores_per_executor": 4,
    "executor_memory_gb": 16.0,
    "executor_memory_overhead_pct": 12.0,
    "cluster_cpu_utilization": 0.75,
    "cpu_throughput_mb_s_per_core": 90.0,
    "disk_throughput_mb_s_per_executor": 320.0,
    "network_throughput_mb_s_per_executor": 220.0,
    "spark_memory_fraction": 0.6,
    "spark_storage_fraction": 0.5,
    "active_working_set_fraction": 0.2,
    "cache_fraction_of_data": 0.2,
    "broadcast_tables_gb": 5.0,
    "concurrent_shuffle_fraction": 0.25,
    "stage_scheduler_overhead_s": 8.0,
    "spill_penalty_per_100pct": 0.65,
    "gc_penalty_sensitivity": 0.9,
    "expected_retry_fraction": 0.03,
    "retry_cost_fraction": 0.35,
    "speculative_execution_gain": 0.05,
    "target_runtime_min": 60.0,
    "min_executors": 4,
    "max_executors": 120,
}

# Defaults of the wave planner's input form (SLA 20 min).
WAVE_DEFAULTS: dict[str, object] = {
    "data_size_gb": 500.0,
    "sla_seconds": 1200,
    "k_comp": 1.2,
    "k_skew": 1.3,
    "block_size_mb": 128,
    "t_base_sec": 25.0,
    "e_mem_rate": 3.0,
    "cores_per_exec": 5,
    "skew_memory_mode": "off",
}

# Defaults of the profile planner's input form.
PROFILE_DEFAULTS: dict[str, object] = {
    "profile": "Balanced",
    "data_volume": 100.0,
    "volume_unit": "GB",
    "data_format": "Parquet",
    "complexity": "Medium",
    "sla_minutes": 60,
    "use_cache": False,
    "manual_override": False,
    # used only under manual override (the override widgets' defaults)
    "shuffle_intensity": "Heavy",
    "skew_risk": True,
    "safety_buffer_pct": 15,
    "max_executors_cap": 250,
}

# Defaults of the node packer's input form (shape fields).
SHAPE_DEFAULTS: dict[str, object] = {
    "node_cores": 16,
    "node_ram_gb": 64,
    "num_nodes": 6,
    "target_exec_cores": 5,
    "os_cores": 1,
    "os_ram_gb": 1,
    "partition_size_mb": 128,
    "memory_fraction": 0.6,
}

# Defaults of the node packer's input form (workload fields).
NODE_WORKLOAD_DEFAULTS: dict[str, object] = {
    "data_size_gb": 1000,
    "data_format": "Parquet / ORC",
}


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Add each missing field as its default; fill NULLs of present fields
    (keeping the present column's type)."""
    cols = []
    types = {f.name: f.dataType for f in df.schema.fields}
    for name, value in defaults.items():
        if name in types:
            cols.append(F.coalesce(F.col(name), F.lit(value).cast(types[name])).alias(name))
        else:
            cols.append(F.lit(value).alias(name))
    others = [c for c in df.columns if c not in defaults]
    return df.select(*others, *cols)
