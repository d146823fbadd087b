"""Coefficient tables as small dimension DataFrames.

They are literal tables of a handful of rows (a proven size bound), so joins
against them are marked ``broadcast``: the workload table is never shuffled for
a lookup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Join / workload pattern -> shuffle volume multiplier (others: 1.0).
JOIN_MULTIPLIERS = [
    ("Broadcast hash join", 0.35),
    ("Sort-merge join", 1.0),
    ("Shuffle hash join", 0.85),
    ("Mostly aggregations (few joins)", 0.6),
]

# Storage format -> in-memory size factor.
FORMAT_IN_MEMORY_FACTOR = [
    ("Parquet", 1.20),
    ("Iceberg", 1.15),
    ("ORC", 1.25),
    ("CSV", 2.80),
]

# Complexity -> task memory MB, core throughput MB/s, partitions per core.
COMPLEXITY = [
    ("Low", 384, 75.0, 24),
    ("Medium", 768, 45.0, 16),
    ("High", 1536, 24.0, 10),
]

# Shuffle intensity -> data multiplier.
SHUFFLE_MULTIPLIER = [
    ("Standard", 1.00),
    ("Heavy", 1.25),
    ("Extreme", 1.45),
]

# Sizing profile -> shuffle intensity, skew risk, safety buffer %, executor cap.
PROFILE_DEFAULTS = [
    ("Conservative", "Heavy", True, 25, 180),
    ("Balanced", "Standard", False, 10, 250),
    ("Aggressive", "Standard", False, 5, 400),
]

# Node-packer input format -> inflation factor in memory.
INFLATION = [
    ("Parquet / ORC", 4),
    ("Compressed CSV / JSON", 8),
    ("Plain text", 3),
]

SCHEMAS = {
    "join_multipliers": ("join_strategy string, join_multiplier double", JOIN_MULTIPLIERS),
    "formats": ("data_format string, format_factor double", FORMAT_IN_MEMORY_FACTOR),
    "complexity": ("complexity string, task_memory_mb int, throughput_mbps double, "
                   "partitions_per_core int", COMPLEXITY),
    "shuffle": ("shuffle_intensity string, shuffle_factor double", SHUFFLE_MULTIPLIER),
    "profiles": ("profile string, profile_shuffle_intensity string, profile_skew_risk boolean, "
                 "profile_safety_buffer_pct int, profile_max_executors_cap int", PROFILE_DEFAULTS),
    "inflation": ("data_format string, inflation_factor int", INFLATION),
}


def _sql_literal(v) -> str:
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("'", "''") + "'"


def _values_table(spark: SparkSession, name: str) -> DataFrame:
    """A literal dimension as a SQL VALUES relation (a local relation: no RDD,
    no job to build it; broadcasting it is free)."""
    schema, rows = SCHEMAS[name]
    fields = [f.strip().split(" ", 1) for f in schema.split(",")]
    values = ", ".join("(" + ", ".join(_sql_literal(v) for v in row) + ")" for row in rows)
    cols = ", ".join(f"CAST(col{i + 1} AS {t}) AS {n}" for i, (n, t) in enumerate(fields))
    return spark.sql(f"SELECT {cols} FROM VALUES {values}")


def dims(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: _values_table(spark, name) for name in SCHEMAS}


def dim(spark: SparkSession, name: str) -> DataFrame:
    return F.broadcast(_values_table(spark, name))
