"""Write plan tables as parquet, partitioned for later per-team reads."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rightsize.session import scratch_path


def write_plans(df: DataFrame, path: str, partition_by: str | None = "team", compression: str | None = None) -> str:
    """One parallel write; each task writes its own files (no coalesce to one)."""
    w = df.write.mode("overwrite")
    if compression:
        w = w.option("compression", compression)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    return path


def write_and_read_back(spark: SparkSession, df: DataFrame, name: str, partition_by: str | None = "team",
                        compression: str | None = None) -> DataFrame:
    """Write under the shared checkpoint folder and return the written table.

    Reading the files back also cuts the lineage: later jobs start from the
    written table, not from a recomputation.
    """
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    write_plans(df, path, partition_by, compression)
    return spark.read.parquet(path)


# ---- plan tables that later runs are joined with ------------------------------

def write_bucketed(spark: SparkSession, df: DataFrame, name: str, key: str, buckets: int,
                   then: Callable[[DataFrame], DataFrame] = lambda df: df) -> str:
    """``then(df)`` as a table of ``buckets`` files, hashed by ``key`` and sorted by
    it within each; an external table below the shared folder. Returns its name
    in the catalog. Rows are dealt to their bucket first, so a bucket is one
    file and its order holds for whoever reads it. ``then`` works row by row and
    keeps the key: the narrow rows meet the exchange, not what is made of them."""
    table = f"{name}_{uuid.uuid4().hex}"
    (then(df.repartition(buckets, key)).sortWithinPartitions(key).write.bucketBy(buckets, key).sortBy(key)
     .option("path", scratch_path(spark, table)).saveAsTable(table))
    return table


def plan_changes(spark: SparkSession, before: str, after: str, key: str, compared: tuple[str, ...]) -> DataFrame:
    """What changed, a workload a row, between two plan tables of
    ``write_bucketed`` with equal bucket counts: 'added', 'removed', 'changed'
    with the old and new values; equal plans have no row. Both tables are
    already dealt by the key: a merge join without an exchange, whose sorts meet
    one sorted file each."""
    old = spark.table(before).select(F.col(key).alias("old_key"), *[F.col(c).alias(f"old_{c}") for c in compared])
    new = spark.table(after).select(F.col(key).alias("new_key"), *[F.col(c).alias(f"new_{c}") for c in compared])
    both = old.hint("merge").join(new, F.col("old_key") == F.col("new_key"), "full_outer")
    same = reduce(lambda a, b: a & b, [F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")) for c in compared])
    change = F.when(F.col("old_key").isNull(), "added").when(F.col("new_key").isNull(), "removed").when(~same, "changed")
    return (both.withColumn("change", change).where("change IS NOT NULL")
            .select(F.coalesce("old_key", "new_key").alias(key), "change", *[f"{v}_{c}" for c in compared for v in ("old", "new")]))
