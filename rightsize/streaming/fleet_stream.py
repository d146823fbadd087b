"""Sizing a stream of workload descriptions with Structured Streaming.

The wave, cost-estimate, profile and node models are per-row projections, so
they apply unchanged to a streaming DataFrame: new workload files landing in
a folder are planned as they arrive. Calibration coefficients, when given,
are joined stream-to-static on ``app_id``. Output goes to a parquet sink with
a checkpoint (exactly-once file sink), partitioned by team; a running demand
total per team is a stateful aggregation whose state is one row per team.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from rightsize.operators import waves as W


def read_workload_stream(spark: SparkSession, path: str, schema: StructType | str,
                         max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.parquet(path)


def plan_stream(workloads: DataFrame, calibration: DataFrame | None = None) -> DataFrame:
    """Wave plans (valid and rejected rows, with reasons) for a workload stream."""
    if calibration is not None:
        workloads = W.with_calibration(workloads, calibration)
    return W.wave_validate(workloads)


def demand_by_team(plans: DataFrame) -> DataFrame:
    """Running totals per team (state: one row per team)."""
    valid = F.col("reject_reason").isNull()
    return (plans.groupBy("team")
            .agg(F.count(F.lit(1)).alias("workloads"),
                 F.sum(F.when(valid, 1).otherwise(0)).cast("bigint").alias("plans"),
                 F.sum("executors").alias("executors"),
                 F.sum(F.col("container_memory_mb") * F.col("executors")).alias("total_memory_mb")))


def write_plans_stream(plans: DataFrame, out_path: str, checkpoint: str,
                       available_now: bool = True) -> StreamingQuery:
    """Append plans to parquet (exactly once through the checkpoint)."""
    w = (plans.drop("reject_reasons").writeStream.format("parquet")
         .option("path", out_path).option("checkpointLocation", checkpoint)
         .partitionBy("team").outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def write_demand_stream(demand: DataFrame, checkpoint: str, sink, available_now: bool = True) -> StreamingQuery:
    """Update-mode running totals handed to ``sink(batch_df, batch_id)``."""
    w = demand.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
