"""Task telemetry from Spark event logs.

Event logs are JSON lines (plain or compressed; Spark 4 writes
``eventlog_v2_<app>/events_<n>_<app>.zstd``). They are read as a file-parallel
JSON scan with an explicit, narrow schema -- only the fields below are
parsed -- filtered to ``SparkListenerTaskEnd`` and flattened into the
``task_metrics`` layout the calibration jobs consume. The application id
comes from the file path (``_metadata.file_path``).
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TASK_END_SCHEMA = """
  `Event` STRING,
  `Stage ID` BIGINT,
  `Stage Attempt ID` BIGINT,
  `Task Info` STRUCT<`Task ID`: BIGINT, `Index`: BIGINT, `Attempt`: INT, `Launch Time`: BIGINT, `Finish Time`: BIGINT,
                     `Failed`: BOOLEAN, `Killed`: BOOLEAN, `Speculative`: BOOLEAN, `Executor ID`: STRING>,
  `Task Metrics` STRUCT<`Executor Run Time`: BIGINT, `JVM GC Time`: BIGINT,
                        `Memory Bytes Spilled`: BIGINT, `Disk Bytes Spilled`: BIGINT,
                        `Input Metrics`: STRUCT<`Bytes Read`: BIGINT>,
                        `Shuffle Read Metrics`: STRUCT<`Remote Bytes Read`: BIGINT, `Local Bytes Read`: BIGINT>,
                        `Shuffle Write Metrics`: STRUCT<`Shuffle Bytes Written`: BIGINT>>
"""

# The log's folder ``eventlog_v2_<id>`` of a rolling log, else the file name up to its first dot.
APP_ID_PATTERN = r"(?:/eventlog_v2_([^/]+)/[^/]+|/([^/.]+)[^/]*)$"


def read_task_metrics(spark: SparkSession, path: str) -> DataFrame:
    """One row per finished task attempt, in the ``task_metrics`` layout."""
    # A damaged or vanished log fails the read: coefficients must not come from part of the telemetry.
    raw = (spark.read.schema(TASK_END_SCHEMA)
           .option("recursiveFileLookup", "true")
           .json(path)
           .where(F.col("Event") == "SparkListenerTaskEnd")
           .select("*", F.col("_metadata.file_path").alias("file_path")))
    ti, tm = F.col("`Task Info`"), F.col("`Task Metrics`")
    shuffle_read = (F.coalesce(tm["Shuffle Read Metrics"]["Remote Bytes Read"], F.lit(0))
                    + F.coalesce(tm["Shuffle Read Metrics"]["Local Bytes Read"], F.lit(0)))
    return raw.select(
        F.coalesce(F.nullif(F.regexp_extract("file_path", APP_ID_PATTERN, 1), F.lit("")),
                   F.regexp_extract("file_path", APP_ID_PATTERN, 2)).alias("app_id"),
        F.col("`Stage ID`").alias("stage_id"),
        F.col("`Stage Attempt ID`").alias("stage_attempt"),
        ti["Task ID"].alias("task_id"),
        ti["Index"].alias("task_index"),
        ti["Attempt"].alias("attempt"),
        (ti["Finish Time"] - ti["Launch Time"]).alias("duration_ms"),
        tm["Executor Run Time"].alias("run_ms"),
        tm["JVM GC Time"].alias("gc_ms"),
        tm["Memory Bytes Spilled"].alias("mem_spill_bytes"),
        tm["Disk Bytes Spilled"].alias("disk_spill_bytes"),
        F.coalesce(tm["Input Metrics"]["Bytes Read"], F.lit(0)).alias("input_bytes"),
        shuffle_read.alias("shuffle_bytes"),
        F.coalesce(tm["Shuffle Write Metrics"]["Shuffle Bytes Written"], F.lit(0)).alias("shuffle_write_bytes"),
        ti["Failed"].alias("failed"),
        ti["Killed"].alias("killed"),
        ti["Speculative"].alias("speculative"),
        ti["Launch Time"].alias("launch_ms"),
        F.timestamp_millis(ti["Launch Time"]).alias("launch_ts"),
    )
