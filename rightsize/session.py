"""Session helpers: build a local session for tests/bench, find the shared
checkpoint folder of whatever session we are handed."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int | None = None,
                  app_name: str = "rightsize", extra: dict | None = None) -> SparkSession:
    """Session for tests and the bench (local mode, UI off)."""
    parts = shuffle_partitions or (8 if cpus == "*" else int(cpus))
    b = (SparkSession.builder.master(f"local[{cpus}]").appName(app_name)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.host", "127.0.0.1")
         .config("spark.driver.bindAddress", "127.0.0.1")
         .config("spark.driver.memory", "16g")
         .config("spark.sql.shuffle.partitions", str(parts))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         # Exact medians (K1) keep one value->count map per (app, stage) group;
         # let a task hold many groups in the hash map before falling back to sort.
         .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "8192"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    On a cluster this is set by the deployment and we only read it. Only when
    it is unset (local tests) do we create one of our own under /tmp.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = configured or tempfile.mkdtemp(prefix="rightsize-ckpt-")
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir() or path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for job outputs inside the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return base.rstrip("/") + "/" + name
