"""Cross-model views.

The four models size the same workloads in different ways; ``compare_models``
puts their answers in one long table (``unionByName`` of four projections) and
``model_spread`` reduces it per workload and reports the largest
disagreements (a top-k report: ``orderBy(...).limit(k)`` plans as a
per-partition top-k followed by one small merge).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rightsize.functions.numeric import ceil_long

COMPARE_COLUMNS = ("workload_id", "model", "executors", "total_cores", "total_ram_mb", "status")
MODELS = ("cost", "node", "profile", "wave")


def from_wave(validated: DataFrame) -> DataFrame:
    """``wave_validate`` rows: plans and rejects with their reason."""
    return validated.select("workload_id", F.lit("wave").alias("model"), "executors",
                            F.col("total_cores").alias("total_cores"),
                            (F.col("container_memory_mb") * F.col("executors")).alias("total_ram_mb"),
                            F.coalesce("reject_reason", F.lit("ok")).alias("status"))


def from_cost(search: DataFrame) -> DataFrame:
    """Executors from the SLA search; memory per executor with overhead.
    ``search`` carries the per-workload memory fields
    (``sla_search(base, keep=COST_KEEP)``), so no join is needed."""
    per_exec_gb = F.col("executor_memory_gb") + F.col("overhead_gb")
    return search.select("workload_id", F.lit("cost").alias("model"), F.col("best_executors").alias("executors"),
                         (F.col("best_executors") * F.col("cores_per_executor")).cast("bigint").alias("total_cores"),
                         ceil_long(F.col("best_executors") * per_exec_gb * F.lit(1024.0)).alias("total_ram_mb"),
                         F.when(F.col("status") == "met", "ok").otherwise(F.col("status")).alias("status"))


COST_KEEP = ("cores_per_executor", "executor_memory_gb", "overhead_gb")


def from_profile(validated: DataFrame) -> DataFrame:
    """``profile_validate`` rows: plans and rejects with their reason."""
    return validated.select("workload_id", F.lit("profile").alias("model"), "executors",
                            F.col("total_cluster_cores").alias("total_cores"),
                            F.col("total_cluster_ram_mb").alias("total_ram_mb"),
                            F.coalesce("reject_reason", F.lit("ok")).alias("status"))


def from_node(packings: DataFrame) -> DataFrame:
    return packings.select("workload_id", F.lit("node").alias("model"), F.col("total_executors").alias("executors"),
                           F.col("total_compute_cores").alias("total_cores"),
                           ceil_long(F.col("total_executors") * F.col("raw_mem_per_exec_gb") * F.lit(1024.0))
                           .alias("total_ram_mb"), "status")


def compare_models(*parts: DataFrame) -> DataFrame:
    """One row per (workload, model); a model that rejects a workload says
    why in ``status`` ('ok' for a plan) and has no figures."""
    norm = [p.select(F.col("workload_id").cast("bigint"), "model", F.col("executors").cast("bigint"),
                     F.col("total_cores").cast("bigint"), F.col("total_ram_mb").cast("bigint"), "status") for p in parts]
    return reduce(DataFrame.unionByName, norm)


def model_spread(compared: DataFrame, k: int = 20) -> DataFrame:
    """Per workload min/max executors over the models that have a plan for
    it; the k widest spreads. A workload id that a model answers more than once
    is no key: it is counted in the same aggregate and left out
    (``operators.unique`` lists such rows).

    One minimum and one maximum per model keep the buffers fixed-width, so this
    is a hash aggregate; the models at the extremes (ties: first name) are read
    off the aggregated row.
    """
    def at(kind: str, model: str) -> str:
        return f"_{kind}_{model}"

    mine = {m: F.when(F.col("model") == m, F.col("executors")) for m in MODELS}
    per = (compared.groupBy("workload_id")
           .agg(F.count("executors").alias("models"),
                F.greatest(*[F.count(F.when(F.col("model") == m, 1)) for m in MODELS]).alias("copies"),
                F.min("executors").alias("min_executors"),
                F.max("executors").alias("max_executors"),
                *[F.min(c).alias(at("min", m)) for m, c in mine.items()],
                *[F.max(c).alias(at("max", m)) for m, c in mine.items()]))

    def first_at(kind: str):
        return F.coalesce(*[F.when(F.col(at(kind, m)) == F.col(f"{kind}_executors"), F.lit(m)) for m in MODELS])

    per = per.where("copies = 1 AND models > 0").select("workload_id", "models", "min_executors", "max_executors",
                     first_at("min").alias("min_model"), first_at("max").alias("max_model"),
                     F.try_divide(F.col("max_executors").cast("double"), F.col("min_executors")).alias("spread_ratio"))
    return per.orderBy(F.col("spread_ratio").desc_nulls_last(), F.col("workload_id")).limit(k)
