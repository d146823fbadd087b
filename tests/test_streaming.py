"""Structured Streaming: plans of a workload stream equal the batch plans."""

import uuid

from pyspark.sql import functions as F

from paths import SF_SMALL
from rightsize.operators import waves as W
from rightsize.session import scratch_path
from rightsize.sources.fixtures import fixture
from rightsize.streaming import fleet_stream as S


def test_stream_plans_equal_batch(spark):
    base = scratch_path(spark, f"stream-{uuid.uuid4().hex}")
    src, out, ckpt, ckpt2 = (f"{base}/{p}" for p in ("in", "out", "ckpt", "ckpt2"))
    wl = fixture(spark, SF_SMALL, "workloads")
    wl.repartition(4).write.parquet(src)          # four files -> several micro-batches
    stream = S.read_workload_stream(spark, src, wl.schema, max_files_per_trigger=1)
    q = S.write_plans_stream(S.plan_stream(stream), out, ckpt)
    q.awaitTermination(240)
    got = spark.read.parquet(out)
    assert got.count() == wl.count()
    batch = W.wave_validate(wl)
    assert got.where(F.col("reject_reason").isNull()).count() == batch.where(F.col("reject_reason").isNull()).count()
    assert (got.agg(F.sum("executors")).first()[0] == batch.agg(F.sum("executors")).first()[0])

    seen = {}

    def sink(df, _):
        for r in df.collect():
            seen[r.team] = r.executors

    q2 = S.write_demand_stream(S.demand_by_team(S.plan_stream(
        S.read_workload_stream(spark, src, wl.schema, max_files_per_trigger=1))), ckpt2, sink)
    q2.awaitTermination(240)
    want = {r.team: r.executors for r in W.wave_fleet(batch).where("team IS NOT NULL AND sla_seconds IS NULL").collect()}
    assert seen == want
