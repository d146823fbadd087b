"""Least squares from telemetry: what a megabyte costs.

Task time is fitted as overhead + a * input + b * spilled + c * shuffled
megabytes, per application (or any keys). The fit needs fourteen sums of whole
numbers a group, its normal equations: a partial aggregate of fixed width on
every mapper, so a hot application ships one row per mapper and no task sees
its rows together. The three-by-three system is then solved in column
expressions on one row a group, without a library or a Python worker.

A measure that does not vary on its own within a group (never spilled, or
always the same share of another) has no coefficient of its own: its pivot
vanishes and it is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rightsize.functions.numeric import stage

MEASURES = ("input_bytes", "disk_spill_bytes", "shuffle_bytes")
TOLERANCE = "1e-9D"     # of a measure's own variation: below it, it does not vary by itself


def normal_equations(tasks: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, sums and sums of products of the successful tasks' megabytes
    (rounded) and milliseconds."""
    good = "NOT coalesce(failed, false) AND NOT coalesce(killed, false)" if {"failed", "killed"} <= set(tasks.columns) else "true"
    rows = tasks.where(good).selectExpr(*keys, "duration_ms AS y", *[f"(coalesce({m}, 0) + 524288) div 1048576 AS x{i}" for i, m in enumerate(MEASURES, 1)]).where("y IS NOT NULL")
    pairs = [(i, j) for i in (1, 2, 3) for j in range(i, 4)]
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("sy"), *[F.sum(f"x{i}").alias(f"s{i}") for i in (1, 2, 3)],
        *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in pairs],
        *[F.sum(F.col(f"x{i}") * F.col("y")).alias(f"s{i}y") for i in (1, 2, 3)])


def solve(sums: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, overhead_ms, input_ms, spill_ms, shuffle_ms per MB): elimination
    on the moments about the mean; a coefficient without a pivot is 0."""
    d = "CAST({} AS DOUBLE)".format
    cov = lambda i, j: f"{d(f's{i}{j}')} - {d(f's{i}')} * {d(f's{j}')} / {d('n')}"
    df = stage(sums, {f"c{i}{j}": cov(i, j) for i in (1, 2, 3) for j in range(i, 4)} | {f"g{i}": f"{d(f's{i}y')} - {d(f's{i}')} * {d('sy')} / {d('n')}" for i in (1, 2, 3)})
    inverse = lambda pivot, own: f"CASE WHEN {pivot} > {TOLERANCE} * greatest({own}, 1D) THEN 1D / ({pivot}) ELSE 0D END"
    df = stage(df, {"i1": inverse("c11", d("s11"))})
    df = stage(df, {"l2": "c12 * i1", "l3": "c13 * i1"})
    df = stage(df, {"d2": "c22 - l2 * c12", "e23": "c23 - l2 * c13", "h2": "g2 - l2 * g1", "f3": "c33 - l3 * c13", "q3": "g3 - l3 * g1"})
    df = stage(df, {"i2": inverse("d2", "c22")})
    df = stage(df, {"m3": "e23 * i2"})
    df = stage(df, {"d3": "f3 - m3 * e23", "h3": "q3 - m3 * h2"})
    df = stage(df, {"i3": inverse("d3", "c33")})
    df = stage(df, {"b3": "h3 * i3"})
    df = stage(df, {"b2": "(h2 - e23 * b3) * i2"})
    df = stage(df, {"b1": "(g1 - c12 * b2 - c13 * b3) * i1"})
    df = stage(df, {"b0": f"({d('sy')} - b1 * {d('s1')} - b2 * {d('s2')} - b3 * {d('s3')}) / {d('n')}"})
    return df.selectExpr(*keys, "n AS tasks", *[f"round({b}, 6) AS {name}" for b, name in zip(("b0", "b1", "b2", "b3"), ("overhead_ms", "input_ms_mb", "spill_ms_mb", "shuffle_ms_mb"))])


def fitted_rates(tasks: DataFrame, keys: list[str]) -> DataFrame:
    """The rates of the cost model read off the fit, per slot: MB/s of
    input, spill and shuffle, and the seconds a task takes besides. A
    coefficient that is not positive measures nothing: NULL."""
    fit = solve(normal_equations(tasks, keys), keys)
    rate = lambda c: f"CASE WHEN {c} > 0 THEN 1000D / {c} END"
    return fit.selectExpr("*", f"{rate('input_ms_mb')} AS cpu_throughput_mb_s_per_core", f"{rate('spill_ms_mb')} AS disk_throughput_mb_s_per_executor",
                          f"{rate('shuffle_ms_mb')} AS network_throughput_mb_s_per_executor", "CASE WHEN overhead_ms > 0 THEN overhead_ms / 1000D END AS task_overhead_s")
