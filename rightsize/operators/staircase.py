"""The first step of a staircase that is high enough, for every row.

The steps' heights, all different, are packed into sorted arrays: about
sqrt(steps) packs, cut at observed heights. The cuts, 1,023 at most, are a
constant of the plan; a row finds its pack by halving among them, meets that
one pack in an equi join, and finds its step by halving within it. A row is
joined with one pack whatever the heights' spread, so the work is linear in the
rows: millions of steps inside one power of two cost as much as spread ones.
A staircase of a few steps is itself a constant of the plan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_PACKS = 1024
FEW = 64


def first_not_below(heights: str, n: str, value: str) -> str:
    """SQL: how many of the first ``n`` entries of the sorted array ``heights``
    lie below ``value``, by halving."""
    middle = "shiftright(s.lo + s.hi, 1)"
    return f"""aggregate(sequence(1, CAST(ceil(log2(CAST(({n}) + 1 AS DOUBLE))) AS INT) + 1), named_struct('lo', 0, 'hi', CAST({n} AS INT)),
        (s, i) -> CASE WHEN s.lo >= s.hi THEN s
            WHEN element_at({heights}, {middle} + 1) < {value} THEN named_struct('lo', {middle} + 1, 'hi', s.hi)
            ELSE named_struct('lo', s.lo, 'hi', {middle}) END, s -> s.lo)"""


def _pack(value: str, cuts: list[float]) -> Column:
    """How many cuts lie below ``value``."""
    if not cuts:
        return F.when(F.col(value).isNotNull(), F.lit(0))
    held = "array(" + ",".join(f"{c!r}D" for c in cuts) + ")"
    return F.expr(f"CASE WHEN {value} IS NOT NULL THEN {first_not_below(held, str(len(cuts)), value)} END")


def first_step(rows: DataFrame, need: str, steps: DataFrame, height: str, found: str) -> DataFrame:
    """``rows`` with ``found``, the least ``height`` of ``steps`` that is no
    lower than ``need``; NULL where all are lower or ``need`` is NULL."""
    n = steps.count()
    if n <= FEW:  # a chain of comparisons stays in generated code
        known = sorted(float(r[0]) for r in steps.select(height).collect())
        chain = " ".join(f"WHEN {need} <= {h!r}D THEN {h!r}D" for h in known)
        return rows.withColumn(found, F.expr(f"CASE {chain} END") if known else F.lit(None).cast("double"))
    packs = min(MOST_PACKS, math.isqrt(max(n, 1)))
    cuts: list[float] = []
    if packs > 1:
        at = [i / packs for i in range(1, packs)]
        cuts = sorted({float(c) for c in steps.agg(F.percentile_approx(F.col(height).cast("double"), at, 100 * packs)).first()[0]})
    held = (steps.select(F.col(height).cast("double").alias("h")).withColumn("pack", _pack("h", cuts))
            .groupBy("pack").agg(F.sort_array(F.collect_list("h")).alias("heights")))
    placed = rows.withColumn("pack", _pack(need, cuts)).join(held, "pack", "left")
    at = F.expr(first_not_below("heights", "size(heights)", need))
    return placed.withColumn(found, F.when(F.col("heights").isNotNull() & F.col(need).isNotNull(), F.get("heights", at))).drop("pack", "heights")
