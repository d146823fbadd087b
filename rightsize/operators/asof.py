"""As-of join: each row of the left side with the latest row of the right side
that is not later, by key.

Sort-merge: both sides are one relation, dealt by key and sorted once by
(key, time); a running ``last`` carries the right side's values forward. No
pairs are formed, so a key with many rows on both sides costs a sort, not a
product. The window's state is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, on: str, left_time: str, right_time: str, take: list[str]) -> DataFrame:
    """Every row of ``left`` with the columns ``take`` of the row of ``right``
    of equal ``on`` with the greatest ``right_time`` <= ``left_time`` (ties:
    the greatest ``take``); NULLs where there is none. A NULL key or time
    matches nothing."""
    kept = F.struct(*take)
    old = (right.where(F.col(on).isNotNull() & F.col(right_time).isNotNull())
           .select(F.col(on).alias("k"), F.col(right_time).alias("t"), F.lit(0).alias("side"), kept.alias("got")))
    new = left.select(F.col(on).alias("k"), F.col(left_time).alias("t"), F.lit(1).alias("side"), F.struct("*").alias("row"))
    both = old.unionByName(new, allowMissingColumns=True)
    upto = Window.partitionBy("k").orderBy("t", "side", "got").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = both.withColumn("found", F.last("got", ignorenulls=True).over(upto)).where("side = 1")
    known = F.col("k").isNotNull() & F.col("t").isNotNull()
    return carried.select("row.*", *[F.when(known, F.col("found")[c]).alias(c) for c in take])
