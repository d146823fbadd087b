"""Keys that must be unique (V): what repeats is counted once and split off.

One grouped count, combined map-side, so a key with a third of all rows ships a
row per mapper; the keys that repeat are then anti-joined (or joined) with the
rows. Spark broadcasts them where they are few and splits the skewed side
where they are not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def unique_rows(df: DataFrame, key: str) -> DataFrame:
    """The rows whose key occurs once. Rows without a key identify nothing and are left out."""
    return df.where(F.col(key).isNotNull()).join(repeated_keys(df, key), key, "left_anti")


def duplicate_rejects(df: DataFrame, key: str) -> DataFrame:
    """The rows ``unique_rows`` leaves out, with the copies of their key and a reason."""
    again = df.join(repeated_keys(df, key).where(F.col(key).isNotNull()), key, "inner").withColumn("reject_reason", F.lit("duplicate_key"))
    none = df.where(F.col(key).isNull()).withColumn("copies", F.lit(None).cast("bigint")).withColumn("reject_reason", F.lit("no_key"))
    return again.unionByName(none)
