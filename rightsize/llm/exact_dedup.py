"""Exact dedup by distributed MSD radix partitioning.

Documents, without the characters between words, are split by their first
digit (the next bytes), groups of two or more by the next digit, and so on
until a group is a single document or its documents have ended. Digits grow
with the depth, so that a text of n bytes takes about log(n) rounds. A round
counts documents by (group, digit) with map-side combination, and a join hands
the new group back. The counts are a table of their own, one row per group
however large it is, so both sides of the merge join are plain exchanges, which
is what lets adaptive execution split the rows of a group with a third of them
over tasks (it cannot where an aggregate sits between exchange and join). The
join is a merge join at every size. Equality is that of all bytes; no digest
takes part in it. Of a digit only the rows still in a group are carried on, with
the rest of their text, in a table of the shared folder.

Of equal texts stays the row with the most code points in the original text,
then with the smallest doc_id (null last), then any one of repeated rows.
Defined results: a null text counts as empty, so null, empty and blank texts
are one group; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rightsize.llm.common import SPACES, Tables, doc_key, packed, unpacked

FIRST, GROWTH = 64, 8


def normalised(text: Column) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), SPACES, F.coalesce(text, F.lit("")))


def equal_texts(docs: DataFrame, tables: Tables | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: key, doc_id, keep_id,
    group_size, kept, text_sha256 (of the normalised text)."""
    tables = tables or Tables(docs.sparkSession)
    text = docs.select(doc_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.char_length("text"), F.lit(0)).alias("points"), normalised(F.col("text")).cast("binary").alias("rest"))
    text = text.withColumn("text_sha256", F.sha2("rest", 256)).withColumn("digit", F.substring("rest", 1, FIRST))
    often = tables.save(text.groupBy("digit").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "count-0")
    first = text.join(often.hint("merge"), "digit", "left").select(
        F.monotonically_increasing_id().alias("row"), "key", "doc_id", "points", "text_sha256", "n",
        F.when(F.col("n").isNotNull(), F.col("digit")).alias("group"),
        F.when(F.col("n").isNotNull(), F.substring("rest", FIRST + 1, 2**31 - 1)).alias("rest"),
    )
    kept = ["row", "key", "doc_id", "points", "text_sha256"]
    first = tables.save(first, "digit-0")
    single = first.filter("n is null").select(*kept)
    left = first.filter("n is not null").select(*kept, "group", "rest")
    # documents that ended inside their first digit are equal already
    ended = [left.filter(F.length("group") < FIRST).select(*kept, F.concat(F.lit("0-").cast("binary"), "group").alias("group"))]
    left, width, level = left.filter(F.length("group") == FIRST), FIRST, 1
    while not left.isEmpty():
        width *= GROWTH
        cut = left.withColumn("digit", F.substring("rest", 1, width))
        groups = tables.save(cut.groupBy("group", "digit").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("least")), f"count-{level}")
        split = cut.join(groups.hint("merge"), ["group", "digit"]).select(
            *kept, F.when(F.col("n") > 1, F.col("least").cast("string").cast("binary")).alias("group"),
            (F.length("digit") < width).alias("over"), F.when((F.col("n") > 1) & (F.length("digit") == width), F.substring("rest", width + 1, 2**31 - 1)).alias("rest"),
        )
        split = tables.save(split, f"digit-{level}")
        single = single.unionByName(split.filter("`group` is null").select(*kept))
        ended.append(split.filter("`group` is not null and over").select(*kept, "group").withColumn("group", F.concat(F.lit(f"{level}-").cast("binary"), "group")))
        left = split.filter("`group` is not null and not over").select(*kept, "group", "rest")
        level += 1
    equal = reduce(DataFrame.unionByName, ended)
    best = equal.groupBy("group").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct(F.col("points"), (-F.col("key")).alias("key"), F.col("row"), F.col("doc_id"))).alias("best"))
    best = tables.save(best, "best")
    out = ["key", "doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    grouped = equal.join(best, "group").withColumn("keep_id", F.col("best.doc_id")).withColumn("kept", F.col("row") == F.col("best.row"))
    alone = single.withColumn("keep_id", F.col("doc_id")).withColumn("group_size", F.lit(1).cast("long")).withColumn("kept", F.lit(True))
    return alone.select(*out).unionByName(grouped.select(*out))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Rows of one
    doc_id with equal texts stay once, the longest original first; with
    different texts each is a document of its own."""
    kept = equal_texts(docs).filter("kept").select("key", "text_sha256")
    rows = packed(docs)
    twice = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = rows.join(twice, "key", "left")
    once = rows.filter("n is null").join(kept.select("key").distinct(), "key", "left_semi")
    text = F.col("row").getField("text")
    more = rows.filter("n is not null").withColumn("text_sha256", F.sha2(normalised(text).cast("binary"), 256)).join(kept.distinct(), ["key", "text_sha256"], "left_semi")
    order = Window.partitionBy("key", "text_sha256").orderBy(F.char_length(text).desc_nulls_last(), text)
    more = more.withColumn("turn", F.row_number().over(order)).filter("turn = 1")
    return unpacked(once.select("row").unionByName(more.select("row")), docs.columns)
