"""Exact medians by distributed selection, and mergeable sketches beside them.

``exact_median`` holds no group's values anywhere. One exchange deals the values
over tasks by (keys, value div ``width``, lane of the value), and two passes read it:

1. a histogram of (keys, value div ``width``, lane); a running count over a
   group's buckets tells which bucket holds the middle ranks, and in which lanes;
2. the values of that bucket alone (two buckets where the middle ranks fall
   into neighbours), counted by value, at most ``width`` of them. The chosen
   buckets go to the lanes that hold values of theirs, the values stay where
   they are.

So a group with a third of all rows is work of every mapper and of as many tasks
as it has buckets and lanes; what one task sees of it besides is a row per
bucket and lane, then a row per distinct value of the chosen bucket.

``duration_sketches`` are KLL sketches a day, to be stored; ``merge_sketches``
adds days (or anything else) up without the tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Normalised rank error of a KLL sketch of size k (quantile queries, 99 % confidence): 2.446 / k ** 0.9433.
SKETCH_K = 1000


def sketch_error(k: int = SKETCH_K) -> float:
    return 2.446 / k ** 0.9433


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi join that also pairs null keys (a null application is a group too); one set of keys stays."""
    cond = reduce(Column.__and__, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
    joined = left.alias("l").join(right.alias("r"), cond, how)
    if how in ("left_semi", "left_anti"):
        return joined
    return joined.select("l.*", *[F.col(f"r.{c}") for c in right.columns if c not in keys])


def _bucket(value: str, width: int) -> Column:
    """value div width, rounded down, in whole numbers."""
    return F.expr(f"(`{value}` - pmod(`{value}`, {width})) div {width}")


def _group(keys: list[str]) -> list[str]:
    return [*keys, "null_keys"]


def _stand_in(kind: str) -> Column:
    return F.lit("1970-01-01" if kind.startswith(("date", "timestamp")) else "0").cast(kind)


def dealt(rows: DataFrame, keys: list[str], value: str, width: int, lanes: int) -> DataFrame:
    """(keys, null_keys, value, bucket, lane): the values dealt over tasks by all
    columns but the value. Keys are null-free, ``null_keys`` has a bit for each
    that was NULL; so a null key is a group too and plain equi joins need no
    other dealing. Whatever groups or joins by these columns adds no exchange,
    and every reader of it shares the one."""
    kinds = dict(rows.dtypes)
    marks = reduce(Column.__add__, [F.when(F.col(k).isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, k in enumerate(keys)])
    plain = (rows.where(F.col(value).isNotNull())
             .select(*[F.coalesce(F.col(k), _stand_in(kinds[k])).alias(k) for k in keys], marks.alias("null_keys"), value))
    zero = F.lit(0)
    bucket, lane = F.coalesce(_bucket(value, width), zero.cast("bigint")), F.coalesce(F.pmod(F.col(value), F.lit(lanes)).cast("int"), zero)
    return plain.repartition(*_group(keys), bucket, lane).withColumns({"bucket": bucket, "lane": lane})


def _with_nulls(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys as they were before ``dealt``."""
    own = [F.when(F.col("null_keys").bitwiseAND(1 << i) == 0, F.col(k)).alias(k) for i, k in enumerate(keys)]
    return df.select(*own, *[c for c in df.columns if c not in _group(keys)])


def _middle(held: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, null_keys, bucket, lane, before, low, high): the lanes that hold values of the middle buckets of ``dealt`` rows."""
    group = _group(keys)
    counted = held.groupBy(*group, "bucket", "lane").agg(F.count(F.lit(1)).alias("n")).repartition(*group)
    over = Window.partitionBy(*group)
    by_bucket, first = over.orderBy("bucket"), Window.unboundedPreceding
    placed = (counted.withColumn("before", F.coalesce(F.sum("n").over(by_bucket.rangeBetween(first, -1)), F.lit(0)))
              .withColumn("upto", F.sum("n").over(by_bucket.rangeBetween(first, Window.currentRow)))
              .withColumn("total", F.sum("n").over(over))
              .withColumn("low", F.expr("(total - 1) div 2")).withColumn("high", F.expr("total div 2")))
    return (placed.where("before <= high AND upto > low")
            .select(*group, "bucket", "lane", "before", "low", "high"))


LANES = 16


def middle_buckets(rows: DataFrame, keys: list[str], value: str, width: int) -> DataFrame:
    """(keys, bucket, before, low, high): the buckets that hold a group's middle
    ``low`` and ``high`` ranks (from 0), and how many values lie before each."""
    return _with_nulls(_middle(dealt(rows, keys, value, width, LANES), keys).drop("lane").distinct(), keys)


def _middle_values(rows: DataFrame, keys: list[str], value: str, width: int, lanes: int) -> DataFrame:
    held = dealt(rows, keys, value, width, lanes)
    at = [*_group(keys), "bucket", "lane"]
    # hashed: two rows a group and lane at most, and the values need no sort
    return (held.join(_middle(held, keys).hint("shuffle_hash"), at)
            .groupBy(*at, "before", "low", "high", F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n")))


def middle_values(rows: DataFrame, keys: list[str], value: str, width: int, lanes: int = LANES) -> DataFrame:
    """(keys, bucket, lane, before, low, high, value, n): the distinct values of
    the middle buckets. The join is dealt by the value's lane besides the key, so
    that a frequent group's bucket meets in ``lanes`` tasks; the grouping by
    value needs no exchange after it."""
    return _with_nulls(_middle_values(rows, keys, value, width, lanes), keys)


def exact_median(rows: DataFrame, keys: list[str], value: str, name: str, width: int = 4096) -> DataFrame:
    """(keys, ``name``): the median of the whole-number column ``value`` by
    group, the mean of the middle two for an even count. NULLs do not count; a
    group of NULLs has no row. Keys are numbers, text, dates or times."""
    # what is left of a group, twice ``width`` rows at most, meets once
    group = _group(keys)
    counts = _middle_values(rows.select(*keys, value), keys, value, width, LANES).repartition(*group)
    # cumulative counts within one bucket: a window of at most ``width`` rows
    at = F.sum("n").over(Window.partitionBy(*group, "bucket").orderBy("value")) + F.col("before")
    placed = counts.withColumn("upto", at).withColumn("from", F.col("upto") - F.col("n"))

    def of_rank(rank: str) -> Column:
        return F.min(F.when((F.col("from") <= F.col(rank)) & (F.col("upto") > F.col(rank)), F.col("value")))

    medians = placed.groupBy(*group).agg(of_rank("low").alias("low_value"), of_rank("high").alias("high_value"))
    return _with_nulls(medians.select(*group, ((F.col("low_value") + F.col("high_value")) / F.lit(2.0)).alias(name)), keys)


# ---- sketches ----------------------------------------------------------------

def duration_sketches(rows: DataFrame, keys: list[str], value: str, k: int = SKETCH_K) -> DataFrame:
    """(keys, n, sketch): one KLL sketch of ``value`` per group, of bounded size."""
    return (rows.where(F.col(value).isNotNull()).groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_bigint(F.col(value).cast("bigint"), F.lit(k)).alias("sketch")))


def merge_sketches(sketches: DataFrame, keys: list[str], k: int = SKETCH_K) -> DataFrame:
    """Stored sketches merged into coarser groups."""
    return (sketches.groupBy(*keys)
            .agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch", F.lit(k)).alias("sketch")))


def sketch_median(sketches: DataFrame, keys: list[str], name: str) -> DataFrame:
    return sketches.select(*keys, "n", F.kll_sketch_get_quantile_bigint("sketch", F.lit(0.5)).alias(name))


def rank_errors(rows: DataFrame, medians: DataFrame, keys: list[str], value: str, name: str, k: int = SKETCH_K) -> DataFrame:
    """(keys, n, rank_error, bound, within_bound): how far the median's rank in
    ``rows`` lies from one half, as a share of all rows. A value that repeats
    holds a range of ranks; the nearest counts."""
    placed = same_keys(rows.select(*keys, value).where(F.col(value).isNotNull()), medians.select(*keys, name), keys, "inner")
    ranks = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(value) < F.col(name), 1)).alias("below"),
                                      F.count(F.when(F.col(value) <= F.col(name), 1)).alias("upto"))
    error = F.greatest(F.lit(0.0), F.col("below") / F.col("n") - 0.5, F.lit(0.5) - F.col("upto") / F.col("n"))
    bound = F.lit(sketch_error(k))
    return ranks.select(*keys, "n", error.alias("rank_error"), bound.alias("bound"), (error <= bound).alias("within_bound"))
