"""Mixing sources to target weights by entropy balancing, with DataFrame and
SQL functions only.

The rates r minimise the relative entropy ``sum size * (r log(r / q) - r)`` to
the prior rates q, under one token constraint per source, ``sum size * r =
target``, and ``r <= cap``. The convex dual has one multiplier per source, and
its solution tilts every document's rate exponentially, ``r = min(cap, q *
exp(multiplier))``. Newton's method solves it: an iteration is one pass that
sums gradient and curvature by source, combined before the shuffle, so that a
source with a third of all rows is one row per task.

Rates become whole copies by ``floor(r + u + shift)``, with u uniform from a
hash of the document and one shift per source. The words taken grow with the
shift, so a few passes, each over a grid of shifts, find the one that comes
nearest to the target. Two last passes give or take one copy of the document
whose size is nearest to what a source still lacks or has too much.

Defined results: a null text has size 0 and takes nothing; null sources are one
source, the last; a source without words has target 0; repeated rows are drawn
alike; other columns are not read; an empty table gives no rows. A source comes
as near its target as whole copies of its documents can.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rightsize.llm.common import Tables, doc_key, packed, unpacked

WORD = r"[^\x20\x09-\x0D]+"
GRID = 32
PARTS = 64


def targets(sizes: DataFrame, cap: float, cycle: int) -> DataFrame:
    """source, number, source_size, target of each source of ``sizes(source,
    source_size)``: weights 1 to ``cycle``, repeating, share all words; what
    exceeds ``cap`` times a source's size is shared by weight among the rest.
    The windows run over one row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "number").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("ratio", "number").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbered = sizes.withColumn("number", F.row_number().over(by_name)).withColumn("weight", (F.col("number") - 1) % cycle + 1)
    level = (
        numbered.withColumn("most", cap * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("per_weight", (F.col("total") - F.coalesce(F.sum("most").over(by_ratio), F.lit(0.0))) / F.sum("weight").over(rest))
        # the sources are filled in order of ratio until the first that stays below its cap
        .withColumn("share", F.max(F.when(F.col("per_weight") <= F.col("ratio"), F.col("per_weight"))).over(every))
    )
    return level.select("source", "number", "source_size", F.least("most", F.col("weight") * F.coalesce("share", F.lit(float("inf")))).alias("target"))


def with_source(rows: DataFrame, by_source: DataFrame, how: str = "inner") -> DataFrame:
    """``rows(number, key, ...)`` with the columns of ``by_source(number, ...)``,
    a table. Spark broadcasts it while it measures small. Beyond that the join
    deals each source over ``PARTS`` parts, so a source with a third of all rows
    is not one task, and a later aggregate by source combines within the parts."""
    spread = by_source.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    part = F.pmod(F.xxhash64("key", F.lit("part")), F.lit(PARTS)).cast("int")
    return rows.withColumn("__part", part).join(spread, ["number", "__part"], how).drop("__part")


def balance(sized: DataFrame, wanted: DataFrame, tables: Tables, cap: float, rounds: int = 40, near: float = 1e-10) -> DataFrame:
    """number, multiplier of each source: Newton's method on the dual, over
    ``sized(number, key, size, prior)`` and ``wanted(number, target)``."""
    state = tables.save(wanted.select("number", "target", F.lit(0.0).alias("multiplier"), F.lit(False).alias("done")), "dual-0")
    for turn in range(1, rounds + 1):
        rate = F.col("prior") * F.exp("multiplier")
        sums = with_source(sized, state.select("number", "multiplier")).groupBy("number").agg(
            F.sum(F.col("size") * F.least(rate, F.lit(cap))).alias("tokens"), F.sum(F.when(rate < cap, F.col("size") * rate).otherwise(0.0)).alias("curve")
        )
        gap = F.col("target") - F.coalesce("tokens", F.lit(0.0))
        step = F.when(F.col("curve") > 0, gap / F.col("curve")).otherwise(F.signum(gap))
        after = state.join(sums, "number", "left").select(
            "number", "target", (F.abs(gap) <= near * F.col("target")).alias("done"),
            F.when(F.abs(gap) <= near * F.col("target"), F.col("multiplier")).otherwise(F.col("multiplier") + F.greatest(F.lit(-2.0), F.least(F.lit(2.0), step))).alias("multiplier"),
        )
        before, state = state, tables.save(after.select("number", "target", "multiplier", "done"), f"dual-{turn}")
        tables.drop(f"dual-{turn - 1}")
        del before
        if state.filter("not done").isEmpty():
            break
    return state.select("number", "multiplier")


def copies_of(rate: Column, u: Column, shift: Column, cap: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(float(cap)), F.floor(rate + u + shift).cast("double")))


def round_to_copies(rated: DataFrame, wanted: DataFrame, tables: Tables, cap: float, rounds: int = 5) -> DataFrame:
    """number, shift of each source: the shift at which the copies of
    ``rated(number, key, size, rate, u)`` come nearest to the target."""
    state = tables.save(wanted.select("number", "target", F.lit(-1.0).alias("low"), F.lit(1.0).alias("high")), "shift-0")
    points = [F.col("low") + (F.col("high") - F.col("low")) * (k / GRID) for k in range(GRID + 1)]
    for turn in range(1, rounds + 1):
        taken = [F.sum(F.col("size") * copies_of(F.col("rate"), F.col("u"), p, cap)).alias(f"t{k}") for k, p in enumerate(points)]
        sums = with_source(rated, state.select("number", "low", "high")).groupBy("number").agg(*taken)
        joined = state.join(sums, "number")
        # the last point that takes no more than the target, and the next one
        below = sum((F.when(F.col(f"t{k}") <= F.col("target"), 1).otherwise(0) for k in range(1, GRID)), F.lit(0))
        width = (F.col("high") - F.col("low")) / GRID
        if turn < rounds:
            new = joined.select("number", "target", (F.col("low") + below * width).alias("low"), (F.col("low") + (below + 1) * width).alias("high"))
        else:
            gaps = [F.abs(F.col(f"t{k}") - F.col("target")) for k in range(GRID + 1)]
            best = F.array_min(F.array(*(F.struct(g.alias("gap"), p.alias("shift")) for g, p in zip(gaps, points))))
            new = joined.select("number", best["shift"].alias("shift"))
        state = tables.save(new, f"shift-{turn}")
        tables.drop(f"shift-{turn - 1}")
    return state


def settle(placed: DataFrame, tables: Tables, name: str, cap: float) -> DataFrame:
    """``placed(number, key, size, copies, target, ...)`` with one copy more or
    less, in each source, of the document that brings it nearest to its target."""
    gap = tables.save(placed.groupBy("number").agg((F.first("target") - F.sum(F.col("size") * F.col("copies"))).alias("gap")), f"{name}-gap")
    joined = with_source(placed.select("number", "key", "size", "copies"), gap)
    fits = F.when(F.col("gap") > 0, F.col("copies") < cap).otherwise(F.col("copies") > 0)
    miss = F.abs(F.abs("gap") - F.col("size"))
    best = joined.filter(fits & (miss < F.abs("gap"))).groupBy("number").agg(F.min(F.struct(miss.alias("miss"), F.col("key"), F.signum("gap").alias("add"))).alias("best"))
    best = tables.save(best.select("number", F.col("best.key").alias("__key"), F.col("best.add").alias("add")), f"{name}-best")
    add = F.when(F.col("key") == F.col("__key"), F.col("add")).otherwise(0.0)
    return with_source(placed, best, "left").withColumn("copies", F.col("copies") + F.coalesce(add, F.lit(0.0))).drop("__key", "add")


def mix(docs: DataFrame, cap: int = 3, cycle: int = 3, prior: Column | None = None) -> DataFrame:
    """key, doc_id, source, size, source_size, target, rate, copies, taken of
    every row of ``docs(doc_id, text, source)``. ``prior``: a document's rate
    before balancing (1 by default), a positive number from its columns."""
    tables = Tables(docs.sparkSession)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    read = docs.select(doc_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"), (F.lit(1.0) if prior is None else prior).alias("prior"))
    read = tables.save(read, "sizes")
    wanted = tables.save(targets(read.groupBy("source").agg(F.sum("size").alias("source_size")), float(cap), cycle), "targets")
    same = wanted.withColumnRenamed("source", "__source")
    sized = tables.save(read.join(same, F.col("source").eqNullSafe(F.col("__source"))).drop("__source"), "numbered")
    tables.drop("sizes")
    dual = balance(sized, wanted, tables, float(cap))
    u = F.shiftrightunsigned(F.xxhash64("key", F.lit("copies")), 11) / F.lit(float(2**53))
    rate = F.least(F.lit(float(cap)), F.col("prior") * F.exp("multiplier"))
    rated = tables.save(with_source(sized, dual).withColumn("rate", rate).withColumn("u", u).drop("multiplier", "prior"), "rated")
    tables.drop("numbered")
    shift = round_to_copies(rated, wanted, tables, float(cap))
    placed = with_source(rated, shift).withColumn("copies", copies_of(F.col("rate"), F.col("u"), F.col("shift"), cap)).drop("u", "shift")
    for turn in range(2):
        placed = tables.save(settle(placed, tables, f"settle-{turn}", float(cap)), f"copies-{turn}")
    out = placed.withColumn("copies", F.col("copies").cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select("key", "doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken")


def repeat_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: every row of ``docs`` as many times as it has copies, with all its columns."""
    copies = mix(docs).filter("copies > 0").groupBy("key").agg(F.max("copies").alias("copies"))
    spread = packed(docs).join(copies, "key").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return unpacked(spread, docs.columns)
