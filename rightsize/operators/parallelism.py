"""Tasks that ran at once: a sweep over launch and finish events.

An attempt occupies a slot from its launch up to, not including, its finish.
Events are the changes of the running count. One exchange deals them by
(application, time range); there they are summed per instant. The prefix sum
over an application's instants is split by these ranges: a range's own running
sum starts from what the ranges before it add up to, so an application with a
third of all tasks is dealt over its ranges and no task holds more than one
range's instants; only one row per range meets in the window that carries the
sums over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rightsize.functions.numeric import safe_div


def running_counts(tasks: DataFrame, range_ms: int) -> DataFrame:
    """(app_id, at_ms, until_ms, running): steps of the number of running
    attempts, one per instant at which it may change."""
    spans = tasks.where("launch_ms IS NOT NULL AND duration_ms > 0")
    kind = dict(tasks.dtypes)["app_id"]
    event = F.explode(F.array(F.struct(F.col("launch_ms").alias("at_ms"), F.lit(1).cast("bigint").alias("step")),
                              F.struct((F.col("launch_ms") + F.col("duration_ms")).alias("at_ms"), F.lit(-1).cast("bigint").alias("step"))))
    # a null application is one too: null-free keys keep the dealing through the join below
    app, none, part = F.coalesce("app_id", F.lit("0").cast(kind)), F.col("app_id").isNull(), F.expr(f"coalesce(CAST(floor(at_ms / {range_ms}) AS BIGINT), 0L)")
    events = spans.select(app.alias("app"), none.alias("no_app"), event.alias("e")).select("app", "no_app", "e.at_ms", "e.step")
    of = ["app", "no_app", "part"]
    steps = (events.repartition("app", "no_app", part).withColumn("part", part)
             .groupBy(*of, "at_ms").agg(F.sum("step").alias("step")))
    inside = Window.partitionBy(*of).orderBy("at_ms")
    local = (steps.withColumn("own", F.sum("step").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
             .withColumn("next_ms", F.lead("at_ms").over(inside)).drop("step"))
    over = Window.partitionBy("app", "no_app").orderBy("part")
    ranges = (steps.groupBy(*of).agg(F.sum("step").alias("sum"), F.min("at_ms").alias("first_ms"))
              .select(*of, (F.sum("sum").over(over.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("sum")).alias("before"),
                      F.lead("first_ms").over(over).alias("following_ms")))
    return local.join(ranges, of).select(F.when(~F.col("no_app"), F.col("app")).alias("app_id"), "at_ms", F.coalesce("next_ms", "following_ms").alias("until_ms"),
                                         (F.col("own") + F.col("before")).alias("running"))


def parallelism(tasks: DataFrame, range_ms: int = 600_000) -> DataFrame:
    """One row per application: the most attempts that ran at once, the time
    with any running, and the mean number running in that time. Attempts
    without a launch time or of no duration occupy no slot. ``range_ms`` deals
    the work and does not change the result."""
    held = F.col("until_ms") - F.col("at_ms")
    per = (running_counts(tasks, range_ms).groupBy("app_id")
           .agg(F.max("running").alias("peak_tasks"), F.sum(F.when(F.col("running") > 0, held)).alias("busy_ms"),
                F.sum(F.when(F.col("running") > 0, held * F.col("running"))).alias("task_ms")))
    return per.withColumn("mean_tasks", safe_div(F.col("task_ms"), F.col("busy_ms")))
