"""Continuous periods and gaps of time intervals, as run-compressed bitmaps.

Time is discretised into whole milliseconds. The bitmap of one (entity, time shard) is kept run-compressed: a row per
set run. An interval belongs to the shard of its start and is never exploded over the shards it crosses; what reaches
beyond a shard is carried to the later ones by a running maximum over one summary row per occupied shard. So no task
holds all intervals of an entity: a hot entity spreads over its shards, and its serial part has a row per shard.

Defined results: intervals with a null, NaN or infinite end or an end not after the start (in milliseconds) hold no
unit and are dropped, as are rows without an entity; copies of an interval count once; an empty input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

SHARD_MS = 600_000


def set_runs(intervals: DataFrame, keys: list[str], shard_ms: int = SHARD_MS) -> DataFrame:
    """Set runs of each (entity, shard) bitmap: keys, shard, run_start, run_end, n_intervals (different ones).

    `intervals` has the keys, start_ms and end_ms. Runs start in their shard and may end beyond it.
    """
    usable = intervals.where(F.col("start_ms").isNotNull() & (F.col("end_ms") > F.col("start_ms")))
    for k in keys:
        usable = usable.where(F.col(k).isNotNull())
    units = usable.select(*keys, F.floor(F.col("start_ms") / shard_ms).cast("bigint").alias("shard"), "start_ms", "end_ms").distinct()
    by_shard = W.partitionBy(*keys, "shard").orderBy("start_ms", "end_ms")
    before = by_shard.rowsBetween(W.unboundedPreceding, -1)
    opened = units.withColumn("_cover", F.max("end_ms").over(before))
    opened = opened.withColumn("_open", F.when(F.col("_cover").isNull() | (F.col("start_ms") > F.col("_cover")), F.col("start_ms")))
    opened = opened.withColumn("run_start", F.last("_open", ignorenulls=True).over(by_shard.rowsBetween(W.unboundedPreceding, 0)))
    return opened.groupBy(*keys, "shard", "run_start").agg(F.max("end_ms").alias("run_end"), F.count(F.lit(1)).alias("n_intervals"))


def union_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Joins the shards' runs over shard borders: each run with `covered_ms` (where the time covered before it ends,
    null at an entity's first run), `opens` (a period starts here) and `period_start`."""
    before = W.partitionBy(*keys).orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    reach = runs.groupBy(*keys, "shard").agg(F.max("run_end").alias("_reach"))
    reach = reach.withColumn("_carry", F.max("_reach").over(before)).drop("_reach")
    by_shard = W.partitionBy(*keys, "shard").orderBy("run_start")
    joined = runs.join(reach, [*keys, "shard"])
    joined = joined.withColumn("covered_ms", F.greatest(F.lag("run_end").over(by_shard), F.col("_carry"))).drop("_carry")
    # inside a shard runs are disjoint, so what covers a run's start is the run before it or an earlier shard's reach
    joined = joined.withColumn("covered_ms", F.greatest(F.col("covered_ms"), F.max("covered_ms").over(by_shard)))
    joined = joined.withColumn("opens", F.col("covered_ms").isNull() | (F.col("run_start") > F.col("covered_ms")))
    joined = joined.withColumn("_open", F.last(F.when(F.col("opens"), F.col("run_start")), ignorenulls=True).over(by_shard))
    last = joined.groupBy(*keys, "shard").agg(F.max("_open").alias("_opened"))
    last = last.withColumn("_before", F.max("_opened").over(before)).drop("_opened")
    return joined.join(last, [*keys, "shard"]).withColumn("period_start", F.coalesce("_open", "_before")).drop("_open", "_before")


def periods(intervals: DataFrame, keys: list[str], shard_ms: int = SHARD_MS) -> DataFrame:
    """The set runs over all shards: keys, start_ms, end_ms, n_intervals of each continuous period."""
    runs = union_runs(set_runs(intervals, keys, shard_ms), keys)
    return runs.groupBy(*keys, F.col("period_start").alias("start_ms")).agg(F.max("run_end").alias("end_ms"), F.sum("n_intervals").alias("n_intervals"))


def periods_and_gaps(intervals: DataFrame, keys: list[str], shard_ms: int = SHARD_MS) -> DataFrame:
    """Periods (kind `period`) and the clear runs between them (kind `gap`, n_intervals 0) in one pass over the runs."""
    runs = union_runs(set_runs(intervals, keys, shard_ms), keys)
    own = F.struct(F.lit("period").alias("kind"), F.col("period_start").alias("start_ms"), F.col("run_end").alias("end_ms"), F.col("n_intervals"))
    gap = F.struct(F.lit("gap").alias("kind"), F.col("covered_ms").alias("start_ms"), F.col("run_start").alias("end_ms"), F.lit(0).cast("bigint").alias("n_intervals"))
    rows = runs.select(*keys, F.inline(F.when(F.col("opens") & F.col("covered_ms").isNotNull(), F.array(own, gap)).otherwise(F.array(own))))
    return rows.groupBy(*keys, "kind", "start_ms").agg(F.max("end_ms").alias("end_ms"), F.sum("n_intervals").alias("n_intervals"))
