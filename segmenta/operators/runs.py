"""Runs of equal values in an ordered sequence per entity, without holding an entity in one task.

Rows are split by (entity, shard) where shards follow the order. Runs are found inside each shard and joined over shard
borders with one summary row per occupied shard, so the serial part of a hot entity has a row per shard.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F


def value_runs(rows: DataFrame, keys: list[str], shard: str, order: list[str], value: str, same: Column | None = None, carry: list[str] | None = None, more: dict[str, tuple[Column, Callable[[Column], Column]]] | None = None) -> DataFrame:
    """keys, value, head (struct of the order columns of a run's first row) and n_rows of each longest run.

    `order` must be a total order that agrees with the order of the shards. Rows that repeat the whole order (a
    redelivery) count once. `same`, if given, further tells whether a row goes on with the row before it; it may use the
    row's order, value and `carry` columns and `_prev`, the struct of those of the row before, over shard borders too.
    `more` gives further columns of a run: an aggregate over its part in one shard, and how its parts are made one."""
    carry, more = carry or [], more or {}
    fields = [*order, value, *(c for c in carry if c not in order and c != value)]
    inside = W.partitionBy(*keys, shard).orderBy(*order)
    across = W.partitionBy(*keys).orderBy(shard)
    own = F.struct(*fields)
    marked = rows.withColumn("_prev", F.lag(own).over(inside))
    repeat = F.lit(True)
    for c in order:
        repeat = repeat & F.col("_prev")[c].eqNullSafe(F.col(c))
    marked = marked.where(F.col("_prev").isNull() | ~repeat)
    goes_on = F.col("_prev").isNotNull() & F.col("_prev")[value].eqNullSafe(F.col(value))
    if same is not None:
        goes_on = goes_on & F.coalesce(same, F.lit(False))
    marked = marked.withColumn("_run", F.sum(F.when(goes_on, 0).otherwise(1)).over(inside.rowsBetween(W.unboundedPreceding, 0)))
    place = F.struct(*order)
    local = marked.groupBy(*keys, shard, "_run").agg(F.min(place).alias("head"), F.first(value).alias(value), F.count(F.lit(1)).alias("n_rows"), F.min_by(own, place).alias("_f"), F.max_by(own, place).alias("_l"), *(part.alias(name) for name, (part, _) in more.items()))
    ends = local.groupBy(*keys, shard).agg(F.min_by("_f", "_run").alias("_first"), F.max_by("_l", "_run").alias("_last"), F.max("_run").alias("_runs"))
    local = local.drop("_f", "_l")
    ends = ends.select(*keys, shard, "_runs", F.lag("_last").over(across).alias("_prev"), *(F.col("_first")[c].alias(c) for c in fields))
    ends = ends.withColumn("_on", goes_on)
    # the run that is open at a shard's end began in the last shard that has a border in it
    ends = ends.withColumn("_open", F.last(F.when((F.col("_runs") > 1) | ~F.col("_on"), F.struct(F.col(shard).alias("s"), F.col("_runs").alias("r"))), ignorenulls=True).over(across.rowsBetween(W.unboundedPreceding, 0)))
    ends = ends.withColumn("_owner", F.when(F.col("_on"), F.lag("_open").over(across))).select(*keys, shard, "_owner")
    joined = local.join(ends, [*keys, shard])
    owner = F.when(F.col("_run") == 1, F.col("_owner"))
    joined = joined.withColumn("_s", F.coalesce(owner["s"], F.col(shard))).withColumn("_r", F.coalesce(owner["r"], F.col("_run")))
    whole = [join(F.col(name)).alias(name) for name, (_, join) in more.items()]
    return joined.groupBy(*keys, "_s", "_r").agg(F.min("head").alias("head"), F.first(value).alias(value), F.sum("n_rows").alias("n_rows"), *whole).drop("_s", "_r")
