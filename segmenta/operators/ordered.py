"""Order inside an entity without gathering the entity in one task.

Rows carry a shard that follows the order. Windows run inside (entity, shard); what crosses a border (the neighbour row,
the number of rows before, a running sum) comes from a summary with one row per shard. So a hot entity spreads over its
shards, and its serial part has a row per shard.

Null keys form an entity of their own in windows but meet no summary, so rows with a null key are to be dropped before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F


def _borders(rows: DataFrame, keys: list[str], shard: str, order: list[str], own: Column) -> tuple[DataFrame, DataFrame]:
    inside = W.partitionBy(*keys, shard).orderBy(*order)
    local = rows.withColumn("_rn", F.row_number().over(inside)).withColumn("_prev", F.lag(own).over(inside)).withColumn("_next", F.lead(own).over(inside))
    ends = local.groupBy(*keys, shard).agg(F.count(F.lit(1)).alias("_n"), F.min_by(own, "_rn").alias("_first"), F.max_by(own, "_rn").alias("_last"))
    across = W.partitionBy(*keys).orderBy(shard)
    before = across.rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(*keys, shard, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.lag("_last").over(across).alias("_before"), F.lead("_first").over(across).alias("_after"))
    return local, ends


def sequenced(rows: DataFrame, keys: list[str], shard: str, order: list[str], carry: list[str]) -> DataFrame:
    """Adds idx (place in the entity, from 0) and prev and next (structs of the carried columns of the neighbours)."""
    local, ends = _borders(rows, keys, shard, order, F.struct(*carry))
    out = local.join(ends, [*keys, shard])
    out = out.withColumn("idx", F.col("_base") + F.col("_rn") - 1).withColumn("prev", F.coalesce("_prev", "_before")).withColumn("next", F.coalesce("_next", "_after"))
    return out.drop("_rn", "_prev", "_next", "_base", "_before", "_after")


def running(rows: DataFrame, keys: list[str], shard: str, order: list[str], amount: Column, out: str) -> DataFrame:
    """Adds the running sum of an amount in order, the row itself included."""
    inside = W.partitionBy(*keys, shard).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = rows.withColumn("_amount", amount)
    local = local.withColumn("_sum", F.sum("_amount").over(inside))
    ends = local.groupBy(*keys, shard).agg(F.sum("_amount").alias("_total"))
    before = W.partitionBy(*keys).orderBy(shard).rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(*keys, shard, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    return local.join(ends, [*keys, shard]).withColumn(out, F.col("_sum") + F.col("_offset")).drop("_amount", "_sum", "_offset")


def islands(rows: DataFrame, keys: list[str], shard: str, order: list[str], carry: list[str], opens: Column, out: str) -> DataFrame:
    """Adds idx, prev, next and the number (from 0) of the island of each row. `opens` may use the row and `prev`; the
    first row of an entity always opens one.

    Inside a shard islands are counted without its first row; whether that opens one is decided in the summary, where the
    row before it is known, so one summary serves neighbours, places and islands."""
    inside = W.partitionBy(*keys, shard).orderBy(*order)
    own, rest = F.struct(*carry), [c for c in rows.columns if c not in (*keys, shard)]
    local = rows.withColumn("_rn", F.row_number().over(inside)).withColumn("prev", F.lag(own).over(inside)).withColumn("next", F.lead(own).over(inside))
    flag = F.when((F.col("_rn") > 1) & F.coalesce(opens, F.lit(True)), 1).otherwise(0)
    local = local.withColumn("_open", F.sum(flag).over(inside.rowsBetween(W.unboundedPreceding, 0)))
    ends = local.groupBy(*keys, shard).agg(F.count(F.lit(1)).alias("_n"), F.max("_open").alias("_opened"), F.min_by(F.struct(*rest, own.alias("_own")), "_rn").alias("_first"), F.max_by(own, "_rn").alias("_last"))
    across = W.partitionBy(*keys).orderBy(shard)
    before = across.rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(*keys, shard, "_n", "_opened", F.lag("_last").over(across).alias("prev"), F.lead("_first._own").over(across).alias("_after"), *[F.col("_first")[c].alias(c) for c in rest])
    ends = ends.withColumn("_f", F.when(F.col("prev").isNull() | F.coalesce(opens, F.lit(True)), 1).otherwise(0))
    ends = ends.select(*keys, shard, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), (F.coalesce(F.sum(F.col("_opened") + F.col("_f")).over(before), F.lit(0)) + F.col("_f")).alias("_offset"), F.col("prev").alias("_before"), "_after")
    joined = local.join(ends, [*keys, shard])
    joined = joined.withColumn("idx", F.col("_base") + F.col("_rn") - 1).withColumn("prev", F.coalesce("prev", "_before")).withColumn("next", F.coalesce("next", "_after"))
    return joined.withColumn(out, F.col("_open") + F.col("_offset") - 1).drop("_rn", "_open", "_base", "_offset", "_before", "_after")


def neighbourhood(rows: DataFrame, keys: list[str], idx: str, before: int, after: int, block: int = 50_000) -> tuple[DataFrame, W]:
    """Rows with a block number such that a window over (keys, block) by idx sees `before` rows back and `after` rows
    ahead of each row that is not a `halo`: rows near a block's border are sent to the next block too."""
    at, b = F.pmod(F.col(idx), F.lit(block)), F.floor(F.col(idx) / block).cast("bigint")
    copies = F.array(F.struct(b.alias("block"), F.lit(False).alias("halo")))
    copies = F.concat(copies, F.when(at >= block - before, F.array(F.struct((b + 1).alias("block"), F.lit(True).alias("halo")))).otherwise(F.array()))
    copies = F.concat(copies, F.when(at < after, F.array(F.struct((b - 1).alias("block"), F.lit(True).alias("halo")))).otherwise(F.array()))
    out = rows.select("*", F.inline(copies))
    return out, W.partitionBy(*keys, "block").orderBy(idx)


def beside(rows: DataFrame, dim: DataFrame, keys: list[str], shard: str, how: str = "left") -> DataFrame:
    """Rows with the columns of `dim`, which has one row per key. A hot key isn't sent to one task: dim meets the occupied
    shards, of which there are few, and rows join by (key, shard). `how` is left or inner."""
    cells = rows.select(*keys, shard).distinct().join(dim, keys)
    return rows.join(cells, [*keys, shard], how)
