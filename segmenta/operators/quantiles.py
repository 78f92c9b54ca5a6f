"""Exact percentiles per key with linear interpolation, without gathering a key's values in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

#: Value ranges for each doubling of a value, in which values are ranked by themselves.
RANGES = 256


def value_range(v: Column) -> Column:
    """The range that a number lies in: an order of ranges whose widths are in proportion to their values, so that it takes
    no knowledge of the scale. NaN, which sorts last, lies in the last."""
    size = lambda x: F.floor(F.least(F.log2(x), F.lit(1100.0)) * RANGES)  # noqa: E731 - infinity lies beyond all others
    return F.when(F.isnan(v), 1 << 40).when(v > 0, (1 << 30) + size(v)).when(v < 0, -(1 << 30) - size(-v)).otherwise(0).cast("bigint")


def percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float], summary: bool = False) -> DataFrame:
    """keys and a column for each named share (0 to 1); with summary also mean and peak of the values, n_frames (rows with
    null values too) and hundredths (the exact sum of the values' rounded hundredths). Equal values are counted first, and
    that is the only shuffle of rows; ranks are running sums inside value ranges, whose totals come from a summary of one
    row per occupied range. Nulls don't count; without summary a key of nulls has no row, with it nulls for the shares."""
    v = F.col("_v")
    counts = (rows if summary else rows.where(F.col(value).isNotNull())).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_all"))
    counts = counts.withColumn("_c", F.when(v.isNull(), 0).otherwise(F.col("_all"))).withColumn("_shard", F.coalesce(value_range(v), F.lit(-(1 << 41))))
    inside = W.partitionBy(*keys, "_shard").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    ends = counts.groupBy(*keys, "_shard").agg(F.sum("_c").alias("_t"))
    across = W.partitionBy(*keys)
    ends = ends.withColumn("_offset", F.coalesce(F.sum("_t").over(across.orderBy("_shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("_n", F.sum("_t").over(across)).drop("_t")
    ranked = counts.withColumn("_in", F.sum("_c").over(inside)).join(ends, [*keys, "_shard"]).withColumn("_cum", F.col("_in") + F.col("_offset"))
    out = []
    for name, p in shares.items():
        at = (F.col("_n") - 1) * p
        low, high = (F.min(F.when((F.col("_c") > 0) & (F.col("_cum") > r(at)), v)) for r in (F.floor, F.ceil))
        part = F.max(at - F.floor(at))
        out.append((low + (high - low) * part).alias(name))
    if summary:
        out += [(F.sum(v * F.col("_c")) / F.sum("_c")).alias("mean"), F.max(v).alias("peak"), F.sum("_all").alias("n_frames"), F.sum(F.round(v * 100).cast("bigint") * F.col("_c")).alias("hundredths")]
    return ranked.groupBy(*keys).agg(*out)
