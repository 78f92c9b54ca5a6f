"""Joins by time: points in spans, spans that overlap. Spans are cut into bins so that the join has an equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bins(start: Column, end: Column, width: int) -> Column:
    """The bins that [start, end) touches."""
    return F.sequence(F.floor(start / width).cast("bigint"), F.floor(F.greatest(start, end - 1) / width).cast("bigint"))


def points_in_spans(points: DataFrame, spans: DataFrame, keys: list[str], point: str, start: str, end: str, width: int) -> DataFrame:
    """Each point with each span of its key that contains it: start <= point < end."""
    left = points.withColumn("_bin", F.floor(F.col(point) / width).cast("bigint"))
    right = spans.withColumn("_bin", F.explode(bins(F.col(start), F.col(end), width)))
    return left.join(right, [*keys, "_bin"]).where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))).drop("_bin")


def best_span(left: DataFrame, right: DataFrame, keys: list[str], left_id: list[str], label: str, width: int) -> DataFrame:
    """For each left span [ls, le) the right span [rs, re) (with its order ro) that contains its middle, the first such;
    else the one it overlaps most, the earlier of equals; null without any. A left outer join that keeps every left row.
    """
    a = left.withColumn("_bin", F.explode(bins(F.col("ls"), F.col("le"), width)))
    b = right.withColumn("_bin", F.explode(bins(F.col("rs"), F.col("re"), width)))
    mid2 = F.col("ls") + F.col("le")  # twice the middle stays whole
    hit = (mid2 >= 2 * F.col("rs")) & (mid2 < 2 * F.col("re"))
    over = F.least("le", "re") - F.greatest("ls", "rs")
    pairs = a.join(b, [*keys, "_bin"]).withColumn("_hit", hit).withColumn("_over", over).where(F.col("_hit") | (F.col("_over") > 0))
    rank = F.struct(F.col("_hit").cast("int").alias("h"), F.when(~F.col("_hit"), F.col("_over")).otherwise(0).alias("o"), (-F.col("ro")).alias("r"))
    best = pairs.groupBy(*keys, *left_id).agg(F.max_by(F.struct(F.col(label).alias("v"), F.col("ro")), rank).alias("_b"))
    return left.join(best, [*keys, *left_id], "left").withColumn(label, F.col("_b.v")).withColumn("ro", F.col("_b.ro")).drop("_b")
