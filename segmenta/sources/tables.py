"""Readers of the Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(seconds: Column) -> Column:
    """Whole milliseconds of a time in seconds; null for null, NaN, infinite and absurd values."""
    usable = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) < F.lit(1e12))
    return F.when(usable, F.round(seconds * 1000).cast("bigint"))


def latest(df: DataFrame, key: str, version: str) -> DataFrame:
    """One row per key, the first delivery; rows without a key are dropped.

    A redelivery repeats the content, so which delivery stays matters only for `version`.
    The aggregate is a partial one before the shuffle, so copies of a hot key meet on the map side.
    """
    rest = [c for c in df.columns if c != key]
    first = F.min_by(F.struct(*[F.col(c) for c in rest]), F.col(version)).alias("_r")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(first).select(key, *[F.col("_r")[c].alias(c) for c in rest]).select(*df.columns)
