"""Sync score of a timeline: coverage, evenness of its anchors, density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

# Weights of coverage, evenness and density; evenness without two anchors; seconds that an anchor should take.
COVERAGE, EVENNESS, DENSITY, UNKNOWN, STEP_S = 0.40, 0.35, 0.25, 0.45, 0.85


def evenness(anchors: DataFrame, keys: list[str], out: str) -> DataFrame:
    """One minus the variation of the steps between a timeline's anchors. A timeline's anchors are few by nature."""
    step = (F.col("at_ms") - F.lag("at_ms").over(W.partitionBy(*keys).orderBy("at_ms"))) / 1000.0
    steps = anchors.withColumn("_g", step).where(F.col("_g") > 1e-4)
    return steps.groupBy(*keys).agg((1.0 - F.least(F.stddev_pop("_g") / F.greatest(F.avg("_g"), F.lit(0.01)), F.lit(1.0))).alias(out))


def density(per_second: Column) -> Column:
    return F.when(per_second < 0.3, per_second / 0.3).when(per_second <= 4.0, 1.0).otherwise(F.greatest(F.lit(0.55), 1.0 - (per_second - 4.0) / 10.0))


def sync_score(points: DataFrame, speech: DataFrame, keys: list[str]) -> DataFrame:
    """keys, coverage, uniformity, score. Points have at_ms and kind; anchors are core vowels, else vowels, else peaks, of
    which there are two, else all; too many are thinned evenly."""
    is_core, is_vowel, is_peak = F.col("kind") == "core_vowel", F.col("kind").isin("core_vowel", "vowel"), F.col("kind") == "openness_peak"
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    count = points.groupBy(*keys).agg(n(is_core).alias("core"), n(is_vowel).alias("vow"), n(is_peak).alias("peak"))
    span = speech.groupBy(*keys).agg(F.greatest(F.max("end_ms") / 1000.0, F.lit(0.01)).alias("span"), (F.sum(F.col("end_ms") - F.col("start_ms")) / 1000.0).alias("talk"))
    whole = span.join(count, keys)
    chosen = F.when(F.col("core") >= 2, is_core).when(F.col("vow") >= 2, is_vowel).when(F.col("peak") >= 2, is_peak).otherwise(is_vowel | is_peak | (F.col("kind") == "speech_start"))
    anchors = points.join(whole, keys).where(chosen)
    own = W.partitionBy(*keys)
    anchors = anchors.withColumn("i", F.row_number().over(own.orderBy("at_ms")) - 1).withColumn("n", F.count(F.lit(1)).over(own)).withColumn("ideal", F.greatest(F.lit(4), F.floor(F.col("span") / STEP_S)))
    # of n anchors the one at place i stays if an even step falls on it
    step = (F.col("n") - 1) / (F.col("ideal") - 1.0)
    first = F.ceil(F.col("i") / step)
    falls = (F.floor(first * step) == F.col("i")) & (first < F.col("ideal")) | (F.floor((first - 1) * step) == F.col("i")) & (first > 0)
    thin = anchors.where(~((F.col("n") >= 4) & (F.col("n") > F.col("ideal") * 2)) | falls)
    out = whole.join(evenness(thin, keys, "uni"), keys, "left").join(evenness(points.where(is_peak), keys, "puni"), keys, "left")
    cover, uni, puni = F.least(F.col("talk") / F.col("span"), F.lit(1.0)), F.coalesce("uni", F.lit(UNKNOWN)), F.coalesce("puni", F.lit(UNKNOWN))
    used = F.when(F.col("core") > 0, F.col("core")).when(F.col("vow") > 0, F.col("vow")).otherwise(F.col("peak"))
    score = COVERAGE * cover + EVENNESS * uni + DENSITY * density(used / F.col("span"))
    peaks = F.when(F.col("peak") >= 2, COVERAGE * cover + EVENNESS * puni + DENSITY * density(F.col("peak") / F.col("span"))).otherwise(0.0)
    return out.select(*keys, cover.alias("coverage"), uni.alias("uniformity"), F.greatest(score, peaks).alias("score"))
