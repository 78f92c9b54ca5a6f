"""Voice activity from an energy series: threshold, hangover, runs, gaps, cuts. Times are frame numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmenta.operators.ordered import beside, islands, neighbourhood, sequenced
from segmenta.operators.quantiles import percentiles

HANG, LEAST, FILL, BLOCK = 2, 3, 3, 50_000


def threshold(frames: DataFrame, keys: list[str], value: str = "rms") -> DataFrame:
    """The energy above which a key's frames are speech, and its greatest energy, number of frames and sum of hundredths."""
    p = percentiles(frames, keys, value, {"p20": 0.2, "p50": 0.5, "p80": 0.8}, summary=True)
    thr = F.greatest(F.col("p20") * 1.8, F.col("p50") * 0.35, F.col("p20") + (F.col("p80") - F.col("p20")) * 0.15)
    return p.select(*keys, F.when(thr < 1e-8, F.col("mean") * 0.2 + 1e-8).otherwise(thr).alias("thr"), "peak", "n_frames", "hundredths")


def voiced(frames: DataFrame, keys: list[str], value: str = "rms", hang: int = HANG, least: int = LEAST, raw: DataFrame | None = None, shard: str = "shard") -> DataFrame:
    """Speech runs: keys, start, end (frames), openness, n_frames of the key, and of the run hundredths (the sum of its values'
    rounded hundredths) and most (its greatest value). Frames carry idx and a shard. Speech lingers `hang` frames and begins
    half as many before; runs of fewer than `least` frames are dropped. A key without any run is one open run. `raw` may give
    the same frames without idx, from which the threshold is cheaper to take. A key's threshold meets its occupied shards, so
    that a hot key isn't gathered for it."""
    whole = threshold(frames if raw is None else raw, keys, value)
    marked = beside(frames, whole.select(*keys, "thr", "peak"), keys, shard, "inner").withColumn("is_speech", (F.col(value) > F.col("thr")).cast("int"))
    near, order = neighbourhood(marked.select(*keys, "idx", value, "peak", "is_speech"), keys, "idx", hang, hang // 2, BLOCK)
    mask = near.withColumn("mask", F.max("is_speech").over(order.rowsBetween(-hang, hang // 2))).where("not halo")
    mask = mask.drop("halo", "is_speech").withColumnRenamed("idx", "at")
    runs = islands(mask, keys, "block", ["at"], ["mask"], F.col("mask") != F.col("prev.mask"), "run")
    runs = runs.where("mask = 1").groupBy(*keys, "run").agg(
        F.min("at").alias("start"), (F.max("at") + 1).alias("end"), F.avg(value).alias("m"), F.first("peak").alias("_p"), F.sum(F.round(F.col(value) * 100).cast("bigint")).alias("_h"), F.max(value).alias("most")
    )
    kept = runs.where(F.col("end") - F.col("start") >= least).select(*keys, "start", "end", F.least(F.lit(1.0), F.col("m") / (F.col("_p") + 1e-8) * 1.5).alias("openness"), "_h", "most")
    out, none = whole.join(kept, keys, "left"), F.col("start").isNull()
    pick = lambda other, own, name: F.when(none, other).otherwise(F.col(own)).alias(name)
    return out.select(*keys, pick(F.lit(0).cast("bigint"), "start", "start"), pick(F.col("n_frames"), "end", "end"), pick(F.lit(0.5), "openness", "openness"), "n_frames", pick(F.col("hundredths"), "_h", "hundredths"), pick(F.col("peak"), "most", "most"))


def filled(runs: DataFrame, keys: list[str], fill: int = FILL) -> DataFrame:
    """Speech runs and the closed stretches of more than `fill` frames before, between and after them."""
    seq = sequenced(runs.withColumn("_s", F.floor(F.col("start") / BLOCK).cast("bigint")), keys, "_s", ["start"], ["end"])
    before = F.coalesce(F.col("prev.end"), F.lit(0))
    own = F.struct(F.col("start"), F.col("end"), F.lit("open").alias("state"), F.col("openness"))
    closed = F.struct(before.alias("start"), F.col("start").alias("end"), F.lit("closed").alias("state"), F.lit(0.05).alias("openness"))
    tail = F.struct(F.col("end").alias("start"), F.col("n_frames").alias("end"), F.lit("closed").alias("state"), F.lit(0.05).alias("openness"))
    rows = F.array_compact(F.array(F.when(F.col("start") > before + fill, closed), own, F.when(F.col("next").isNull() & (F.col("end") < F.col("n_frames") - fill), tail)))
    return seq.select(*keys, F.inline(rows))


def trimmed(frames: DataFrame, keys: list[str], value: str = "rms", top_db: float = 30.0, shard: str = "shard") -> DataFrame:
    """keys, first_idx, end_idx: where the frames within top_db of a key's peak begin and end. A silent key has no row."""
    peak = frames.groupBy(*keys).agg(F.max(value).alias("_peak"))
    loud = beside(frames, peak, keys, shard, "inner").where(F.col(value) > F.col("_peak") * F.pow(F.lit(10.0), F.lit(-top_db / 20)))
    return loud.groupBy(*keys).agg(F.min("idx").alias("first_idx"), (F.max("idx") + 1).alias("end_idx"))
