"""The stages of a run composed: segments -> speakers and moods -> groups -> translations -> labels -> timeline -> scores ->
report.

`run` gives a DataFrame per stage; nothing executes until one is used, so a stage that isn't asked for costs nothing. Stages
share what they stand on: the translations are one DataFrame, so a plan that has them twice has the same subplan.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmenta import models, sinks
from segmenta.operators import islands as I
from segmenta.operators.energy import filled, voiced
from segmenta.operators.folds import crumb_glue, retry_empty
from segmenta.plans import frames as timelines
from segmenta.plans import segments as labels
from segmenta.plans.base import SEG_ORDER, bucket, frame, seg

STEPS = ("segments", "glued", "turns", "groups", "merge_groups", "translations", "retried", "labels", "states", "sync", "quality", "report")


def run(spark: SparkSession, sf_dir: str, steps: tuple[str, ...] = STEPS, translate: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> dict[str, DataFrame]:
    """The tables of the steps that are asked for, by name."""
    own = seg(spark, sf_dir).withColumn("bucket", bucket(F.col("emotion")))

    @cache
    def merged() -> DataFrame:
        return I.merge_groups(own, SEG_ORDER).select("rec_id", "idx", "grp", "shard", "speaker", "emotion", "start_ms", "end_ms", "text")

    @cache
    def translated() -> DataFrame:
        return models.apply(merged(), "translate", translate)

    def by_group() -> DataFrame:
        one = translated().groupBy("rec_id", "grp").agg(F.min("shard").alias("shard"), F.first("speaker").alias("speaker"), F.array_sort(F.collect_list(F.struct("idx", "text", "tgt"))).alias("x"))
        whole = lambda c: F.array_join(F.transform("x", lambda x: x[c]), "")
        return one.select("rec_id", "shard", "grp", "speaker", whole("text").alias("text"), whole("tgt").alias("tgt"))

    makers: dict[str, Callable[[], DataFrame]] = {
        "segments": lambda: own,
        "glued": lambda: crumb_glue(own),
        "turns": lambda: I.turns(own, SEG_ORDER),
        "groups": lambda: I.speaker_groups(own, SEG_ORDER),
        "merge_groups": merged,
        "translations": translated,
        "retried": lambda: retry_empty(by_group(), lambda source: source),
        "labels": lambda: labels.best_labeling(spark, sf_dir),
        "states": lambda: filled(voiced(frame(spark, sf_dir, ["rms"]), ["user_id"], raw=frame(spark, sf_dir)), ["user_id"]),
        "sync": lambda: timelines.sync_score(spark, sf_dir),
        "quality": lambda: labels.quality_gate(spark, sf_dir),
        "report": lambda: sinks.segment_lines(translated()),
    }
    return {name: makers[name]() for name in dict.fromkeys(("segments", *steps)) if name in makers}
