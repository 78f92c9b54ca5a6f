"""Views that many queries start from, in Spark and in SQL.

`seg`: gold segments, each once, in whole milliseconds: a missing or impossible end is a second after the start, a blank
speaker is SPEAKER_00. `frame`: events as an energy series per user. `memo`: translations, each once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from segmenta.operators.ordered import sequenced
from segmenta.sources.tables import latest, millis, table

SEG_ORDER, SEG_SHARD_MS = ["start_ms", "seg_idx", "seg_id"], 600_000
FRAME_ORDER = ["ts", "event_id"]


def seg(spark: SparkSession, sf_dir: str, carry: list[str] | None = None) -> DataFrame:
    rows = table(spark, sf_dir, "gold_segments").where("seg_id is not null and rec_id is not null and start_s is not null")
    start, end = millis(F.col("start_s")), millis(F.col("end_s"))
    rows = rows.select(
        "rec_id", "seg_id", "seg_idx", start.alias("start_ms"), F.when(end > start, end).otherwise(start + 1000).alias("end_ms"),
        F.coalesce(F.regexp_replace("text", "^[ \t]+|[ \t]+$", ""), F.lit("")).alias("text"),
        F.coalesce(F.nullif(F.trim("speaker"), F.lit("")), F.lit("SPEAKER_00")).alias("speaker"), "label_confidence", "emotion",
    )
    rows = rows.withColumn("shard", F.floor(F.col("start_ms") / SEG_SHARD_MS).cast("bigint"))
    # a redelivery repeats its place, so it is the neighbour of the first delivery; later windows keep this shuffle
    before = F.lag("seg_id").over(W.partitionBy("rec_id", "shard").orderBy(*SEG_ORDER))
    rows = rows.withColumn("_before", before).where(~F.col("_before").eqNullSafe(F.col("seg_id"))).drop("_before")
    return sequenced(rows, ["rec_id"], "shard", SEG_ORDER, carry) if carry else rows


SEG = """seg0 AS (SELECT *, row_number() OVER (PARTITION BY seg_id ORDER BY ingested_at) AS rn FROM gold_segments WHERE seg_id IS NOT NULL),
seg1 AS (SELECT rec_id, seg_id, seg_idx, CAST(round(start_s * 1000) AS BIGINT) AS start_ms, CAST(round(end_s * 1000) AS BIGINT) AS e,
  coalesce(regexp_replace(text, '^[ \t]+|[ \t]+$', '', 'g'), '') AS text, coalesce(nullif(trim(speaker, ' '), ''), 'SPEAKER_00') AS speaker, label_confidence, emotion
  FROM seg0 WHERE rn = 1 AND rec_id IS NOT NULL AND start_s IS NOT NULL),
seg AS (SELECT * EXCLUDE (e), CASE WHEN e > start_ms THEN e ELSE start_ms + 1000 END AS end_ms,
  row_number() OVER (PARTITION BY rec_id ORDER BY start_ms, seg_idx, seg_id) - 1 AS idx FROM seg1)"""


def frame(spark: SparkSession, sf_dir: str, carry: list[str] | None = None) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("user_id is not null and ts is not null").select("user_id", "ts", "event_id", "event_type", F.nanvl("value", F.lit(None)).alias("rms"))
    rows = rows.withColumn("shard", F.datediff(F.col("ts"), F.lit("1970-01-01").cast("timestamp")).cast("bigint"))
    return sequenced(rows, ["user_id"], "shard", FRAME_ORDER, carry) if carry else rows


FRAME = """frame AS (SELECT user_id, ts, event_id, event_type, value AS rms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)"""


def memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "translations"), "trans_id", "created_at")


MEMO = "memo AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY trans_id ORDER BY created_at) AS rn FROM translations WHERE trans_id IS NOT NULL) WHERE rn = 1)"

# Which emotions are positive and negative; all others are neutral.
POSITIVE, NEGATIVE = ("happy", "surprised"), ("sad", "fearful", "angry", "disgusted")


def bucket(emotion: Column) -> Column:
    e = F.lower(emotion)
    return F.when(e.isin(*POSITIVE), "positive").when(e.isin(*NEGATIVE), "negative").otherwise("neutral")


def bucket_sql(c: str) -> str:
    return f"CASE WHEN lower({c}) IN ('happy', 'surprised') THEN 'positive' WHEN lower({c}) IN ('sad', 'fearful', 'angry', 'disgusted') THEN 'negative' ELSE 'neutral' END"
