"""Groups of adjacent segments: speaker groups, turns, merge groups, runs of states. All in whole milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmenta.operators.ordered import beside, islands

TURN_GAP_MS, MERGE_GAP_MS, SHORT_CHARS, CRUMB_CHARS, LEAST_GROUP = 350, 500, 12, 4, 2


def compact(text: Column) -> Column:
    """Without white space of any kind."""
    return F.regexp_replace(text, r"[\s 　 -  ]+", "")


def is_crumb(text: Column, most: int = CRUMB_CHARS) -> Column:
    """Nothing but marks, at most `most` letters, or two more without any Han letter."""
    t = F.regexp_replace(compact(text), "^[.,;:!?，。、；：！？…]+|[.,;:!?，。、；：！？…]+$", "")
    return (F.length(t) <= most) | (~t.rlike("[一-鿿]") & (F.length(t) <= most + 2))


def turns(seg: DataFrame, order: list[str], gap_ms: int = TURN_GAP_MS) -> DataFrame:
    """Adds idx and turn: a new one after a pause of gap_ms. If a recording of four segments or more has but one turn,
    each segment is one."""
    out = islands(seg, ["rec_id"], "shard", order, ["end_ms"], F.col("start_ms") - F.col("prev.end_ms") >= gap_ms, "turn")
    whole = out.groupBy("rec_id").agg(F.max("turn").alias("_last"), F.count(F.lit(1)).alias("_n"))
    out = beside(out, whole, ["rec_id"], "shard", "inner")
    return out.withColumn("turn", F.when((F.col("_last") == 0) & (F.col("_n") >= 4), F.col("idx")).otherwise(F.col("turn"))).drop("_last", "_n", "prev", "next")


def merge_groups(seg: DataFrame, order: list[str], gap_ms: int = MERGE_GAP_MS, short: int = SHORT_CHARS, crumb: int = CRUMB_CHARS) -> DataFrame:
    """Adds idx and grp: neighbours of one speaker with at most gap_ms between them join if either is short, a crumb or blank."""
    size, before = F.length(compact(F.col("text"))), F.length(compact(F.col("prev.text")))
    small = is_crumb(F.col("text"), crumb) | is_crumb(F.col("prev.text"), crumb) | (size <= short) | (before <= short)
    joins = (F.col("speaker") == F.col("prev.speaker")) & (F.col("start_ms") - F.col("prev.end_ms") <= gap_ms) & small
    return islands(seg, ["rec_id"], "shard", order, ["end_ms", "speaker", "text"], ~joins, "grp").drop("prev", "next")


def speaker_groups(seg: DataFrame, order: list[str], least: int = LEAST_GROUP, text: bool = False) -> DataFrame:
    """Groups of adjacent segments of one speaker and mood (`bucket`); a group of fewer than `least` segments is absorbed
    by the group before it if that is of the same speaker. A row per group, with the mood of its first base group and, if
    asked for, `said`: its texts in order, each closed by a full stop, blank ones skipped. With least 0 each segment is a
    group by itself, as in songs."""
    own = F.when(F.col("text") == "", F.lit(None)).when(F.col("text").rlike(r"[.!?。！？]\z"), F.col("text")).otherwise(F.concat("text", F.lit(".")))
    said = lambda c: [c.alias("said")] if text else []
    change = F.lit(True) if least < 1 else (F.col("speaker") != F.col("prev.speaker")) | (F.col("bucket") != F.col("prev.bucket"))
    kept = ["rec_id", "shard", *order, "speaker", "bucket", "end_ms", *(["text"] if text else [])]
    base = islands(seg.select(*dict.fromkeys([*kept, "start_ms"])), ["rec_id"], "shard", order, ["speaker", "bucket"], change, "base")
    base = base.groupBy("rec_id", "base").agg(
        F.min("shard").alias("shard"), F.first("speaker").alias("speaker"), F.min_by("bucket", "idx").alias("bucket"), F.count(F.lit(1)).alias("n"),
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("talk_ms"),
        *said(F.collect_list(F.when(own.isNotNull(), F.struct("idx", own.alias("t"))))),
    )
    grouped = islands(base, ["rec_id"], "shard", ["base"], ["speaker"], (F.col("speaker") != F.col("prev.speaker")) | (F.col("n") >= least), "grp")
    out = grouped.groupBy("rec_id", "grp").agg(
        F.min("shard").alias("shard"), F.first("speaker").alias("speaker"), F.min_by("bucket", "base").alias("bucket"), F.sum("n").alias("n_segments"),
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum("talk_ms").alias("talk_ms"), *said(F.flatten(F.collect_list("said")) if text else F.lit(None)),
    )
    return out.withColumn("said", F.array_join(F.transform(F.array_sort("said"), lambda x: x["t"]), " ")) if text else out
