"""Artifacts of a run, as DataFrames of text or nested rows, and their writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def segment_lines(seg: DataFrame) -> DataFrame:
    """rec_id, idx, line: a fixed-width line per segment (rec_id, idx, speaker, start_ms, end_ms, emotion, text, tgt)."""
    cut = lambda c, n: F.left(F.coalesce(F.col(c), F.lit("")), F.lit(n))
    line = F.format_string("%3d | %-12s | %6.2f-%-6.2f | %5.2fs | %-10s | %s -> %s", F.col("idx") + 1, F.col("speaker"), F.col("start_ms") / 1000.0, F.col("end_ms") / 1000.0, (F.col("end_ms") - F.col("start_ms")) / 1000.0, F.coalesce("emotion", F.lit("neutral")), cut("text", 40), cut("tgt", 60))
    return seg.select("rec_id", "idx", line.alias("line"))


def nested(seg: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per recording: its segments and groups as arrays in order. A recording's document holds all its segments,
    as the artifact does; for a recording of unbounded length write `segment_lines` instead."""
    one = F.struct("idx", "speaker", F.round(F.col("start_ms") / 1000.0, 3).alias("start"), F.round(F.col("end_ms") / 1000.0, 3).alias("end"), F.coalesce("emotion", F.lit("neutral")).alias("emotion"), F.col("text").alias("source"), F.col("tgt").alias("target"))
    s = seg.groupBy("rec_id").agg(F.array_sort(F.collect_list(one)).alias("segments"))
    g = groups.groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct("grp", "speaker", "bucket", "n_segments"))).alias("groups"))
    return s.join(g, "rec_id", "left")


def openness(states: DataFrame, key: str) -> DataFrame:
    """key, state segments in order, and the share of open ones by number, to three places."""
    rows = states.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "state", "openness"))).alias("state_segments"), F.sum(F.when(F.col("state") == "open", 1).otherwise(0)).alias("n"))
    return rows.select(key, "state_segments", F.round(F.col("n") / F.greatest(F.size("state_segments"), F.lit(1)), 3).alias("open_ratio"))


def timeline_sync(runs: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """key, sync_score and speech_segments (start, end, state, openness) in order, of runs (key, sync_score)."""
    own = segments.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "state", "openness"))).alias("speech_segments"))
    return runs.select(key, "sync_score").join(own, key, "left").withColumn("speech_segments", F.coalesce("speech_segments", F.array()))


def translation_lines(seg: DataFrame) -> DataFrame:
    """rec_id, idx, line: source and translation of each segment that has either."""
    some = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    return seg.where((some("text") != "") | (some("tgt") != "")).select("rec_id", "idx", F.concat(some("text"), F.lit("\n -> "), some("tgt")).alias("line"))


def upserted(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """A checkpoint table with new rows over it: of each key the row of the latest version, the new one of equals."""
    both = old.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)), allowMissingColumns=True)
    names = [c for c in both.columns if c not in (key, "_n")]
    last = F.max_by(F.struct(*names), F.struct(F.col(version), "_n"))
    return both.where(F.col(key).isNotNull()).groupBy(key).agg(last.alias("_r")).select(key, *[F.col("_r")[c].alias(c) for c in names])


def score_report(scores: DataFrame, columns: list[str], order: Column, passed: Column) -> DataFrame:
    """A table of scores as lines of Markdown, and a last line with how many passed."""
    table = markdown(scores.withColumn("passed", passed), [*columns, "passed"], order)
    n = scores.agg(F.count_if(passed).alias("p"), F.count(F.lit(1)).alias("n")).select(F.format_string("%d of %d passed", "p", "n").alias("line"))
    return table.unionByName(n)


def summary(runs: DataFrame) -> DataFrame:
    """rec_id, value: the labelled lines that `sources.files.summaries` reads."""
    shown = lambda c, f: F.when(F.col(c).isNotNull(), F.format_string(f, F.col(c)))
    lines = F.array_compact(F.array(F.format_string("recording: %s", F.col("rec_id")), shown("length_ratio", "length_ratio: %.3f"), shown("sync_score", "sync_score: %.3f"), shown("status", "status: %s")))
    return runs.select("rec_id", F.array_join(lines, "\n").alias("value"))


def markdown(rows: DataFrame, columns: list[str], order: Column) -> DataFrame:
    """A table as lines of Markdown in order: `line`, with the head first. For reports that people read."""
    text = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    head = rows.sparkSession.createDataFrame([(0, "| " + " | ".join(columns) + " |"), (1, "|" + "---|" * len(columns))], "at int, line string")
    return head.unionByName(rows.select(F.lit(2).alias("at"), order.cast("string").alias("k"), text.alias("line")), allowMissingColumns=True).orderBy("at", "k").select("line")


def write(rows: DataFrame, path: str, kind: str, run_id: str) -> None:
    """Writes json, csv, text or parquet under a folder of the run."""
    out = rows.write.mode("overwrite")
    target = f"{path}/run_id={run_id}"
    if kind == "csv":
        out.option("header", True).csv(target)
    else:
        getattr(out, kind)(target)
