"""Queries of problem 2: overlapping and gapped time intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmenta.operators.run_bitmaps import periods, periods_and_gaps
from segmenta.sources.tables import millis, table

GAP_OVER_MS, GAP_MOST_MS = 350, 30_000


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All intervals: origin, entity_id, start_ms, end_ms."""
    gold = table(spark, sf_dir, "gold_segments").select(F.lit("gold").alias("origin"), F.col("rec_id").alias("entity_id"), "start_s", "end_s")
    lines = table(spark, sf_dir, "timeline_results").select("timeline_id", F.explode(F.concat(F.coalesce("speech_segments", F.array()), F.coalesce("silence_segments", F.array()))).alias("x"))
    lines = lines.select(F.lit("timeline").alias("origin"), F.col("timeline_id").cast("string").alias("entity_id"), "x.start_s", "x.end_s")
    return gold.unionByName(lines).select("origin", "entity_id", millis(F.col("start_s")).alias("start_ms"), millis(F.col("end_s")).alias("end_ms"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periods_and_gaps(intervals(spark, sf_dir), ["origin", "entity_id"])
    length = F.col("end_ms") - F.col("start_ms")
    merged = (F.col("kind") == "period") & (F.col("n_intervals") >= 2)
    gap = (F.col("kind") == "gap") & (length > GAP_OVER_MS) & (length <= GAP_MOST_MS)
    return rows.where(merged | gap).select("origin", "entity_id", F.when(F.col("kind") == "gap", "gap").otherwise("merged").alias("found_kind"), "start_ms", "end_ms")


def p2_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods(intervals(spark, sf_dir), ["origin", "entity_id"])


_ISLANDS = """
WITH iv AS (
  SELECT DISTINCT origin, entity_id, CAST(round(start_s * 1000) AS BIGINT) AS s, CAST(round(end_s * 1000) AS BIGINT) AS e
  FROM (
    SELECT 'gold' AS origin, rec_id AS entity_id, start_s, end_s FROM gold_segments
    UNION ALL
    SELECT 'timeline', CAST(timeline_id AS VARCHAR), x.start_s, x.end_s
    FROM (SELECT timeline_id, unnest(list_concat(coalesce(speech_segments, []), coalesce(silence_segments, []))) AS x FROM timeline_results)
  ) WHERE entity_id IS NOT NULL AND start_s IS NOT NULL AND end_s IS NOT NULL AND NOT isnan(start_s) AND NOT isnan(end_s)
),
ok AS (SELECT * FROM iv WHERE e > s),
c AS (SELECT *, max(e) OVER (PARTITION BY origin, entity_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cover FROM ok),
r AS (SELECT *, sum(CASE WHEN cover IS NULL OR s > cover THEN 1 ELSE 0 END) OVER (PARTITION BY origin, entity_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM c),
p AS (SELECT origin, entity_id, run, min(s) AS start_ms, max(e) AS end_ms, count(*) AS n FROM r GROUP BY ALL),
g AS (SELECT *, lead(start_ms) OVER (PARTITION BY origin, entity_id ORDER BY start_ms) AS nxt FROM p)
"""

QUERIES = {"p2_found": p2_found, "p2_periods": p2_periods}
SQL = {
    "p2_found": _ISLANDS
    + """SELECT origin, entity_id, 'merged' AS found_kind, start_ms, end_ms FROM p WHERE n >= 2
UNION ALL SELECT origin, entity_id, 'gap', end_ms, nxt FROM g WHERE nxt - end_ms > 350 AND nxt - end_ms <= 30000""",
    "p2_periods": _ISLANDS + "SELECT origin, entity_id, start_ms, end_ms, CAST(n AS BIGINT) AS n_intervals FROM p",
}
