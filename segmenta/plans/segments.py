"""Queries over segments of speech: groups, turns, labels, gaps, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from segmenta.operators import islands as I
from segmenta.operators.ordered import islands, sequenced
from segmenta.plans.base import MEMO, SEG, SEG_ORDER, bucket, bucket_sql, memo, seg
from segmenta.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


CRUMB = "(length({t}) <= 4 OR (NOT regexp_matches({t}, '[一-鿿]') AND length({t}) <= 6))"
COMPACT = r"regexp_replace({t}, '[\s\x{{00a0}}\x{{3000}}\x{{2000}}-\x{{200a}}\x{{202f}}]+', '', 'g')"


def _compact(t: str) -> str:
    return COMPACT.format(t=t)


def _crumb(t: str) -> str:
    return CRUMB.format(t=f"regexp_replace({_compact(t)}, '^[.,;:!?，。、；：！？…]+|[.,;:!?，。、；：！？…]+$', '', 'g')")


_GROUPS = f"""WITH {SEG}, b0 AS (SELECT *, {bucket_sql('emotion')} AS bucket FROM seg),
b1 AS (SELECT *, CASE WHEN lag(speaker) OVER w IS NOT DISTINCT FROM speaker AND lag(bucket) OVER w IS NOT DISTINCT FROM bucket THEN 0 ELSE 1 END AS f FROM b0 WINDOW w AS (PARTITION BY rec_id ORDER BY idx)),
b2 AS (SELECT *, sum(f) OVER (PARTITION BY rec_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS base FROM b1),
b3 AS (SELECT rec_id, base, any_value(speaker) AS speaker, any_value(bucket) AS bucket, count(*) AS n, min(start_ms) AS start_ms, max(end_ms) AS end_ms, sum(end_ms - start_ms) AS talk_ms FROM b2 GROUP BY rec_id, base),
b4 AS (SELECT *, CASE WHEN lag(speaker) OVER (PARTITION BY rec_id ORDER BY base) IS NOT DISTINCT FROM speaker AND n < 2 THEN 0 ELSE 1 END AS f FROM b3),
b5 AS (SELECT *, sum(f) OVER (PARTITION BY rec_id ORDER BY base ROWS UNBOUNDED PRECEDING) - 1 AS grp FROM b4),
grp AS (SELECT rec_id, CAST(grp AS BIGINT) AS grp, any_value(speaker) AS speaker, arg_min(bucket, base) AS bucket, CAST(sum(n) AS BIGINT) AS n_segments, min(start_ms) AS start_ms, max(end_ms) AS end_ms, CAST(sum(talk_ms) AS BIGINT) AS talk_ms FROM b5 GROUP BY rec_id, grp)
"""


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return I.speaker_groups(seg(spark, d).withColumn("bucket", bucket(F.col("emotion"))), SEG_ORDER)


@query(_GROUPS + "SELECT rec_id, grp, speaker, bucket, n_segments, start_ms, end_ms, talk_ms, round(least(talk_ms / (end_ms - start_ms), 1.0), 3) AS coverage FROM grp")
def speaker_groups(spark: SparkSession, d: str) -> DataFrame:
    cover = F.round(F.least(F.col("talk_ms") / (F.col("end_ms") - F.col("start_ms")), F.lit(1.0)), 3)
    return _groups(spark, d).select("rec_id", "grp", "speaker", "bucket", "n_segments", "start_ms", "end_ms", "talk_ms", cover.alias("coverage"))


@query(_GROUPS + "SELECT rec_id, grp, greatest(80, least(800, greatest(0, lead(start_ms) OVER (PARTITION BY rec_id ORDER BY grp) - end_ms))) AS gap_ms FROM grp QUALIFY lead(start_ms) OVER (PARTITION BY rec_id ORDER BY grp) IS NOT NULL")
def inter_group_gap(spark: SparkSession, d: str) -> DataFrame:
    rows = sequenced(_groups(spark, d), ["rec_id"], "shard", ["grp"], ["start_ms"]).where("next is not null")
    pause = F.greatest(F.lit(0), F.col("next.start_ms") - F.col("end_ms"))
    return rows.select("rec_id", "grp", F.greatest(F.lit(80), F.least(F.lit(800), pause)).cast("bigint").alias("gap_ms"))


_TURNS = f"""WITH {SEG}, t1 AS (SELECT *, CASE WHEN start_ms - lag(end_ms) OVER (PARTITION BY rec_id ORDER BY idx) < 350 THEN 0 ELSE 1 END AS f FROM seg),
t2 AS (SELECT *, sum(f) OVER (PARTITION BY rec_id ORDER BY idx ROWS UNBOUNDED PRECEDING) - 1 AS t, count(*) OVER (PARTITION BY rec_id) AS n FROM t1),
turn AS (SELECT *, CAST(CASE WHEN max(t) OVER (PARTITION BY rec_id) = 0 AND n >= 4 THEN idx ELSE t END AS BIGINT) AS turn FROM t2)
"""


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return I.turns(seg(spark, d), SEG_ORDER)


@query(_TURNS + "SELECT rec_id, turn, count(*) AS n_segments, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM turn GROUP BY rec_id, turn")
def turn_split(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d).groupBy("rec_id", "turn").agg(F.count(F.lit(1)).alias("n_segments"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


@query(_TURNS + ", s AS (SELECT rec_id, CASE WHEN speaker = 'SPEAKER_00' THEN 0 ELSE 1 END AS id0 FROM seg WHERE idx = 0) SELECT rec_id, turn, 'SPEAKER_0' || ((id0 + turn) % 2) AS speaker, count(*) AS n_segments FROM turn JOIN s USING (rec_id) GROUP BY rec_id, turn, id0")
def turn_alternate(spark: SparkSession, d: str) -> DataFrame:
    """Turns alternate between two speakers; the first segment's label decides who begins."""
    rows = _turns(spark, d)
    first = rows.where("idx = 0").select("rec_id", F.when(F.col("speaker") == "SPEAKER_00", 0).otherwise(1).alias("id0"))
    per = rows.groupBy("rec_id", "turn").agg(F.count(F.lit(1)).alias("n_segments"))
    return per.join(first, "rec_id").select("rec_id", "turn", F.concat(F.lit("SPEAKER_0"), ((F.col("id0") + F.col("turn")) % 2).cast("string")).alias("speaker"), "n_segments")


_MERGE = f"""WITH {SEG}, m1 AS (SELECT *, lag(speaker) OVER w AS ps, lag(end_ms) OVER w AS pe, lag(text) OVER w AS pt FROM seg WINDOW w AS (PARTITION BY rec_id ORDER BY idx)),
m2 AS (SELECT *, CASE WHEN ps = speaker AND start_ms - pe <= 500 AND ({_crumb('text')} OR {_crumb('pt')} OR length({_compact('text')}) <= 12 OR length({_compact('pt')}) <= 12) THEN 0 ELSE 1 END AS f FROM m1),
m3 AS (SELECT *, CAST(sum(f) OVER (PARTITION BY rec_id ORDER BY idx ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS grp FROM m2)
"""


def _merge(spark: SparkSession, d: str) -> DataFrame:
    return I.merge_groups(seg(spark, d), SEG_ORDER)


@query(_MERGE + "SELECT rec_id, grp, min(idx) AS first_idx, count(*) AS n_segments FROM m3 GROUP BY rec_id, grp")
def merge_groups(spark: SparkSession, d: str) -> DataFrame:
    return _merge(spark, d).groupBy("rec_id", "grp").agg(F.min("idx").alias("first_idx"), F.count(F.lit(1)).alias("n_segments"))


@query(_MERGE + "SELECT rec_id, idx, grp, idx = min(idx) OVER (PARTITION BY rec_id, grp) AS is_head FROM m3")
def group_membership(spark: SparkSession, d: str) -> DataFrame:
    """Which merge group each segment is in, and whether it leads it."""
    rows = _merge(spark, d)
    heads = rows.groupBy("rec_id", "grp").agg(F.min("idx").alias("head"))
    return rows.join(heads, ["rec_id", "grp"]).select("rec_id", "idx", "grp", (F.col("idx") == F.col("head")).alias("is_head"))


@query(_MERGE + "SELECT rec_id, grp, string_agg(CASE WHEN regexp_matches(text, '[.!?。！？…]$') THEN text ELSE text || '.' END, ' ' ORDER BY idx) AS text FROM m3 WHERE text <> '' GROUP BY rec_id, grp")
def group_text(spark: SparkSession, d: str) -> DataFrame:
    """Texts of a merge group, each closed by a full stop, joined by spaces; blank ones are skipped."""
    closed = F.when(F.col("text").rlike("[.!?。！？…]$"), F.col("text")).otherwise(F.concat("text", F.lit(".")))
    rows = _merge(spark, d).where("text <> ''").groupBy("rec_id", "grp").agg(F.array_sort(F.collect_list(F.struct("idx", closed.alias("t")))).alias("x"))
    return rows.select("rec_id", "grp", F.array_join(F.transform("x", lambda x: x["t"]), " ").alias("text"))


@query(f"WITH {SEG} SELECT rec_id, round(least(sum(end_ms - start_ms) / max(end_ms), 1.0), 3) AS coverage, CAST(sum(end_ms - start_ms) AS BIGINT) AS talk_ms, max(end_ms) AS total_ms FROM seg GROUP BY rec_id")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    talk = F.sum(F.col("end_ms") - F.col("start_ms"))
    return seg(spark, d).groupBy("rec_id").agg(F.round(F.least(talk / F.max("end_ms"), F.lit(1.0)), 3).alias("coverage"), talk.alias("talk_ms"), F.max("end_ms").alias("total_ms"))


@query(f"WITH {SEG} SELECT rec_id, count(DISTINCT speaker) AS n_speakers FROM seg GROUP BY rec_id")
def speaker_counts(spark: SparkSession, d: str) -> DataFrame:
    return seg(spark, d).groupBy("rec_id").agg(F.countDistinct("speaker").alias("n_speakers"))


@query(f"WITH {SEG} SELECT rec_id, idx, end_ms - start_ms AS dur_ms, text FROM seg QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY end_ms - start_ms DESC, idx) = 1")
def longest_segment(spark: SparkSession, d: str) -> DataFrame:
    """The longest segment of each recording, the first of equals; by a partial aggregate, without a window."""
    rows = seg(spark, d, ["start_ms"]).withColumn("dur_ms", F.col("end_ms") - F.col("start_ms"))
    best = rows.groupBy("rec_id").agg(F.max_by(F.struct("idx", "dur_ms", "text"), F.struct("dur_ms", (-F.col("idx")).alias("i"))).alias("b"))
    return best.select("rec_id", "b.idx", "b.dur_ms", "b.text")


@query(f"WITH {SEG}, c AS (SELECT rec_id, emotion, count(*) AS n, min(idx) AS i FROM seg WHERE emotion IS NOT NULL GROUP BY rec_id, emotion) SELECT rec_id, emotion, n FROM c QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY n DESC, i) = 1")
def dominant_label(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent emotion of each recording; of equals the one seen first."""
    rows = seg(spark, d, ["start_ms"]).where("emotion is not null").groupBy("rec_id", "emotion").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("i"))
    best = rows.groupBy("rec_id").agg(F.max_by(F.struct("emotion", "n"), F.struct("n", (-F.col("i")).alias("i"))).alias("b"))
    return best.select("rec_id", "b.emotion", "b.n")


@query(f"WITH {SEG}, f AS (SELECT rec_id, speaker, min(idx) AS i FROM seg GROUP BY rec_id, speaker) SELECT rec_id, speaker, 'SPEAKER_' || lpad(CAST(row_number() OVER (PARTITION BY rec_id ORDER BY i) - 1 AS VARCHAR), 2, '0') AS label FROM f")
def first_seen_relabel(spark: SparkSession, d: str) -> DataFrame:
    """Speakers numbered in the order in which they first speak."""
    first = seg(spark, d, ["start_ms"]).groupBy("rec_id", "speaker").agg(F.min("idx").alias("i"))
    n = F.row_number().over(W.partitionBy("rec_id").orderBy("i")) - 1
    return first.select("rec_id", "speaker", F.format_string("SPEAKER_%02d", n).alias("label"))


_SCORE = """SELECT rec_id, {cand} AS candidate, n_labels, switches, same_after_gap, balance,
  round((CASE WHEN n_labels = 2 THEN 3.0 WHEN n_labels > 1 THEN 1.5 ELSE -2.0 END) - (CASE WHEN n_labels > 3 THEN 0.5 * (n_labels - 2) ELSE 0 END) + least(0.25 * switches, 1.5) - 0.4 * same_after_gap + balance, 6) AS score
FROM (SELECT rec_id, count(DISTINCT label) AS n_labels, CAST(sum(sw) AS BIGINT) AS switches, CAST(sum(same) AS BIGINT) AS same_after_gap FROM (
  SELECT rec_id, label, CASE WHEN lag(label) OVER w <> label THEN 1 ELSE 0 END AS sw, CASE WHEN lag(label) OVER w = label AND start_ms - lag(end_ms) OVER w >= 350 THEN 1 ELSE 0 END AS same FROM {src} WINDOW w AS (PARTITION BY rec_id ORDER BY idx)) GROUP BY rec_id)
JOIN (SELECT rec_id, min(n) / max(n) AS balance FROM (SELECT rec_id, label, count(*) AS n FROM {src} GROUP BY rec_id, label) GROUP BY rec_id) USING (rec_id)"""


def _score(rows: DataFrame) -> DataFrame:
    """The score of a labelling (rec_id, idx, start_ms, end_ms, label, prev): near two speakers, switching, balanced."""
    switch = F.when(F.col("prev.label") != F.col("label"), 1).otherwise(0)
    same = F.when((F.col("prev.label") == F.col("label")) & (F.col("start_ms") - F.col("prev.end_ms") >= I.TURN_GAP_MS), 1).otherwise(0)
    # two levels: first by label, which also yields the balance
    per = rows.groupBy("rec_id", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(switch).alias("s"), F.sum(same).alias("g"))
    out = per.groupBy("rec_id").agg(F.count(F.lit(1)).alias("n_labels"), F.sum("s").alias("switches"), F.sum("g").alias("same_after_gap"), (F.min("n") / F.max("n")).alias("balance"))
    k = F.col("n_labels")
    score = F.when(k == 2, 3.0).when(k > 1, 1.5).otherwise(-2.0) - F.when(k > 3, 0.5 * (k - 2)).otherwise(0.0)
    score = score + F.least(0.25 * F.col("switches"), F.lit(1.5)) - 0.4 * F.col("same_after_gap") + F.col("balance")
    return out.withColumn("score", F.round(score, 6))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    given = seg(spark, d).withColumn("label", F.col("speaker"))
    given = _score(sequenced(given, ["rec_id"], "shard", SEG_ORDER, ["label", "end_ms"])).withColumn("candidate", F.lit(0))
    other = _turns(spark, d).withColumn("label", (F.col("turn") % 2).cast("string"))
    other = _score(sequenced(other.drop("idx"), ["rec_id"], "shard", SEG_ORDER, ["label", "end_ms"])).withColumn("candidate", F.lit(1))
    return given.unionByName(other).withColumn("candidate", F.col("candidate").cast("bigint"))


_CANDIDATES = _TURNS + ", l0 AS (SELECT *, speaker AS label FROM seg), l1 AS (SELECT *, CAST(turn % 2 AS VARCHAR) AS label FROM turn), cand AS (" + _SCORE.format(cand=0, src="l0") + " UNION ALL " + _SCORE.format(cand=1, src="l1") + ")"


@query(_CANDIDATES + "SELECT rec_id, CAST(candidate AS BIGINT) AS candidate, n_labels, switches, same_after_gap, balance, score FROM cand")
def labeling_score(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d)


@query(_CANDIDATES + "SELECT rec_id, CAST(candidate AS BIGINT) AS candidate, score FROM cand QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY score DESC, candidate) = 1")
def best_labeling(spark: SparkSession, d: str) -> DataFrame:
    """The better of the given labels and alternating turns; the given ones if both score alike."""
    best = _candidates(spark, d).groupBy("rec_id").agg(F.max_by(F.struct("candidate", "score"), F.struct("score", (-F.col("candidate")).alias("c"))).alias("b"))
    return best.select("rec_id", "b.candidate", "b.score")


@query(f"WITH {SEG}, t AS (SELECT timeline_id, rec_id, unnest(speech_segments) AS x FROM (SELECT *, row_number() OVER (PARTITION BY timeline_id ORDER BY created_at) AS rn FROM timeline_results) WHERE rn = 1), l AS (SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY timeline_id, x.start_s, x.end_s, x.openness) - 1 AS idx, x.openness AS openness FROM t) SELECT seg.rec_id, seg.idx, seg.speaker, coalesce(l.openness, 0.5) AS openness, l.openness IS NULL AS is_default FROM seg LEFT JOIN l ON seg.rec_id = l.rec_id AND seg.idx = l.idx")
def segment_zip_labels(spark: SparkSession, d: str) -> DataFrame:
    """Segments beside a shorter or longer list of labels, place by place, with a default where the list has ended."""
    lines = table(spark, d, "timeline_results")
    lines = lines.withColumn("rn", F.row_number().over(W.partitionBy("timeline_id").orderBy("created_at"))).where("rn = 1")
    items = lines.where("rec_id is not null").select("timeline_id", "rec_id", F.explode("speech_segments").alias("x")).select("rec_id", "timeline_id", "x.start_s", "x.end_s", "x.openness", F.lit(0).alias("shard"))
    items = items.withColumn("shard", F.col("timeline_id"))
    items = sequenced(items, ["rec_id"], "shard", ["timeline_id", "start_s", "end_s", "openness"], ["openness"]).select("rec_id", "idx", "openness")
    rows = seg(spark, d, ["start_ms"]).select("rec_id", "idx", "speaker").join(items, ["rec_id", "idx"], "left")
    return rows.select("rec_id", "idx", "speaker", F.coalesce("openness", F.lit(0.5)).alias("openness"), F.col("openness").isNull().alias("is_default"))


@query(f"""WITH {SEG}, p AS (SELECT rec_id, idx, speaker, start_ms, end_ms, text, last_value(CASE WHEN text <> '' THEN idx END IGNORE NULLS) OVER (PARTITION BY rec_id, speaker ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anchor FROM seg)
SELECT p.rec_id, p.idx, q.idx AS anchor_idx FROM p JOIN seg q ON p.rec_id = q.rec_id AND p.anchor = q.idx WHERE p.start_ms - q.end_ms <= 800""")
def asof_previous_nonblank(spark: SparkSession, d: str) -> DataFrame:
    """As-of backward: the nearest earlier segment of the same speaker that has text, if it ends at most 800 ms before."""
    rows = seg(spark, d, ["start_ms"]).select("rec_id", "speaker", "idx", "start_ms", "end_ms", "text", "shard")
    own = F.when(F.col("text") != "", F.struct("idx", "end_ms"))
    inside = W.partitionBy("rec_id", "speaker", "shard").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    local = rows.withColumn("_a", F.last(own, ignorenulls=True).over(inside))
    ends = rows.groupBy("rec_id", "speaker", "shard").agg(F.max_by(own, F.when(own.isNotNull(), F.col("idx"))).alias("_l"))
    ends = ends.withColumn("_b", F.last("_l", ignorenulls=True).over(W.partitionBy("rec_id", "speaker").orderBy("shard").rowsBetween(W.unboundedPreceding, -1))).drop("_l")
    found = local.join(ends, ["rec_id", "speaker", "shard"]).withColumn("a", F.coalesce("_a", "_b"))
    return found.where((F.col("start_ms") - F.col("a.end_ms")) <= 800).select("rec_id", "idx", F.col("a.idx").alias("anchor_idx"))


@query(f"""WITH {SEG}, p AS (SELECT rec_id, idx, text AS a, lead(text) OVER (PARTITION BY rec_id ORDER BY idx) AS b0 FROM seg),
q AS (SELECT rec_id, idx, trim(a, ' ') AS a, trim(b0, ' ') AS raw, regexp_replace(trim(b0, ' '), '^[,，、;；]\\s*', '') AS b FROM p WHERE b0 IS NOT NULL)
SELECT rec_id, idx, CASE WHEN a = '' THEN raw WHEN raw = '' THEN a
 WHEN length(regexp_replace(a, '[^一-鿿]', '', 'g')) >= greatest(1, length(a) // 3) OR length(regexp_replace(b, '[^一-鿿]', '', 'g')) >= greatest(1, length(b) // 3) THEN a || b
 WHEN regexp_matches(a, '[\\p{{L}}\\p{{N}}]$') AND regexp_matches(b, '^[\\p{{L}}\\p{{N}}]') THEN a || ' ' || b ELSE a || b END AS joined FROM q""")
def smart_join(spark: SparkSession, d: str) -> DataFrame:
    """A segment and the next one as one text: Han text without space, Latin words with one, no doubled mark between."""
    from segmenta.functions.text import smart_join as join

    rows = seg(spark, d, ["text"]).where("next is not null")
    return rows.select("rec_id", "idx", join(F.col("text"), F.col("next.text")).alias("joined"))


@query(f"WITH {SEG} SELECT rec_id, idx, CAST(coalesce(try_cast(nullif(regexp_replace(speaker, '[^0-9]', '', 'g'), '') AS BIGINT), 0) % 4 AS BIGINT) AS slot, ['voice_a', 'voice_b', 'voice_c', 'voice_d'][CAST(coalesce(try_cast(nullif(regexp_replace(speaker, '[^0-9]', '', 'g'), '') AS BIGINT), 0) % 4 AS BIGINT) + 1] AS voice FROM seg")
def voice_slot(spark: SparkSession, d: str) -> DataFrame:
    """A voice of a list by the digits of the speaker's label; the first one without digits."""
    n = F.pmod(F.coalesce(F.nullif(F.regexp_replace("speaker", "[^0-9]", ""), F.lit("")).try_cast("bigint"), F.lit(0)), F.lit(4)).cast("bigint")
    voices = F.array(*[F.lit(f"voice_{c}") for c in "abcd"])
    return seg(spark, d, ["start_ms"]).select("rec_id", "idx", n.alias("slot"), F.element_at(voices, (n + 1).cast("int")).alias("voice"))


@query(f"WITH {MEMO}, {SEG}, s AS (SELECT rec_id, count(*) AS n, CAST(sum(CASE WHEN text <> '' THEN 1 ELSE 0 END) AS BIGINT) AS ok FROM seg GROUP BY rec_id), m AS (SELECT rec_id, sum(target_syllables) / sum(source_syllables) AS ratio FROM memo WHERE rec_id IS NOT NULL GROUP BY rec_id) SELECT rec_id, round(ratio, 6) AS length_ratio, round(ok / n, 6) AS covered, CASE WHEN ratio >= 0.8 AND ratio <= 1.15 AND ok / n >= 0.95 THEN 'success' ELSE 'degraded' END AS status, list_concat(CASE WHEN ratio >= 0.8 AND ratio <= 1.15 THEN CAST([] AS VARCHAR[]) ELSE ['length_ratio'] END, CASE WHEN ok / n >= 0.95 THEN CAST([] AS VARCHAR[]) ELSE ['coverage'] END) AS reasons FROM s JOIN m USING (rec_id)")
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    """Status of a run: the length ratio in [0.8, 1.15] and 95 % of segments covered; reasons where not."""
    s = seg(spark, d).groupBy("rec_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("text") != "", 1).otherwise(0)).alias("ok"))
    m = memo(spark, d).where("rec_id is not null").groupBy("rec_id").agg(F.sum("target_syllables").alias("t"), F.sum("source_syllables").alias("s"))
    # a source without syllables: infinite as in the SQL, NaN if the target has none either, and so degraded
    m = m.select("rec_id", F.when(F.col("s") == 0, F.col("t") * F.lit(float("inf"))).otherwise(F.col("t") / F.col("s")).alias("ratio"))
    rows = s.join(m, "rec_id").withColumn("c", F.col("ok") / F.col("n"))
    good, full = F.coalesce(F.col("ratio").between(0.8, 1.15), F.lit(False)), F.col("c") >= 0.95
    reasons = F.array_compact(F.array(F.when(~good, "length_ratio"), F.when(~full, "coverage")))
    return rows.select("rec_id", F.round("ratio", 6).alias("length_ratio"), F.round("c", 6).alias("covered"), F.when(good & full, "success").otherwise("degraded").alias("status"), reasons.alias("reasons"))
