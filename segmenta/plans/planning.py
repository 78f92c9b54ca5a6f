"""Queries that plan a run: contexts, retries of blank translations, speakers' references, synthesis, trimming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmenta.functions import profiles as C
from segmenta.functions import rewrite as Y
from segmenta.operators import energy, folds
from segmenta.operators import islands as I
from segmenta.operators.ordered import beside, running, sequenced
from segmenta.plans.fold_sql import strip
from segmenta.plans.base import FRAME, SEG_ORDER, bucket, bucket_sql, frame, seg
from segmenta.plans.segments import _GROUPS, _MERGE
from segmenta.plans.texts import _PATH
from segmenta.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_NAMED = "CASE WHEN regexp_matches(name, 'talking_head|willkent|will_kent|english|_en_|[.]en[.]|wikidata|wikipedia') THEN 'en' WHEN regexp_matches(name, 'singing_|ruguaiawang|walkman|xiaoxiong|qianxia|real_dialog|dialog_|fleurs') THEN 'zh' END"


@query(f"""WITH r AS (SELECT rec_id, title, lyrics_hint, gold_lang, list_distinct(list_filter(coalesce(keywords, []), lambda x: x IS NOT NULL AND x <> '')) AS ks0, coalesce(keywords, []) AS kw, lower(trim(domain_tag, ' ')) AS asked, lower(regexp_extract({_PATH}, '[^/]*$')) AS name FROM recordings WHERE rec_id IS NOT NULL),
k AS (SELECT *, list_filter(kw, lambda x, i: x IS NOT NULL AND x <> '' AND list_position(kw, x) = i) AS ks, CASE WHEN asked IN ('neutral', 'singing', 'fleurs_dialog', 'video_talking') THEN asked WHEN coalesce(asked, '') = '' AND starts_with(name, 'singing_') THEN 'singing' ELSE 'neutral' END AS profile FROM r),
l AS (SELECT *, coalesce(nullif(gold_lang, ''), {_NAMED}, CASE WHEN profile = 'video_talking' THEN 'en' END) AS lang FROM k)
SELECT rec_id, profile, lang AS language, profile = 'singing' AS assume_single, CASE
 WHEN profile = 'singing' THEN '这是中文清唱，请按歌词逐字转写，不要写成对话摘要。' || CASE WHEN coalesce(title, '') <> '' THEN ' 歌曲《' || title || '》。' ELSE '' END || CASE WHEN coalesce(lyrics_hint, '') <> '' THEN ' 歌词包含：' || lyrics_hint || '。' ELSE '' END
 WHEN profile = 'neutral' AND (lang IS NULL OR split_part(lower(lang), '-', 1) IN ('zh', 'yue', 'chinese', 'cmn')) THEN '这是一段中文口语对话，请准确转写说话内容。' || CASE WHEN len(ks) > 0 THEN ' 可能出现的专名：' || array_to_string(ks[1:12], '、') || '。' ELSE '' END
 WHEN profile = 'neutral' THEN CASE WHEN len(ks) > 0 THEN 'Names that may appear: ' || array_to_string(ks[1:16], ', ') || '.' ELSE '' END END AS prompt FROM l""")
def run_context(spark: SparkSession, d: str) -> DataFrame:
    """Profile, language, whether one speaker is assumed, and prompt of each recording's run; its keywords are the names."""
    c = lambda n, other: F.coalesce(F.col(n), F.lit(other))
    rows = table(spark, d, "recordings").where("rec_id is not null")
    path = F.concat(F.lit("data/"), c("source", "x"), F.lit("/"), c("domain_tag", "x"), F.lit("_"), F.col("rec_id"), F.lit("_"), c("gold_lang", "xx"), F.lit("_.wav"))
    rows = rows.withColumn("profile", C.resolved(F.col("domain_tag"), F.regexp_replace(path, "^.*/", "")))
    rows = rows.withColumn("language", C.language(F.col("profile"), F.col("gold_lang"), Y.named_language(path)))
    text = C.prompt(F.col("profile"), F.col("language"), F.col("title"), F.col("lyrics_hint"), F.col("keywords"))
    return rows.select("rec_id", "profile", "language", (F.col("profile") == "singing").alias("assume_single"), text.alias("prompt"))


_BLANK = f"""{_MERGE}, g AS (SELECT rec_id, grp, any_value(speaker) AS speaker, string_agg(text, '' ORDER BY idx) AS text, CASE WHEN arg_min(coalesce(emotion, '?'), idx) IN ('?', 'sad') THEN '' ELSE string_agg(text, '' ORDER BY idx) END AS tgt FROM m3 GROUP BY rec_id, grp),
s AS (SELECT *, CASE WHEN lag(speaker) OVER (PARTITION BY rec_id ORDER BY grp) = speaker THEN 0 ELSE 1 END AS f FROM g), r AS (SELECT *, sum(f) OVER (PARTITION BY rec_id ORDER BY grp ROWS UNBOUNDED PRECEDING) AS run FROM s),
b AS (SELECT *, coalesce(sum(CASE WHEN {strip('tgt')} <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id, run ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bundle FROM r),
w AS (SELECT *, count(*) OVER p AS n, first_value(tgt) OVER q AS head, first_value(grp) OVER q AS lead, string_agg({strip('text')}, '') OVER (PARTITION BY rec_id, run, bundle ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS src FROM b WINDOW p AS (PARTITION BY rec_id, run, bundle), q AS (PARTITION BY rec_id, run, bundle ORDER BY grp))
SELECT rec_id, grp, CASE WHEN n > 1 AND {strip('head')} = '' AND src <> '' THEN CASE WHEN grp = lead THEN src ELSE '' END ELSE tgt END AS tgt, n > 1 AND {strip('head')} = '' AND src <> '' AS retried FROM w"""


def _blank_groups(spark: SparkSession, d: str) -> DataFrame:
    """Merge groups with a stand-in's translation, which fails where the first emotion is sad or unknown."""
    rows = I.merge_groups(seg(spark, d), SEG_ORDER).withColumn("feeling", F.coalesce("emotion", F.lit("?")))
    rows = rows.groupBy("rec_id", "grp").agg(F.min("shard").alias("shard"), F.first("speaker").alias("speaker"), F.min_by("feeling", "idx").alias("feeling"), F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("x"))
    text = F.array_join(F.transform("x", lambda x: x["text"]), "")
    return rows.select("rec_id", "shard", "grp", "speaker", text.alias("text"), F.when(F.col("feeling").isin("?", "sad"), "").otherwise(text).alias("tgt"))


@query(_BLANK)
def empty_retry(spark: SparkSession, d: str) -> DataFrame:
    return folds.retry_empty(_blank_groups(spark, d), lambda source: source)


_REFERENCE = f"""WITH {{SEG}}, b AS (SELECT *, {bucket_sql('emotion')} AS bucket, end_ms - start_ms AS dur FROM seg), t AS (SELECT rec_id, max(end_ms) AS total FROM seg GROUP BY rec_id),
p AS (SELECT rec_id, speaker, arg_min(bucket, idx) AS liked FROM b GROUP BY rec_id, speaker),
c AS (SELECT b.rec_id, b.speaker, b.idx, b.text, CASE WHEN dur > 8000 THEN greatest(start_ms, (start_ms + end_ms - 8000) // 2) ELSE start_ms END AS onset, dur, least(dur, 8000) AS len, least(greatest(coalesce(label_confidence, 0), 0), 1) * 2e-1 AS e, bucket, liked, domain_tag = 'singing' AS sung, total FROM b JOIN p USING (rec_id, speaker) JOIN t USING (rec_id) LEFT JOIN recordings r USING (rec_id)),
q AS (SELECT *, round((CASE WHEN len < 1000 THEN -5e0 WHEN len < 2000 THEN -1e0 ELSE least(len, 6000) * 3e-4 END) + (CASE WHEN e < 1e-2 THEN -4e0 ELSE least(e, 2e-1) * 10 END) + (CASE WHEN e > 0 THEN 5e-1 ELSE 0e0 END) - abs(dur - 5000) * 15e-5 + (CASE WHEN bucket = liked AND bucket <> 'neutral' THEN 1.5e0 ELSE 0e0 END) + (CASE WHEN sung AND (2 * onset + len) < 1.1e0 * total AND len BETWEEN 3000 AND 8000 THEN 2e0 ELSE 0e0 END), 6) AS score, len >= 1500 AND e >= 12e-3 AS ok FROM c),
r AS (SELECT *, sum(len) OVER w AS total_len FROM q WINDOW w AS (PARTITION BY rec_id, speaker ORDER BY score DESC, idx ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, CASE WHEN total_len >= 2000 AND (ok OR total_len >= 2400) OR total_len >= 8000 THEN 1 ELSE 0 END AS stop FROM r),
k AS (SELECT *, sum(stop) OVER (PARTITION BY rec_id, speaker ORDER BY score DESC, idx ROWS UNBOUNDED PRECEDING) - stop AS stopped FROM s)
SELECT rec_id, speaker, CAST(min(onset) AS BIGINT) AS onset_ms, CAST(max(onset + len) AS BIGINT) AS offset_ms, count(*) AS n_pieces, CAST(least(sum(len), 8000) AS BIGINT) AS total_ms, max(score) AS best, left(string_agg(text, ' ' ORDER BY score DESC, idx) FILTER (text <> ''), 200) AS said FROM k WHERE stopped = 0 GROUP BY rec_id, speaker"""


def _reference_sql() -> str:
    from segmenta.plans.base import SEG

    return _REFERENCE.replace("{SEG}", SEG)


@query(_reference_sql())
def speaker_reference(spark: SparkSession, d: str) -> DataFrame:
    """The best segments of each speaker of a recording as its reference: long ones clipped around their middle to eight seconds,
    scored by length, energy (the label's confidence stands for it), the mood of the speaker's first segment and, in songs,
    an early place; the best ones until two seconds are reached, and of their text 200 letters."""
    rows = seg(spark, d, ["start_ms"]).withColumn("bucket", bucket(F.col("emotion"))).withColumn("dur", F.col("end_ms") - F.col("start_ms"))
    song = table(spark, d, "recordings").where("rec_id is not null").select("rec_id", (F.col("domain_tag") == "singing").alias("sung"))
    whole = rows.groupBy("rec_id").agg(F.max("end_ms").alias("total")).join(song, "rec_id", "left")
    liked = rows.groupBy("rec_id", "speaker").agg(F.min_by("bucket", "idx").alias("liked"))
    rows = beside(beside(rows, whole, ["rec_id"], "shard"), liked, ["rec_id", "speaker"], "shard")
    size, e = F.least("dur", F.lit(8000)), F.least(F.greatest(F.coalesce("label_confidence", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) * 0.2
    rows = rows.withColumn("len", size).withColumn("e", e).withColumn("onset", F.when(F.col("dur") > 8000, F.greatest("start_ms", F.expr("(start_ms + end_ms - 8000) div 2"))).otherwise(F.col("start_ms")))
    score = F.when(F.col("len") < 1000, -5.0).when(F.col("len") < 2000, -1.0).otherwise(F.least("len", F.lit(6000)) * 3e-4) + F.when(F.col("e") < 0.01, -4.0).otherwise(F.least("e", F.lit(0.2)) * 10)
    score = score + F.when(F.col("e") > 0, 0.5).otherwise(0.0) - F.abs(F.col("dur") - 5000) * 15e-5 + F.when((F.col("bucket") == F.col("liked")) & (F.col("bucket") != "neutral"), 1.5).otherwise(0.0)
    early = F.col("sung") & (2 * F.col("onset") + F.col("len") < 1.1 * F.col("total")) & F.col("len").between(3000, 8000)
    rows = rows.withColumn("score", F.round(score + F.when(early, 2.0).otherwise(0.0), 6)).withColumn("ok", (F.col("len") >= 1500) & (F.col("e") >= 0.012))
    rows = rows.select("rec_id", "speaker", "idx", "text", "onset", "len", "score", "ok", (-F.col("score")).alias("low")).withColumn("shard", F.floor(F.col("low") * 16).cast("bigint"))
    keys, order = ["rec_id", "speaker"], ["low", "idx"]
    rows = running(rows, keys, "shard", order, F.col("len"), "sum_len")
    stop = ((F.col("sum_len") >= 2000) & (F.col("ok") | (F.col("sum_len") >= 2400))) | (F.col("sum_len") >= 8000)
    rows = running(rows.withColumn("stop", F.when(stop, 1).otherwise(0)), keys, "shard", order, F.col("stop"), "stops").where("stops - stop = 0")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("low", "idx", "text")))), lambda x: x["text"]), " ")
    out = rows.groupBy(*keys).agg(F.min("onset").alias("onset_ms"), F.max(F.col("onset") + F.col("len")).alias("offset_ms"), F.count(F.lit(1)).alias("n_pieces"), F.least(F.sum("len"), F.lit(8000)).cast("bigint").alias("total_ms"), F.max("score").alias("best"), said.alias("said"))
    return out.withColumn("said", F.nullif(F.left("said", F.lit(200)), F.lit("")))


_PLAN = (
    _GROUPS
    + r""", said AS (SELECT b5.rec_id, b5.grp, string_agg(CASE WHEN regexp_matches(b2.text, '[.!?。！？]$') THEN b2.text ELSE b2.text || '.' END, ' ' ORDER BY b2.idx) FILTER (b2.text <> '') AS said FROM b5 JOIN b2 USING (rec_id, base) GROUP BY b5.rec_id, b5.grp),
cut AS (SELECT *, list_transform(list_filter(string_split(regexp_replace(regexp_replace(said, '^[\s\x{000b}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x{000b}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '', 'g'), '([.!?。！？])[\s\x{000b}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[.!?。！？]$') THEN x ELSE x || '.' END) AS s FROM said),
ch AS (SELECT rec_id, grp, len(list_reduce(list_transform(s, lambda y: [{'l': length(y), 'n': 1}]), lambda acc, x: CASE WHEN acc[-1].l + x[1].l > 250 OR acc[-1].n >= 3 THEN acc || x ELSE acc[1:len(acc) - 1] || [{'l': acc[-1].l + 1 + x[1].l, 'n': acc[-1].n + 1}] END)) AS n_chunks FROM cut WHERE said IS NOT NULL AND len(s) > 0)
SELECT grp.rec_id, CAST(grp.grp AS BIGINT) AS grp, grp.speaker, grp.bucket, CAST(coalesce(n_chunks, 0) AS BIGINT) AS n_chunks, grp.end_ms - grp.start_ms AS source_ms, CASE WHEN grp.end_ms - grp.start_ms > 300 AND n_chunks > 0 THEN (grp.end_ms - grp.start_ms) // n_chunks END AS chunk_ms,
 CASE WHEN lead(grp.start_ms) OVER (PARTITION BY grp.rec_id ORDER BY grp.grp) IS NOT NULL THEN CAST(greatest(80, least(800, greatest(0, lead(grp.start_ms) OVER (PARTITION BY grp.rec_id ORDER BY grp.grp) - grp.end_ms))) AS BIGINT) END AS gap_ms FROM grp LEFT JOIN ch ON ch.rec_id = grp.rec_id AND ch.grp = grp.grp"""
)


@query(_PLAN)
def synthesis_plan(spark: SparkSession, d: str) -> DataFrame:
    """What is to be spoken: each group with its speaker and mood, the chunks its text is cut into, the time it took, the time
    each chunk should take, and the pause after it (none after the last)."""
    rows = seg(spark, d).withColumn("bucket", bucket(F.col("emotion")))
    groups = I.speaker_groups(rows, SEG_ORDER, text=True)
    groups = sequenced(groups, ["rec_id"], "shard", ["grp"], ["start_ms"])
    n, long = F.col("n_chunks"), F.col("end_ms") - F.col("start_ms")
    groups = groups.withColumn("n_chunks", F.size(folds.text_chunks(F.col("said"))).cast("bigint"))
    gap = F.when(F.col("next").isNotNull(), F.greatest(F.lit(80), F.least(F.lit(800), F.greatest(F.lit(0), F.col("next.start_ms") - F.col("end_ms")))).cast("bigint"))
    return groups.select("rec_id", "grp", "speaker", "bucket", "n_chunks", long.alias("source_ms"), F.when((long > 300) & (n > 0), F.expr("(end_ms - start_ms) div n_chunks")).alias("chunk_ms"), gap.alias("gap_ms"))


@query(f"""WITH {FRAME}, p AS (SELECT user_id, max(rms) AS peak FROM frame GROUP BY user_id)
SELECT user_id, CAST(min(idx) AS BIGINT) AS first_idx, CAST(max(idx) + 1 AS BIGINT) AS end_idx FROM frame JOIN p USING (user_id) WHERE rms > peak * pow(10e0, -1.5e0) GROUP BY user_id""")
def silence_trim(spark: SparkSession, d: str) -> DataFrame:
    """The first frame and the end of what is within 30 dB of each series' peak."""
    return energy.trimmed(frame(spark, d, ["rms"]), ["user_id"])
