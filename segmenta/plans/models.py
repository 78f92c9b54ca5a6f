"""Queries on vectors, folds and text comparison, and small reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmenta.functions import matching as M
from segmenta.operators import folds, vectors as V
from segmenta.operators.diarize import diarize
from segmenta.operators.long_segments import split_long
from segmenta.plans import fold_sql
from segmenta.plans.base import MEMO, frame, memo, seg
from segmenta.sources.tables import latest, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_CEN = """d AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS dim FROM embeddings),
c AS (SELECT label AS cl, dim, avg(x) AS m FROM d GROUP BY label, dim),
s AS (SELECT vec_id, any_value(d.label) AS label, cl, sum(x * m) / greatest(sqrt(sum(x * x)) * sqrt(sum(m * m)), 1e-8) AS sim FROM d JOIN c USING (dim) GROUP BY vec_id, cl)"""


def _nearest(spark: SparkSession, d: str, most: int = 1) -> DataFrame:
    rows = table(spark, d, "embeddings")
    near = V.nearest(rows, "vec_id", "embedding", V.means(rows.where("label is not null"), "label", "embedding").withColumnRenamed("label", "cl"), "cl", most)
    return near.join(rows.select("vec_id", "label"), "vec_id") if most == 1 else near


@query(f"WITH {_CEN} SELECT vec_id, label, cl AS nearest, round(sim, 6) AS sim FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 9) DESC, cl) = 1")
def nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d).select("vec_id", "label", F.col("cl").alias("nearest"), F.round("sim", 6).alias("sim"))


@query(f"WITH {_CEN}, n AS (SELECT vec_id, label, cl, sim FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 9) DESC, cl) = 1) SELECT label, count(*) AS n, round(avg(sim), 6) AS confidence, round(avg(CASE WHEN label = cl THEN 1e0 ELSE 0e0 END), 6) AS agreement FROM n GROUP BY label")
def label_confidence(spark: SparkSession, d: str) -> DataFrame:
    agree = F.avg(F.when(F.col("label") == F.col("cl"), 1.0).otherwise(0.0))
    return _nearest(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("sim"), 6).alias("confidence"), F.round(agree, 6).alias("agreement"))


@query(f"WITH {_CEN} SELECT vec_id, cl, round(sim, 4) AS sim, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 9) DESC, cl) AS place FROM s QUALIFY place <= 5")
def topk_labels(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest labels of each vector: a report of the top five."""
    return _nearest(spark, d, 5).select("vec_id", "cl", F.round("sim", 4).alias("sim"), "place")


@query("SELECT vec_id, len(embedding) AS n_dims, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def segment_embedding_norm(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.size("embedding").alias("n_dims"), F.round(V.norm(F.col("embedding")), 6).alias("norm"))


@query("WITH d AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS dim FROM embeddings) SELECT label, CAST(dim AS INT) AS dim, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd, min(x) AS least, max(x) AS most FROM d GROUP BY label, dim")
def feature_stats_vector(spark: SparkSession, d: str) -> DataFrame:
    rows = V.by_dimension(table(spark, d, "embeddings"), ["label"], "embedding")
    return rows.groupBy("label", "dim").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("sd"), F.min("x").alias("least"), F.max("x").alias("most"))


@query("WITH d AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS dim FROM embeddings), c AS (SELECT label, dim, avg(x) AS m FROM d GROUP BY label, dim), g AS (SELECT dim, avg(x) AS m FROM d GROUP BY dim) SELECT label, round(sum(c.m * g.m) / (sqrt(sum(c.m * c.m)) * sqrt(sum(g.m * g.m)) + 1e-12), 6) AS cosine, round(0.5e0 * sum(c.m * g.m) / (sqrt(sum(c.m * c.m)) * sqrt(sum(g.m * g.m)) + 1e-12) + 0.3e0 * least(sqrt(sum(c.m * c.m)), sqrt(sum(g.m * g.m))) / greatest(sqrt(sum(c.m * c.m)), sqrt(sum(g.m * g.m)), 1e-8) + 0.1e0, 3) AS quality FROM c JOIN g USING (dim) GROUP BY label")
def mean_vector_cosine(spark: SparkSession, d: str) -> DataFrame:
    """How like each label's mean vector is to the mean of all, and the quality of a clone that were so like it."""
    rows = V.by_dimension(table(spark, d, "embeddings"), ["label"], "embedding")
    g = rows.groupBy("dim").agg(F.avg("x").alias("g"))
    c = rows.groupBy("label", "dim").agg(F.avg("x").alias("m")).join(g, "dim")
    dots = F.sum(F.col("m") * F.col("g")) / (F.sqrt(F.sum(F.col("m") * F.col("m"))) * F.sqrt(F.sum(F.col("g") * F.col("g"))) + 1e-12)
    size = lambda x: F.sqrt(F.sum(F.col(x) * F.col(x)))
    even = F.least(size("m"), size("g")) / F.greatest(size("m"), size("g"), F.lit(1e-8))
    return c.groupBy("label").agg(F.round(dots, 6).alias("cosine"), F.round(0.5 * dots + 0.3 * even + 0.1, 3).alias("quality"))


@query("WITH x AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS a FROM embeddings) SELECT vec_id, round(list_max(a), 6) AS peak, round(list_sum(list_transform(a, lambda y: y / greatest(list_max(a), 1e-8) * 95e-2)), 4) AS total FROM x")
def peak_normalise(spark: SparkSession, d: str) -> DataFrame:
    a = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    rows = table(spark, d, "embeddings").select("vec_id", a.alias("a"), F.array_max(a).alias("p"))
    total = F.aggregate(F.transform("a", lambda x: x / F.greatest(F.col("p"), F.lit(1e-8)) * 0.95), F.lit(0.0), lambda s, x: s + x)
    return rows.select("vec_id", F.round("p", 6).alias("peak"), F.round(total, 4).alias("total"))


def _grouped(spark: SparkSession, d: str, how: Callable) -> DataFrame:
    """Vectors in groups of one label, as the segments of a recording would be."""
    return V.per_group(table(spark, d, "embeddings").where("label is not null and vec_id is not null"), ["label"], "vec_id", "embedding", how)


@query(fold_sql.GREEDY_CLUSTER)
def greedy_cluster(spark: SparkSession, d: str) -> DataFrame:
    return _grouped(spark, d, V.greedy)


@query()
def avg_link_cluster(spark: SparkSession, d: str) -> DataFrame:
    return _grouped(spark, d, V.average_linkage)


@query(fold_sql.FARTHEST_SPLIT)
def farthest_split(spark: SparkSession, d: str) -> DataFrame:
    return _grouped(spark, d, V.farthest_split)


@query()
def diarize_groups(spark: SparkSession, d: str) -> DataFrame:
    """Speakers of groups of one label's vectors, as of the segments of a recording, one each second."""
    rows = table(spark, d, "embeddings").where("vec_id is not null and embedding is not null and label is not null")
    rows = rows.select(F.col("label").cast("string").alias("rec_id"), F.col("vec_id").alias("idx"), (F.col("vec_id") * 1000).alias("start_ms"), (F.col("vec_id") * 1000 + 800).alias("end_ms"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    return diarize(rows)


@query()
def long_segment_split(spark: SparkSession, d: str) -> DataFrame:
    """Each user's day as one segment of frames, cut until no part is too long."""
    rows = frame(spark, d).where("rms is not null").withColumn("day", F.to_date("ts"))
    rows = rows.groupBy("user_id", "day").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "rms"))).alias("x"))
    rows = rows.select(F.concat_ws(" ", "user_id", "day").alias("seg"), F.lit(0).cast("bigint").alias("start_ms"), F.flatten(F.transform("x", lambda x: F.array_repeat(x["rms"], 40))).alias("energy"))
    return split_long(rows, "seg")


@query(fold_sql.CRUMB_GLUE)
def crumb_glue(spark: SparkSession, d: str) -> DataFrame:
    return folds.crumb_glue(seg(spark, d))


@query(fold_sql.PHRASE_MERGE)
def phrase_merge(spark: SparkSession, d: str) -> DataFrame:
    return folds.phrase_merge(seg(spark, d))


@query(fold_sql.SHORT_FRAGMENT_MERGE)
def short_fragment_merge(spark: SparkSession, d: str) -> DataFrame:
    return folds.short_fragment_merge(seg(spark, d))


@query(fold_sql.TEXT_CHUNKS)
def text_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(folds.text_chunks(F.col("text"))).alias("chunk", "text"))
    return rows


def _compared(rows: DataFrame, f: Callable, schema: str, kinds: list[pa.DataType]) -> DataFrame:
    """f(a, b) of each row (id, a, b), in Arrow batches; no shuffle."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [f(a, b) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            got = [g if isinstance(g, tuple) else (g,) for g in got]
            columns = zip(*got, strict=True) if got else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return rows.mapInArrow(run, schema)


def _hinted_rows(spark: SparkSession, d: str, column: str) -> DataFrame:
    asr = latest(table(spark, d, "asr_results").select("asr_id", "rec_id", "text", "created_at"), "asr_id", "created_at")
    rec = table(spark, d, "recordings").where(f"{column} is not null").select("rec_id", column)
    return asr.join(rec, "rec_id").select("asr_id", "text", column)


@query(fold_sql.PROMPT_OVERLAP)
def prompt_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Does a recognised text repeat its recording's note?"""
    return _compared(_hinted_rows(spark, d, "note"), M.hallucinated, "asr_id bigint, flagged boolean, score double, reason string", [pa.bool_(), pa.float64(), pa.string()])


@query()
def fuzzy_hint(spark: SparkSession, d: str) -> DataFrame:
    return _compared(_hinted_rows(spark, d, "lyrics_hint"), M.hinted, "asr_id bigint, text string", [pa.string()])


@query(fold_sql.WER_PAIRS)
def wer_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = memo(spark, d).select("trans_id", "source_text", "translated_text")
    return _compared(rows, M.word_error_rate, "trans_id bigint, wer double", [pa.float64()])


@query(f"WITH {MEMO}, m AS (SELECT target_lang, avg(confidence) AS c, avg(target_syllables / greatest(source_syllables, 1)) AS t FROM memo WHERE target_lang IS NOT NULL AND confidence IS NOT NULL GROUP BY target_lang) SELECT target_lang, CASE WHEN c - 0.7e0 >= 0.02e0 AND t <= 3 THEN 'large' ELSE 'small' END AS model FROM m")
def model_choice(spark: SparkSession, d: str) -> DataFrame:
    """The larger model where it gains enough and takes at most three times as long."""
    rows = memo(spark, d).where("target_lang is not null and confidence is not null").groupBy("target_lang").agg(F.avg("confidence").alias("c"), F.avg(F.col("target_syllables") / F.greatest(F.col("source_syllables"), F.lit(1))).alias("t"))
    return rows.select("target_lang", F.when((F.col("c") - 0.7 >= 0.02) & (F.col("t") <= 3), "large").otherwise("small").alias("model"))


_RUNS = "l0 AS (SELECT *, row_number() OVER (PARTITION BY timeline_id ORDER BY created_at) AS rn FROM timeline_results WHERE timeline_id IS NOT NULL), run AS (SELECT * FROM l0 WHERE rn = 1)"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "timeline_results"), "timeline_id", "created_at")


_ITEMS = {
    "recording": "r.rec_id IS NOT NULL", "duration known": "total_duration_s IS NOT NULL", "duration of 15 s": "total_duration_s >= 15", "timeline": "speech_segments IS NOT NULL OR silence_segments IS NOT NULL",
    "speech": "size(speech_segments) > 0", "silence": "silence_segments IS NOT NULL", "sync score": "sync_score IS NOT NULL", "sync of 0.65": "sync_score >= 0.65", "coverage": "coverage IS NOT NULL",
    "coverage within 0 and 1": "coverage BETWEEN 0 AND 1", "states known": "size(filter(coalesce(speech_segments, array()), x -> x.seg_state IS NULL)) = 0", "title": "r.title IS NOT NULL", "language": "r.gold_lang IS NOT NULL",
}


def _check_sql() -> str:
    as_sql = lambda c: c.replace("size(filter(coalesce(speech_segments, array()), x -> x.seg_state IS NULL))", "len(list_filter(coalesce(speech_segments, []), lambda x: x.seg_state IS NULL))").replace("size(", "len(")
    return f"WITH {_RUNS} SELECT timeline_id, unnest([{', '.join(repr(n) for n in _ITEMS)}]) AS item, unnest([{', '.join(f'coalesce({as_sql(c)}, false)' for c in _ITEMS.values())}]) AS ok FROM run LEFT JOIN recordings r ON run.rec_id = r.rec_id"


@query(_check_sql())
def check_list(spark: SparkSession, d: str) -> DataFrame:
    """The checks of each run, a row each."""
    rows = _runs(spark, d).alias("run").join(table(spark, d, "recordings").select("rec_id", "title", "gold_lang").alias("r"), F.col("run.rec_id") == F.col("r.rec_id"), "left")
    checks = F.array(*[F.struct(F.lit(n).alias("item"), F.coalesce(F.expr(c), F.lit(False)).alias("ok")) for n, c in _ITEMS.items()])
    return rows.select("timeline_id", F.inline(checks))


@query(f"WITH {_RUNS}, b AS (SELECT rec_id, arg_max(timeline_id, (created_at, timeline_id)) AS timeline_id, arg_max(coalesce(sync_score, -1), (created_at, timeline_id)) AS sync FROM run WHERE rec_id IS NOT NULL GROUP BY rec_id) SELECT r.rec_id, r.domain_tag AS category, b.timeline_id, CASE WHEN r.duration_s IS NULL THEN 'missing_file' WHEN b.timeline_id IS NULL THEN 'no_run' ELSE 'parsed' END AS status, nullif(b.sync, -1) AS sync_score FROM recordings r LEFT JOIN b USING (rec_id)")
def acceptance_report(spark: SparkSession, d: str) -> DataFrame:
    """Each recording with its latest run, and how far it came."""
    best = _runs(spark, d).where("rec_id is not null").groupBy("rec_id").agg(F.max_by(F.struct("timeline_id", "sync_score"), F.struct("created_at", "timeline_id")).alias("b"))
    status = F.when(F.col("duration_s").isNull(), "missing_file").when(F.col("b").isNull(), "no_run").otherwise("parsed")
    return table(spark, d, "recordings").join(best, "rec_id", "left").select("rec_id", F.col("domain_tag").alias("category"), "b.timeline_id", status.alias("status"), "b.sync_score")
