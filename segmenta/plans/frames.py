"""Queries over energy series, timelines and ranked candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmenta.operators import energy
from segmenta.operators.intervals import best_span, points_in_spans
from segmenta.operators.ordered import beside, running
from segmenta.operators.quantiles import percentiles
from segmenta.operators.run_bitmaps import periods
from segmenta.operators.runs import value_runs
from segmenta.plans.base import FRAME, FRAME_ORDER, MEMO, SEG, frame, memo, seg
from segmenta.sources.tables import latest, millis, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_KEY = ["user_id"]


@query(f"WITH {FRAME}, r AS (SELECT *, idx - row_number() OVER (PARTITION BY user_id, rms >= 100 ORDER BY idx) AS g FROM frame WHERE rms IS NOT NULL) SELECT user_id, rms >= 100 AS loud, min(idx) AS start_idx, count(*) AS n_frames FROM r GROUP BY user_id, rms >= 100, g")
def state_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = frame(spark, d, ["rms"]).where("rms is not null").withColumn("loud", F.col("rms") >= 100).select("user_id", "shard", "idx", "loud")
    return value_runs(rows, _KEY, "shard", ["idx"], "loud").select("user_id", "loud", F.col("head.idx").alias("start_idx"), F.col("n_rows").alias("n_frames"))


def _voiced(spark: SparkSession, d: str) -> DataFrame:
    return energy.voiced(frame(spark, d, ["rms"]), _KEY, raw=frame(spark, d))


_VAD = f"""WITH {FRAME}, p AS (SELECT user_id, quantile_cont(rms, 0.2) AS p20, quantile_cont(rms, 0.5) AS p50, quantile_cont(rms, 0.8) AS p80, max(rms) AS peak, count(*) AS n FROM frame GROUP BY user_id),
t AS (SELECT *, greatest(p20 * 1.8, p50 * 0.35, p20 + (p80 - p20) * 0.15) AS thr FROM p),
m AS (SELECT f.*, peak, n, max(CASE WHEN rms > thr THEN 1 ELSE 0 END) OVER (PARTITION BY f.user_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS mask FROM frame f JOIN t USING (user_id)),
r AS (SELECT *, idx - row_number() OVER (PARTITION BY user_id, mask ORDER BY idx) AS g FROM m),
v0 AS (SELECT user_id, min(idx) AS start, max(idx) + 1 AS "end", least(1.0, avg(rms) / (any_value(peak) + 1e-8) * 1.5) AS openness, any_value(n) AS n FROM r WHERE mask = 1 GROUP BY user_id, g HAVING count(*) >= 3),
v AS (SELECT * FROM v0 UNION ALL SELECT user_id, 0, n, 0.5, n FROM p WHERE user_id NOT IN (SELECT user_id FROM v0)),
x AS (SELECT *, coalesce(lag("end") OVER w, 0) AS pe, lead(start) OVER w AS ns FROM v WINDOW w AS (PARTITION BY user_id ORDER BY start)),
filled AS (SELECT user_id, start, "end", 'open' AS state, openness FROM v UNION ALL SELECT user_id, pe, start, 'closed', 0.05 FROM x WHERE start > pe + 3 UNION ALL SELECT user_id, "end", n, 'closed', 0.05 FROM x WHERE ns IS NULL AND "end" < n - 3)
"""


@query(_VAD + 'SELECT user_id, start, "end", round(openness, 6) AS openness FROM v')
def vad_segments(spark: SparkSession, d: str) -> DataFrame:
    return _voiced(spark, d).select("user_id", "start", "end", F.round("openness", 6).alias("openness"))


def _filled(spark: SparkSession, d: str) -> DataFrame:
    return energy.filled(_voiced(spark, d), _KEY)


@query(_VAD + 'SELECT user_id, start, "end", state, round(openness, 6) AS openness FROM filled')
def vad_gap_fill(spark: SparkSession, d: str) -> DataFrame:
    return _filled(spark, d).select("user_id", "start", "end", "state", F.round("openness", 6).alias("openness"))


@query(_VAD + """SELECT user_id, round(count(*) FILTER (state = 'open') / count(*), 3) AS open_ratio, round(CAST(sum(CASE WHEN state = 'open' THEN "end" - start ELSE 0 END) AS DOUBLE) / sum("end" - start), 6) AS open_time,
 sum(CASE WHEN state = 'open' THEN "end" - start ELSE 0 END) / sum("end" - start) > 0.95 OR count(*) FILTER (state = 'open') = 0 AS need_vad FROM filled GROUP BY user_id""")
def open_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Share of open stretches, by number and by time, and whether the states tell nothing apart."""
    opened, long = F.sum(F.when(F.col("state") == "open", 1).otherwise(0)), F.col("end") - F.col("start")
    share = F.sum(F.when(F.col("state") == "open", long).otherwise(0)) / F.sum(long)
    return _filled(spark, d).groupBy("user_id").agg(F.round(opened / F.count(F.lit(1)), 3).alias("open_ratio"), F.round(share, 6).alias("open_time"), ((share > 0.95) | (opened == 0)).alias("need_vad"))


@query(_VAD + """, seg AS (SELECT *, "end" - start > 5 AND state = 'open' AS core FROM filled)
SELECT s.user_id, s.start, s.state, count(*) AS n_frames, CAST(sum(CAST(round(f.rms * 100) AS BIGINT)) * 10000 // count(*) AS BIGINT) AS mean_micro, max(f.rms) AS max_rms, s.core AS is_speech_core, s.state IN ('open', 'transition') AS needs_lip_sync
 FROM seg s JOIN frame f ON f.user_id = s.user_id AND f.idx >= s.start AND f.idx < s."end" GROUP BY ALL""")
def state_openness_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Mean (in millionths, from whole hundredths) and greatest energy of the frames in each state segment, whether it is the
    core of speech (open for more than 50 ms) and whether lips have to follow it. By a binned range join, as closed segments
    are known only by their bounds."""
    rows = frame(spark, d, ["rms"])
    states = energy.filled(energy.voiced(rows, _KEY, raw=frame(spark, d)), _KEY).select("user_id", "start", "end", "state")
    inside = points_in_spans(rows.select("user_id", "idx", "rms"), states, _KEY, "idx", "start", "end", 1024)
    out = inside.groupBy("user_id", "start", "end", "state").agg(F.count(F.lit(1)).alias("n_frames"), F.expr("sum(cast(round(rms * 100) as bigint)) * 10000 div count(1)").alias("mean_micro"), F.max("rms").alias("max_rms"))
    core = (F.col("state") == "open") & (F.col("end") - F.col("start") > 5)
    return out.select("user_id", "start", "state", "n_frames", "mean_micro", "max_rms", core.alias("is_speech_core"), F.col("state").isin("open", "transition").alias("needs_lip_sync"))


@query(_VAD + """, pk AS (SELECT v.user_id, v.start, v."end", arg_max(f.idx, (f.rms, -f.idx)) AS peak_idx, max(f.rms) AS peak, CAST(sum(CAST(round(f.rms * 100) AS BIGINT)) * 10000 // count(*) AS BIGINT) AS mean_micro
 FROM v JOIN frame f ON f.user_id = v.user_id AND f.idx >= v.start AND f.idx < v."end" WHERE f.rms IS NOT NULL GROUP BY ALL) SELECT user_id, start, "end", peak_idx, peak, mean_micro FROM pk""")
def openness_peaks(spark: SparkSession, d: str) -> DataFrame:
    """The first frame of the greatest energy in each speech run, as sync points take it, and the run's mean."""
    rows = frame(spark, d, ["rms"]).where("rms is not null").select("user_id", "idx", "rms")
    inside = points_in_spans(rows, _voiced(spark, d).select("user_id", "start", "end", F.expr("hundredths * 10000 div (end - start)").alias("mean_micro")), _KEY, "idx", "start", "end", 1024)
    best = inside.groupBy("user_id", "start", "end", "mean_micro").agg(F.min_by(F.struct("idx", "rms"), F.struct((-F.col("rms")).alias("r"), "idx")).alias("b"))
    return best.select("user_id", "start", "end", F.col("b.idx").alias("peak_idx"), F.col("b.rms").alias("peak"), "mean_micro")


@query(f"""WITH {FRAME}, t AS (SELECT user_id, greatest(quantile_cont(rms, 0.2) * 1.2, max(rms) * 0.08) AS thr, count(*) AS n FROM frame GROUP BY user_id),
r AS (SELECT f.*, n, idx - row_number() OVER (PARTITION BY f.user_id, rms < thr ORDER BY idx) AS g, rms < thr AS silent FROM frame f JOIN t USING (user_id))
SELECT user_id, (min(idx) + max(idx) + 1) / 2.0 AS cut FROM r WHERE silent GROUP BY user_id, g HAVING count(*) >= 2 AND (min(idx) + max(idx) + 1) / 2.0 >= 5 AND (min(idx) + max(idx) + 1) / 2.0 <= any_value(n) - 5""")
def silence_cuts(spark: SparkSession, d: str) -> DataFrame:
    """Middles of the silent runs of two frames at least that lie five frames inside."""
    rows = frame(spark, d, ["rms"])
    p = percentiles(frame(spark, d), _KEY, "rms", {"p20": 0.2}, summary=True)
    thr = p.select("user_id", F.greatest(F.col("p20") * 1.2, F.col("peak") * 0.08).alias("thr"), F.col("n_frames").alias("n"))
    marked = beside(rows, thr, _KEY, "shard", "inner").withColumn("silent", F.col("rms") < F.col("thr")).select("user_id", "shard", "idx", "silent")
    runs = value_runs(marked, _KEY, "shard", ["idx"], "silent").where("silent and n_rows >= 2").join(thr, "user_id")
    cut = F.col("head.idx") + F.col("n_rows") / 2.0
    return runs.where((cut >= 5) & (cut <= F.col("n") - 5)).select("user_id", cut.alias("cut"))


_PAD = 5


@query(f"""WITH {FRAME}, n AS (SELECT user_id, count(*) AS total FROM frame GROUP BY user_id), d AS (SELECT user_id, CAST(ts AS DATE) AS day, min(idx) AS a, max(idx) + 1 AS b FROM frame GROUP BY ALL),
s AS (SELECT d.user_id, day, a, b, total, greatest(0, a - 5) AS pa, least(total, b + 5) AS pb FROM d JOIN n USING (user_id)),
j AS (SELECT s.*, f.idx, f.rms, max(f.rms) OVER (PARTITION BY s.user_id, s.day) AS peak FROM s JOIN frame f ON f.user_id = s.user_id AND f.idx >= s.pa AND f.idx < s.pb),
h AS (SELECT user_id, day, a, b, min(CASE WHEN peak > 1e-6 AND rms > 0.25 * peak THEN idx END) AS x, max(CASE WHEN peak > 1e-6 AND rms > 0.25 * peak THEN idx END) + 1 AS y FROM j GROUP BY user_id, day, a, b)
SELECT user_id, day, round(coalesce(x, a) * 1e-2, 3) AS onset_s, round(coalesce(y, b) * 1e-2, 3) AS offset_s FROM h""")
def onset_offset_trim(spark: SparkSession, d: str) -> DataFrame:
    """Where speech of each user's day begins and ends: the first and last frame, from five before it to five after it, above a
    quarter of the greatest of these; its own bounds where none is. A frame takes 10 ms."""
    rows = frame(spark, d, ["rms"]).select("user_id", "ts", "idx", "rms", "shard")
    day = rows.withColumn("day", F.to_date("ts")).groupBy("user_id", "day").agg(F.min("idx").alias("a"), (F.max("idx") + 1).alias("b"))
    total = day.groupBy("user_id").agg(F.max("b").alias("total"))
    spans = day.join(total, "user_id").select("user_id", "day", "a", "b", F.greatest(F.lit(0), F.col("a") - _PAD).alias("pa"), F.least("total", F.col("b") + _PAD).alias("pb"))
    inside = points_in_spans(rows.select("user_id", "idx", "rms"), spans, _KEY, "idx", "pa", "pb", 1024).select("user_id", "day", "a", "b", "idx", "rms")
    peak = inside.groupBy("user_id", "day").agg(F.max("rms").alias("peak"))
    hit = F.when((F.col("peak") > 1e-6) & (F.col("rms") > 0.25 * F.col("peak")), F.col("idx"))
    out = inside.join(peak, ["user_id", "day"]).groupBy("user_id", "day", "a", "b").agg(F.min(hit).alias("x"), (F.max(hit) + 1).alias("y"))
    return out.select("user_id", "day", F.round(F.coalesce("x", "a") * 0.01, 3).alias("onset_s"), F.round(F.coalesce("y", "b") * 0.01, 3).alias("offset_s"))


@query("""WITH m AS (SELECT event_type, user_id, median(value) AS f0 FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL GROUP BY event_type, user_id HAVING count(*) > 3),
q AS (SELECT event_type, quantile_cont(f0, 0.25) AS a, quantile_cont(f0, 0.75) AS b FROM m GROUP BY event_type)
SELECT event_type, user_id, round(f0, 6) AS f0, CASE WHEN b - a < 12 THEN 0 WHEN f0 > (a + b) / 2 THEN 1 ELSE 0 END AS label FROM m JOIN q USING (event_type)""")
def f0_split(spark: SparkSession, d: str) -> DataFrame:
    """Median pitch per segment (more than three frames), split in two at the middle of the quartiles if they are apart."""
    rows = table(spark, d, "events").where("value is not null and user_id is not null")
    many = rows.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n")).where("n > 3")
    m = percentiles(rows, ["event_type", "user_id"], "value", {"f0": 0.5}).join(many, ["event_type", "user_id"], "left_semi")
    q = percentiles(m, ["event_type"], "f0", {"a": 0.25, "b": 0.75})
    label = F.when(F.col("b") - F.col("a") < 12, 0).when(F.col("f0") > (F.col("a") + F.col("b")) / 2, 1).otherwise(0)
    return m.join(q, "event_type").select("event_type", "user_id", F.round("f0", 6).alias("f0"), label.alias("label"))


@query(f"""WITH {FRAME}, x AS (SELECT user_id, rms / 490.0 AS y FROM frame WHERE rms IS NOT NULL), a AS (SELECT user_id, count(*) * 2e-2 AS dur, sqrt(avg(y * y) + 1e-12) AS e, max(abs(y)) AS peak, avg(CASE WHEN abs(y) > 0.99 THEN 1.0 ELSE 0.0 END) AS clip FROM x GROUP BY user_id),
s AS (SELECT x.user_id, avg(CASE WHEN abs(y) < e * 0.15 + 1e-6 THEN 1.0 ELSE 0.0 END) AS silent FROM x JOIN a USING (user_id) GROUP BY x.user_id)
SELECT user_id, round(dur, 3) AS duration, round(e, 5) AS energy, round(clip, 4) AS clip_ratio, round(silent, 3) AS silence_ratio,
 round((CASE WHEN dur < 1.0 THEN -5.0 WHEN dur < 2.0 THEN -1.0 ELSE least(dur, 6.0) * 0.3 END) + (CASE WHEN e < 0.01 THEN -4.0 ELSE least(e, 0.2) * 10.0 END) - (CASE WHEN clip > 0.02 THEN 3.0 ELSE 0 END) - (CASE WHEN silent > 0.55 THEN 2.0 ELSE 0 END) + (CASE WHEN peak > 0 THEN 0.5 ELSE 0 END), 6) AS score,
 dur >= 1.5 AND e >= 0.012 AND clip <= 0.05 AND silent <= 0.65 AS ok FROM a JOIN s USING (user_id)""")
def reference_quality(spark: SparkSession, d: str) -> DataFrame:
    """Duration, energy, clipping and silence of a clip as one score, and whether it may serve as a reference."""
    x = frame(spark, d).where("rms is not null").select("user_id", (F.col("rms") / 490.0).alias("y"))
    a = x.groupBy("user_id").agg((F.count(F.lit(1)) * 0.02).alias("dur"), F.sqrt(F.avg(F.col("y") * F.col("y")) + 1e-12).alias("e"), F.max(F.abs("y")).alias("peak"), F.avg(F.when(F.abs("y") > 0.99, 1.0).otherwise(0.0)).alias("clip"))
    s = x.join(a, "user_id").groupBy("user_id").agg(F.avg(F.when(F.abs("y") < F.col("e") * 0.15 + 1e-6, 1.0).otherwise(0.0)).alias("silent"))
    dur, e, clip, silent = (F.col(c) for c in ("dur", "e", "clip", "silent"))
    score = F.when(dur < 1.0, -5.0).when(dur < 2.0, -1.0).otherwise(F.least(dur, F.lit(6.0)) * 0.3) + F.when(e < 0.01, -4.0).otherwise(F.least(e, F.lit(0.2)) * 10.0)
    score = score - F.when(clip > 0.02, 3.0).otherwise(0.0) - F.when(silent > 0.55, 2.0).otherwise(0.0) + F.when(F.col("peak") > 0, 0.5).otherwise(0.0)
    ok = (dur >= 1.5) & (e >= 0.012) & (clip <= 0.05) & (silent <= 0.65)
    return a.join(s, "user_id").select("user_id", F.round(dur, 3).alias("duration"), F.round(e, 5).alias("energy"), F.round(clip, 4).alias("clip_ratio"), F.round(silent, 3).alias("silence_ratio"), F.round(score, 6).alias("score"), ok.alias("ok"))


_PICK = """WITH c AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice AS score, l_quantity AS size, l_discount <= 0.05 AS ok FROM lineitem),
r AS (SELECT *, sum(size) OVER w AS total FROM c WINDOW w AS (PARTITION BY l_suppkey ORDER BY score DESC, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, CASE WHEN total >= 60 AND (ok OR total >= 72) OR total >= 200 THEN 1 ELSE 0 END AS stop FROM r),
picked AS (SELECT * FROM (SELECT *, sum(stop) OVER (PARTITION BY l_suppkey ORDER BY score DESC, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) - stop AS stopped FROM s) WHERE stopped = 0)
"""


def _picked(spark: SparkSession, d: str, least: float = 60, most: float = 200) -> DataFrame:
    """The best-ranked candidates of each key up to the row where their sizes suffice, that row included."""
    rows = table(spark, d, "lineitem").where("l_suppkey is not null").select("l_suppkey", "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("score"), F.col("l_quantity").alias("size"), (F.col("l_discount") <= 0.05).alias("ok"))
    rows = rows.withColumn("low", -F.col("score")).withColumn("shard", F.floor(F.col("low") / 1000).cast("bigint"))
    order = ["low", "l_orderkey", "l_linenumber"]
    rows = running(rows, ["l_suppkey"], "shard", order, F.col("size"), "total")
    stop = F.when((F.col("total") >= least) & (F.col("ok") | (F.col("total") >= least * 1.2)) | (F.col("total") >= most), 1).otherwise(0)
    rows = rows.withColumn("stop", stop)
    return running(rows, ["l_suppkey"], "shard", order, F.col("stop"), "stops").where(F.col("stops") - F.col("stop") == 0)


@query(_PICK + "SELECT l_suppkey, l_orderkey, l_linenumber, score, total FROM picked")
def reference_pick_prefix(spark: SparkSession, d: str) -> DataFrame:
    return _picked(spark, d).select("l_suppkey", "l_orderkey", "l_linenumber", "score", "total")


@query(_PICK + "SELECT l_suppkey, count(*) AS n_pieces, round(least(sum(size), 200.0), 6) AS total, round(min(score), 6) AS least_score, NOT bool_or(ok) AS weak FROM picked GROUP BY l_suppkey")
def reference_pick_full(spark: SparkSession, d: str) -> DataFrame:
    """What the picked candidates of each key amount to; weak if none of them is good."""
    return _picked(spark, d).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_pieces"), F.round(F.least(F.sum("size"), F.lit(200.0)), 6).alias("total"), F.round(F.min("score"), 6).alias("least_score"), (~F.bool_or("ok")).alias("weak"))


@query("""WITH a AS (SELECT l_suppkey, l_orderkey, l_linenumber, min(pri) AS pri FROM (SELECT l_suppkey, l_orderkey, l_linenumber, 0 AS pri FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_suppkey, l_orderkey, l_linenumber, 1 FROM lineitem) GROUP BY ALL) SELECT l_suppkey, pri, count(*) AS n FROM a GROUP BY l_suppkey, pri""")
def pool_union_distinct(spark: SparkSession, d: str) -> DataFrame:
    """A preferred pool, then the rest that is not in it yet: how many of each."""
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag")
    pool = rows.where("l_returnflag = 'R'").withColumn("pri", F.lit(0)).unionByName(rows.withColumn("pri", F.lit(1)))
    return pool.groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(F.min("pri").alias("pri")).groupBy("l_suppkey", "pri").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {FRAME}, n AS (SELECT user_id, count(*) AS n FROM frame GROUP BY user_id), w AS (SELECT DISTINCT user_id, CASE WHEN n > 40 THEN CAST(floor(k * (n - 1) / 19.0) AS BIGINT) ELSE k END AS idx FROM n, (SELECT unnest(range(0, 100000)) AS k) WHERE CASE WHEN n > 40 THEN k < 20 ELSE k < n END)
SELECT f.user_id, f.idx, f.rms FROM frame f JOIN w USING (user_id, idx)""")
def linspace_thin(spark: SparkSession, d: str) -> DataFrame:
    """Twenty evenly spaced frames of each series of more than forty; shorter ones stay whole."""
    rows = frame(spark, d, ["rms"])
    n = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    even = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: F.floor(k * (F.col("n") - 1) / 19.0).cast("bigint"))
    kept = n.where("n > 40").select("user_id", F.explode(F.array_distinct(even)).alias("idx"))
    long = rows.join(kept, ["user_id", "idx"], "left_semi")
    short = rows.join(n.where("n <= 40"), "user_id", "left_semi")
    return long.unionByName(short).select("user_id", "idx", "rms")


@query(f"WITH {FRAME} SELECT user_id, round(exp(avg(ln(rms + 1e-10))) / avg(rms + 1e-10), 6) AS flatness, round(sqrt(avg(rms * rms)), 6) AS energy FROM frame GROUP BY user_id")
def spectral_flatness_analog(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("rms") + 1e-10
    return frame(spark, d).groupBy("user_id").agg(F.round(F.exp(F.avg(F.ln(x))) / F.avg(x), 6).alias("flatness"), F.round(F.sqrt(F.avg(F.col("rms") * F.col("rms"))), 6).alias("energy"))


LINES = """line0 AS (SELECT *, row_number() OVER (PARTITION BY timeline_id ORDER BY created_at) AS rn FROM timeline_results WHERE timeline_id IS NOT NULL),
item AS (SELECT timeline_id, x.start_s AS start_s, x.end_s AS end_s, x.seg_state AS state, x.openness AS openness FROM (SELECT timeline_id, unnest(list_concat(coalesce(speech_segments, []), coalesce(silence_segments, []))) AS x FROM line0 WHERE rn = 1)),
ms AS (SELECT DISTINCT timeline_id, CAST(round(start_s * 1000) AS BIGINT) AS start_ms, CAST(round(end_s * 1000) AS BIGINT) AS end_ms, state, openness FROM item WHERE start_s IS NOT NULL AND end_s IS NOT NULL)"""


def items(spark: SparkSession, d: str) -> DataFrame:
    """The different items of both arrays of each timeline, in milliseconds."""
    rows = latest(table(spark, d, "timeline_results"), "timeline_id", "created_at")
    both = F.concat(F.coalesce("speech_segments", F.array()), F.coalesce("silence_segments", F.array()))
    rows = rows.select("timeline_id", F.explode(both).alias("x")).select("timeline_id", millis(F.col("x.start_s")).alias("start_ms"), millis(F.col("x.end_s")).alias("end_ms"), F.col("x.seg_state").alias("state"), F.col("x.openness").alias("openness"))
    return rows.where("start_ms is not null and end_ms is not null").distinct()


_SPLIT = LINES + """, cls AS (SELECT *, CASE WHEN state = 'open' THEN 'speech' WHEN state = 'closed' AND end_ms - start_ms >= 30 THEN 'silence' WHEN state NOT IN ('open', 'closed') AND end_ms - start_ms >= 50 THEN 'speech' END AS kind FROM ms WHERE end_ms > start_ms)"""


def _split(spark: SparkSession, d: str) -> DataFrame:
    long, state = F.col("end_ms") - F.col("start_ms"), F.col("state")
    kind = F.when(state == "open", "speech").when((state == "closed") & (long >= 30), "silence").when(~state.isin("open", "closed") & (long >= 50), "speech")
    return items(spark, d).where("end_ms > start_ms").withColumn("kind", kind)


_RATIO = f"""{MEMO}, m AS (SELECT rec_id, sum(target_syllables) AS t, sum(source_syllables) AS s FROM memo WHERE rec_id IS NOT NULL AND source_syllables IS NOT NULL AND target_syllables IS NOT NULL GROUP BY rec_id HAVING sum(source_syllables) > 0),
tr AS (SELECT DISTINCT timeline_id, rec_id FROM line0 WHERE rn = 1)"""


@query(f"WITH {_SPLIT}, {_RATIO} SELECT timeline_id, kind, CASE WHEN kind = 'speech' AND s IS NOT NULL THEN CAST(start_ms * t // s AS BIGINT) ELSE start_ms END AS start_ms, CASE WHEN kind = 'speech' AND s IS NOT NULL THEN CAST(end_ms * t // s AS BIGINT) ELSE end_ms END AS end_ms, kind = 'speech' AND s IS NOT NULL AS is_scaled FROM cls JOIN tr USING (timeline_id) LEFT JOIN m USING (rec_id) WHERE kind IS NOT NULL")
def speech_silence_scaled(spark: SparkSession, d: str) -> DataFrame:
    """Speech and silence of a timeline; speech is scaled by the syllables of its recording's translations over those of their
    sources, where these are known, silence is not, which a flag says."""
    speech = (F.col("kind") == "speech") & F.col("s").isNotNull()
    scaled = lambda c: F.when(speech, F.expr(f"cast(floor({c} * t / s) as bigint)")).otherwise(F.col(c)).alias(c)
    m = memo(spark, d).where("rec_id is not null and source_syllables is not null and target_syllables is not null").groupBy("rec_id").agg(F.sum("target_syllables").alias("t"), F.sum("source_syllables").alias("s")).where("s > 0")
    runs = latest(table(spark, d, "timeline_results").select("timeline_id", "rec_id", "created_at"), "timeline_id", "created_at").select("timeline_id", "rec_id")
    rows = _split(spark, d).where("kind is not null").join(runs.join(m, "rec_id", "left").select("timeline_id", "t", "s"), "timeline_id", "left")
    return rows.select("timeline_id", "kind", scaled("start_ms"), scaled("end_ms"), speech.alias("is_scaled"))


_POINTS = f"""{_SPLIT}, sp AS (SELECT * FROM cls WHERE kind = 'speech'),
points AS (SELECT timeline_id, (start_ms + end_ms) // 2 AS at_ms, 'openness_peak' AS kind, openness AS value FROM sp UNION ALL SELECT timeline_id, start_ms, 'speech_start', openness FROM sp UNION ALL SELECT timeline_id, end_ms, 'speech_end', openness FROM sp
 UNION ALL SELECT timeline_id, start_ms + (end_ms - start_ms) // 4, CASE WHEN openness > 0.45 THEN 'core_vowel' ELSE 'vowel' END, openness FROM sp)"""


def _points(spark: SparkSession, d: str) -> DataFrame:
    sp = _split(spark, d).where("kind = 'speech'")
    a, b = F.col("start_ms"), F.col("end_ms")
    point = lambda at, kind: F.struct(at.cast("bigint").alias("at_ms"), kind.alias("kind"), F.col("openness").alias("value"))
    vowel = F.when(F.col("openness") > 0.45, "core_vowel").otherwise("vowel")
    return sp.select("timeline_id", F.inline(F.array(point(F.floor((a + b) / 2), F.lit("openness_peak")), point(a, F.lit("speech_start")), point(b, F.lit("speech_end")), point(a + F.floor((b - a) / 4), vowel))))


@query(f"WITH {_POINTS} SELECT timeline_id, at_ms, kind, value FROM points")
def sync_points(spark: SparkSession, d: str) -> DataFrame:
    return _points(spark, d)


_UNI = "(SELECT timeline_id, coalesce(1.0 - least(stddev_pop(g) / greatest(avg(g), 0.01), 1.0), 0.45) AS uni FROM (SELECT timeline_id, (at_ms - lag(at_ms) OVER (PARTITION BY timeline_id ORDER BY at_ms)) / 1000.0 AS g FROM {src}) WHERE g > 1e-4 GROUP BY timeline_id)"


@query(f"""WITH {_POINTS}, c AS (SELECT timeline_id, count(*) FILTER (kind = 'core_vowel') AS core, count(*) FILTER (kind IN ('core_vowel', 'vowel')) AS vow, count(*) FILTER (kind = 'openness_peak') AS peak FROM points GROUP BY timeline_id),
span AS (SELECT timeline_id, greatest(max(end_ms) / 1000.0, 0.01) AS span, sum(end_ms - start_ms) / 1000.0 AS talk FROM sp GROUP BY timeline_id),
anc AS (SELECT p.timeline_id, p.at_ms FROM points p JOIN c USING (timeline_id) WHERE CASE WHEN core >= 2 THEN kind = 'core_vowel' WHEN vow >= 2 THEN kind IN ('core_vowel', 'vowel') WHEN peak >= 2 THEN kind = 'openness_peak' ELSE kind IN ('speech_start', 'openness_peak', 'vowel', 'core_vowel') END),
an AS (SELECT timeline_id, at_ms, row_number() OVER (PARTITION BY timeline_id ORDER BY at_ms) - 1 AS i, count(*) OVER (PARTITION BY timeline_id) AS n, greatest(4, CAST(floor(span / 0.85) AS BIGINT)) AS ideal FROM anc JOIN span USING (timeline_id)),
thin AS (SELECT timeline_id, at_ms FROM an WHERE NOT (n >= 4 AND n > ideal * 2) UNION ALL SELECT an.timeline_id, at_ms FROM an JOIN (SELECT timeline_id, CAST(floor(k * (n - 1) / (ideal - 1.0)) AS BIGINT) AS i FROM (SELECT DISTINCT timeline_id, n, ideal FROM an WHERE n >= 4 AND n > ideal * 2), (SELECT unnest(range(0, 5000)) AS k) WHERE k < ideal) w USING (timeline_id, i)),
pk AS (SELECT timeline_id, at_ms FROM points WHERE kind = 'openness_peak'),
f AS (SELECT timeline_id, least(talk / span, 1.0) AS cov, coalesce(u.uni, 0.45) AS uni, coalesce(v.uni, 0.45) AS puni, peak, span,
 (CASE WHEN core > 0 THEN core WHEN vow > 0 THEN vow ELSE peak END) / span AS dens, peak / span AS pdens FROM span JOIN c USING (timeline_id) LEFT JOIN {_UNI.format(src='thin')} u USING (timeline_id) LEFT JOIN {_UNI.format(src='pk')} v USING (timeline_id)),
g AS (SELECT *, CASE WHEN dens < 0.3 THEN dens / 0.3 WHEN dens <= 4.0 THEN 1.0 ELSE greatest(0.55, 1.0 - (dens - 4.0) / 10.0) END AS ds, CASE WHEN pdens < 0.3 THEN pdens / 0.3 WHEN pdens <= 4.0 THEN 1.0 ELSE greatest(0.55, 1.0 - (pdens - 4.0) / 10.0) END AS pds FROM f)
SELECT timeline_id, round(cov, 6) AS coverage, round(uni, 6) AS uniformity, round(greatest(0.40 * cov + 0.35 * uni + 0.25 * ds, CASE WHEN peak >= 2 THEN 0.40 * cov + 0.35 * puni + 0.25 * pds ELSE 0 END), 6) AS score FROM g""")
def sync_score(spark: SparkSession, d: str) -> DataFrame:
    """Coverage, evenness and density of a timeline's anchors as one score, or that of its peaks alone if it is higher."""
    from segmenta.operators.sync import sync_score as score

    sp = _split(spark, d).where("kind = 'speech'")
    out = score(_points(spark, d), sp.select("timeline_id", "start_ms", "end_ms"), ["timeline_id"])
    return out.select("timeline_id", F.round("coverage", 6).alias("coverage"), F.round("uniformity", 6).alias("uniformity"), F.round("score", 6).alias("score"))


_CLOSE = f"""WITH {SEG}, c AS (SELECT rec_id, start_ms, end_ms, max(end_ms) OVER (PARTITION BY rec_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cover FROM seg),
r AS (SELECT *, sum(CASE WHEN cover IS NULL OR start_ms - cover >= 250 THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT rec_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM r GROUP BY rec_id, run"""


@query(_CLOSE)
def close_interval_merge(spark: SparkSession, d: str) -> DataFrame:
    """Segments less than 250 ms apart as one."""
    near = seg(spark, d).select("rec_id", "start_ms", (F.col("end_ms") + 249).alias("end_ms"))
    return periods(near, ["rec_id"]).select("rec_id", "start_ms", (F.col("end_ms") - 249).alias("end_ms"))


@query(f"""WITH {SEG}, a0 AS (SELECT *, row_number() OVER (PARTITION BY asr_id ORDER BY created_at) AS rn FROM asr_results WHERE asr_id IS NOT NULL),
l AS (SELECT asr_id, rec_id, pos, CAST(round(x.start_s * 1000) AS BIGINT) AS ls, CAST(round(x.end_s * 1000) AS BIGINT) AS le FROM (SELECT asr_id, rec_id, unnest(segments) AS x, unnest(range(len(segments))) AS pos FROM a0 WHERE rn = 1 AND rec_id IS NOT NULL) WHERE x.end_s > x.start_s),
j AS (SELECT l.*, seg.idx AS ro, seg.speaker, (ls + le >= 2 * seg.start_ms AND ls + le < 2 * seg.end_ms) AS hit, least(le, seg.end_ms) - greatest(ls, seg.start_ms) AS o FROM l JOIN seg ON l.rec_id = seg.rec_id AND seg.start_ms < le AND seg.end_ms > ls WHERE le > ls),
b AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY asr_id, pos ORDER BY hit DESC, CASE WHEN hit THEN 0 ELSE o END DESC, ro) = 1)
SELECT l.asr_id, CAST(l.pos AS BIGINT) AS pos, coalesce(b.speaker, 'SPEAKER_00') AS speaker, b.ro AS turn_idx FROM l LEFT JOIN b ON l.asr_id = b.asr_id AND l.pos = b.pos WHERE l.le > l.ls""")
def interval_speaker_assign(spark: SparkSession, d: str) -> DataFrame:
    """Each recognised segment with the speaker of the gold segment around its middle, or else of the one it overlaps most."""
    asr = latest(table(spark, d, "asr_results").select("asr_id", "rec_id", "segments", "created_at"), "asr_id", "created_at").where("rec_id is not null")
    left = asr.select("asr_id", "rec_id", F.posexplode("segments").alias("pos", "x")).where("x.end_s > x.start_s")
    left = left.select("asr_id", "rec_id", F.col("pos").cast("bigint").alias("pos"), millis(F.col("x.start_s")).alias("ls"), millis(F.col("x.end_s")).alias("le")).where("le > ls")
    right = seg(spark, d, ["start_ms"]).select("rec_id", F.col("start_ms").alias("rs"), F.col("end_ms").alias("re"), F.col("idx").alias("ro"), "speaker")
    out = best_span(left, right, ["rec_id"], ["asr_id", "pos"], "speaker", 60_000)
    return out.select("asr_id", "pos", F.coalesce("speaker", F.lit("SPEAKER_00")).alias("speaker"), F.col("ro").alias("turn_idx"))


_JOBS = "CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'running' ELSE 'degraded' END"


@query(f"SELECT {_JOBS} AS status, count(*) AS n, arg_min(event_id, (ts, event_id)) AS next_job FROM events GROUP BY 1")
def job_status_counts(spark: SparkSession, d: str) -> DataFrame:
    """Jobs by status, and the one that came first of each, as a queue would take it."""
    status = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "click", "running").otherwise("degraded")
    return table(spark, d, "events").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.min_by("event_id", F.struct("ts", "event_id")).alias("next_job"))
