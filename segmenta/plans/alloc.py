"""Queries that allocate: words, letters and phonemes to times and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from segmenta.functions import labels as E
from segmenta.functions import phonemes as P
from segmenta.functions import text as X
from segmenta.operators.ordered import beside
from segmenta.plans.base import SEG, bucket, bucket_sql, seg
from segmenta.plans.frames import _SPLIT, _split
from segmenta.plans.segments import _GROUPS, _groups
from segmenta.plans.texts import _words
from segmenta.sources.tables import latest, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Milliseconds of a letter of a word, the pause after an end mark, the pause that splits, the least length of a part.
LETTER_MS, MARK_MS, SPLIT_MS, FOLD_MS = 60, 400, 320, 180

_WORD = f"""WITH {SEG}, w0 AS (SELECT seg_id, start_ms, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT seg_id, start_ms, {_words('text')} AS w FROM seg)),
w1 AS (SELECT *, 60 * length(word) AS dur, CASE WHEN regexp_matches(word, '[.!?。！？…]$') THEN 400 ELSE 0 END AS pause FROM w0),
word AS (SELECT seg_id, pos, word, dur, start_ms + coalesce(sum(dur + pause) OVER (PARTITION BY seg_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ws FROM w1)
"""


def _word(spark: SparkSession, d: str) -> DataFrame:
    """Words with times: a segment's words one after the other, with a pause after an end mark. Windows by segment."""
    rows = seg(spark, d).select("seg_id", "start_ms", "end_ms", F.posexplode(X.words(F.col("text"))).alias("pos", "word"))
    dur = LETTER_MS * F.length("word")
    pause = F.when(F.col("word").rlike("[.!?。！？…]$"), MARK_MS).otherwise(0)
    before = W.partitionBy("seg_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("dur", dur).withColumn("ws", F.col("start_ms") + F.coalesce(F.sum(dur + pause).over(before), F.lit(0)))


@query(_WORD + """, c1 AS (SELECT *, CASE WHEN ws - lag(ws + dur) OVER (PARTITION BY seg_id ORDER BY pos) < 320 THEN 0 ELSE 1 END AS f FROM word),
c2 AS (SELECT *, sum(f) OVER (PARTITION BY seg_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS chunk FROM c1),
c3 AS (SELECT seg_id, chunk, min(ws) AS s, max(ws + dur) AS e, count(*) AS n FROM c2 GROUP BY seg_id, chunk),
c4 AS (SELECT *, sum(CASE WHEN chunk > 1 AND e - s < 180 THEN 0 ELSE 1 END) OVER (PARTITION BY seg_id ORDER BY chunk ROWS UNBOUNDED PRECEDING) AS part FROM c3)
SELECT seg_id, CAST(part AS BIGINT) AS part, CAST(min(s) AS BIGINT) AS start_ms, CAST(max(e) AS BIGINT) AS end_ms, CAST(sum(n) AS BIGINT) AS n_words FROM c4 GROUP BY seg_id, part""")
def word_gap_split(spark: SparkSession, d: str) -> DataFrame:
    """Segments cut where a pause between words is long; a short part but the first joins the one before."""
    own = W.partitionBy("seg_id").orderBy("pos")
    rows = _word(spark, d).withColumn("f", F.when(F.col("ws") - F.lag(F.col("ws") + F.col("dur")).over(own) < SPLIT_MS, 0).otherwise(1))
    rows = rows.withColumn("chunk", F.sum("f").over(own)).groupBy("seg_id", "chunk").agg(F.min("ws").alias("s"), F.max(F.col("ws") + F.col("dur")).alias("e"), F.count(F.lit(1)).alias("n"))
    opens = F.when((F.col("chunk") > 1) & (F.col("e") - F.col("s") < FOLD_MS), 0).otherwise(1)
    rows = rows.withColumn("part", F.sum(opens).over(W.partitionBy("seg_id").orderBy("chunk")))
    return rows.groupBy("seg_id", "part").agg(F.min("s").alias("start_ms"), F.max("e").alias("end_ms"), F.sum("n").alias("n_words"))


@query(_WORD + ", v AS (SELECT seg_id, unnest([0, 1]) AS half, start_ms, end_ms FROM seg), x AS (SELECT seg_id, half, CASE half WHEN 0 THEN start_ms ELSE (start_ms + end_ms) // 2 END AS a, CASE half WHEN 0 THEN (start_ms + end_ms) // 2 ELSE end_ms END AS b FROM v) SELECT x.seg_id, CAST(half AS INT) AS half, count(*) AS n_words FROM x JOIN word USING (seg_id) WHERE ws >= a - 50 AND ws + dur <= b + 50 GROUP BY x.seg_id, half")
def words_in_window(spark: SparkSession, d: str) -> DataFrame:
    """Words inside each half of their segment, with 50 ms of tolerance; no join, as both come from the segment."""
    mid = F.floor((F.col("start_ms") + F.col("end_ms")) / 2)
    halves = F.array(F.struct(F.lit(0).alias("half"), F.col("start_ms").alias("a"), mid.alias("b")), F.struct(F.lit(1).alias("half"), mid.alias("a"), F.col("end_ms").alias("b")))
    rows = _word(spark, d).select("seg_id", "ws", "dur", F.inline(halves))
    return rows.where((F.col("ws") >= F.col("a") - 50) & (F.col("ws") + F.col("dur") <= F.col("b") + 50)).groupBy("seg_id", "half").agg(F.count(F.lit(1)).alias("n_words"))


_SYL = _WORD + """, z AS (SELECT word.*, coalesce(gold_lang, '') AS lang, seg.start_ms AS s0, seg.end_ms AS e0 FROM word JOIN seg USING (seg_id) LEFT JOIN recordings r ON seg.rec_id = r.rec_id),
y AS (SELECT *, CASE WHEN lang IN ('zh', 'cmn', 'chi') THEN length(word) ELSE greatest(1, len(regexp_extract_all(lower(word), '[aeiouy]+'))) END AS n FROM z), x AS (SELECT *, unnest(range(n)) AS k FROM y)"""


def _syllables(spark: SparkSession, d: str) -> DataFrame:
    """Syllables of words in even time: in Chinese one a letter, else one a cluster of vowels, with the letter at its place or
    the last one. Times are fractions: start is ws + k * dur / n."""
    lang = table(spark, d, "recordings").where("rec_id is not null").select("rec_id", "gold_lang")
    rows = beside(seg(spark, d), lang, ["rec_id"], "shard")
    rows = rows.select("seg_id", "start_ms", "end_ms", "gold_lang", F.posexplode(X.words(F.col("text"))).alias("pos", "word"))
    dur, pause = LETTER_MS * F.length("word"), F.when(F.col("word").rlike("[.!?。！？…]$"), MARK_MS).otherwise(0)
    before = W.partitionBy("seg_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("dur", dur).withColumn("ws", F.col("start_ms") + F.coalesce(F.sum(dur + pause).over(before), F.lit(0)))
    n = F.when(F.col("gold_lang").isin("zh", "cmn", "chi"), F.length("word")).otherwise(X.vowel_clusters(F.col("word")))
    rows = rows.withColumn("n", n).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    return rows.withColumn("char", F.substring(F.col("word"), F.least(F.col("k") + 1, F.length("word")), F.lit(1)))


@query(_SYL + " SELECT seg_id, CAST(pos AS INT) AS pos, CAST(k AS INT) AS k, substr(word, least(k + 1, length(word)), 1) AS char, CAST(ws + k * dur // n AS BIGINT) AS start_ms, lower(substr(word, least(k + 1, length(word)), 1)) IN ('a', 'e', 'o') AS is_open FROM x")
def word_syllables(spark: SparkSession, d: str) -> DataFrame:
    return _syllables(spark, d).select("seg_id", "pos", "k", "char", F.expr("ws + k * dur div n").alias("start_ms"), F.lower("char").isin("a", "e", "o").alias("is_open"))


@query(_SYL + ", v AS (SELECT *, unnest([0, 1]) AS half FROM x), u AS (SELECT *, CASE half WHEN 0 THEN s0 ELSE (s0 + e0) // 2 END AS a, CASE half WHEN 0 THEN (s0 + e0) // 2 ELSE e0 END AS b FROM v) SELECT seg_id, CAST(half AS INT) AS half, count(*) AS n_syllables, count(*) FILTER (lower(substr(word, least(k + 1, length(word)), 1)) IN ('a', 'e', 'o')) AS n_open FROM u WHERE ws * n + k * dur >= (a - 1) * n AND ws * n + (k + 1) * dur <= (b + 1) * n GROUP BY seg_id, half")
def syllables_in_window(spark: SparkSession, d: str) -> DataFrame:
    """Syllables inside each half of their segment, with a millisecond of tolerance, and how many of them are open."""
    mid = F.floor((F.col("start_ms") + F.col("end_ms")) / 2)
    halves = F.array(F.struct(F.lit(0).alias("half"), F.col("start_ms").alias("a"), mid.alias("b")), F.struct(F.lit(1).alias("half"), mid.alias("a"), F.col("end_ms").alias("b")))
    rows = _syllables(spark, d).select("seg_id", "ws", "dur", "n", "k", "char", F.inline(halves))
    inside = (F.expr("ws * n + k * dur") >= F.expr("(a - 1) * n")) & (F.expr("ws * n + (k + 1) * dur") <= F.expr("(b + 1) * n"))
    return rows.where(inside).groupBy("seg_id", "half").agg(F.count(F.lit(1)).alias("n_syllables"), F.count_if(F.lower("char").isin("a", "e", "o")).alias("n_open"))


#: The longest part of a segment, and the least, in milliseconds.
LONGEST_MS, LEAST_MS = 2_800, 450


@query(f"""WITH {SEG}, n AS (SELECT seg_id, text, start_ms, end_ms - start_ms AS dur, CAST(ceil((end_ms - start_ms) / 2800e0) AS BIGINT) AS n FROM seg), p AS (SELECT *, unnest(range(n)) AS k FROM n WHERE n > 1)
SELECT seg_id, CAST(k AS INT) AS part, start_ms + dur * k // n AS start_ms, start_ms + dur * (k + 1) // n AS end_ms, coalesce(nullif(trim(substr(text, CAST(length(text) * k // n + 1 AS BIGINT), CAST(length(text) * (k + 1) // n - length(text) * k // n AS BIGINT)), ' '), ''), text) AS text FROM p""")
def time_cut_split(spark: SparkSession, d: str) -> DataFrame:
    """Segments that are too long cut into equal parts that aren't, their text in proportion; a part whose share of the text
    is blank keeps all of it. No part is shorter than the least, as the longest is more than twice that."""
    rows = seg(spark, d).withColumn("dur", F.col("end_ms") - F.col("start_ms")).withColumn("n", F.ceil(F.col("dur") / LONGEST_MS)).where("n > 1")
    rows = rows.select("seg_id", "text", "start_ms", "dur", "n", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("part"))
    at = lambda k: f"cast(length(text) * cast({k} as bigint) div n as int)"
    own = F.trim(F.expr(f"substring(text, {at('part')} + 1, {at('(part + 1)')} - {at('part')})"))
    return rows.select("seg_id", "part", F.expr("start_ms + dur * part div n").alias("start_ms"), F.expr("start_ms + dur * (part + 1) div n").alias("end_ms"), F.coalesce(F.nullif(own, F.lit("")), "text").alias("text"))


_LANG = "rl AS (SELECT rec_id, gold_lang FROM recordings)"
_FINAL = "nullif(regexp_extract(lower({b}), '^[bpmfdtnlgkhjqxzcsrwy]*(a|o|e|i|u|v|ai|ei|ao|ou|an|en|ang|eng|ong|ia|ie|iu|ian|in|iang|ing|iong|ua|uo|uai|ui|uan|un|uang|ueng|ve|vn|van)$', 1), '')"
_PHON = f"""WITH {SEG}, {_LANG}, c0 AS (SELECT seg_id, start_ms, end_ms, CASE WHEN gold_lang IN ('zh', 'zho', 'chi', 'cmn') THEN list_filter(string_split(replace(text, ' ', ''), ''), lambda c: c <> '')
  WHEN gold_lang IN ('en', 'eng', 'english') THEN list_filter(string_split_regex(lower(text), '[\\s\\x{{00a0}}\\x{{3000}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}]+'), lambda w: w <> '') ELSE list_filter(string_split(text, ''), lambda c: c <> '') END AS ps FROM seg LEFT JOIN rl USING (rec_id) WHERE text <> ''),
c1 AS (SELECT seg_id, start_ms, end_ms, unnest(ps) AS ph, unnest(range(len(ps))) AS pos FROM c0),
c2 AS (SELECT *, regexp_replace(trim(ph, ' '), '[0-9]+$', '') AS b FROM c1), c3 AS (SELECT *, {_FINAL.format(b='b')} AS f, lower(b) AS low, upper(b) AS up FROM c2),
c4 AS (SELECT *, CASE WHEN f IN ('a', 'ai', 'ao', 'an', 'ang', 'ia', 'ua', 'uai', 'uan', 'uang') THEN 75 WHEN f IN ('o', 'e', 'uo', 'ou', 'ong', 'en', 'eng') THEN 55 WHEN f IS NOT NULL THEN 45
  WHEN up IN ('AA', 'AE', 'AO', 'AW', 'AY') THEN 80 WHEN up IN ('EH', 'AH', 'ER', 'OW', 'OY') THEN 55 WHEN up IN ('EY', 'IH', 'IY', 'UH', 'UW') THEN 25
  WHEN ph IN ('a', 'ɶ', 'ɑ', 'ɒ', 'æ', 'ɐ') OR low IN ('a', 'ɶ', 'ɑ', 'ɒ', 'æ', 'ɐ') THEN 85 WHEN low IN ('ɛ', 'œ', 'ɜ', 'ɞ', 'ʌ', 'ɔ', 'ə') THEN 50
  WHEN low IN ('i', 'y', 'ɨ', 'ʉ', 'ɯ', 'u', 'ɪ', 'ʏ', 'ʊ') THEN 15 WHEN low IN ('p', 'b', 't', 'd', 'k', 'g', 'ʔ') THEN 10 WHEN low IN ('m', 'n', 'ɲ', 'ŋ', 'f', 'v', 'θ', 'ð', 's', 'z', 'ʃ', 'ʒ', 'h') THEN 40 ELSE 50 END AS o FROM c3),
phon AS (SELECT *, CAST(start_ms + (end_ms - start_ms) * coalesce(sum(50 + o) OVER w, 0) // sum(50 + o) OVER (PARTITION BY seg_id) AS BIGINT) AS at_ms FROM c4 WINDOW w AS (PARTITION BY seg_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
"""


def _phones(spark: SparkSession, d: str) -> DataFrame:
    """Segments with their phonemes, by the language of their recording."""
    lang = table(spark, d, "recordings").where("rec_id is not null").select("rec_id", "gold_lang")
    return beside(seg(spark, d).where("text <> ''"), lang, ["rec_id"], "shard").withColumn("phonemes", P.of_text(F.col("text"), F.col("gold_lang")))


def _phonemes(spark: SparkSession, d: str) -> DataFrame:
    """Phonemes with their openness, timed in whole milliseconds by cumulative weights of half plus openness."""
    rows = _phones(spark, d).select("seg_id", "start_ms", "end_ms", F.posexplode("phonemes").alias("pos", "phoneme"))
    rows = rows.withColumn("x", P.described(F.col("phoneme"))).withColumn("o", P.openness(F.col("x")))
    own = W.partitionBy("seg_id")
    before = own.orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("wt", (50 + F.round(F.col("o.openness") * 100)).cast("bigint"))
    rows = rows.withColumn("done", F.coalesce(F.sum("wt").over(before), F.lit(0))).withColumn("total", F.sum("wt").over(own))
    return rows.select("seg_id", "pos", "phoneme", "x", F.col("o.class").alias("class"), F.col("o.openness").alias("openness"), F.expr("start_ms + (end_ms - start_ms) * done div total").alias("at_ms"))


@query(f"{_PHON[:_PHON.index('c1 AS')].rstrip().rstrip(',')} SELECT seg_id, ps AS phonemes FROM c0")
def char_phonemes(spark: SparkSession, d: str) -> DataFrame:
    """What stands for a pronunciation dictionary: the letters of a text, in English its words."""
    return _phones(spark, d).select("seg_id", "phonemes")


@query(_PHON + "SELECT seg_id, CAST(pos AS INT) AS pos, ph AS phoneme, o / 100.0 AS openness, at_ms FROM phon")
def phoneme_weights_timeline(spark: SparkSession, d: str) -> DataFrame:
    return _phonemes(spark, d).select("seg_id", "pos", "phoneme", "openness", "at_ms")


_DISTINCT = _PHON + ", k AS (SELECT DISTINCT ph, b, f, o, low, up FROM c4)"


@query(_DISTINCT + "SELECT ph AS phoneme, b AS bare, f AS final, CASE WHEN o IN (75, 80, 85) THEN 'open' WHEN o IN (10, 15, 25) THEN 'closed' ELSE 'mid' END AS class, o / 100.0 AS openness FROM k")
def phoneme_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each different phoneme of the segments: without tone, its pinyin final, its class and openness."""
    rows = _phones(spark, d).select(F.explode("phonemes").alias("phoneme")).distinct()
    p = F.col("phoneme")
    rows = rows.withColumn("x", P.described(p)).withColumn("o", P.openness(F.col("x")))
    return rows.select("phoneme", P.bare(p).alias("bare"), "x.final", "o.class", "o.openness")


_VOWEL = """ f IS NOT NULL OR up IN ('AA', 'AE', 'AH', 'AO', 'AW', 'AY', 'EH', 'ER', 'EY', 'IH', 'IY', 'OW', 'OY', 'UH', 'UW') OR low IN ('i', 'y', 'ɨ', 'ʉ', 'ɯ', 'u', 'ɪ', 'ʏ', 'ʊ', 'e', 'ø', 'ɘ', 'ɵ', 'ɤ', 'o', 'ə', 'ɛ', 'œ', 'ɜ', 'ɞ', 'ʌ', 'ɔ', 'æ', 'ɐ', 'a', 'ɶ', 'ɑ', 'ɒ')"""


@query(_PHON + f"SELECT seg_id, CAST(pos AS INT) AS pos, ph AS phoneme, at_ms, CASE WHEN f IN ('a', 'ao', 'ang', 'ia', 'ua', 'ai') OR up IN ('AA', 'AE', 'AO') THEN greatest(o, 55) ELSE o END / 100.0 AS openness, CASE WHEN f IN ('a', 'ao', 'ang', 'ia', 'ua', 'ai') OR up IN ('AA', 'AE', 'AO') THEN greatest(o, 55) ELSE o END > 45 AS is_core FROM phon WHERE {_VOWEL}")
def vowel_points(spark: SparkSession, d: str) -> DataFrame:
    """Vowels in time, those that mouths are seen to open for as core."""
    x = F.col("x")
    rows = _phonemes(spark, d).where(P.is_vowel(x)).withColumn("openness", P.vowel_openness(x, F.col("openness")))
    return rows.select("seg_id", "pos", "phoneme", "at_ms", "openness", (F.col("openness") > P.CORE_OVER).alias("is_core"))


@query(_PHON + "SELECT seg_id, CAST(pos AS INT) AS pos, ph AS phoneme, at_ms FROM phon WHERE ph IN ('p', 'b', 't', 'd', 'k', 'g', 'ʔ', 'æ', 'ɐ', 'a', 'ɶ', 'ɑ', 'ɒ')")
def phoneme_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Starts of plosives and open vowels, as written: the last branch of sync points."""
    return _phonemes(spark, d).where(P.is_border(F.col("x"))).select("seg_id", "pos", "phoneme", "at_ms")


@query(f"""WITH {SEG}, s AS (SELECT seg_id, start_ms, end_ms, greatest(1, length(replace(text, ' ', ''))) AS n, replace(text, ' ', '') AS t FROM seg WHERE text <> '')
SELECT seg_id, CAST(i AS INT) AS i, substr(t, CAST(i AS BIGINT) + 1, 1) AS char, start_ms + i * (end_ms - start_ms) // n AS start_ms, lower(substr(t, CAST(i AS BIGINT) + 1, 1)) IN ('a', 'e', 'o') AS is_open FROM (SELECT *, unnest(range(n)) AS i FROM s)""")
def syllable_timing(spark: SparkSession, d: str) -> DataFrame:
    """A segment's letters in even time, and whether each is an open vowel."""
    rows = seg(spark, d).where("text <> ''").withColumn("t", F.replace(F.col("text"), F.lit(" "), F.lit(""))).withColumn("n", F.greatest(F.lit(1), F.length("t")))
    letters = F.filter(F.split("t", ""), lambda c: c != "")
    letters = F.when(F.size(letters) > 0, letters).otherwise(F.array(F.lit("")))
    rows = rows.select("seg_id", "start_ms", "end_ms", "n", F.posexplode(letters).alias("i", "char"))
    return rows.select("seg_id", "i", "char", F.expr("start_ms + i * (end_ms - start_ms) div n").alias("start_ms"), F.lower("char").isin("a", "e", "o").alias("is_open"))


@query(f"""WITH {_SPLIT}, s AS (SELECT timeline_id, start_ms, end_ms, row_number() OVER (PARTITION BY timeline_id ORDER BY start_ms, end_ms, openness) AS i, sum(end_ms - start_ms) OVER (PARTITION BY timeline_id) AS total FROM cls WHERE kind = 'speech'),
q AS (SELECT *, greatest(1, 40 * (end_ms - start_ms) // total) AS req FROM s), c AS (SELECT *, sum(req) OVER (PARTITION BY timeline_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS cum FROM q)
SELECT timeline_id, i, CAST(least(40, cum) - least(40, cum - req) AS BIGINT) AS n_phonemes FROM c""")
def capped_allocation(spark: SparkSession, d: str) -> DataFrame:
    """Forty phonemes shared among a timeline's speech by length, one at least, until none is left. A timeline is one row
    of its table, so its items are few."""
    own = W.partitionBy("timeline_id")
    order = own.orderBy("start_ms", "end_ms", "openness")
    rows = _split(spark, d).where("kind = 'speech'").withColumn("i", F.row_number().over(order)).withColumn("total", F.sum(F.col("end_ms") - F.col("start_ms")).over(own))
    rows = rows.withColumn("req", F.greatest(F.lit(1), F.floor(40 * (F.col("end_ms") - F.col("start_ms")) / F.col("total"))))
    rows = rows.withColumn("cum", F.sum("req").over(own.orderBy("i").rowsBetween(W.unboundedPreceding, 0)))
    return rows.select("timeline_id", F.col("i").cast("bigint").alias("i"), (F.least(F.lit(40), F.col("cum")) - F.least(F.lit(40), F.col("cum") - F.col("req"))).cast("bigint").alias("n_phonemes"))


_SCRIPT = f"""b0 AS (SELECT *, row_number() OVER (PARTITION BY script_id ORDER BY created_at) AS rn FROM bilingual_scripts WHERE script_id IS NOT NULL),
b AS (SELECT script_id, translated_text, {_words('translated_text')} AS w, unnest(source_segments) AS x, unnest(range(len(source_segments))) AS i, len(source_segments) AS k FROM b0 WHERE rn = 1 AND translated_text IS NOT NULL AND len(source_segments) > 0),
sh AS (SELECT script_id, i, k, translated_text, w, greatest(1, length(trim(coalesce(x.text, ''), ' '))) AS weight, sum(greatest(1, length(trim(coalesce(x.text, ''), ' ')))) OVER (PARTITION BY script_id) AS total FROM b)"""


def _shares(spark: SparkSession, d: str) -> DataFrame:
    """Each script's source segments with their weight by length. A script is one row of its table."""
    rows = latest(table(spark, d, "bilingual_scripts"), "script_id", "created_at").where("translated_text is not null and size(source_segments) > 0")
    rows = rows.select("script_id", "translated_text", F.size("source_segments").alias("k"), F.posexplode("source_segments").alias("i", "x"))
    rows = rows.withColumn("weight", F.greatest(F.lit(1), F.length(F.trim(F.coalesce("x.text", F.lit(""))))))
    return rows.withColumn("total", F.sum("weight").over(W.partitionBy("script_id")))


def _dealt(rows: DataFrame, n, least: int) -> DataFrame:
    """Adds first and take: consecutive pieces of n by weight, half to even, `least` each; the last takes the rest."""
    take = F.greatest(F.lit(least), F.rint(n * F.col("weight") / F.col("total")).cast("bigint"))
    before = W.partitionBy("script_id").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_t", take).withColumn("first", F.coalesce(F.sum("_t").over(before), F.lit(0)))
    return rows.withColumn("take", F.when(F.col("i") == F.col("k") - 1, F.greatest(F.lit(0), n - F.col("first"))).otherwise(F.col("_t"))).drop("_t")


@query(f"""WITH {_SCRIPT}, t AS (SELECT *, greatest(1, CAST(round_even(len(w) * weight / total, 0) AS BIGINT)) AS tk FROM sh), f AS (SELECT *, coalesce(sum(tk) OVER (PARTITION BY script_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM t)
SELECT script_id, CAST(i AS INT) AS i, array_to_string(w[CAST(first AS BIGINT) + 1 : CAST(first + CASE WHEN i = k - 1 THEN greatest(0, len(w) - first) ELSE tk END AS BIGINT)], ' ') AS text FROM f""")
def proportional_words(spark: SparkSession, d: str) -> DataFrame:
    """The words of a translation dealt to the source segments in proportion to their length."""
    rows = _shares(spark, d).withColumn("w", X.words(F.col("translated_text")))
    rows = _dealt(rows, F.size("w"), 1)
    return rows.select("script_id", "i", F.array_join(F.slice("w", (F.col("first") + 1).cast("int"), F.col("take").cast("int")), " ").alias("text"))


@query(f"""WITH {_SCRIPT}, t AS (SELECT *, greatest(1, CAST(round_even(length(translated_text) * weight / total, 0) AS BIGINT)) AS tk FROM sh), f AS (SELECT *, coalesce(sum(tk) OVER (PARTITION BY script_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM t)
SELECT script_id, CAST(i AS INT) AS i, substr(translated_text, CAST(first AS BIGINT) + 1, CAST(CASE WHEN i = k - 1 THEN greatest(0, length(translated_text) - first) ELSE tk END AS BIGINT)) AS text FROM f""")
def char_redistribute(spark: SparkSession, d: str) -> DataFrame:
    """The letters of a translation dealt to the source segments in proportion to their length."""
    rows = _dealt(_shares(spark, d), F.length("translated_text"), 1)
    return rows.select("script_id", "i", F.substring(F.col("translated_text"), (F.col("first") + 1).cast("int"), F.col("take").cast("int")).alias("text"))


@query(r"""WITH b0 AS (SELECT *, row_number() OVER (PARTITION BY script_id ORDER BY created_at) AS rn FROM bilingual_scripts WHERE script_id IS NOT NULL),
b AS (SELECT script_id, len(source_segments) AS k, list_filter(string_split_regex(translated_text, '[.!?。！？।]+\s*'), lambda x: x <> '') AS s FROM b0 WHERE rn = 1 AND translated_text IS NOT NULL AND len(source_segments) > 0),
p AS (SELECT script_id, k, unnest(s) AS t, unnest(range(len(s))) AS j FROM b)
SELECT script_id, CAST(least(j, k - 1) AS INT) AS i, string_agg(t, ' ' ORDER BY j) AS text FROM p GROUP BY script_id, least(j, k - 1)""")
def sentence_align(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of a translation laid to the source segments one by one; the last segment takes all that are left."""
    rows = latest(table(spark, d, "bilingual_scripts"), "script_id", "created_at").where("translated_text is not null and size(source_segments) > 0")
    s = F.filter(F.split("translated_text", r"[.!?。！？।]+\s*"), lambda x: x != "")
    rows = rows.select("script_id", F.size("source_segments").alias("k"), F.posexplode(s).alias("j", "t"))
    rows = rows.groupBy("script_id", F.least(F.col("j"), F.col("k") - 1).alias("i")).agg(F.array_sort(F.collect_list(F.struct("j", "t"))).alias("x"))
    return rows.select("script_id", "i", F.array_join(F.transform("x", lambda x: x["t"]), " ").alias("text"))


@query(_GROUPS + "SELECT rec_id, grp, end_ms - start_ms AS source_ms, n_segments * 1500 AS spoken_ms, abs(n_segments * 1500 - (end_ms - start_ms)) > 0.05 * (end_ms - start_ms) AS stretch, round(least(greatest(n_segments * 1500, 0.9e0 * (end_ms - start_ms)), 1.2e0 * (end_ms - start_ms)), 3) AS planned_ms, CAST(least(2048, greatest(64, floor((end_ms - start_ms) / 1000 * 12 * 1.6e0 + 50))) AS BIGINT) AS tokens FROM grp")
def duration_plan(spark: SparkSession, d: str) -> DataFrame:
    """How long a group would be spoken, whether it is to be stretched, within which bounds, and a token budget."""
    source, spoken = F.col("end_ms") - F.col("start_ms"), F.col("n_segments") * 1500
    planned = F.least(F.greatest(spoken, 0.9 * source), 1.2 * source)
    tokens = F.least(F.lit(2048), F.greatest(F.lit(64), F.floor(source / 1000 * 12 * 1.6 + 50)))
    return _groups(spark, d).select("rec_id", "grp", source.alias("source_ms"), spoken.alias("spoken_ms"), (F.abs(spoken - source) > 0.05 * source).alias("stretch"), F.round(planned, 3).alias("planned_ms"), tokens.cast("bigint").alias("tokens"))


_NAMES = "MAP {'happy': 'happy', 'happiness': 'happy', 'joy': 'happy', 'hap': 'happy', 'sad': 'sad', 'sadness': 'sad', 'angry': 'angry', 'anger': 'angry', 'ang': 'angry', 'fearful': 'fearful', 'fear': 'fearful', 'fea': 'fearful', 'disgusted': 'disgusted', 'disgust': 'disgusted', 'disg': 'disgusted', 'surprised': 'surprised', 'surprise': 'surprised', 'surp': 'surprised', 'neutral': 'neutral', 'calm': 'neutral', 'neu': 'neutral'}"
_NORM = f"coalesce({_NAMES}[e], CASE WHEN contains(e, 'hap') THEN 'happy' WHEN contains(e, 'sad') THEN 'sad' WHEN contains(e, 'ang') THEN 'angry' WHEN contains(e, 'fea') THEN 'fearful' WHEN contains(e, 'disg') THEN 'disgusted' WHEN contains(e, 'surp') THEN 'surprised' ELSE 'neutral' END)"
_EMO = f"WITH {SEG}, x AS (SELECT rec_id, idx, label_confidence, emotion, coalesce(nullif(lower(trim(regexp_extract(trim(emotion, ' '), '^[^/|,;]*'), ' ')), ''), 'neutral') AS e FROM seg), n AS (SELECT *, {_NORM} AS label FROM x)"


def _emotions(spark: SparkSession, d: str) -> DataFrame:
    return seg(spark, d, ["start_ms"]).withColumn("label", E.category(E.coerced(F.col("emotion"))))


@query(_EMO + " SELECT rec_id, idx, label FROM n")
def emotion_norm(spark: SparkSession, d: str) -> DataFrame:
    return _emotions(spark, d).select("rec_id", "idx", "label")


@query(_EMO + """ SELECT rec_id, idx, CASE label WHEN 'happy' THEN 8e-1 WHEN 'sad' THEN -7e-1 WHEN 'angry' THEN -5e-1 WHEN 'surprised' THEN 4e-1 WHEN 'fearful' THEN -6e-1 WHEN 'disgusted' THEN -7e-1 ELSE 0e0 END AS valence,
 CASE label WHEN 'neutral' THEN 3e-1 WHEN 'happy' THEN 7e-1 WHEN 'sad' THEN 2e-1 WHEN 'angry' THEN 9e-1 WHEN 'surprised' THEN 8e-1 WHEN 'fearful' THEN 8e-1 ELSE 5e-1 END AS arousal,
 round(CASE WHEN coalesce(label_confidence, 0) > 0 THEN least(label_confidence / 0.8e0, 1e0) ELSE 0.5e0 END, 6) AS intensity FROM n""")
def emotion_va(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("label_confidence")
    at = lambda i, other: E.looked_up(F.col("label"), {k: v[i] for k, v in E.VALENCE_AROUSAL.items()}, other)
    intensity = F.when(F.coalesce(c, F.lit(0.0)) > 0, F.least(c / 0.8, F.lit(1.0))).otherwise(0.5)
    return _emotions(spark, d).select("rec_id", "idx", at(0, 0.0).alias("valence"), at(1, 0.5).alias("arousal"), F.round(intensity, 6).alias("intensity"))


@query(_EMO + """, c AS (SELECT rec_id, idx, label, label_confidence AS p, unnest(['neutral', 'happy', 'sad', 'angry', 'surprised', 'fearful', 'disgusted']) AS category FROM n)
 SELECT rec_id, idx, category, CASE WHEN category = label AND p IS NOT NULL THEN p ELSE 0e0 END AS score, round(CASE WHEN coalesce(p, 0) > 0 THEN least(p / 0.8e0, 1e0) ELSE 0.5e0 END, 6) AS intensity FROM c""")
def emotion_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of all categories, 0 for those that a segment has none for, and the intensity by the greatest."""
    own = F.when(F.col("label_confidence").isNotNull(), F.create_map("label", "label_confidence"))
    rows = _emotions(spark, d).select("rec_id", "idx", E.all_scores(own).alias("scores"))
    return rows.select("rec_id", "idx", F.round(E.intensity(F.col("scores")), 6).alias("intensity"), F.explode("scores").alias("category", "score"))


@query(f"WITH {SEG} SELECT rec_id, idx, coalesce(nullif(trim(regexp_extract(trim(emotion, ' '), '^[^/|,;]*'), ' '), ''), 'neutral') AS of_list, coalesce(nullif(trim(regexp_extract(trim(coalesce(nullif(emotion, ''), speaker), ' '), '^[^/|,;]*'), ' '), ''), 'neutral') AS of_map FROM seg")
def label_coercion(spark: SparkSession, d: str) -> DataFrame:
    """One label of a list and of a map, as models give them."""
    rows = seg(spark, d, ["start_ms"]).withColumn("l", F.array("emotion", "speaker")).withColumn("m", F.create_map(F.lit("other"), F.col("speaker"), F.lit("emotion"), F.col("emotion")))
    kinds = rows.schema
    of_map = F.when(F.col("emotion").isNull(), E.coerced(F.map_filter("m", lambda k, v: v.isNotNull()), kinds["m"].dataType)).otherwise(E.coerced(F.col("m"), kinds["m"].dataType))
    return rows.select("rec_id", "idx", E.coerced(F.col("l"), kinds["l"].dataType).alias("of_list"), of_map.alias("of_map"))


@query(f"WITH {SEG} SELECT {bucket_sql('emotion')} AS bucket, speaker, count(*) AS n FROM seg GROUP BY 1, 2")
def emotion_bucket(spark: SparkSession, d: str) -> DataFrame:
    return seg(spark, d).groupBy(bucket(F.col("emotion")).alias("bucket"), "speaker").agg(F.count(F.lit(1)).alias("n"))


@query(_EMO + f""", p AS (SELECT rec_id, idx, label AS feeling FROM n UNION ALL SELECT rec_id, idx, {bucket_sql('emotion')} FROM n),
q AS (SELECT *, CASE feeling WHEN 'happy' THEN 1e0 WHEN 'surprised' THEN 1.5e0 WHEN 'positive' THEN 0.8e0 WHEN 'sad' THEN -1.2e0 WHEN 'negative' THEN -1e0 WHEN 'angry' THEN 1.8e0 WHEN 'fearful' THEN 0.8e0 WHEN 'disgusted' THEN 0.5e0 ELSE 0e0 END AS half_tones,
 CASE feeling WHEN 'happy' THEN 1.04e0 WHEN 'surprised' THEN 1.05e0 WHEN 'positive' THEN 1.03e0 WHEN 'sad' THEN 0.96e0 WHEN 'negative' THEN 0.97e0 WHEN 'angry' THEN 1.06e0 WHEN 'fearful' THEN 1.04e0 ELSE 1e0 END AS rate FROM p)
 SELECT rec_id, idx, feeling, half_tones, rate, abs(half_tones) >= 0.3e0 AS shifts, abs(rate - 1) >= 0.02e0 AS stretches FROM q""")
def prosody_params(spark: SparkSession, d: str) -> DataFrame:
    """By how much speech of each label, and of its bucket, is shifted and stretched."""
    at = lambda i, other: E.looked_up(F.col("feeling"), {k: v[i] for k, v in E.PROSODY.items()}, other)
    rows = _emotions(spark, d).select("rec_id", "idx", F.explode(F.array("label", bucket(F.col("emotion")))).alias("feeling"))
    rows = rows.withColumn("half_tones", at(0, 0.0)).withColumn("rate", at(1, 1.0))
    return rows.select("*", (F.abs("half_tones") >= 0.3).alias("shifts"), (F.abs(F.col("rate") - 1) >= 0.02).alias("stretches"))
