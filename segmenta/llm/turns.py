"""Speech transcripts into clean speaker turns, and the queries of problem 7.

One operator, `turns`: segments are swept in order of their start per entity and time shard; a turn ends at a change of
speaker or at a calibrated pause. Repetition of rolling captions is removed by the longest suffix of a segment that is a
prefix of the next one of its turn, where both ends lie at word borders, it makes up half of the earlier caption at least
and the two adjoin in time. The entity's own label map meets the occupied shards of its recording, so no task gathers an
entity, and rows are shuffled once before they are turns.

The pause is calibrated over all gaps of one speaker's neighbouring segments, per origin: the border between short and long
ones that leaves the least variance of their logarithms on both sides.

Defined results: a redelivered segment counts once; segments without words are dropped; a segment without a start comes
first; equal starts go by position and id; a segment of a labelled entity that has words but no label goes on as a turn
of unknown speaker, which is left out; entities without any label are left out; null and empty arrays give nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segmenta.llm import debris as D
from segmenta.operators.ordered import sequenced
from segmenta.operators.runs import value_runs

SHARD_S = 600
KEYS, ORDER = ["origin", "entity_id"], ["start_s", "pos", "seg"]
#: Letters that a repetition has at least, its share of the earlier caption, and the seconds between captions that roll on.
LEAST_LETTERS, LEAST_PART, ADJOINING_S = 4, 0.5, 1.0
#: Bins of the calibration for each doubling of a gap, and the shortest and longest gap in seconds that are told apart.
BINS, SHORTEST_S, LONGEST_S = 8, 0.01, 3600.0


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """origin, entity_id, rec_id, seg, pos, start_s, end_s, text, speaker of all segments, redeliveries included."""
    gold = spark.read.parquet(f"{sf_dir}/gold_segments.parquet").select(F.lit("gold").alias("origin"), F.col("rec_id").alias("entity_id"), "rec_id", F.col("seg_id").alias("seg"), F.col("seg_idx").cast("bigint").alias("pos"), "start_s", "end_s", "text", "speaker")
    asr = spark.read.parquet(f"{sf_dir}/asr_results.parquet").select("asr_id", "rec_id", F.posexplode("segments").alias("pos", "x"))
    asr = asr.select(F.lit("asr").alias("origin"), F.col("asr_id").cast("string").alias("entity_id"), "rec_id", F.col("pos").cast("bigint").alias("seg"), F.col("pos").cast("bigint").alias("pos"), "x.start_s", "x.end_s", "x.text", "x.speaker")
    return gold.unionByName(asr).where(F.col("entity_id").isNotNull())


def _shard(start: Column) -> Column:
    return F.coalesce(F.floor(start / SHARD_S).cast("bigint"), F.lit(-(1 << 40)))


def labelled(rows: DataFrame, recordings: DataFrame, only_spoken: bool = False) -> DataFrame:
    """Adds shard, speaker (SPEAKER_NN or null), body (text without time stamp and label) and spoken (it has words)."""
    text = D.untimed(D.narrow(F.coalesce("text", F.lit(""))))
    may = r"^[^\n]{0,42}[:：\]]|\s[-–—]\s"
    part = lambda i: F.when(F.col("_t").rlike(may), F.regexp_extract("_t", D.PREFIX, i)).otherwise("")
    rows = rows.withColumn("shard", _shard(F.col("start_s"))).withColumn("_t", F.trim(D.unsounded_start(text))).withColumn("_p", part(0))
    inner = F.when(F.col("_p") != "", F.coalesce(F.nullif(part(1), F.lit("")), part(2)))
    rows = rows.withColumn("_own", F.nullif(F.trim(D.narrow(F.col("speaker"))), F.lit(""))).withColumn("_pre", F.nullif(F.trim(inner), F.lit("")))
    rows = rows.withColumn("label", F.coalesce("_own", "_pre"))
    rows = rows.withColumn("_n", D.speaker_number(F.col("label"))).withColumn("_sure", F.coalesce(D.speaker_number(F.col("_pre")).isNotNull() | (F.col("_pre") == F.col("_own")), F.lit(False)))
    rows = rows.withColumn("_rest", F.when(F.col("_p") != "", F.expr("trim(substring(_t, length(_p) + 1))")).otherwise(F.col("_t")))
    rows = rows.withColumn("_wr", D.has_words(F.col("_rest"))).withColumn("_wt", F.when(F.col("_p") != "", D.has_words(F.col("_t"))).otherwise(F.col("_wr")))
    # an entity's map is sent to its occupied shards, so a hot recording's rows aren't gathered for it
    named = F.transform(F.map_entries("diarization"), lambda e: F.struct(F.trim(D.narrow(e["key"])).alias("label"), e["value"].alias("name")))
    names = recordings.where("rec_id is not null").select("rec_id", named.alias("_named")).where("size(_named) > 0")
    cells = rows.where("rec_id is not null").select(*KEYS, "shard", "rec_id").distinct().join(names, "rec_id")
    cells = cells.groupBy(*KEYS, "shard").agg(F.array_sort(F.collect_list(F.struct("rec_id", "_named"))).alias("_maps"))
    kept = rows.where(F.col("_wr") | F.col("_wt")) if only_spoken else rows
    joined = kept.join(cells, [*KEYS, "shard"], "left")
    own = F.filter(F.col("_maps"), lambda m: m["rec_id"] == F.col("rec_id"))
    joined = joined.withColumn("_m", F.get(F.filter(F.get(own, F.lit(0))["_named"], lambda e: e["label"] == F.col("label")), F.lit(0))["name"])
    cut = F.col("_sure") | (F.col("_own").isNull() & (F.col("_m").isNotNull() | F.col("_n").isNotNull()))
    return joined.select(*KEYS, "rec_id", "shard", *ORDER, "end_s", F.coalesce("_m", "_n").alias("speaker"), F.when(cut, F.col("_rest")).otherwise(F.col("_t")).alias("body"), F.when(cut, F.col("_wr")).otherwise(F.col("_wt")).alias("spoken"))


def spoken_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(segments(spark, sf_dir), spark.read.parquet(f"{sf_dir}/recordings.parquet"), only_spoken=True).where("spoken")


def _at_border(text: str, i: int) -> bool:
    """May a word end before letter i of a text and another begin there? Between letters of scripts without spaces it may."""
    if not 0 < i < len(text):
        return True
    a, b = text[i - 1], text[i]
    return not (a.isalnum() and b.isalnum()) or "\u2e80" <= a <= "\u9fff" or "\u2e80" <= b <= "\u9fff"


def _longest(a: str, b: str) -> list[int]:
    """Lengths of all suffixes of a that are prefixes of b, the longest first, in time linear in both: the prefix function of
    b, followed along a."""
    a = a[-len(b) :] if b else ""
    fail, k = [0] * len(b), 0
    for i in range(1, len(b)):
        while k and b[i] != b[k]:
            k = fail[k - 1]
        k += b[i] == b[k]
        fail[i] = k
    k = 0
    for c in a:
        while k and (k == len(b) or c != b[k]):
            k = fail[k - 1]
        k += c == b[k]
    out = []
    while k:
        out.append(k)
        k = fail[k - 1]
    return out


def repeated(a: str, b: str, least: int = LEAST_LETTERS, part: float = LEAST_PART) -> int:
    """Letters at b's start that a's end has said already, as rolling captions do: the longest suffix of a that is a prefix of
    b, between word borders, of `least` letters and `part` of a at least; 0 without one."""
    least = max(least, math.ceil(part * len(a)))
    if min(len(a), len(b)) < least:
        return 0
    found, at = [], a.find(b[:least])
    while at >= 0 and len(found) < 64:
        found.append(at)
        at = a.find(b[:least], at + 1)
    lengths = (len(a) - i for i in found if b.startswith(a[i:])) if at < 0 else iter(_longest(a, b))
    return next((k for k in lengths if k >= least and _at_border(a, len(a) - k) and _at_border(b, k)), 0)


def clean(rows: DataFrame) -> DataFrame:
    """Adds said: the body without sounds and fillers, with white space and marks set right."""
    text = F.regexp_replace(D.unfilled(D.unsounded(F.col("body"))), r"\s+", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"([,，、])\s*[,，、]+", "$1"), r"^[\s,，、…;；:：.]+| (?=[,.!?，。！？])", "")
    return rows.withColumn("said", F.trim(text))


def calibrated(rows: DataFrame) -> dict[str, float]:
    """Seconds of the pause that parts short gaps from long ones, by origin: Otsu's border on logarithms of all gaps between
    neighbouring segments of one speaker. What comes to the driver is a histogram, bounded by its bins."""
    seq = sequenced(rows.select(*KEYS, "shard", *ORDER, "end_s", "speaker"), KEYS, "shard", ORDER, ["end_s", "speaker"])
    gap = F.least(F.greatest(F.col("start_s") - F.col("prev.end_s"), F.lit(SHORTEST_S)), F.lit(LONGEST_S))
    gaps = seq.where(F.col("speaker") == F.col("prev.speaker")).select("origin", F.floor(F.log2(gap) * BINS).cast("int").alias("bin")).where("bin is not null")
    found: dict[str, dict[int, int]] = {}
    for r in gaps.groupBy("origin", "bin").agg(F.count(F.lit(1)).alias("n")).collect():
        found.setdefault(r.origin, {})[r.bin] = r.n
    out = {}
    for origin, bins in found.items():
        x = np.array(sorted(bins), dtype=float)
        n = np.array([bins[int(b)] for b in x], dtype=float)
        if len(x) > 1:
            w, s = np.cumsum(n)[:-1], np.cumsum(n * x)[:-1]
            apart = w * (n.sum() - w) * (s / w - ((n * x).sum() - s) / (n.sum() - w)) ** 2
            at = int(apart.argmax())
            out[origin] = float(2 ** ((x[at] + 1 + x[at + 1]) / 2 / BINS))  # the middle of what lies empty between
    return out


def turns(rows: DataFrame, pauses: dict[str, float] | None = None, texts: bool = False) -> DataFrame:
    """origin, entity_id, head (start_s, pos, seg), speaker, n_rows of each turn and, with texts, said: its segments as
    (start_s, pos, seg, end_s, said). Rows have KEYS, shard, ORDER, speaker and, where they are needed, end_s and said. With
    `pauses` (seconds by origin) a turn also ends at one as long."""
    same = None
    if pauses:
        longest = F.create_map(*[F.lit(x) for kv in pauses.items() for x in kv])[F.col("origin")]
        same = F.coalesce(F.col("start_s") - F.col("_prev.end_s") < longest, F.lit(True))
    carry = ["end_s"] if pauses else []
    more = {"said": (F.collect_list(F.struct(*ORDER, "end_s", "said")), lambda c: F.flatten(F.collect_list(c)))} if texts else {}
    kept = [*KEYS, "shard", *ORDER, "speaker", *(["end_s", "said"] if texts else carry)]
    return value_runs(rows.select(*kept), KEYS, "shard", ORDER, "speaker", same, carry, more).where(F.col("speaker").isNotNull())


def rolled(segments: list[dict]) -> str:
    """The text of a turn's segments in order, without what a rolling caption says again."""
    out: list[str] = []
    before, end = "", None
    for s in segments:
        now = s["said"] or ""
        adjoins = end is None or s["start_s"] is None or s["start_s"] - end <= ADJOINING_S
        new = now[repeated(before, now) if adjoins else 0 :].strip()
        if new:
            out.append(new)
        before, end = now, s["end_s"]
    return " ".join(out)


def written(found: DataFrame) -> DataFrame:
    """origin, entity_id, head_seg, speaker, start_s, end_s, text of turns with their segments. No shuffle."""
    names = [*KEYS, "head_seg", "speaker", "start_s", "end_s", "text"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for *own, said in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                starts, ends = [s["start_s"] for s in said if s["start_s"] is not None], [s["end_s"] for s in said if s["end_s"] is not None]
                rows.append((*own, min(starts, default=None), max(ends, default=None), rolled(said)))
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    rows = found.select(*KEYS, F.col("head.seg").alias("head_seg"), "speaker", F.array_sort("said").alias("said"))
    return rows.mapInArrow(run, "origin string, entity_id string, head_seg bigint, speaker string, start_s double, end_s double, text string")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whatever the pauses, as defined."""
    out = turns(spoken_rows(spark, sf_dir))
    return out.select(*KEYS, F.col("head.seg").alias("head_seg"), "speaker", F.col("n_rows").alias("n_segs"))


def p7_turns(spark: SparkSession, sf_dir: str, pauses: dict[str, float] | None = None) -> DataFrame:
    """Clean turns: origin, entity_id, head_seg, speaker, start_s, end_s, text, in order by start_s. Turns end at a change of speaker and at pauses,
    calibrated on the tables unless they are given."""
    rows = spoken_rows(spark, sf_dir)
    pauses = calibrated(rows) if pauses is None else pauses
    return written(turns(clean(rows), pauses, texts=True))


QUERIES = {"p7_found": p7_found, "p7_turns": p7_turns}
SQL: dict[str, str] = {}
