"""Readers of sidecars, lexicons, manifests, summaries, probes and media, as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIDECAR = "language string, source_lang string, domain string, title string, lyrics_hint string, asr_bypass boolean, source string, note string, keywords array<string>, segments array<struct<start:double, end:double, text:string, speaker:string, keywords:array<string>>>"
MANIFEST = "id string, category string, file string, target_lang string, args array<string>, run_dir string"


def stem(path: Column) -> Column:
    """A file's name without folders and extensions of media and sidecars."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*[/\\]", ""), r"(\.gold)?\.[A-Za-z0-9]+$", "")


def sidecars(spark: SparkSession, path: str) -> DataFrame:
    """One row per sidecar, by the stem of its file; a file that is no JSON gives nulls."""
    return spark.read.schema(SIDECAR).option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("stem", stem(F.input_file_name()))


def transcripts(sidecar: DataFrame) -> DataFrame:
    """stem, segments, text, duration_s of sidecars that are to be used: asr_bypass isn't false and a segment has text.
    Blank segments are dropped, a missing start is 0, a missing end a second later."""
    own = F.filter("segments", lambda s: F.coalesce(F.trim(s["text"]), F.lit("")) != "")
    start = lambda s: F.coalesce(s["start"], F.lit(0.0))
    own = F.transform(own, lambda s: F.struct(start(s).alias("start"), F.coalesce(s["end"], start(s) + 1.0).alias("end"), F.trim(s["text"]).alias("text"), s["speaker"].alias("speaker"), s["keywords"].alias("keywords")))
    rows = sidecar.where(F.coalesce("asr_bypass", F.lit(True))).withColumn("segments", own).where(F.size("segments") > 0)
    return rows.select("stem", F.coalesce("language", "source_lang").alias("language"), "segments", F.array_join(F.transform("segments", lambda s: s["text"]), " ").alias("text"), F.array_max(F.transform("segments", lambda s: s["end"])).alias("duration_s"), F.lit(1.0).alias("confidence"))


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """kind (hotword or rule), src, dst of a lexicon's lines: `wrong|right` is a rule, another line a hotword, # a comment."""
    line = F.trim("value")
    parts = F.split(line, r"\|", 2)
    rows = spark.read.text(path).where((line != "") & ~line.startswith("#"))
    rule = F.size(parts) == 2
    return rows.select(F.when(rule, "rule").otherwise("hotword").alias("kind"), F.trim(parts[0]).alias("src"), F.when(rule, F.trim(F.get(parts, F.lit(1)))).alias("dst"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The samples of an acceptance manifest (YAML), read on the driver: it is a list written by hand."""
    import yaml

    samples = yaml.safe_load(Path(path).read_text(encoding="utf-8")).get("samples") or []
    names = [x.split()[0] for x in MANIFEST.split(", ")]
    return spark.createDataFrame([tuple(s.get(n) for n in names) for s in samples], MANIFEST)


def config(path: str, *overlays: dict, paths: tuple[str, ...] = ()) -> dict:
    """A YAML configuration with overlays on top, the last first; null values don't count. Relative values of the settings
    named in `paths` (a.b.c) are taken from the configuration's folder."""
    import yaml

    def merge(a: dict, b: dict) -> dict:
        return a | {k: merge(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items() if v is not None}

    out = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    for o in overlays:
        out = merge(out, o)
    for name in paths:
        *outer, last = name.split(".")
        at = out
        for part in outer:
            at = at.get(part) or {}
        if isinstance(at.get(last), str) and not Path(at[last]).is_absolute():
            at[last] = str(Path(path).resolve().parent / at[last])
    return out


def fps(rate: Column) -> Column:
    """Frames a second from a fraction or number; 0 for nothing and for a division by zero."""
    whole = F.split(rate, "/", 2)
    fraction = F.try_divide(whole[0].try_cast("double"), F.get(whole, F.lit(1)).try_cast("double"))
    return F.coalesce(F.when(F.contains(rate, F.lit("/")), fraction).otherwise(rate.try_cast("double")), F.lit(0.0))


def probe(text: Column) -> Column:
    """width, height, fps, duration, has_audio from what a media probe prints."""
    clock = lambda i: F.regexp_extract(text, r"Duration:\s*(\d+):(\d+):(\d+(?:\.\d+)?)", i).try_cast("double")
    size = lambda i: F.coalesce(F.regexp_extract(text, r"Video:.*?,\s*(\d{2,5})x(\d{2,5})", i).try_cast("int"), F.lit(0))
    return F.struct(
        size(1).alias("width"), size(2).alias("height"), F.coalesce(F.regexp_extract(text, r"([\d.]+)\s*fps", 1).try_cast("double"), F.lit(0.0)).alias("fps"),
        F.coalesce(clock(1) * 3600 + clock(2) * 60 + clock(3), F.lit(0.0)).alias("duration"), F.contains(text, F.lit("Audio:")).alias("has_audio"),
    )


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """run_dir and the labelled values of the summaries that `sinks.summary` writes."""
    rows = spark.read.text(path, wholetext=True)
    grab = lambda p: F.nullif(F.regexp_extract("value", p, 1), F.lit(""))
    return rows.select(F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1).alias("run_dir"), grab(r"length_ratio: ([\d.]+)").try_cast("double").alias("length_ratio"), grab(r"sync_score: ([\d.]+)").try_cast("double").alias("sync_score"), grab(r"status: (\w+)").alias("status"))


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest of runs (run_dir, has_summary, n_segments) that has a summary and segments."""
    return runs.where("has_summary and n_segments > 0").orderBy(F.col("run_dir").desc()).limit(1)


def resampled(samples: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Samples at another rate, between two by a straight line; channels (columns) become one by their mean."""
    mono = samples.mean(axis=1) if samples.ndim > 1 else samples
    if rate == target or not len(mono):
        return mono
    n = max(1, round(len(mono) * target / rate))
    return np.interp(np.arange(n) * (rate / target), np.arange(len(mono)), mono)


def media(spark: SparkSession, path: str, decode, target_rate: int | None = None) -> DataFrame:
    """path, sample_rate, samples of media files, by a decoder (bytes) -> (sample rate, samples, of one channel or a row of
    channels each) that the caller brings; at target_rate if it is given."""
    rows = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [decode(bytes(c)) for c in batch["content"]]
            made = [resampled(np.asarray(s, dtype=float), r, target_rate or r) for r, s in got]
            yield pd.DataFrame({"path": batch["path"], "sample_rate": [target_rate or r for r, _ in got], "samples": [m.tolist() for m in made]})

    return rows.mapInPandas(run, "path string, sample_rate int, samples array<double>")


def demuxed(spark: SparkSession, path: str, extract, again=None, target_rate: int | None = None) -> DataFrame:
    """As media, of the sound of videos: `extract` (bytes) -> (sample rate, samples); where it fails `again` is tried, as
    without filters, and where that fails too the row has no samples."""

    def decode(content: bytes):
        for f in (extract, again):
            try:
                if f is not None:
                    return f(content)
            except Exception:  # noqa: BLE001, S112 - a decoder may fail in any way
                continue
        return target_rate or 16_000, []

    return media(spark, path, decode, target_rate)


def run_segments(spark: SparkSession, path: str) -> DataFrame:
    """run_dir and the source text of runs' segments.json: the segments' sources in order, blank ones skipped, by spaces."""
    rows = spark.read.schema("segments array<struct<index:int, source:string>>").option("multiLine", True).json(path)
    own = F.filter(F.transform(F.coalesce("segments", F.array()), lambda s: F.trim(F.coalesce(s["source"], F.lit("")))), lambda t: t != "")
    return rows.select(F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1).alias("run_dir"), F.array_join(own, " ").alias("text"), F.coalesce(F.size("segments"), F.lit(0)).alias("n_segments"))


def samples(listed: DataFrame, files: DataFrame) -> DataFrame:
    """A list of samples (name, ...) with `exists`: whether a file (path) of that name is there."""
    there = files.select(F.regexp_replace("path", r"^.*[/\\]", "").alias("name")).distinct().withColumn("_there", F.lit(True))
    return listed.join(there, "name", "left").withColumn("exists", F.coalesce("_there", F.lit(False))).drop("_there")


def frames(signal: DataFrame, hop_ms: int = 10) -> DataFrame:
    """path, idx, rms: the energy of each hop of a signal (path, sample_rate, samples)."""
    hop = F.greatest(F.lit(1), (F.col("sample_rate") * hop_ms / 1000).cast("int"))
    rows = signal.withColumn("hop", hop).where(F.size("samples") > 0).select("*", F.explode(F.sequence(F.lit(0), ((F.size("samples") - 1) / F.col("hop")).cast("int"))).alias("idx"))
    part = F.slice("samples", F.col("idx") * F.col("hop") + 1, F.col("hop"))
    energy = F.aggregate(part, F.lit(0.0), lambda s, x: s + x * x) / F.size(part)
    return rows.select("path", F.col("idx").cast("bigint").alias("idx"), F.sqrt(energy).alias("rms"))
