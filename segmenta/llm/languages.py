"""Missing or wrong language labels, and the queries of problem 4.

A record's pieces (ASR segments, document lines, or the whole source text) are classified by the nearest centroid; the
record takes the language of most of its pieces. A given label, or the record's language for a piece, is only overruled
by a language that is CLAIMED near and nearer by CLAIM.

Defined results: null and empty texts, and texts and pieces of fewer than 6 letters or without a language, give no row;
an ASR record without segments goes by its text; a redelivered record counts once; a label that is no notation of
lang_names is a missing one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmenta.llm.langid import CLAIM, CLAIMED, LETTERS, REJECT, Model, code, confidence, notations, trained


def classify(pieces: list[list[str | None] | None], labels: list[str | None], model: Model) -> list[tuple[int, int, str, float, bool]]:
    """(record, piece_no, lang, confidence, found) of each piece with a language, and of each record as piece -1."""
    flat, owner, number = [], [], []
    for i, ps in enumerate(pieces):
        for j, p in enumerate(ps or []):
            if p and len(p) >= LETTERS:
                flat.append(p)
                owner.append(i)
                number.append(j)
    scores = model.scores(flat)
    top = scores.max(axis=1, initial=-1.0)
    good = np.flatnonzero(top >= REJECT).tolist()
    if not good:
        return []
    owner_a = np.array(owner)[good]
    s, n = scores[good], len(model.langs)
    best = s.argmax(axis=1)
    records, where = np.unique(owner_a, return_inverse=True)
    votes = np.zeros((len(records), n))
    np.add.at(votes, (where, best), 1.0)
    mean = np.zeros((len(records), n))
    np.add.at(mean, where, s)
    mean /= votes.sum(axis=1, keepdims=True)
    home = (votes + 1e-3 * mean).argmax(axis=1)
    for r, i in enumerate(records.tolist()):
        if labels[i] in model.langs:
            own = model.langs.index(labels[i])
            if mean[r, home[r]] < CLAIMED or mean[r, home[r]] - mean[r, own] <= CLAIM:
                home[r] = own
    sure = confidence(mean, model.sharpness)
    out = [(i, -1, model.langs[home[r]], float(sure[r]), labels[i] != model.langs[home[r]]) for r, i in enumerate(records.tolist())]
    near = s.max(axis=1)
    settled = np.where((near >= CLAIMED) & (near - s[np.arange(len(s)), home[where]] > CLAIM), best, home[where])
    piece_sure = confidence(s, model.sharpness)
    out += [(owner[k], number[k], model.langs[settled[x]], float(piece_sure[x]), bool(settled[x] != home[where[x]])) for x, k in enumerate(good)]
    return out


def languages(df: DataFrame, model: Model, only_found: bool = False) -> DataFrame:
    """df has origin, record_id, label (a code or null) and pieces (array of strings); no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            origin, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = [(origin[i], ids[i], j, lang, c, f) for i, j, lang, c, f in classify(batch.column(3).to_pylist(), batch.column(2).to_pylist(), model) if f or not only_found]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_())
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["origin", "record_id", "piece_no", "lang", "confidence", "found"])

    out = df.select("origin", "record_id", "label", "pieces").mapInArrow(run, "origin string, record_id bigint, piece_no bigint, lang string, confidence double, found boolean")
    return out.dropDuplicates(["origin", "record_id", "piece_no"])


def records(spark: SparkSession, sf_dir: str, names: dict[str, str]) -> DataFrame:
    """origin, record_id, label, pieces of asr_results, translations and documents."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    segments = F.transform("segments", lambda x: x["text"])
    asr = read("asr_results").select(F.lit("asr").alias("origin"), F.col("asr_id").alias("record_id"), code(F.col("asr_lang"), names).alias("label"), F.when(F.size("segments") > 0, segments).otherwise(F.array("text")).alias("pieces"))
    memo = read("translations").select(F.lit("translation").alias("origin"), F.col("trans_id").alias("record_id"), code(F.col("source_lang"), names).alias("label"), F.array("source_text").alias("pieces"))
    docs = read("documents").where("text is not null").select(F.lit("document").alias("origin"), F.col("doc_id").alias("record_id"), code(F.col("lang"), names).alias("label"), F.split("text", "\n").alias("pieces"))
    return asr.unionByName(memo).unionByName(docs).where("record_id is not null")


def p4_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = notations(spark, sf_dir)
    return languages(records(spark, sf_dir, names), trained(spark, sf_dir, names))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = notations(spark, sf_dir)
    return languages(records(spark, sf_dir, names), trained(spark, sf_dir, names), only_found=True).select("origin", "record_id", "piece_no", "lang")


QUERIES = {"p4_found": p4_found, "p4_languages": p4_languages}
SQL: dict[str, str] = {}
