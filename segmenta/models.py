"""Slots for models that run outside: a schema each, and a deterministic stand-in. A slot is a function on a pandas
DataFrame that adds the schema's columns; the caller passes its own to `apply`."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SLOTS = {
    "transcribe": "text string, confidence double",
    "emotion": "emotion string, intensity double",
    "language": "language string, confidence double, alternatives array<struct<language:string, confidence:double>>",
    "embed": "embedding array<double>",
    "translate": "tgt string, engine string",
    "openness": "openness double",
    "repair": "repaired string",
    "speak": "sample_rate int, duration_s double, engine string",
}


def echo_transcribe(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.assign(text=rows["text"].fillna(""), confidence=1.0)


def neutral_emotion(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.assign(emotion="neutral", intensity=0.5)


def no_language(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.assign(language="und", confidence=0.0, alternatives=[[] for _ in range(len(rows))])


def zero_embedding(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.assign(embedding=[[0.0] * 8 for _ in range(len(rows))])


def pass_through(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.assign(tgt=rows["text"].fillna(""), engine="none")


def half_open(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.assign(openness=0.5)


def no_repair(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.assign(repaired=rows["text"].fillna(""))


def silent(rows: pd.DataFrame) -> pd.DataFrame:
    """As long as the text would take at fifteen letters a second; no sound is made."""
    return rows.assign(sample_rate=24_000, duration_s=rows["text"].fillna("").map(len) / 15.0, engine="none")


STAND_INS: dict[str, Callable[[pd.DataFrame], pd.DataFrame]] = {"transcribe": echo_transcribe, "emotion": neutral_emotion, "language": no_language, "embed": zero_embedding, "translate": pass_through, "openness": half_open, "repair": no_repair, "speak": silent}


def apply(rows: DataFrame, slot: str, model: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
    """Adds a slot's columns, in Arrow batches, without a shuffle; columns of the same names are replaced."""
    added = StructType.fromDDL(SLOTS[slot])
    kept = [f for f in rows.schema.fields if f.name not in added.fieldNames()]
    schema = StructType([*kept, *added.fields])
    run, names = model or STAND_INS[slot], schema.fieldNames()

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield run(part)[names]

    return rows.mapInPandas(batches, schema)


def repaired(rows: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
    """Texts after a model's repair, which counts only if it keeps two fifths of the letters and four at least; an
    announcement before it and quotes around it are dropped. Texts of fewer than four letters stay."""
    out = apply(rows, "repair", model)
    text, made = F.trim(F.coalesce("text", F.lit(""))), F.regexp_replace(F.trim(F.coalesce("repaired", F.lit(""))), "^(修正后|输出)[:：]\\s*", "")
    made = F.regexp_replace(made, "^[「」\"']+|[「」\"']+$", "")
    good = (F.length(text) >= 4) & (F.length(made) >= F.greatest(F.length(text) * 0.4, F.lit(4.0)))
    return out.withColumn("text", F.when(good, made).otherwise(text)).drop("repaired")


def transcribed_again(rows: DataFrame, flagged: Column, first: Callable, again: Callable) -> DataFrame:
    """Transcripts by a model; those that are flagged as invented (a column of the result) are made once more by another,
    as the same one without its prompt, and only they."""
    out = apply(rows, "transcribe", first).withColumn("_bad", F.coalesce(flagged, F.lit(False)))
    redone = apply(out.where("_bad").drop("_bad"), "transcribe", again)
    return out.where("not _bad").drop("_bad").unionByName(redone)


def with_fallbacks(rows: DataFrame, models: list[Callable[[pd.DataFrame], pd.DataFrame]], good: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """Translations by the first model whose result is good; each later one only sees the rows that are left."""

    def chain(part: pd.DataFrame) -> pd.DataFrame:
        left, done = part, []
        for m in models:
            if not len(left):
                break
            got = m(left)
            ok = good(got)
            done.append(got[ok])
            left = left[~ok]
        if len(left):
            done.append(left.assign(tgt="", engine="failed"))
        return pd.concat(done) if done else part.assign(tgt="", engine="none")

    return apply(rows, "translate", chain)
