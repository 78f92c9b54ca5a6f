"""Emotion labels: their forms, what they stand for, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType

# The categories, other names of them, letters that tell one where no name fits (in this order), valence and
# arousal of each, and half tones and rate by which speech of each is changed.
CATEGORIES = ["neutral", "happy", "sad", "angry", "surprised", "fearful", "disgusted"]
NAMES = {
    "happy": "happy", "happiness": "happy", "joy": "happy", "hap": "happy",
    "sad": "sad", "sadness": "sad",
    "angry": "angry", "anger": "angry", "ang": "angry",
    "fearful": "fearful", "fear": "fearful", "fea": "fearful",
    "disgusted": "disgusted", "disgust": "disgusted", "disg": "disgusted",
    "surprised": "surprised", "surprise": "surprised", "surp": "surprised",
    "neutral": "neutral", "calm": "neutral", "neu": "neutral",
}
PARTS = ["hap", "sad", "ang", "fea", "disg", "surp"]
VALENCE_AROUSAL = {
    "neutral": (0.0, 0.3), "happy": (0.8, 0.7), "sad": (-0.7, 0.2), "angry": (-0.5, 0.9),
    "surprised": (0.4, 0.8), "fearful": (-0.6, 0.8), "disgusted": (-0.7, 0.5),
}
PROSODY = {
    "happy": (1.0, 1.04), "surprised": (1.5, 1.05), "positive": (0.8, 1.03), "sad": (-1.2, 0.96), "negative": (-1.0, 0.97),
    "angry": (1.8, 1.06), "fearful": (0.8, 1.04), "disgusted": (0.5, 1.0),
}


def looked_up(key: Column, table: dict, other: object) -> Column:
    """The table's value of a key, `other` without one."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key], F.lit(other))


def coerced(raw: Column, kind: DataType | None = None) -> Column:
    """One label of what a model gives: a text, a list (its first), or a map (its `label`, else `emotion`, else first
    value). Of several in a text the first counts; null and blank are neutral."""
    if isinstance(kind, ArrayType):
        raw = F.get(raw, F.lit(0))
    elif isinstance(kind, MapType):
        told = lambda k: F.nullif(F.try_element_at(raw, F.lit(k)), F.lit(""))
        raw = F.coalesce(told("label"), told("emotion"), F.get(F.map_values(raw), F.lit(0)))
    first = F.trim(F.get(F.split(F.trim(raw), "[/|,;]"), F.lit(0)))
    return F.coalesce(F.nullif(first, F.lit("")), F.lit("neutral"))


def category(label: Column) -> Column:
    """The category of one label: by its name, else by the first part that it holds, else neutral."""
    low = F.lower(label)
    part = F.coalesce(*[F.when(F.contains(low, F.lit(p)), NAMES[p]) for p in PARTS], F.lit("neutral"))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])[low], part)


def all_scores(scores: Column) -> Column:
    """A map of scores with 0 for each category that it lacks; null counts as an empty map."""
    own = F.coalesce(scores, F.from_json(F.lit("{}"), "map<string,double>"))
    lacking = F.filter(F.array(*map(F.lit, CATEGORIES)), lambda c: ~F.map_contains_key(own, c))
    return F.map_concat(own, F.map_from_arrays(lacking, F.transform(lacking, lambda c: F.lit(0.0))))


def intensity(scores: Column) -> Column:
    """The greatest score over 0.8, 1 at most; 0.5 where no score is above 0."""
    most = F.array_max(F.map_values(scores))
    return F.when(most > 0, F.least(most / 0.8, F.lit(1.0))).otherwise(0.5)
