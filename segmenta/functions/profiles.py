"""Recognition profiles: which one a recording takes, its settings, and the prompt that goes with it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The built-in profiles; a null or absent setting leaves the base one.
PROFILES: dict[str, dict] = {
    "neutral": {"initial_prompt": "这是一段中文口语对话，请准确转写说话内容。", "condition_on_previous_text": False},
    "singing": {
        "initial_prompt": "这是中文清唱，请按歌词逐字转写，不要写成对话摘要。", "condition_on_previous_text": False, "model_name": "medium", "beam_size": 5,
        "split_silence_seconds": 0.55, "max_segment_seconds": 6.0, "min_segment_seconds": 0.8, "merge_gap_seconds": 0.80, "merge_short_chars": 18,
        "min_silence_ms": 400, "crumb_max_chars": 6,
    },
    "fleurs_dialog": {"initial_prompt": "这是一段中文朗读，请准确转写说话内容。", "condition_on_previous_text": False},
    "video_talking": {
        "initial_prompt": "Clear spoken English from a talking-head video. Transcribe verbatim. Proper nouns may include Wiki Education, Wikidata, Wikipedia, Will Kent.",
        "condition_on_previous_text": False, "language": "en", "beam_size": 5, "vad_filter": True, "min_silence_ms": 320, "speech_pad_ms": 160,
        "split_silence_seconds": 0.45, "max_segment_seconds": 5.5, "min_segment_seconds": 0.6, "merge_gap_seconds": 0.70, "merge_max_seconds": 7.0,
        "merge_short_chars": 28, "crumb_max_chars": 8,
    },
}
#: Names that a prompt lists, in Chinese and in other languages.
NAMES_ZH, NAMES_OTHER = 12, 16


def merged(own: dict[str, dict] | None = None) -> dict[str, dict]:
    """The built-in profiles with a configuration's own over them."""
    return {k: PROFILES.get(k, {}) | v for k, v in {**dict.fromkeys(PROFILES, {}), **{k: v for k, v in (own or {}).items() if isinstance(v, dict)}}.items()}


def applied(base: dict, name: str | None = None, own: dict[str, dict] | None = None) -> tuple[dict, str]:
    """A configuration under a profile, and the profile's name: an unknown one is neutral, null settings don't count."""
    known = merged(own)
    name = (name or base.get("prompt_profile") or "neutral").strip().lower()
    name = name if name in known else "neutral"
    return base | {k: v for k, v in known[name].items() if v is not None} | {"prompt_profile_active": name}, name


def resolved(asked: Column, stem: Column) -> Column:
    """The profile of a recording: the one asked for if it is known, singing by the name of its file, else neutral."""
    name = F.lower(F.trim(asked))
    return F.when(name.isin(*PROFILES), name).when(F.nullif(name, F.lit("")).isNull() & F.lower(stem).startswith("singing_"), "singing").otherwise("neutral")


def language(profile: Column, explicit: Column, named: Column) -> Column:
    """What is known of the language: told, else by the file's name, else by the profile; null if unknown."""
    return F.coalesce(F.nullif(explicit, F.lit("")), named, F.when(profile == "video_talking", "en"))


def prompt(profile: Column, lang: Column, title: Column, hint: Column, names: Column) -> Column:
    """The recogniser's prompt: for singing with title and lyrics, else with the names that may appear."""
    base = F.create_map(*[F.lit(x) for k, v in PROFILES.items() for x in (k, v["initial_prompt"])])[profile]
    given = lambda c, f: F.when(F.coalesce(c, F.lit("")) != "", F.format_string(f, c)).otherwise("")
    song = F.concat(base, given(title, " 歌曲《%s》。"), given(hint, " 歌词包含：%s。"))
    own = F.array_distinct(F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")))
    chinese = F.coalesce(F.split(F.lower(lang), "-")[0].isin("zh", "yue", "chinese", "cmn"), F.lit(True))
    latin = F.trim(F.concat(F.when(profile == "neutral", "").otherwise(F.concat(base, F.lit(" "))), F.when(F.size(own) > 0, F.concat(F.lit("Names that may appear: "), F.array_join(F.slice(own, 1, NAMES_OTHER), ", "), F.lit("."))).otherwise("")))
    begun = F.when((profile == "video_talking") & (F.size(own) > 0), "这是一段视频口播，请准确转写说话内容。").otherwise(base)
    han = F.when(F.size(own) > 0, F.concat(begun, F.lit(" 可能出现的专名："), F.array_join(F.slice(own, 1, NAMES_ZH), "、"), F.lit("。"))).otherwise(base)
    return F.when(profile == "singing", song).when(profile == "fleurs_dialog", base).when(chinese, han).otherwise(latin)
