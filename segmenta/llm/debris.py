"""Labels, time stamps, fillers and sound annotations of speech transcripts, as Spark expressions and patterns.

The patterns are used by Java's regex engine and, where a Python operator needs them, by `regex`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters without width, and full-width letters, digits and underscore with their half-width ones.
IGNORED = "​‌‍⁠﻿­"
FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F) if chr(c - 0xFEE0).isalnum()) + "＿"
HALF = "".join(chr(ord(c) - 0xFEE0) for c in FULL)

# Words that name a speaker before a number.
LABEL_WORDS = ["speaker", "spkr", "spk", "sprecher", "locuteur", "hablante", "falante", "orador", "спикер", "говорящий", "说话人", "話者", "话者", "発話者", "화자", "वक्ता", "s"]
# Filler words; the last letter may be drawn out.
FILLERS = [
    "uh", "um", "uhm", "hm", "er", "erm", "mm", "mhm", "hum", "heu", "euh", "bah", "eh", "ehm", "em", "este", "äh", "ähm", "öh", "öhm", "é", "hã", "ahn", "né",
    "э", "эм", "э-э", "мм", "ну", "अं", "उम", "हम्म", "मतलब", "흠", "음", "어", "그", "에", "저기",
]
CJK_FILLERS = ["嗯", "呃", "唔", "额", "ええと", "えっと", "えーと", "あのー", "あの", "うーん", "んー", "えー"]
#: Fillers that are also words: they count as fillers alone or before a comma, pause or the text's end.
ALSO_WORDS = ["那个", "这个"]

# Bracketed things that are no speech: times anywhere, and annotations without digits (in round brackets: of one word).
TIME = r"(?:\[\s*\d+(?:[:.,]\d+)*\s*s?\s*\]|\(\s*\d{1,4}(?::\d{2}){1,2}(?:[.,]\d+)?\s*\)|<\|\s*\d+(?:[.,]\d+)?\s*\|>)"
BARE_TIME = r"\d{1,4}(?::\d{2}){1,2}(?:[.,]\d{1,3})?(?:\s*-->\s*\d{1,4}(?::\d{2}){1,2}(?:[.,]\d{1,3})?)?(?=\s|$)"
SOUND = r"(?:\[[^\[\]\d]{1,40}\]|\{[^{}\d]{1,40}\}|<[^<>\d|]{1,40}>|【[^【】\d]{1,40}】|\*[^*\d]{1,40}\*|\(\([^()\d]{1,40}\)\)|\([^()\s\d]{1,40}\)|（[^（）\s\d]{1,40}）|[♪♫♬♩]+|\[[♪♫♬♩]+\])"
SOUND_FIRST = r"(?:\{[^{}\d]{1,40}\}|<[^<>\d|]{1,40}>|【[^【】\d]{1,40}】|\*[^*\d]{1,40}\*|\(\([^()\d]{1,40}\)\)|\([^()\s\d]{1,40}\)|（[^（）\s\d]{1,40}）|[♪♫♬♩]+|\[[♪♫♬♩]+\])"
LABEL = r"(?:" + "|".join(LABEL_WORDS) + r")[\s_.\-]{0,2}\d{1,3}"
#: A label or a name before the text: in square brackets, or before a colon or a dash between spaces.
PREFIX = r"^\s*(?:\[\s*([^\[\]:：]{1,40}?)\s*\]\s*[:：]?|([^\[\]:：\n]{1,40}?)\s*(?:[:：]|\s[-–—]\s))\s*"


def _drawn(word: str) -> str:
    return word + word[-1] + "*"


FILLER = r"(?<![\p{L}\p{M}\p{N}])(?:ben\s+)?(?:" + "|".join(sorted(map(_drawn, FILLERS), key=len, reverse=True)) + r")(?![\p{L}\p{M}\p{N}'’])"
CJK_FILLER = "(?:" + "|".join(sorted(map(_drawn, CJK_FILLERS), key=len, reverse=True)) + ")"
PAUSED = r"(?:" + "|".join(ALSO_WORDS) + r")(?=\s*(?:[,，、…。]|\.\.|$))"


#: The same for str.translate.
NARROWED = str.maketrans(FULL, HALF, IGNORED)


def narrow(text: Column) -> Column:
    """Without characters of no width, full-width letters and digits as half-width ones."""
    return F.translate(text, FULL + IGNORED, HALF)


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once however often f refers to it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _where(text: Column, hint: str, pattern: str) -> Column:
    """Without what the pattern finds, which is looked for only where the text has what the hint tells cheaply."""
    return _once(text, lambda t: F.when(t.rlike(hint), F.regexp_replace(t, pattern, " ")).otherwise(t))


def untimed(text: Column) -> Column:
    """Without time stamps in brackets, and bare ones at the start."""
    return _where(_where(text, r"[\[(<]", TIME), r"^\s*\d", rf"^\s*{BARE_TIME}")


def unsounded(text: Column) -> Column:
    return _where(text, r"[\[{<【*(（♪♫♬♩]", SOUND)


def unsounded_start(text: Column) -> Column:
    """Without annotations before the first word, so that a label after them is seen; labels in brackets stay."""
    return _where(text, r"^\s*[\[{<【*(（♪♫♬♩]", rf"^(?:\s*{SOUND_FIRST})+")


def unfilled(text: Column) -> Column:
    t = F.regexp_replace(text, f"(?iu){FILLER}", " ")
    return _where(t, f"[{''.join(sorted({c for w in (*CJK_FILLERS, *ALSO_WORDS) for c in w}))}]", f"(?:{CJK_FILLER}|{PAUSED})")


#: A letter or digit that no filler has; where there is one, there is a word.
_SURE = r"[\p{L}\p{N}&&[^" + "".join(sorted({x for w in (*FILLERS, *CJK_FILLERS, *ALSO_WORDS, "ben") for c in w if c.isalpha() for x in (c, c.upper(), c.lower()) if len(x) == 1})) + "]]"


def has_words(text: Column) -> Column:
    """Anything but labels, times, sounds and fillers; for text whose label is cut off already."""
    return _once(unsounded(text), lambda t: t.rlike(_SURE) | unfilled(t).rlike(r"[\p{L}\p{N}]"))


def speaker_number(label: Column) -> Column:
    """SPEAKER_NN of a label with a number, else null."""
    number = F.regexp_extract(label, rf"(?iu)^\s*(?:{'|'.join(LABEL_WORDS)})[\s_.\-]{{0,2}}(\d{{1,3}})\s*$", 1)
    return F.when(number != "", F.format_string("SPEAKER_%02d", number.try_cast("int")))
