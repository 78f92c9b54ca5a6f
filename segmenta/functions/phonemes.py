"""Phonemes: from text by the fallbacks that need no dictionary, their class and openness, which are vowels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phonemes by class, finals of pinyin syllables, vowels of the ARPA alphabet, letters of pinyin initials.
CLASSES = {
    "high_close": "i y ɨ ʉ ɯ u",
    "near_close": "ɪ ʏ ʊ",
    "mid_close": "e ø ɘ ɵ ɤ o",
    "mid": "ə",
    "mid_open": "ɛ œ ɜ ɞ ʌ ɔ",
    "near_open": "æ ɐ",
    "open": "a ɶ ɑ ɒ",
    "plosive": "p b t d k g ʔ",
    "nasal": "m n ɲ ŋ",
    "fricative": "f v θ ð s z ʃ ʒ h",
    "approximant": "j w l r",
}
FINALS = "a o e i u v ai ei ao ou an en ang eng ong ia ie iu ian in iang ing iong ua uo uai ui uan un uang ueng ve vn van".split()
ARPA_VOWELS = "AA AE AH AO AW AY EH ER EY IH IY OW OY UH UW".split()
INITIAL_LETTERS = "bpmfdtnlgkhjqxzcsrwy"
# Openness by final, ARPA vowel and class; all other finals, ARPA vowels and phonemes come last in each.
OPEN_FINALS, MID_FINALS = "a ai ao an ang ia ua uai uan uang".split(), "o e uo ou ong er en eng".split()
OPEN_ARPA, MID_ARPA = "AA AE AO AW AY".split(), "EH AH ER OW OY".split()
BY_CLASS = {"open": ("open", 0.85), "near_open": ("open", 0.85), "mid_open": ("mid", 0.5), "mid": ("mid", 0.5), "high_close": ("closed", 0.15), "near_close": ("closed", 0.15), "plosive": ("closed", 0.1), "nasal": ("mid", 0.4), "fricative": ("mid", 0.4), "mid_close": ("mid", 0.5), "approximant": ("mid", 0.5)}
CORE_FINALS, CORE_ARPA, CORE_LEAST, CORE_OVER = "a ao ang ia ua ai".split(), "AA AE AO".split(), 0.55, 0.45
BORDER_CLASSES = ("plosive", "open", "near_open")

CLASS_OF = {p: name for name, ps in reversed(CLASSES.items()) for p in ps.split()}
VOWELS = [p for p, name in CLASS_OF.items() if name in list(CLASSES)[:7]]


def of_text(text: Column, lang: Column) -> Column:
    """Phonemes of a text: Chinese by letters without spaces, English by words in lower case, others by letters."""
    letters = lambda t: F.filter(F.split(t, ""), lambda c: c != "")
    by_word = F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")
    return F.when(lang.isin("zh", "zho", "chi", "cmn"), letters(F.replace(text, F.lit(" "), F.lit("")))).when(lang.isin("en", "eng", "english"), by_word).otherwise(letters(text))


def bare(phoneme: Column) -> Column:
    """Without the digits of tone or stress. Most phonemes are one letter, which needs no pattern."""
    plain = (F.length(phoneme) == 1) & ~phoneme.between("0", "9") & (phoneme != " ")
    return F.when(plain, phoneme).otherwise(F.regexp_replace(F.trim(phoneme), "[0-9]+$", ""))


def final(phoneme: Column) -> Column:
    """The final of a pinyin syllable, null if it is none. Finals begin with vowels and initials have none, so a syllable is
    its leading consonants and a final that is the whole rest."""
    return _final(F.lower(bare(phoneme)))


def _final(low: Column) -> Column:
    whole = F.nullif(F.regexp_extract(low, f"^[{INITIAL_LETTERS}]*({'|'.join(FINALS)})$", 1), F.lit(""))
    return F.when(F.length(low) == 1, F.when(low.isin([f for f in FINALS if len(f) == 1]), low)).otherwise(whole)


#: Every listed phoneme is one letter, so its class is found by exchanging it for a mark of the class.
_MARKS = {name: chr(0xE000 + i) for i, name in enumerate(CLASSES)}


def kind(phoneme: Column) -> Column:
    """The mark of a phoneme's class as it is written; the phoneme itself without one."""
    return F.when(F.length(phoneme) == 1, F.translate(phoneme, "".join(CLASS_OF), "".join(_MARKS[c] for c in CLASS_OF.values()))).otherwise("")


def described(phoneme: Column) -> Column:
    """What the other functions ask of a phoneme, found once: its final, its bare form in capitals and in small letters, and
    the marks of its class as written and of its bare small form."""
    low = F.lower(bare(phoneme))
    return F.struct(_final(low).alias("final"), F.upper(low).alias("arpa"), low.alias("low"), kind(phoneme).alias("written"), kind(low).alias("kind"))


def openness(x: Column) -> Column:
    """(class, openness) of a described phoneme: as a pinyin syllable, else an ARPA vowel, else by its class as written or
    else of its bare form, else mid."""
    pair = lambda c, v: F.struct(F.lit(c).alias("class"), F.lit(v).alias("openness"))
    f, arpa = x["final"], x["arpa"]
    out = F.when(f.isin(OPEN_FINALS), pair("open", 0.75)).when(f.isin(MID_FINALS), pair("mid", 0.55)).when(f.isNotNull(), pair("mid", 0.45))
    out = out.when(arpa.isin(OPEN_ARPA), pair("open", 0.8)).when(arpa.isin(MID_ARPA), pair("mid", 0.55)).when(arpa.isin(ARPA_VOWELS), pair("closed", 0.25))
    marks = lambda cv: [_MARKS[n] for n, y in BY_CLASS.items() if y == cv]
    for k in ("written", "kind"):
        for c, v in dict.fromkeys(BY_CLASS.values()):
            out = out.when(x[k].isin(marks((c, v))), pair(c, v))
    return out.otherwise(pair("mid", 0.5))


def is_vowel(x: Column) -> Column:
    return x["final"].isNotNull() | x["arpa"].isin(ARPA_VOWELS) | x["low"].isin(*VOWELS, *"aeiou")


def vowel_openness(x: Column, own: Column) -> Column:
    """Openness of a vowel; that of the widest finals and ARPA vowels is CORE_LEAST at least."""
    wide = F.coalesce(x["final"].isin(CORE_FINALS), F.lit(False)) | x["arpa"].isin(CORE_ARPA)
    return F.when(wide, F.greatest(own, F.lit(CORE_LEAST))).otherwise(own)


def is_border(x: Column) -> Column:
    """Is its start one that lips have to meet, as of plosives and open vowels? As it is written."""
    return x["written"].isin(*(_MARKS[c] for c in BORDER_CLASSES))
