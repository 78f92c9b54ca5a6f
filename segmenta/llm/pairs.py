"""Broken prompt and response pairs, here translations, and the queries of problem 1.

Ordered rules: emptiness; multilingual refusal phrases; the copied source; the wrong language, by the nearest centroid
of the language model (a script mismatch is part of it: scripts are features, but scripts alone don't tell Latin
languages apart); and breaking off, by an unclosed delimiter, by an ending without a full stop that hardly any text of that
language has, or by clauses, numbers or names of the source that are missing. Each row gets every defect that it triggers; the first in
that order is its defect.

Endings are counted over all rows. Defined results: null counts as empty; a redelivered row counts once; a pair without
source text is only held against the rules on the response; an unknown target language has no wrong language.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmenta.llm.langid import CLAIM, CLAIMED, LETTERS, Model, code, notations, trained

DEFECTS = ("empty", "refusal", "copy", "wrong_language", "truncated")
# Stand-ins for no text.
STAND_INS = {"null", "none", "nil", "nan", "n/a", "na", "n.a.", "no text", "empty", "blank", "undefined", "missing", "no translation", "not available", "untranslated", "todo", "tbd", "空", "无", "無", "なし", "없음", "нет текста", "vacío", "vide", "leer", "vazio", "खाली"}
# How one declines, in the languages of the tables; and what a translator would decline.
CANNOT = [
    r"can'?t\b", r"can ?not\b", r"not able", r"unable", r"won'?t be able", r"n'?t possible", r"not possible", r"must decline", r"have to decline", r"not allowed", r"not permitted", r"against my", r"refuse to",
    r"kann\b.{0,80}\bnicht", r"nicht möglich", r"\bnicht\b.{0,80}\bmöglich", r"darf\b.{0,80}\bnicht", r"ablehnen", r"nicht imstande", r"kann ich\b.{0,80}(?:leider|keine)", r"leider\b.{0,80}\bnicht", r"darf ich\b.{0,80}\bnicht",
    r"ne (?:peux|puis|saurais)", r"impossible", r"refuser", r"pas autorisée?", r"pas en mesure", r"pas possible",
    r"no puedo", r"no me es posible", r"no es posible", r"no estoy autorizad", r"rechazar", r"imposible", r"no soy capaz", r"no se puede",
    r"não posso", r"não me é possível", r"não é possível", r"recusar", r"não consigo", r"não estou autorizad", r"impossível",
    r"не могу", r"не вправе", r"отказ", r"невозможн", r"не уда", r"не имею права", r"нельзя", r"нет возможности", r"не получ", r"не смогу",
    r"无法", r"不能", r"不便", r"没办法", r"拒绝", r"不可以", r"不符合",
    r"[えけせてねべめれき]ません", r"できない", r"断り", r"かねます", r"かねる", r"控え",
    r"수 없", r"거절", r"어렵습니다", r"불가", r"못 ", r"할 수가 없",
    r"नहीं.{0,12}सक", r"संभव नहीं", r"असमर्थ", r"मना कर", r"इनकार", r"अनुमति नहीं", r"अस्वीकार", r"नहीं दे", r"नहीं कर",
]
TASK = [
    r"translat", r"render", r"this (?:text|content|passage|line|sentence|request)", r"that (?:line|request|text|sentence)", r"process", r"guideline", r"language (?:model|assistant)", r"usage rules", r"your request",
    r"übersetz", r"anfrage", r"abschnitt", r"diese[nr]? (?:inhalt|text|satz)", r"sprachassistent", r"richtlinie",
    r"traduire", r"traduction", r"demande", r"contenu", r"ce texte", r"ce passage", r"assistante? linguistique",
    r"traducir", r"traducción", r"solicitud", r"petición", r"contenido", r"este (?:texto|fragmento)", r"asistente de idiomas",
    r"traduzir", r"tradução", r"pedido", r"conteúdo", r"este (?:texto|trecho)", r"assistente de idiomas",
    r"перевод", r"перевести", r"перевест", r"запрос", r"текст", r"фрагмент", r"содерж", r"помощник",
    r"翻译", r"译文", r"请求", r"文字", r"内容", r"文本", r"助手",
    r"翻訳", r"訳", r"リクエスト", r"依頼", r"内容", r"テキスト", r"文章", r"アシスタント",
    r"번역", r"요청", r"내용", r"이 글", r"텍스트", r"도우미",
    r"अनुवाद", r"अनुरोध", r"सामग्री", r"पाठ", r"सहायक",
]
_CANNOT, _TASK = re.compile("|".join(CANNOT), re.IGNORECASE), re.compile("|".join(TASK), re.IGNORECASE)


def _literals(patterns: list[str]) -> list[str]:
    """The longest part of each pattern that every match of it contains."""
    out = set()
    for p in patterns:
        bare = re.sub(r"\(\?:[^()]*\)\??|\[[^\]]*\]|\\.|\.?\{[^}]*\}|.\?", "\n", p)
        out.add(max(re.split(r"[\n.*+|]", bare), key=len).casefold())
    return sorted(x for x in out if not any(y != x and y in x for y in out))


_DECLINING = _literals(CANNOT)
_SENTENCE = re.compile(r"(?<=[.!?。！？।])\s*")
_CLAUSE = re.compile(r"[,，、;；](?!\d)|[。！？।!?…]|\.(?!\w)")
_MARKED = re.compile(r"(?<![.…])[.!?。！？।][\s\"'”’»)）\]】」』]*$")
_SPACELESS = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]")
_NOT_WORD = re.compile(r"[\W_]+")
_NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
_ASCII, _LETTERS = re.compile("[A-Za-z]"), re.compile(r"[^\W\d_]")
_LATIN = re.compile(r"[A-Z][a-z]{3,}")
_OPENED = re.compile("[(\\[{“«‹„「『《〈（【｛〔\"`]")
_PAIRS = {"(": ")", "[": "]", "{": "}", "«": "»", "‹": "›", "「": "」", "『": "』", "《": "》", "〈": "〉", "（": "）", "【": "】", "｛": "｝", "〔": "〕"}


def core(text: str) -> str:
    """Letters, marks and digits alone, in one case."""
    return _NOT_WORD.sub("", unicodedata.normalize("NFKC", text).casefold())


def few_letters(text: str, most: int = LETTERS) -> bool:
    """Fewer than `most` letters?"""
    n = 0
    for c in text:
        n += c.isalpha()
        if n >= most:
            return False
    return True


def is_empty(text: str | None) -> bool:
    t = unicodedata.normalize("NFKC", text or "").strip().strip("()[]{}<>\"'“”.-* ").casefold()
    return not core(t) or t in STAND_INS


def is_refusal(text: str, source: str) -> bool:
    """It declines and speaks of the task in the same sentence, which the source doesn't."""

    def declines(t: str) -> bool:
        t = t.replace("’", "'")
        low = t.casefold()
        return any(x in low for x in _DECLINING) and bool(_CANNOT.search(t)) and any(_CANNOT.search(s) and _TASK.search(s) for s in _SENTENCE.split(t))

    return declines(text) and not declines(source)


def is_copy(text: str, source: str) -> bool:
    """The source's letters in order, with something around them, or without one word."""
    s, t = core(source), core(text)
    if few_letters(s):
        return False
    if s in t:
        return len(t) - len(s) <= max(24, len(s) // 2)
    short = len(s) - len(t)
    if not 0 < short <= max(16, len(s) // 4):
        return False
    head = next((i for i, (a, b) in enumerate(zip(s, t, strict=False)) if a != b), len(t))
    tail = next((i for i, (a, b) in enumerate(zip(reversed(s), reversed(t), strict=False)) if a != b), len(t))
    return head + tail >= len(t)


def ending(text: str) -> str | None:
    """The last word before closing marks, the last two letters of spaceless scripts; numbers are alike."""
    t = text.rstrip(" \t\n\r\u00a0\u3000.!?。！？।…·\"'”’»)）]】」』-–—~*_")
    if not t:
        return None
    if t[-1].isdigit():
        return "0"
    if _SPACELESS.match(t[-1]):
        return t[-2:] if _SPACELESS.match(t[-2:-1] or " ") else t[-1]
    at = len(t)
    while at and (t[at - 1].isalpha() and not _SPACELESS.match(t[at - 1]) or t[at - 1] in "'’" or unicodedata.category(t[at - 1])[0] == "M"):
        at -= 1
    return t[at:].casefold() or None


def unclosed(text: str) -> int:
    """How many kinds of delimiters stay open: brackets and quotes that differ, German low quotes, straight quotes and code
    fences of odd number. A straight quote after a digit is an inch."""
    if not _OPENED.search(text):
        return 0
    n = sum(text.count(a) > text.count(b) for a, b in _PAIRS.items())
    low, up, end = text.count("„"), text.count("“"), text.count("”")
    n += low > up + end if low else up > end
    return n + len(re.findall(r'(?<!\d)"', text)) % 2 + text.count("```") % 2


def numbers(text: str) -> list[str]:
    """Numbers of two or more digits, which translations keep in digits, without their separators."""
    return [n for n in (re.sub(r"[.,]", "", n) for n in _NUMBER.findall(text)) if len(n) > 1]


def is_truncated(text: str, source: str, lang: str | None, endings: dict[tuple[str, str], int], neutral: frozenset[str]) -> bool:
    if unclosed(text) > unclosed(source):
        return True
    last = ending(text)
    if last is None or (lang is not None and (lang, last) not in endings and not _MARKED.search(text)):
        return True
    have = numbers(text)
    if any(n not in have for n in numbers(source)):
        return True
    # in a source of another script, what is written in Latin letters is a name and stays
    names = {w.lower() for w in _LATIN.findall(source)} & neutral
    if names and len(_ASCII.findall(source)) * 2 < len(_LETTERS.findall(source)):
        folded = text.casefold()
        if any(w not in folded for w in names):
            return True

    def clauses(t: str) -> int:
        """Parts between marks of nine letters at least, a letter of a spaceless script for 1.4; one if none is."""
        parts = [core(c) for c in _CLAUSE.split(t)]
        return sum(len(c) + 0.4 * len(_SPACELESS.findall(c)) >= 9 for c in parts) or any(parts)

    return clauses(text) < clauses(source)


def endings(df: DataFrame, share: float = 0.0002) -> dict[tuple[str, str], int]:
    """How often texts of each language (text, lang) end in each word and a full stop, over all rows; words that so end more
    than `share` of a language's texts. So a language has at most 1 / share of them, however many texts there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], int] = {}
        for batch in batches:
            for t, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if _MARKED.search(t) and (e := ending(t)) is not None:
                    found[lang, e] = found.get((lang, e), 0) + 1
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in (zip(*found, strict=True) if found else [[], []])), pa.array(list(found.values()), pa.int64())], names=["lang", "e", "n"])

    rows = df.where("text is not null and lang is not null").select("text", "lang").mapInArrow(count, "lang string, e string, n bigint").groupBy("lang", "e").agg(F.sum("n").alias("n"))
    total = rows.groupBy("lang").agg(F.sum("n").alias("total"))
    kept = rows.join(total, "lang").where((F.col("n") >= 2) & (F.col("n") > share * F.col("total")))
    return {(r.lang, r.e): r.n for r in kept.collect()}


def defects(df: DataFrame, model: Model, usual: dict[tuple[str, str], int]) -> DataFrame:
    """df has id, source, text, lang (a code or null). Gives id and defects (array, in order) of each defective row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sources, texts, langs = (c.to_pylist() for c in batch.columns)
            scores = model.scores([t or "" for t in texts])
            out: list[tuple[int, list[str]]] = []
            for i, source, text, lang, score in zip(ids, sources, texts, langs, scores, strict=True):
                source = source or ""
                if is_empty(text):
                    out.append((i, ["empty"]))
                    continue
                same = few_letters(text) and few_letters(core(text)) and core(source) == core(text)
                found = ["refusal"] * is_refusal(text, source) + ["copy"] * is_copy(text, source)
                if lang in model.langs and score.max() >= CLAIMED and score.max() - score[model.langs.index(lang)] > CLAIM:
                    found.append("wrong_language")
                if not same and is_truncated(text, source, None if "wrong_language" in found else lang, usual, model.neutral):
                    found.append("truncated")
                if found:
                    out.append((i, found))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.list_(pa.string()))], names=["id", "defects"])

    return df.select("id", "source", "text", "lang").mapInArrow(run, "id bigint, defects array<string>").dropDuplicates(["id"])


def p1_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = notations(spark, sf_dir)
    rows = spark.read.parquet(f"{sf_dir}/translations.parquet").where("trans_id is not null")
    rows = rows.select(F.col("trans_id").alias("id"), F.col("source_text").alias("source"), F.col("translated_text").alias("text"), code(F.col("target_lang"), names).alias("lang"))
    return defects(rows, trained(spark, sf_dir, names), endings(rows)).withColumnRenamed("id", "trans_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_defects(spark, sf_dir).select("trans_id", F.col("defects")[0].alias("defect"))


QUERIES = {"p1_found": p1_found, "p1_defects": p1_defects}
SQL: dict[str, str] = {}
