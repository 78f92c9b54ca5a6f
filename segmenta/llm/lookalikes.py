"""One form for text that looks the same, and the queries of problem 6.

Text is decomposed for compatibility, ignorable characters are deleted and all kinds of space become one. Then each word
is a lattice: a letter that has twins in other scripts may be any of them. Viterbi takes the path with the best score of
character bigrams inside one script, a large price for every change of script, and a small one for leaving the script of
the line's own unmistakable letters. The score never asks which twin was written, so texts that differ only in twins
end in the same form. Bigram counts are taken over all lines, from words that are unmistakably of one script.

Han letters and kana that look alike are twins as well. These scripts mix inside words, so a change between them has no
price: the counts of a twin's neighbours, in whichever script, decide. Digits are no letters and have no twins here.

What looks different stays different: case, accents and other marks, the number of spaces, simplified and traditional
characters. Defined results: null text has a null form and is in no pair; a keyword that is null or has nothing visible
is not looked for; copies of a line pair with each differing line, never with each other.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Letters that look alike, by script. Position i of each row is the same shape; a space means none.
TWINS = {
    "Latin": "ABCEHIJKMNOPSTVXYZacehijopqsuvwxydgklb",
    "Cyrillic": "АВСЕНІЈКМ ОРЅТѴХУ асеһіјорԛѕ ѵԝхуԁ  ӏ ",
    "Greek": "ΑΒ ΕΗΙ ΚΜΝΟΡ Τ ΧΥΖα   ι ορ  υν χγ    ",
    "Armenian": "          Օ Տ       հ ո օ զ ս      ց լ ",
}
#: Kana (in the first row katakana, then hiragana) and Han letters that look alike; a space means none.
MIXED = {
    "Katakana": "カニロエハトタオヒヘベペー",
    "Hiragana": "         へべぺ ",
    "Han": "力二口工八卜夕才匕   一",
}
#: Price of a change of script inside a word, and of a script that is not the line's.
CHANGE, FOREIGN = 40.0, 6.0
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_IGNORED = regex.compile(r"[\p{Default_Ignorable_Code_Point}\p{Cf}​]")
_SPACE = regex.compile(r"[\p{Zs}]")
_HYPHENS = {0x2010: "-", 0x2011: "-", 0x2043: "-", 0x02BC: "'"}
_SCRIPT = {s: regex.compile(rf"\p{{Script={s}}}") for s in TWINS}


def _twins() -> dict[str, dict[str, str]]:
    """For each letter that has twins: the letter of each script."""
    out: dict[str, dict[str, str]] = {}
    for i in range(len(TWINS["Latin"])):
        row = {s: letters[i] for s, letters in TWINS.items() if i < len(letters) and letters[i] != " "}
        for letter in row.values():
            out[letter] = row | out.get(letter, {}) if len(row) > 1 else out.get(letter, {})
    return {k: v for k, v in out.items() if v}


_TWIN = _twins()
_MIXED_TWIN = {c: "".join(column).replace(" ", "") for column in zip(*MIXED.values(), strict=True) for c in column if c != " "}
#: Twins in a row among Han letters and kana, but for those with a sound mark, which only kana have; and a letter of theirs.
_TWINS_MET = regex.compile(f"(?:[{''.join(_MIXED_TWIN)}](?![\u3099\u309a]))+")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]")


def script(letter: str) -> str:
    return next((s for s, p in _SCRIPT.items() if p.match(letter)), "other")


def plain(text: str) -> str:
    """Compatibility decomposition without ignorable characters, with one kind of space."""
    if text.isascii():
        return text
    text = _IGNORED.sub("", unicodedata.normalize("NFKD", _IGNORED.sub("", text)))
    return _SPACE.sub(" ", text).translate(_HYPHENS)


def _neighbours(text: str, m: regex.Match) -> tuple[str, str, str]:
    """The letter before twins in a row, or a border, the twins, and the letter after them, or a border."""
    a, b = m.span()
    left, right = text[a - 1 : a], text[b : b + 1]
    return left if left and _CJK.match(left) else "^", m.group(), right if right and _CJK.match(right) else "$"


class Former:
    """Gives text its form by bigram counts {(script, first, second): n}."""

    def __init__(self, counts: dict[tuple[str, str, str], int]):
        self.pairs = {(a, b): n for (s, a, b), n in counts.items() if s == "mixed"}
        counts = {k: n for k, n in counts.items() if k[0] != "mixed"}
        total: dict[tuple[str, str], int] = {}
        for (s, a, _), n in counts.items():
            total[s, a] = total.get((s, a), 0) + n
        self.score = {(s, a, b): math.log((n + 0.1) / (total[s, a] + 10)) for (s, a, b), n in counts.items()}
        self.base = {k: math.log(0.1 / (n + 10)) for k, n in total.items()}
        self.known: dict[tuple[str, str], str] = {}
        self.met: dict[str, str] = {}
        self.owner: dict[str, str] = {}

    def among(self, left: str, met: str, right: str) -> str:
        """Twins in a row between two letters (or borders) as the likeliest letters. Other letters have no choice, so nothing
        beyond the neighbours matters."""
        key = left + met + right
        if (done := self.met.get(key)) is None:
            if len(self.met) > 300_000:
                self.met.clear()
            paths = {left: (0.0, "")}
            for column in [*(_MIXED_TWIN[c] for c in met), right]:
                step: dict[str, tuple[float, str]] = {}
                for c in column:
                    best = max(((v + math.log(self.pairs.get((a, c), 0) + 0.1), path) for a, (v, path) in paths.items()), key=lambda x: (x[0], x[1]))
                    step[c] = (best[0], best[1] + c)
                paths = step
            done = self.met[key] = paths[right][1][:-1]
        return done

    def script(self, letter: str) -> str:
        if (s := self.owner.get(letter)) is None:
            s = self.owner[letter] = script(letter)
        return s

    def home(self, text: str) -> str:
        """The script of most letters that have no twin; Latin if there are none."""
        count: dict[str, int] = {}
        for w in _WORD.findall(text):
            for c in w:
                if c not in _TWIN and (s := self.script(c)) in TWINS:
                    count[s] = count.get(s, 0) + 1
        return max(sorted(count), key=count.__getitem__) if count else "Latin"

    def word(self, word: str, home: str) -> str:
        if (done := self.known.get((word, home))) is None:
            if len(self.known) > 300_000:
                self.known.clear()
            done = self.known[word, home] = self._search(word, home)
        return done

    def _search(self, word: str, home: str) -> str:
        if not any(c in _TWIN for c in word):
            return word
        states: dict[tuple[str, str], tuple[float, str]] = {("", "^"): (0.0, "")}
        for c in word:
            if unicodedata.combining(c):
                states = {k: (v, path + c) for k, (v, path) in states.items()}
                continue
            step: dict[tuple[str, str], tuple[float, str]] = {}
            for s, twin in (_TWIN.get(c) or {self.script(c): c}).items():
                price = 0.0 if s in (home, "other") else FOREIGN / len(word)
                for (before, last), (v, path) in states.items():
                    w = v - price - (CHANGE if before and before != s else 0.0)
                    w += self.score.get((s, last, twin), self.base.get((s, last), -4.0))
                    if (s, twin) not in step or w > step[s, twin][0]:
                        step[s, twin] = (w, path + twin)
            states = step
        return max(sorted(states.values(), key=lambda x: x[1]), key=lambda x: x[0])[1]

    def form(self, text: str, home: str) -> str:
        if not text.isascii():
            text = _TWINS_MET.sub(lambda m: self.among(*_neighbours(text, m)), text)
        return unicodedata.normalize("NFC", _WORD.sub(lambda m: self.word(m.group(), home), text))


def bigrams(df: DataFrame, text: str) -> dict[tuple[str, str, str], int]:
    """Counts of adjacent letters in words that are unmistakably of one script, and of the neighbours of twins among Han
    letters and kana, over all rows. A job of its own; what comes to the driver is bounded by the squares of the alphabets
    in TWINS, and by the twins in MIXED times the letters of their scripts, not by the data."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str, str], int] = {}
        owner: dict[str, str] = {}
        for batch in batches:
            for t in batch.column(0).to_pylist():
                t = plain(t)
                for m in _TWINS_MET.finditer(t) if not t.isascii() else ():
                    left, met, right = _neighbours(t, m)
                    for a, b in zip(left + met, met + right, strict=True):
                        found["mixed", a, b] = found.get(("mixed", a, b), 0) + 1
                for w in _WORD.findall(t):
                    w = "".join(c for c in w if not unicodedata.combining(c))
                    kinds = {owner.get(c) or owner.setdefault(c, script(c)) for c in w}
                    if len(kinds) == 1 and (s := kinds.pop()) in TWINS and any(c not in _TWIN for c in w):
                        for a, b in zip("^" + w, w, strict=False):
                            found[s, a, b] = found.get((s, a, b), 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (zip(*found, strict=True) if found else [[]] * 3)] + [pa.array(list(found.values()), pa.int64())], names=["s", "a", "b", "n"])

    rows = df.where(F.col(text).isNotNull()).select(text).mapInArrow(count, "s string, a string, b string, n bigint")
    return {(r.s, r.a, r.b): r.n for r in rows.groupBy("s", "a", "b").agg(F.sum("n").alias("n")).collect()}


def _mapped(make: Callable[[Former, list[tuple]], list[tuple]], counts: dict, kinds: list[pa.DataType], names: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        former = Former(counts)
        for batch in batches:
            rows = make(former, list(zip(*(c.to_pylist() for c in batch.columns), strict=True)))
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def forms(df: DataFrame, key: str, text: str, keywords: str | None = None) -> DataFrame:
    """key, text, form and, if asked for, keywords and keyword_forms of each row with a text, in one pass after the count."""

    def make(former: Former, rows: list[tuple]) -> list[tuple]:
        out = []
        for k, t, *words in rows:
            p = plain(t)
            home = former.home(p)
            own = [[None if w is None else former.form(plain(w), home) for w in words[0] or []]] if words else []
            out.append((k, t, former.form(p, home), *words, *own))
        return out

    kind = df.schema[key].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    more = keywords is not None
    run = _mapped(make, bigrams(df, text), [arrow, pa.string(), pa.string(), *[pa.list_(pa.string())] * (2 * more)], ["k", "text", "form", *["keywords", "keyword_forms"] * more])
    rows = df.where(F.col(text).isNotNull()).select(key, text, *[keywords] * more)
    return rows.mapInArrow(run, f"k {kind}, text string, form string" + ", keywords array<string>, keyword_forms array<string>" * more).withColumnRenamed("k", key)


def twins(formed: DataFrame, key: str) -> DataFrame:
    """line_a < line_b of the same form and different text. The result has such pairs by definition (`classes` has not);
    forms with only one text are dropped before the join, and a hot form is split by the join's skew handling."""
    return _paired(formed.select("form", F.col(key).alias("line"), "text", F.lit(-1).cast("bigint").alias("pos"))).select("line_a", "line_b")


def _paired(rows: DataFrame) -> DataFrame:
    """line_a, line_b, pos of rows (form, line, text, pos): pairs of lines of one form with different text (pos -1), and rows
    with a pos by themselves, once each; those have a form of their own and no text.

    Rows are made and shuffled once: every branch needs all columns, so that Spark finds their exchanges to be the same."""
    placed = rows.repartition("form")
    form = placed.groupBy("form").agg(F.min("text").alias("_a"), F.max("text").alias("_b"), F.max("line").alias("_line"), F.max("pos").alias("_pos"))
    several = form.where("_a <> _b and _line is not null and _pos is not null").select("form")
    left = placed.join(several, "form", "left_semi")
    a, b = (left.select("form", F.col("line").alias(f"line_{x}"), F.col("text").alias(f"_t{x}"), F.col("pos").alias(f"_p{x}")) for x in "ab")
    pairs = a.join(b, "form").where("line_a < line_b and _ta <> _tb").select("line_a", "line_b", F.greatest("_pa", "_pb").alias("pos"))
    alone = form.where("_pos >= 0 and _a is null and _b is null").select(F.col("_line").alias("line_a"), F.col("_line").alias("line_b"), F.col("_pos").alias("pos"))
    return pairs.unionByName(alone)


def classes(formed: DataFrame, key: str) -> DataFrame:
    """One row per different text of a form that has several: class_id (the least id of the form's lines), line_id (the
    text's own representative, its least id), n_lines (its copies) and n_links (lines of the form with another text). With
    the forms as membership it says all that pairs say, without listing them. Copies are counted before the shuffle."""
    text = formed.groupBy("form", "text").agg(F.min(key).alias("line_id"), F.count(F.lit(1)).alias("n_lines"))
    form = text.groupBy("form").agg(F.min("line_id").alias("class_id"), F.sum("n_lines").alias("_n"), F.count(F.lit(1)).alias("_texts")).where("_texts > 1")
    return text.join(form, "form").select("class_id", "line_id", "n_lines", (F.col("_n") - F.col("n_lines")).alias("n_links"))


def sought(df: DataFrame, key: str, text: str, keywords: str) -> DataFrame:
    """form, line, text, pos of each line, with pos -1, and of each keyword that looks like a part of its line but isn't in it
    character by character, with its place as pos, a form of its own and no text. One pass after the count."""

    def make(former: Former, rows: list[tuple]) -> list[tuple]:
        out = []
        for k, t, words in rows:
            p = plain(t)
            home = former.home(p)
            form = former.form(p, home)
            out.append((form, k, t, -1))
            for i, w in enumerate(words or []):
                if w is not None and w not in t and (f := former.form(plain(w), home)) and f in form:
                    out.append((f"\x00{k}:{i}", k, None, i))
        return out

    kind = df.schema[key].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    run = _mapped(make, bigrams(df, text), [pa.string(), arrow, pa.string(), pa.int64()], ["form", "line", "text", "pos"])
    return df.where(F.col(text).isNotNull()).select(key, text, keywords).mapInArrow(run, f"form string, line {kind}, text string, pos bigint")


def p6_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms(spark.read.parquet(f"{sf_dir}/lyric_lines.parquet"), "line_id", "text", "keywords").drop("text", "keywords")


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(forms(spark.read.parquet(f"{sf_dir}/lyric_lines.parquet"), "line_id", "text"), "line_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _paired(sought(spark.read.parquet(f"{sf_dir}/lyric_lines.parquet"), "line_id", "text", "keywords"))
    return found.select(F.when(F.col("pos") < 0, "text").otherwise("keywords").alias("field_name"), "line_a", "line_b", F.col("pos").alias("kw_pos"))


QUERIES = {"p6_found": p6_found, "p6_forms": p6_forms, "p6_classes": p6_classes}
SQL: dict[str, str] = {}
