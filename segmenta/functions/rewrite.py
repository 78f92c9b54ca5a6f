"""Correction and rewriting of texts by ordered rule tables, phrase tables, cleaning of model output."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmenta.functions import rules as R
from segmenta.functions.text import HAN, count_of

#: White space of all kinds, for both regular expression engines.
WHITE = r"[\s\u00a0\u3000\u2000-\u200a\u202f]"
MARKS = r"[\s,，。！？、.!?]+"


def compact(text: Column) -> Column:
    return F.regexp_replace(text, WHITE + "+", "")


def merged_rules(*sets: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Rule sets one after the other, each rule once at its first place; rules without a source are skipped."""
    return [r for r in dict.fromkeys(r for s in sets for r in s) if r[0]]


def corrected(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Literal replacements in the order of the rules. Where a source isn't in the text as written but is once white space
    is ignored, its first such place is replaced, white space inside included. Null stays null."""
    if not rules:
        return text
    spaced = lambda s: (WHITE + "*").join(re.escape(c) for c in re.sub(r"\s+", "", s))
    literal = lambda s: s.replace("\\", "\\\\").replace("$", "\\$")
    table = F.array(*[F.struct(F.lit(a).alias("src"), F.lit(b).alias("dst"), F.lit(re.sub(r"\s+", "", a)).alias("bare"), F.lit(f"(?s)^(.*?){spaced(a)}").alias("at"), F.lit("$1" + literal(b)).alias("by")) for a, b in merged_rules(rules)])

    def step(t: Column, r: Column) -> Column:
        second = F.contains(compact(t), r["bare"]) & (r["bare"] != "")
        return F.when(F.contains(t, r["src"]), F.replace(t, r["src"], r["dst"])).when(second, F.regexp_replace(t, r["at"], r["by"])).otherwise(t)

    # most texts hold no rule's source at all: one look tells them
    some = compact(text).rlike("|".join(sorted({spaced(a) for a, _ in rules if a.strip()})) or "(?!)")
    return F.when(some | text.rlike("|".join(re.escape(a) for a, _ in rules if not a.strip()) or "(?!)"), F.aggregate(table, text, step)).otherwise(text)


def rewritten(text: Column, source: Column, table: list[tuple[str | None, str, str]]) -> Column:
    """The table's rewrites in order, case ignored, each where the source matches its pattern. Every step refers to the
    text once, so that the plan grows with the table alone."""
    for condition, pattern, by in table:
        own = F.lit(f"(?i){pattern}") if condition is None else F.when(source.rlike(condition), f"(?i){pattern}").otherwise("(?!)")
        text = F.regexp_replace(text, own, F.lit(by))
    return F.regexp_replace(F.regexp_replace(text, r"\s{2,}", " "), "^[ ,;]+|[ ,;]+$", "")


def simplified(text: Column) -> Column:
    """Traditional characters as simplified ones in texts of which a quarter at least is Han."""
    han = count_of(text, HAN) >= F.greatest(F.lit(1), F.floor(F.length(text) / 4))
    return F.when(han, F.translate(text, R.TRADITIONAL, R.SIMPLIFIED)).otherwise(text)


def for_comparison(text: Column) -> Column:
    """Chinese text without white space and marks, in simplified characters and lower case."""
    t = F.regexp_replace(compact(text), "[，。！？、；：'…,.!?]", "")
    for a, b in R.COMPARED:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.lower(t)


def cleaned(text: Column) -> Column:
    """Model output without fences and quotes around it. An answer that begins like a refusal or an announcement counts
    only from where it says that the translation comes, and else is empty."""
    t = F.regexp_replace(text, "^\\s+|\\s+$", "")
    declines = F.lower(t).rlike("^(" + "|".join(re.escape(p.lower()) for p in R.DECLINING) + ")")
    told = F.regexp_replace(F.regexp_extract(t, rf"(?i){R.ANNOUNCED}\s*(.+)", 1), "^\\s+|\\s+$", "")
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"```[\s\S]*?```", ""), "^[\"']+|[\"']+$", ""), "^\\s+|\\s+$", "")
    return F.when(declines, told).otherwise(bare)


def plain_html(text: Column) -> Column:
    """Text of a page: without scripts, styles, comments and tags, the five common entities resolved, white space as one
    space. Block ends count as white space."""
    t = F.regexp_replace(text, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"<[^<>]*>", " ")
    for entity, letter in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(letter))
    return F.trim(F.regexp_replace(t, WHITE + "+", " "))


def bare_phrase(text: Column) -> Column:
    """A phrase as tables are looked up by: simplified, without white space and marks."""
    return F.regexp_replace(simplified(F.regexp_replace(text, "^\\s+|\\s+$", "")), MARKS, "")


def _anchors(text: Column, whole: bool) -> Column:
    """The four letters in the middle of a text, or all runs of four of it if asked for or it is short."""
    n = F.length(text)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 3)), lambda i: F.substring(text, i, 4))
    return F.array_distinct(runs) if whole else F.when(n < 14, F.array_distinct(runs)).otherwise(F.array(F.substring(text, F.floor(n / 2).cast("int") - 1, F.lit(4))))


def phrase(rows: DataFrame, key: list[str], text: str, table: DataFrame, least: int = 4, share: float = 0.7) -> DataFrame:
    """key and dst of the longest phrase of the table (ord, src, dst) that is the text, makes up `share` of it or holds it as
    such a part of itself, by bare forms; the first in the table's order among equals. Phrases of fewer than `least` letters
    fit only exactly.

    No product of texts and phrases: what makes up 70 % of another text holds its middle, so the middle four letters of the
    longer one are looked for among the shorter one's. The table's side is sent around only if Spark finds it small."""
    phrases = table.select("ord", "dst", bare_phrase(F.col("src")).alias("p")).where("p <> ''")
    phrases = phrases.groupBy("p").agg(F.min_by("dst", "ord").alias("dst"), F.min("ord").alias("ord"))
    texts = rows.select(*key, bare_phrase(F.col(text)).alias("t")).where("t <> ''")
    long, nt, np_ = phrases.where(F.length("p") >= least), F.length("t"), F.length("p")
    anchored = lambda df, c, whole: df.withColumn("_g", F.explode(_anchors(F.col(c), whole)))
    inside = anchored(texts, "t", False).join(anchored(long, "p", True), "_g").where(F.contains("t", F.col("p")) & (np_ >= nt * share))
    around = anchored(texts, "t", True).join(anchored(long, "p", False), "_g").where(F.contains("p", F.col("t")) & (nt >= np_ * share))
    same = texts.join(phrases, F.col("t") == F.col("p"))
    every = [x.select(*key, "p", "t", "dst", "ord") for x in (same, inside, around)]
    both = every[0].unionByName(every[1]).unionByName(every[2])
    # the text itself comes before longer phrases
    return both.groupBy(*key).agg(F.min_by("dst", F.struct((F.col("p") != F.col("t")).cast("int").alias("e"), (-F.length("p")).alias("n"), "ord")).alias("dst"))


def named_language(path: Column) -> Column:
    """The language that a file's name tells, English before Chinese; null if none."""
    name = F.lower(F.regexp_replace(path, r"^.*[/\\]", ""))
    told = lambda parts: name.rlike("|".join(map(re.escape, parts)))
    return F.when(told(R.NAMED_EN), "en").when(told(R.NAMED_ZH), "zh")
