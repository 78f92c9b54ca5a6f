"""Does a text break off at its end, does it go on from the one before? As Spark expressions and as features of a string."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = "[一-鿿]"
# Words and letters that hang at a text's end, starts that go on, starts that open a sentence, end marks, and
# marks that are left aside at an edge.
HANGING_WORDS = "the a an to of for and or but with in on at by from into is are was were be let'?s we i you".split()
HANGING_HAN = (
    "把说 把說 还分 還分 不太 先把 我们先 我們先 "
    "把 将 將 还 還 分 不 太 的 了 着 過 过 和 与 與 对 對 从 從 "
    "在 是 有 要 会 會 能 可 就 都 也 很 更 再 先 来 來 去 给 給 "
    "说 說 话 話"
).split()
CONTINUING = "太清 话人 話人 人分离 人分離 不同说话 不同說話 说话人 說話人 克隆质量 克隆質量 坐稳 坐穩 进度 進度 听感 聽感 也一般 分离 分離".split()
OPENING = (
    "你好 您好 喂 嗯 啊 哦 好的 是的 对 對 嗯嗯 今天 目前 那我们 那我們 "
    "然后 然後 所以 因为 因為 如果 但是 不过 不過 另外 首先 其次 "
    "再提升 接下来 接下來 下一步 另外 同时 同時 "
    "Hello Hi Okay Yes No Well So Then Alright Next Also"
).split()
END_MARKS, EDGE_MARKS = "。！？.!?;；…", ",，、;；"
#: Han letters of a text that is too short to be whole, and of one that is likely to go on from the one before.
STUB, TAIL = 4, 8

HANGS = rf"(?i:\b({'|'.join(HANGING_WORDS)}))$|({'|'.join(HANGING_HAN)})$"
GOES_ON, OPENS = f"^({'|'.join(CONTINUING)})", f"^(?i:{'|'.join(OPENING)})"


def closed(text: Column) -> Column:
    """Does the text end with an end mark?"""
    return F.trim(text).rlike(f"[{END_MARKS}]$")


def ends_open(text: Column) -> Column:
    """Does it break off: no end mark, and a hanging word or letter, or STUB Han letters at most?"""
    t = F.regexp_replace(F.trim(text), f"[{EDGE_MARKS}]+$", "")
    han = F.regexp_count(t, F.lit(HAN))
    return (t != "") & ~t.rlike(f"[{END_MARKS}]$") & (t.rlike(HANGS) | ((han > 0) & (han <= STUB)))


def goes_on(text: Column) -> Column:
    """Does it go on from the one before: a continuing start; else, unless it opens a sentence, a small letter or TAIL Han
    letters at most?"""
    t = F.regexp_replace(F.trim(text), f"^[{EDGE_MARKS}]+", "")
    han = F.regexp_count(t, F.lit(HAN))
    return (t != "") & (t.rlike(GOES_ON) | ~t.rlike(OPENS) & (t.rlike(r"^\p{Ll}") | ((han > 0) & (han <= TAIL))))


_HANGS, _GOES_ON, _OPENS = re.compile(HANGS), re.compile(GOES_ON), re.compile(OPENS)


@dataclass(frozen=True, slots=True)
class Features:
    """What a rule on neighbours asks of a text, found once."""

    blank: bool
    closed: bool
    hangs: bool
    goes_on: bool
    han: int
    size: int


def features(text: str) -> Features:
    t = text.strip()
    han = sum("一" <= c <= "鿿" for c in t)
    tail, head = t.rstrip(EDGE_MARKS), t.lstrip(EDGE_MARKS)
    hangs = bool(tail) and tail[-1] not in END_MARKS and (bool(_HANGS.search(tail)) or 0 < han <= STUB)
    on = bool(head) and (bool(_GOES_ON.match(head)) or not _OPENS.match(head) and (unicodedata.category(head[0]) == "Ll" or 0 < han <= TAIL))
    return Features(not t, t[-1:] != "" and t[-1] in END_MARKS, hangs, on, han, len(t))
