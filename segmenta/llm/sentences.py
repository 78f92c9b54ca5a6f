"""Sentence boundaries across languages and scripts, and the queries of problem 5.

Spaced scripts go by the lattice of terminators: every cluster of end marks, line break and, in spaceless scripts, white
space is a node with a score, which is negative inside brackets and paired quotes, after an abbreviation, initial or number,
after a conjunction or filler (a pause), or before a continuation. Straight quotes are read as opening, closing or stray;
the path of the best score through nodes and readings gives the boundaries. Spaceless scripts are cut into words by a
dictionary lattice (Viterbi over word frequencies); a gap between words without an end mark is a boundary when the word
before it mostly ends sentences and the word after it mostly opens them, with white space in its favour.

The dictionary and the counts of final and opening words are fitted over all texts that differ, by distributed aggregates.

Defined results: null, empty and blank texts give no row; a redelivered text counts once; units without words (labels,
time stamps, fillers, annotations) join the sentence before, or the first one at the start.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmenta.llm import debris as D

#: Words have at most LONGEST letters, are there LEAST times and for more than LEAST_SHARE of all letters, and COHERE times
#: as often as their parts would meet by chance.
LONGEST, LEAST, LEAST_SHARE, COHERE = 6, 5, 1e-6, 30
#: The score that the words on both sides of a gap without mark and white space need.
SURE = 0.7
# Abbreviations, without their last full stop; the second list may also end a sentence.
ABBREVIATIONS = set(
    "approx fig figs no nos p pp vol vols ver vs ch chap cf ca env ex ed eds e.g i.e viz resp dept est mr mrs ms dr prof rev hon st jr sr gen col sgt capt lt gov sen rep jan feb mar apr jun jul aug sep sept oct nov dec mon tue wed thu fri sat sun "
    "aprox pág págs núm núms cap caps sr sra srta sres dra d dña ud uds ee uu p.ej av art vol fasc "
    "nr abschn bzw bzgl anm bd bde s z.b d.h u.a vgl hr fr hrn str tel geb evtl ggf usf sog mio mrd vers "
    "c.-à-d m mm mme mlle mgr env n° p.ex t "
    "prof profa exmo exma sto sta aprox n.º "
    "т ок рис табл гл стр см вер напр др проф г гг в вв ул д прим им тыс млн млрд руб коп т.е т.к "
    "डॉ श्री श्रीमती अ प्रो पृ सं fig spk ig".split()
)
MAY_END = {"etc", "usw", "p.m", "a.m", "u.s", "u.k", "u.s.a", "e.u", "inc", "ltd", "co", "corp", "jr", "sr", "т. д", "т.д", "т. п", "т.п", "др", "u. a", "ff", "al", "आदि", "h", "ee. uu"}
# Words that can't end a sentence, so that a pause after them goes on.
GOES_ON = set(
    "and but because so or then that if when while although since as the a an of to in on at by with for from "
    "und aber denn weil oder dass wenn als der die das ein eine "
    "et mais car ou que si quand parce puisque le la les un une de "
    "y e o pero porque que si cuando sino el los las una uno "
    "mas ou porque que quando se o os as um uma "
    "и а но или что чтобы если когда потому хотя "
    "और लेकिन क्योंकि या कि मगर तो "
    "그리고 하지만 왜냐하면 그런데 그래서 또는".split()
)
CJK_GOES_ON = ("而且", "但是", "因为", "所以", "可是", "不过", "然后", "并且", "或者", "如果", "虽然", "由于", "なぜなら", "そして", "しかし", "でも", "だから", "それで", "また", "ですが", "ますが", "ので", "けど", "から")
MONTHS = set("januar februar märz april mai juni juli august september oktober november dezember jan feb".split())
FILES = set("wav mp3 mp4 txt json csv srt vtt pdf doc html xml yaml py com org net de io www ogg flac avi mkv zip tar gz jpg png".split())

#: Letters of scripts that write no spaces between words: Han, kana, and Thai, Lao, Burmese and Khmer with their signs.
_CJK = "㐀-鿿぀-ヿ豈-﫿ก-๎ກ-໎က-ဿក-៓"
#: A place that may be a boundary: end marks with what closes after them, a line break, white space after a CJK letter.
_NODE = regex.compile(rf"(?P<mark>[.!?…。！？।॥｡．។៕။]+)(?P<close>[\"'”’»›)\]）】」』〉》]*)(?P<gap>\s*)(?=\S)|(?<![^\S\n])(?P<line>[^\S\n]*+[\r\n]\s*)(?=\S)|(?<=[{_CJK}])(?P<white>[^\S\n]+)(?=[{_CJK}\p{{Lu}}“「『«\"(（])")
_FAST = re.compile(rf"[.!?…。！？।॥｡．។៕။][\"'”’»›)\]）】」』〉》]*\s*\S|[\r\n]|[{_CJK}]\s+\S")
_INSIDE = regex.compile(r"“[^“”]*[”]|«[^«»]*»|‹[^‹›]*›|「(?:[^「」]|「[^「」]*」)*」|『[^『』]*』|„[^„“”]*[“”]|\([^()]*\)|（[^（）]*）|\[[^\[\]]*\]|【[^【】]*】|<(?!\s)[^<>\n]*>")
_OPENERS = "“«‹「『„(（[【<\""
_TOKEN = regex.compile(rf"(?:(?![{_CJK}])[\p{{L}}\p{{M}}\p{{N}}.'’°º\-])+")
#: A filler at the end of what is looked at, found backwards.
_FILLER = regex.compile(f"(?r)(?i)(?:{D.FILLER}|{D.CJK_FILLER}|那个|这个)")
#: Full stops that an abbreviation or initials have at most, and the letters of the longest abbreviation with a space in it.
STOPS, SPACED = 8, max(len(x) for x in MAY_END if " " in x)
#: Prices on the path: a straight quote that is taken for a stray one though it could pair, and if it couldn't; a line break
#: or the text's end inside a quotation; a boundary there.
STRAY, ODD, BROKEN, UNCLOSED, INSIDE = 1e6, 0.5, 2.02e6, 2e6, 1e12
_WORDS = regex.compile(r"[\p{L}\p{N}]")
_DEBRIS = regex.compile(f"(?i){D.TIME}|{D.SOUND}|^\\s*{D.BARE_TIME}|^\\s*\\[?{D.LABEL}\\]?\\s*[:：\\-–]?|{D.FILLER}|{D.CJK_FILLER}")
#: What ends a sentence for certain.
ENDS = r"[。！？!?…។៕။\r\n]+"
_RUN = re.compile(rf"[{_CJK}]+")
_LETTER = re.compile(rf"[{_CJK}]")


@dataclass
class Model:
    """Word log-probabilities of spaceless scripts, and how often a word was seen, seen last and seen first."""

    words: dict[str, float] = field(default_factory=dict)
    seen: dict[str, int] = field(default_factory=dict)
    last: dict[str, int] = field(default_factory=dict)
    first: dict[str, int] = field(default_factory=dict)
    longest: int = 1

    def cut(self, run: str) -> list[str]:
        """The likeliest words of a run of letters."""
        n = len(run)
        best, back = [0.0] + [-1e18] * n, [0] * (n + 1)
        words = self.words
        for i in range(n):
            base = best[i]
            for j in range(i + 1, min(n, i + self.longest) + 1):
                p = words.get(run[i:j])
                if p is None:
                    if j > i + 1:
                        continue
                    p = -14.0
                if base + p > best[j]:
                    best[j], back[j] = base + p, i
        out, j = [], n
        while j:
            out.append(run[back[j] : j])
            j = back[j]
        return out[::-1]

    def final(self, word: str) -> float:
        return math.log((self.last.get(word, 0) + 0.3) / (self.seen.get(word, 0) - self.last.get(word, 0) + 1.0))

    def opening(self, word: str) -> float:
        return math.log((self.first.get(word, 0) + 0.3) / (self.seen.get(word, 0) - self.first.get(word, 0) + 1.0))


    @cached_property
    def meeting(self) -> re.Pattern | None:
        """A word that mostly ends sentences before one that mostly opens them; no other gap of a run is a boundary."""
        ends, opens = [w for w in self.last if self.final(w) > SURE], [w for w in self.first if self.opening(w) > SURE]
        return re.compile(f"(?:{'|'.join(map(re.escape, ends))})(?:{'|'.join(map(re.escape, opens))})") if ends and opens else None


def _grams(runs: Iterable[tuple[str, int]]) -> Counter[str]:
    """How often runs of letters, each so many times there, have each substring of up to LONGEST letters."""
    grams: Counter[str] = Counter()
    for run, n in runs:
        for k in range(1, LONGEST + 1):
            for i in range(len(run) - k + 1):
                grams[run[i : i + k]] += n
    return grams


def _dictionary(kept: dict[str, int]) -> Model:
    size = sum(kept.values()) or 1
    return Model({g: math.log(n / size) for g, n in sorted(kept.items())}, longest=max([1, *map(len, kept)]))


def _places(runs: Iterable[tuple[str, int, int, int]], model: Model) -> tuple[Counter[str], Counter[str], Counter[str]]:
    """How often words are seen, seen last and seen first, of runs with how often each is there, ends and opens sentences."""
    seen: Counter[str] = Counter()
    last: Counter[str] = Counter()
    first: Counter[str] = Counter()
    for run, n, ends, opens in runs:
        words = model.cut(run)
        for w in words:
            seen[w] += n
        if ends:
            last[words[-1]] += ends
        if opens:
            first[words[0]] += opens
    return seen, last, first


def fit(texts: list[str]) -> Model:
    """A dictionary of the runs' frequent substrings whose parts cohere, and the places of its words in sentences."""
    runs: dict[str, list[int]] = {}
    for t in texts:
        for s in re.split(ENDS, t):
            parts = _RUN.findall(s)
            for i, p in enumerate(parts):
                at = runs.setdefault(p, [0, 0, 0])
                at[0] += 1
                at[1] += i == len(parts) - 1
                at[2] += i == 0
    grams = _grams((p, n) for p, (n, _, _) in runs.items())
    total = max(1, sum(n for g, n in grams.items() if len(g) == 1))
    kept = {}
    for g, n in grams.items():
        if len(g) == 1:
            kept[g] = n
        elif n >= LEAST and n > LEAST_SHARE * total and all(n * total > COHERE * grams[g[:k]] * grams[g[k:]] for k in range(1, len(g))):
            kept[g] = n
    model = _dictionary(kept)
    model.seen, model.last, model.first = map(dict, _places(((p, *at) for p, at in runs.items()), model))
    return model


def fitted(rows: DataFrame) -> Model:
    """The same as fit() over all rows (text), whole texts that differ: counts are summed by distributed aggregates. Only
    words come to the driver, at most LONGEST / LEAST_SHARE and the letters, however many texts there are."""
    spaceless = rows.where(F.col("text").rlike(_RUN.pattern)).select("text").distinct()
    parts = spaceless.select(F.explode(F.split("text", ENDS)).alias("s")).select(F.expr(f"regexp_extract_all(s, '{_RUN.pattern}', 0)").alias("p"))
    each = parts.select(F.size("p").alias("m"), F.posexplode("p").alias("i", "run"))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    runs = each.groupBy("run").agg(F.count(F.lit(1)).alias("n"), one(F.col("i") == F.col("m") - 1).alias("ends"), one(F.col("i") == 0).alias("opens"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = _grams(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(grams.keys(), pa.string()), pa.array(grams.values(), pa.int64())], names=["g", "n"])

    grams = runs.select("run", "n").mapInArrow(count, "g string, n bigint").groupBy("g").agg(F.sum("n").alias("n"))
    total = max(1, each.agg(F.sum(F.length("run"))).first()[0] or 0)
    often = grams.where((F.length("g") == 1) | (F.col("n") >= LEAST) & (F.col("n") > LEAST_SHARE * total))
    # parts of a frequent substring are at least as frequent
    halves = often.where(F.length("g") > 1).select("g", "n", F.explode(F.sequence(F.lit(1), F.length("g") - 1)).alias("k"))
    halves = halves.select("g", "n", F.expr("left(g, k)").alias("a"), F.expr("substring(g, k + 1)").alias("b"))
    part = lambda c: often.select(F.col("g").alias(c), F.col("n").cast("double").alias(f"n_{c}"))
    whole = F.min(F.col("n") * F.lit(float(total)) > COHERE * F.col("n_a") * F.col("n_b"))
    coherent = halves.join(part("a"), "a").join(part("b"), "b").groupBy("g").agg(F.first("n").alias("n"), whole.alias("whole")).where("whole").select("g", "n")
    model = _dictionary({r.g: r.n for r in often.where(F.length("g") == 1).unionByName(coherent).collect()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, last, first = _places(zip(*(c.to_pylist() for c in batch.columns), strict=True), model)
            words = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in (seen, last, first))], names=["w", "seen", "last", "first"])

    places = runs.select("run", "n", "ends", "opens").mapInArrow(place, "w string, seen bigint, last bigint, first bigint").groupBy("w").agg(*(F.sum(c).alias(c) for c in ("seen", "last", "first")))
    got = sorted(tuple(r) for r in places.collect())
    model.seen, model.last, model.first = ({x[0]: x[k] for x in got if x[k]} for k in (1, 2, 3))
    return model


def _cased(letter: str) -> bool:
    """Of a script with capitals, or no letter at all."""
    return letter.lower() != letter.upper() or not letter.isalpha() and unicodedata.category(letter or " ")[0] != "M"


class _Text:
    """A text with what its nodes ask for, each found once: words before a place, words of runs of spaceless scripts."""

    def __init__(self, text: str, model: Model):
        self.text, self.model, self.lower = text, model, text == text.lower()
        self.runs: dict[int, list[str]] = {}

    @cached_property
    def tokens(self) -> tuple[list[int], list[int]]:
        spans = [m.span() for m in _TOKEN.finditer(self.text)]
        return [a for a, _ in spans], [b for _, b in spans]

    @cached_property
    def spaceless(self) -> tuple[list[int], list[int]]:
        spans = [m.span() for m in _RUN.finditer(self.text)]
        return [a for a, _ in spans], [b for _, b in spans]

    def word_before(self, at: int) -> str:
        """The word of a spaced script that ends at a place, from its STOPS-th full stop from the end on; empty without."""
        starts, ends = self.tokens
        k = bisect_right(starts, at - 1) - 1
        if k < 0 or ends[k] < at:
            return ""
        a = starts[k]
        stop = at - 1
        for _ in range(STOPS + 1):
            stop = self.text.rfind(".", a, stop)
            if stop < 0:
                return self.text[a:at]
        return self.text[stop + 1 : at]

    def words_of_run(self, k: int) -> list[str]:
        if k not in self.runs:
            self.runs[k] = self.model.cut(self.text[self.spaceless[0][k] : self.spaceless[1][k]])
        return self.runs[k]

    def gap(self, end: int, start: int) -> float:
        """The score of white space between two words of a spaceless script."""
        starts, ends = self.spaceless
        left, right = bisect_left(ends, end), bisect_left(starts, start)
        before = self.words_of_run(left)[-1] if left < len(ends) and ends[left] == end else ""
        score = 2.5 + self.model.final(before)
        return score + (self.model.opening(self.words_of_run(right)[0]) if right < len(starts) and starts[right] == start else 0.0)

    def ends(self, m: regex.Match) -> bool:
        """Is a cluster of end marks outside quotations a boundary?"""
        text, lower = self.text, self.lower
        mark, close, gap, at, end = m["mark"], m["close"], m["gap"], m.start(), m.end()
        nxt = text[end]
        if nxt in ",;:，、；：)）]】”»」』" or (nxt in "-–—" and not gap):
            return False
        following = _lead(text, end) or nxt
        if close and close[0] in "”»›」』〉》\"" or (close and len(close) > 1 and any(c in "”»」』" for c in close)):
            return following.isupper() and not lower and nxt not in "“«「『" or "\n" in gap
        small = following.islower() and not lower and _cased(text[at - 1 : at])
        word = self.word_before(at)
        if mark[0] in "…" or mark.startswith(".."):
            e = at
            while e and text[e - 1].isspace():
                e -= 1
            if not e or text[e - 1] in ",，、:：;；-–—" or small:
                return False
            return not (word.lower() in GOES_ON or text.endswith(CJK_GOES_ON, 0, e) or _FILLER.match(text, 0, e))
        if mark in (".", "．"):
            return self._stops(m, word, following, small)
        return not small or "।" in mark

    def _stops(self, m: regex.Match, word: str, following: str, small: bool) -> bool:
        """The same of one full stop: after no abbreviation, initial or number, and inside no name of a file."""
        text, lower, at, end, nxt = self.text, self.lower, m.start(), m.end(), self.text[m.end()]
        token = word.lower().rstrip(".")
        if (stuck := re.fullmatch(r"[^\W\d_]{4,}\.((?:[^\W\d_]\.)*[^\W\d_])", token)) is not None:
            token = stuck[1]  # an abbreviation that follows a sentence without space
        if not m["gap"]:
            if not (following.isalpha() and word and text[at - 1].isalpha()):
                return bool(_LETTER.match(nxt)) and not nxt.isdigit() and len(token) > 3 and not token.isascii()
            after = _LETTERS.match(text, end)
            tail = after.group() if after else ""
            if tail.lower() in FILES or "." in token or token in ABBREVIATIONS or not regex.fullmatch(r"[\p{L}\p{M}'’\-]+", word):
                return bool(after and following.isupper() and token not in ABBREVIATIONS and word[-1:].isdigit())
            if text[end + len(tail) : end + len(tail) + 1] == "." and len(tail) < 3:
                return len(token) > 3
            return len(token) > 2 and (following.isupper() or len(tail) > 2 and not token.isascii() or lower and len(tail) > 2)
        two = " ".join(text[max(0, at - SPACED - 1) : at].lower().split(" ")[-2:]).lstrip("([ ")
        if two in MAY_END and " " in two:
            return not small and nxt != "("
        if token == "no" and not nxt.isdigit():
            return not small
        if token in MAY_END:
            return not small and nxt != "(" and not (lower and token in ("u.s", "u.k", "др", "sr", "jr", "h")) and not (token in ABBREVIATIONS and token != "др")
        if token in ABBREVIATIONS or token.split("-")[-1] in ABBREVIATIONS and len(token) < 8:
            return False
        if len(token) == 1 and token.isalpha() and not _LETTER.match(token) or regex.fullmatch(r"(?:\p{L}\.)+\p{L}", token):
            return False
        if token.isdigit() and len(token) < 3:
            after = _LETTERS.match(text, end)
            if after and regex.match(r"\p{L}+", after.group()).group().lower() in MONTHS:
                return False
        return not small


_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_LEADING = regex.compile(r"[“«‹「『„(（\[【<\"'¿¡\-–—•* ]*")


def _lead(text: str, at: int) -> str:
    """The first letter from a place on that is no opening mark or list mark; empty at the end."""
    k = _LEADING.match(text, at).end()
    return text[k : k + 1]


def _readings(text: str, at: int) -> tuple[float, float, float]:
    """Prices of a straight quote as an opening, a closing and a stray one, by what stands beside it."""
    a, b = text[at - 1 : at], text[at + 1 : at + 2]
    opens = bool(b) and not b.isspace() and not (a.isalnum() and not _LETTER.match(a))
    closes = bool(a) and not a.isspace()
    inch = a.isdigit()
    return 0.0 if opens else INSIDE, 0.0 if closes else INSIDE, ODD if inch or not (opens or closes) else STRAY


def _path(text: str, nodes: list[tuple[int, int, float]]) -> list[int]:
    """Places of the boundaries on the best path through nodes (place of the mark, place of the cut, score) in order and the
    readings of straight quotes between them. States are outside and inside a straight quotation; boundaries lie outside."""
    quotes = [m.start() for m in re.finditer('"', text)]
    if not quotes:
        return [cut for _, cut, score in nodes if score > 0]
    events = sorted([(q, 0, 0.0) for q in quotes] + [(cut - 0.5, 1, score) for _, cut, score in nodes] + [(m.start(), 2, 0.0) for m in re.finditer("\n", text)])
    best = [0.0, -INSIDE]
    back: list[tuple[tuple[int, bool], tuple[int, bool]]] = []
    for place, kind, score in events:
        if kind == 0:
            opening, closing, stray = _readings(text, int(place))
            out, into = (best[0] - stray, best[1] - closing), (best[1] - stray, best[0] - opening)
            back.append(((0, False) if out[0] >= out[1] else (1, False), (1, False) if into[0] > into[1] else (0, False)))
            best = [max(out), max(into)]
        elif kind == 1:
            back.append(((0, score > 0), (1, False)))
            best = [best[0] + max(score, 0.0), best[1]]
        else:
            back.append(((0, False), (1, False)))
            best = [best[0], best[1] - BROKEN]
    state = 0 if best[0] >= best[1] - UNCLOSED else 1
    found = []
    for (place, _, _), step in zip(reversed(events), reversed(back), strict=True):
        state, cut = step[state]
        if cut:
            found.append(int(place + 0.5))
    return found[::-1]


def cuts(text: str, model: Model) -> list[int]:
    """Where the sentences after the first begin."""
    if not _FAST.search(text) and not _RUN.search(text):
        return []
    spans: list[tuple[int, int]] = [m.span() for m in _INSIDE.finditer(text)] if any(c in text for c in _OPENERS) else []
    own = _Text(text, model)
    nodes: list[tuple[int, int, float]] = []
    k = 0
    for m in _NODE.finditer(text):
        at = m.start() if m["mark"] is None else m.start("mark")
        while k < len(spans) and spans[k][1] <= at:
            k += 1
        closes = m["mark"] is not None and k < len(spans) and m.end("close") >= spans[k][1]
        if m.end() >= len(text) or k < len(spans) and spans[k][0] < at and not closes:
            continue
        if m["mark"] is not None:
            good = 1.0 if "\n" in m["gap"] or own.ends(m) else -1.0
        elif m["line"] is not None:
            good = 1.0 if m.start() > 0 and text[m.start() - 1] not in ",，、:：;；" else -1.0
        else:
            good = own.gap(m.start(), m.end())
        nodes.append((at, m.end(), good))
    for r, (start, end) in enumerate(zip(*own.spaceless, strict=True)):
        # cut into words only where some two words could meet
        if model.meeting is not None and model.meeting.search(text, start, end):
            words, at = own.words_of_run(r), start
            for a, b in zip(words, words[1:], strict=False):
                at += len(a)
                score = model.final(a) + model.opening(b) - 2.0
                if score > 0 and model.final(a) > SURE and model.opening(b) > SURE and not _within(spans, at):
                    nodes.append((at, at, score))
    found = _path(text, sorted(nodes, key=lambda n: n[1]))
    if not found:
        return found
    # an edge of the path holds words: units without any join the sentence before, or the first one
    out: list[int] = []
    edges = [0, *sorted(set(found)), len(text)]
    pending = True
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        spoken = bool(_WORDS.search(_DEBRIS.sub(" ", text[a:b])))
        if not pending and spoken:
            out.append(a)
        pending = pending and not spoken
    return out


def _within(spans: list[tuple[int, int]], at: int) -> bool:
    """Is a place inside one of disjoint spans in order?"""
    k = bisect_left(spans, (at,)) - 1
    return k >= 0 and spans[k][0] < at < spans[k][1]


def boundaries(df: DataFrame, model: Model) -> DataFrame:
    """df has origin, record_id and text; gives origin, record_id, cut_pos. A row stands alone; repeats are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            origin, ids, where = [], [], []
            for o, i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for c in cuts(t, model):
                    origin.append(o)
                    ids.append(i)
                    where.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(origin, pa.string()), pa.array(ids, pa.int64()), pa.array(where, pa.int64())], names=["origin", "record_id", "cut_pos"])

    rows = df.where("text is not null and record_id is not null").select("origin", "record_id", "text")
    return rows.mapInArrow(run, "origin string, record_id bigint, cut_pos bigint").distinct()


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    asr = spark.read.parquet(f"{sf_dir}/asr_results.parquet").select(F.lit("asr").alias("origin"), F.col("asr_id").alias("record_id"), "text")
    return asr.unionByName(spark.read.parquet(f"{sf_dir}/gold_segments.parquet").select(F.lit("seg").alias("origin"), F.col("seg_id").alias("record_id"), "text"))


def trained(spark: SparkSession, sf_dir: str) -> Model:
    """Fitted on all texts."""
    return fitted(texts(spark, sf_dir).select("text"))


def units(df: DataFrame, model: Model) -> DataFrame:
    """origin, record_id, sentence_no, start_pos, end_pos, sentence of every text (origin, record_id, text) with anything but white
    space, texts of one sentence included. Units begin with no white space and cover the text but for that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        for batch in batches:
            rows = []
            for o, i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = [len(t) - len(t.lstrip()), *cuts(t, model), len(t)]
                rows += [(o, i, n, a, a + len(t[a:b].rstrip()), t[a:b].rstrip()) for n, (a, b) in enumerate(zip(at, at[1:], strict=False)) if a < b]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["origin", "record_id", "sentence_no", "start_pos", "end_pos", "sentence"])

    rows = df.where("text is not null and record_id is not null").select("origin", "record_id", "text")
    out = rows.mapInArrow(run, "origin string, record_id bigint, sentence_no bigint, start_pos bigint, end_pos bigint, sentence string")
    return out.dropDuplicates(["origin", "record_id", "sentence_no"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundaries(texts(spark, sf_dir), trained(spark, sf_dir))


def p5_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units(texts(spark, sf_dir), trained(spark, sf_dir))


QUERIES = {"p5_found": p5_found, "p5_sentences": p5_sentences}
SQL: dict[str, str] = {}
