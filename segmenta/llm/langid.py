"""Language of short texts by nearest centroid.

A text is the sum of its words' hashed character n-gram vectors, weighted by inverse document frequency and normalised;
each language has several centroids, found by spherical k-means over labelled texts, and a text takes the language of
the nearest one by cosine. A dot product with a centroid is a sum over words, so each word's products are computed once and
remembered; a text's own length is that of its summed vector. A text farther than REJECT from every centroid, or without
language (fewer than LETTERS letters, only names, labels, numbers), gets none. Words that occur in most languages alike, as
names do, weigh nothing. A tenth of the training texts forms no centroid: on it the confidence is calibrated.

The model is fitted on the driver from at most about SAMPLE labelled texts, chosen by a hash of the row; that bound is a
parameter. A text that another language's centroid claims is left out of its label's clusters, as labels may be wrong.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segmenta.llm import debris as D

SAMPLE, DIMS, CENTROIDS, LETTERS, REJECT = 20_000, 1 << 14, 3, 6, 0.1
#: How much nearer than the record's own language another one must be to claim a piece of it, and how near at least.
CLAIM, CLAIMED = 0.08, 0.18
REMEMBERED = 100_000

# letters of the scripts that write no spaces go by two; Indic and South-East Asian signs belong to their words
_WORD = re.compile(r"[\u3400-\u9fff\uf900-\ufaff]{1,2}|[\u3040-\u30ff]{1,2}|[\u0900-\u109f\u200c\u200d]+|[^\W\d_\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\u0900-\u109f]+")
_DEBRIS = regex.compile(f"{D.TIME}|{D.SOUND}|<[^<>\\n]{{1,80}}>|https?://\\S+", regex.IGNORECASE)
_HINT = re.compile(r"[\[({<【（*♪♫]|://")
_LABEL = regex.compile(f"^\\W*{D.LABEL}(?!\\p{{N}})", regex.IGNORECASE)
_WIDE = re.compile(r"[\uff01-\uff5e\u200b\u2060\ufeff\u00ad]")
_FILLER = regex.compile(f"(?i){D.FILLER}|[嗯呃唔]{{1,2}}|ben")
#: First and last code points of scripts that say much about the language.
SCRIPTS = {"#han": (0x3400, 0x9FFF), "#kana": (0x3040, 0x30FF), "#hangul": (0xAC00, 0xD7A3), "#cyrillic": (0x400, 0x52F), "#deva": (0x900, 0x97F), "#greek": (0x370, 0x3FF), "#arabic": (0x600, 0x6FF), "#thai": (0xE00, 0xE7F)}


def bare(text: str) -> str:
    """Without labels, time stamps, sound annotations and markup."""
    text = _LABEL.sub(" ", text.translate(D.NARROWED) if _WIDE.search(text) else text)
    return _LABEL.sub(" ", _DEBRIS.sub(" ", text)) if _HINT.search(text) else text


def words(text: str) -> list[str]:
    """The words that may have a language, in lower case."""
    return _WORD.findall(bare(text).lower())


def features(word: str) -> tuple[list[int], list[float]]:
    """Hashed n-grams of one to three letters of a word, with borders, the word itself, and its script."""
    w = f"<{word}>"
    grams = [word, *(w[i : i + 2] for i in range(len(w) - 1)), *(w[i : i + 3] for i in range(len(w) - 2))]
    first = ord(word[0])
    if first > 0x2E7F and len(word) == 2:
        grams += word
    if first > 0x36F:
        grams += [name for name, (a, b) in SCRIPTS.items() if a <= first <= b] * 2
    hashes = [zlib.crc32(g.encode()) for g in grams]
    return [h % DIMS for h in hashes], [1.0 if h & 0x10000 else -1.0 for h in hashes]


class _Rows:
    """Ragged arrays of numbers, one after the other, in room that doubles."""

    def __init__(self) -> None:
        self.start, self.length, self.used = np.zeros(4096, dtype=np.int64), np.zeros(4096, dtype=np.int64), 0
        self.dim, self.value = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.float32)

    def add(self, row: int, dim: np.ndarray, value: np.ndarray) -> None:
        while row >= len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        while self.used + len(dim) > len(self.dim):
            self.dim, self.value = (np.concatenate([x, np.zeros_like(x)]) for x in (self.dim, self.value))
        self.start[row], self.length[row] = self.used, len(dim)
        self.dim[self.used : self.used + len(dim)], self.value[self.used : self.used + len(dim)] = dim, value
        self.used += len(dim)

    def squares(self, rows: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
        """For each text the squared length of the sum of its rows."""
        length = self.length[rows]
        ends = np.cumsum(length)
        at = np.repeat(self.start[rows] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
        if not len(at):
            return np.zeros(texts)
        key = np.repeat(text, length) * DIMS + self.dim[at]
        order = np.argsort(key)
        key, value = key[order], self.value[at][order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        total = np.add.reduceat(value.astype(np.float64), first)
        return np.bincount(key[first] // DIMS, weights=total * total, minlength=texts)


@dataclass
class Model:
    langs: list[str]
    centroids: np.ndarray
    owner: np.ndarray
    idf: np.ndarray
    neutral: frozenset[str]
    sharpness: float = 12.0
    row: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None
    rows: _Rows | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"row": {}, "table": None, "rows": None}

    def _learn(self, new: list[str]) -> None:
        if self.table is None or len(self.row) + len(new) >= REMEMBERED:
            self.row.clear()
            self.table, self.rows = np.zeros((4096, len(self.centroids) + 1), dtype=np.float32), _Rows()
        while len(self.row) + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        for w in new:
            at = len(self.row)
            self.row[w] = at
            if not _FILLER.fullmatch(w):
                self.table[at, -1] = len(w)
                if w not in self.neutral:
                    i, sign = features(w)
                    dim, where = np.unique(i, return_inverse=True)
                    value = self.idf[dim] * np.bincount(where, weights=sign).astype(np.float32)
                    self.table[at, :-1] = self.centroids[:, dim] @ value
                    self.rows.add(at, dim, value)

    def near(self, split: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Cosines with the centroids, zeros for a text without language; and each text's letters outside fillers."""
        flat = list(chain.from_iterable(split))
        out = np.zeros((len(split), len(self.centroids) + 1), dtype=np.float32)
        square = np.zeros(len(split))
        if flat:
            new = [w for w in dict.fromkeys(flat) if w not in self.row]
            if new:
                self._learn(new if len(self.row) + len(new) < REMEMBERED else list(dict.fromkeys(flat)))
            rows = np.fromiter(map(self.row.__getitem__, flat), dtype=np.int64, count=len(flat))
            count = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
            some = np.flatnonzero(count)
            out[some] = np.add.reduceat(self.table[rows], (np.cumsum(count) - count)[some], axis=0)
            square = self.rows.squares(rows, np.repeat(np.arange(len(split)), count), len(split))
        length = np.sqrt(square)[:, None]
        return np.divide(out[:, :-1], length, out=np.zeros((len(split), len(self.centroids)), np.float32), where=length > 1e-6), out[:, -1]

    def scores(self, texts: list[str]) -> np.ndarray:
        """For each text its cosine with the nearest centroid of each language; rows of -1 where there is no language,
        or fewer than LETTERS letters."""
        out = np.full((len(texts), len(self.langs)), -1.0, dtype=np.float32)
        if not self.langs:
            return out
        for a in range(0, len(texts), 2000):
            near, size = self.near([words(t) for t in texts[a : a + 2000]])
            part = np.stack([near[:, self.owner == i].max(axis=1) for i in range(len(self.langs))], axis=1)
            part[(size < LETTERS) | ~near.any(axis=1)] = -1.0
            out[a : a + 2000] = part
        return out


def confidence(scores: np.ndarray, sharpness: float) -> np.ndarray:
    """How probable the best language is among all, by the distances to their nearest centroids."""
    e = np.exp(sharpness * (scores - scores.max(axis=1, keepdims=True)))
    return 1 / e.sum(axis=1)


def sharpest(scores: np.ndarray, label: np.ndarray, steps: tuple[float, ...] = tuple(2.0 * 1.15**k for k in range(30))) -> float:
    """The sharpness under which the labels of held-out texts are likeliest; of few texts nothing is learned."""
    if len(label) < 20:
        return Model.sharpness
    own = scores - scores.max(axis=1, keepdims=True)
    loss = [float((np.log(np.exp(k * own).sum(axis=1)) - k * own[np.arange(len(label)), label]).sum()) for k in steps]
    return steps[int(np.argmin(loss))]


class _Vectors:
    """Sparse normalised vectors of the training texts."""

    def __init__(self, split: list[list[str]], neutral: set[str], label: np.ndarray, langs: int):
        known: dict[str, tuple[list[int], list[float]]] = {}
        at, sign, size = [], [], []
        for ws in split:
            n = len(at)
            for w in ws:
                if w not in neutral:
                    f = known.get(w) or known.setdefault(w, features(w))
                    at += f[0]
                    sign += f[1]
            size.append(len(at) - n)
        key = np.repeat(np.arange(len(split)), size) * DIMS + np.asarray(at, dtype=np.int64)
        key, where = np.unique(key, return_inverse=True)
        self.n, self.text, self.at = len(split), key // DIMS, key % DIMS
        value = np.bincount(where, weights=sign, minlength=len(key)) if len(key) else np.zeros(0)
        df = np.bincount(self.at[value != 0], minlength=DIMS)
        self.idf = np.log((len(split) + 2) / (df + 1)).astype(np.float32) + np.float32(0.1)
        # a feature of many languages weighs less: the same idea with languages for documents
        rate = np.zeros((langs, DIMS))
        np.add.at(rate, (label[self.text], self.at), value != 0)
        rate /= np.maximum(np.bincount(label, minlength=langs), 1)[:, None]
        spread = (rate >= 0.2 * rate.max(axis=0)).sum(axis=0)
        self.idf *= np.where(rate.max(axis=0) > 0, 0.1 + np.log(langs / np.maximum(spread, 1)), 1.0).astype(np.float32)
        value = value * self.idf[self.at]
        norm = np.sqrt(np.bincount(self.text, weights=value * value, minlength=self.n))
        self.some = norm > 0
        self.value = np.divide(value, norm[self.text], out=np.zeros_like(value), where=norm[self.text] > 0)

    def dots(self, centroids: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """Cosines of the texts (of those in the mask) with centroids."""
        use = slice(None) if own is None else own[self.text]
        text, at, value = self.text[use], self.at[use], self.value[use]
        return np.stack([np.bincount(text, weights=c[at] * value, minlength=self.n) for c in centroids], axis=1)

    def mean(self, own: np.ndarray) -> np.ndarray:
        use = own[self.text]
        c = np.bincount(self.at[use], weights=self.value[use], minlength=DIMS)
        n = np.linalg.norm(c)
        return (c / n if n > 0 else c).astype(np.float32)

    def kmeans(self, own: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
        """Spherical k-means; the seeds are the mean and the texts farthest from the seeds so far. A cluster of less
        than a fiftieth of the texts goes back to the mean."""
        whole = self.mean(own)
        c = [whole]
        while len(c) < min(k, int(own.sum())):
            far = np.where(own, self.dots(np.stack(c), own).max(axis=1), np.inf).argmin()
            c.append(self.mean(np.arange(self.n) == far))
        for _ in range(rounds):
            near = self.dots(np.stack(c), own).argmax(axis=1)
            parts = [own & (near == i) for i in range(len(c))]
            c = [self.mean(p) if p.sum() > max(3, own.sum() // 50) else whole for p in parts]
        return np.stack(c)


def fit(texts: list[str], labels: list[str], centroids: int = CENTROIDS) -> Model:
    langs = sorted(set(labels))
    if not langs:
        return Model([], np.zeros((0, DIMS), np.float32), np.zeros(0, int), np.ones(DIMS, np.float32), frozenset())
    label = np.array([langs.index(x) for x in labels])
    split = [words(t) for t in texts]
    seen: dict[str, np.ndarray] = {}
    size = np.maximum(np.bincount(label, minlength=len(langs)), 1)
    for ws, i in zip(split, label, strict=True):
        for w in set(ws):
            seen.setdefault(w, np.zeros(len(langs)))[i] += 1
    neutral = {*D.FILLERS, "嗯", "呃", "唔", "嗯嗯", "呃呃", "唔唔"}
    for w, n in seen.items():
        rate = n / size
        if n.sum() >= 5 and (rate >= 0.2 * rate.max()).sum() >= max(3, 0.6 * len(langs)):
            neutral.add(w)
    v = _Vectors(split, neutral, label, len(langs))
    held = np.arange(len(texts)) % 10 == 9
    mean = np.stack([v.mean(~held & (label == i)) for i in range(len(langs))])
    for _ in range(3):
        true = v.some & ~held & (v.dots(mean).argmax(axis=1) == label)
        mean = np.stack([v.mean(true & (label == i)) for i in range(len(langs))])
    parts = [v.kmeans(true & (label == i), centroids) for i in range(len(langs))]
    held &= v.some
    near = np.stack([v.dots(p, held).max(axis=1) for p in parts], axis=1)[held]
    return Model(langs, np.concatenate(parts).astype(np.float32), np.repeat(np.arange(len(langs)), [len(p) for p in parts]), v.idf, frozenset(neutral), sharpest(near, label[held]))


def notations(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """The language code of each notation: a list whose length doesn't grow with the data, read on the driver once a query."""
    return {r.notation: r.lang for r in spark.read.parquet(f"{sf_dir}/lang_names.parquet").select("notation", "lang").collect()}


def code(label: Column, table: dict[str, str]) -> Column:
    """The language code that a notation names, else null."""
    if not table:
        return F.lit(None).cast("string")
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[label]


def trained(spark: SparkSession, sf_dir: str, names: dict[str, str] | None = None, sample: int = SAMPLE) -> Model:
    """Fitted on translated_text by target_lang, of about `sample` rows at most."""
    rows = spark.read.parquet(f"{sf_dir}/translations.parquet")
    names = notations(spark, sf_dir) if names is None else names
    share = min(1.0, sample / max(1, rows.count()))
    rows = rows.where(F.pmod(F.xxhash64("trans_id"), F.lit(1_000_000)) < math.ceil(share * 1_000_000))
    rows = rows.select(F.col("translated_text").alias("t"), code(F.col("target_lang"), names).alias("l")).where("t is not null and l is not null")
    got = sorted((r.t, r.l) for r in rows.collect())
    return fit([t for t, _ in got], [x for _, x in got])
