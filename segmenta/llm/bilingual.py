"""Sentence alignment in bilingual documents, and the queries of problem 3.

Segments are cut into clauses, so that merged and split sentences become pairs of clauses; the clauses' pairs are lifted
to segments at the end. Three steps: (1) clauses of each script are aligned by length alone, by dynamic programming, and
the runs of one-to-one pairs, with the translation memory, are the confident pairs; (2) word-translation probabilities
of each pair of languages are trained on them by expectation-maximization: salted groups of a language pair run it by
themselves and their expected counts are summed over all; (3) clauses are realigned by dynamic programming with lexical
scores, after which what is left over may pair across the order, and a left-over clause may join a clause that contains
its translation.

Defined results: null and blank segments pair with nothing; a script without source or target segments gives no row; a
redelivered script counts once; equal scores go to the earlier clause; null languages form a language pair of their own.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from segmenta.llm.langid import code, notations

#: Scripts of a salted group, rounds of expectation-maximization, and the least expected count over all groups and the least
#: link that are kept.
GROUP_SCRIPTS, ROUNDS, LEAST_COUNT, LEAST_LINK = 4_000, 5, 0.01, 0.02
#: The score that a pair needs in order, out of order, and to join a clause that is paired already.
PAIRED, MOVED, JOINED = 0.3, 0.45, 0.6
#: Pairs of clauses, or of words, of a document beyond which it is aligned row by row, which needs less memory and gives the same pairs; and
#: the letters of a script on average that a group of scripts is laid out for.
CELLS, SCRIPT_LETTERS = 1 << 20, 2_048

_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[㐀-鿿぀-ヿ]+|[ऀ-႟]+|[^\W\d_぀-ヿ㐀-鿿ऀ-႟]+")
_CUT = re.compile(r"[,，、;；](?!\d)|[。！？।!?…]|\.(?!\w)")
_SPACELESS = re.compile(r"[㐀-鿿぀-ヿ]")


def tokens(text: str) -> list[str]:
    """Words in lower case, numbers without separators, and pairs of letters of spaceless scripts; each once."""
    out: dict[str, None] = {}
    for t in _TOKEN.findall(unicodedata.normalize("NFKC", text)):
        if t[0].isdigit():
            out["#" + t.replace(",", "").replace(".", "")] = None
        elif _SPACELESS.match(t):
            out.update(dict.fromkeys(t[i : i + 2] for i in range(max(1, len(t) - 1))))
        else:
            out[t.lower()] = None
    return list(out)


def clauses(texts: list[str | None]) -> tuple[list[list[str]], list[int]]:
    """Token lists of all clauses, and the place of the segment of each. A part of one short word joins the next one."""
    out: list[list[str]] = []
    owner: list[int] = []
    for i, text in enumerate(texts):
        held = ""
        parts = [p for p in _CUT.split(text or "") if p.strip()]
        for k, part in enumerate(parts):
            held += " " + part
            if len(held.strip()) < 6 and k + 1 < len(parts):
                continue
            if ts := tokens(held):
                out.append(ts)
                owner.append(i)
            held = ""
    return out, owner


def size(clause: list[str]) -> float:
    return sum(2.0 if _SPACELESS.match(t) else len(t) + 1.0 for t in clause)


def by_length(a: list[list[str]], b: list[list[str]]) -> list[tuple[int, int]]:
    """One-to-one pairs of clauses by length alone that stand in a run of three at least, or in short documents."""
    if not a or not b:
        return []
    la, lb = np.array([size(x) for x in a]), np.array([size(x) for x in b])
    ratio = lb.sum() / la.sum()
    off = lambda i, j: np.abs(np.log((lb[j] + 4) / (la[i] * ratio + 4)))
    if len(a) * len(b) > CELLS:
        best = _path_by_rows(lambda i: 0.8 - off(i, slice(None)), len(a), len(b))
    else:
        best = _path(0.8 - off((slice(None), None), (None, slice(None))), 0.0)
    kept = []
    for x, (i, j) in enumerate(best):
        near = sum((i + d, j + d) in best[max(0, x - 2) : x + 3] for d in (-1, 1))
        if off(i, j) < 0.5 and (near == 2 or (near and len(best) < 4) or len(a) == len(b) == 1):
            kept.append((i, j))
    return kept


def _path(gain: np.ndarray, gap: float) -> list[tuple[int, int]]:
    """The monotone one-to-one pairs with the greatest sum of gains; a clause left out costs `gap`."""
    n, m = gain.shape
    total = np.zeros((n + 1, m + 1))
    for i in range(1, n + 1):
        total[i, 0] = -gap * i
        up = np.concatenate([[total[i, 0]], np.maximum(total[i - 1, 1:] - gap, total[i - 1, :-1] + gain[i - 1])])
        # a row's best is a running maximum once gaps along it are taken out
        total[i] = np.maximum.accumulate(up + gap * np.arange(m + 1)) - gap * np.arange(m + 1)
    out, i, j = [], n, m
    while i and j:
        if gain[i - 1, j - 1] > 0 and abs(total[i, j] - (total[i - 1, j - 1] + gain[i - 1, j - 1])) < 1e-9:
            out.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif abs(total[i, j] - (total[i - 1, j] - gap)) < 1e-9:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def _path_by_rows(gain: Callable[[int], np.ndarray], n: int, m: int) -> list[tuple[int, int]]:
    """_path without gaps' costs over rows of gains that are asked for as needed. Every step-th row of sums is kept and the
    rows between are made again on the way back, so memory grows with m times the root of n."""
    step = max(1, math.isqrt(n))

    def onward(before: np.ndarray, g: np.ndarray) -> np.ndarray:
        return np.maximum.accumulate(np.concatenate([[0.0], np.maximum(before[1:], before[:-1] + g)]))

    kept = [np.zeros(m + 1)]
    last = kept[0]
    for i in range(n - n % step if n % step else n - step):
        last = onward(last, gain(i))
        if (i + 1) % step == 0:
            kept.append(last)
    out, j = [], m
    for k in reversed(range(len(kept))):
        gains = [gain(i) for i in range(k * step, min(n, (k + 1) * step))]
        total = [kept[k]]
        for g in gains:
            total.append(onward(total[-1], g))
        i = len(gains)
        while i and j:
            g = gains[i - 1][j - 1]
            if g > 0 and abs(total[i][j] - (total[i - 1][j - 1] + g)) < 1e-9:
                out.append((k * step + i - 1, j - 1))
                i, j = i - 1, j - 1
            elif abs(total[i][j] - total[i - 1][j]) < 1e-9:
                i -= 1
            else:
                j -= 1
    return out[::-1]


def expected_counts(pairs: Iterable[tuple[list[str], list[str]]], rounds: int = ROUNDS) -> dict[tuple[str, str], float]:
    """Expected counts of word pairs by expectation-maximization: each word of b comes from a word of a or from none."""
    ia: dict[str, int] = {"": 0}
    ib: dict[str, int] = {}
    left, right, cell = [], [], []
    cells = 0
    for a, b in pairs:
        xs = np.array([0, *(ia.setdefault(t, len(ia)) for t in a)])
        ys = np.array([ib.setdefault(t, len(ib)) for t in b])
        left.append(np.tile(xs, len(ys)))
        right.append(np.repeat(ys, len(xs)))
        cell.append(np.repeat(np.arange(cells, cells + len(ys)), len(xs)))
        cells += len(ys)
    if not left:
        return {}
    x, y, c = np.concatenate(left), np.concatenate(right), np.concatenate(cell)
    key, where = np.unique(x * len(ib) + y, return_inverse=True)
    kx = key // len(ib)
    p = np.full(len(key), 1.0)
    for _ in range(rounds):
        w = p[where]
        # "none" explains little: words that always go together win over it
        w = np.where(x == 0, 0.3 * w, w)
        share = w / np.bincount(c, weights=w, minlength=cells)[c]
        count = np.bincount(where, weights=share, minlength=len(key))
        p = count / np.bincount(kx, weights=count)[kx]
    na, nb = list(ia), list(ib)
    return {(na[k // len(ib)], nb[k % len(ib)]): float(v) for k, v in zip(key.tolist(), count.tolist(), strict=True) if v > 0 and k >= len(ib)}


def _places(clauses: list[list[str]]) -> dict[str, list[int]]:
    """The clauses that have each word."""
    out: dict[str, list[int]] = {}
    for i, c in enumerate(clauses):
        for t in c:
            out.setdefault(t, []).append(i)
    return out


def _incidence(places: dict[str, list[int]], clauses: int) -> np.ndarray:
    """Which clause (row) has which word (column)."""
    out = np.zeros((clauses, len(places)))
    out[[i for mine in places.values() for i in mine], [k for k, mine in enumerate(places.values()) for _ in mine]] = 1.0
    return out


def _large(a: list[list[str]], b: list[list[str]]) -> bool:
    """Would tables of clauses or words of the two be too large to hold?"""
    words = lambda cs: len({t for c in cs for t in c})
    return len(a) * len(b) > CELLS or sum(map(len, a)) * sum(map(len, b)) > CELLS and words(a) * words(b) > CELLS


class Lexicon:
    """Links of words {a: {b: (probability of b given a, of a given b)}} and the weights of words of both sides."""

    def __init__(self, links: dict[str, dict[str, tuple[float, float]]], weight_a: dict[str, float], weight_b: dict[str, float], unseen: float):
        self.links, self.wa, self.wb, self.unseen = links, weight_a, weight_b, unseen

    def scores(self, a: list[list[str]], b: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """For each pair of clauses the weighted share of a's words that b translates, and of b's that a does. A word is
        translated as far as the other clause has the words that mostly go with it, all their probabilities together."""
        at_a, at_b = _places(a), _places(b)
        row_b = {u: j for j, u in enumerate(at_b)}
        to_b, to_a = np.zeros((len(at_a), len(at_b))), np.zeros((len(at_a), len(at_b)))
        for i, t in enumerate(at_a):
            known = self.links.get(t, {})
            # the shorter of the two is walked
            for u in known if len(known) < len(row_b) else row_b:
                if (j := row_b.get(u)) is not None and (link := known.get(u)) is not None:
                    to_b[i, j], to_a[i, j] = link
            # numbers and names are written alike
            if (j := row_b.get(t)) is not None and not _SPACELESS.match(t):
                to_b[i, j] = to_a[i, j] = 1.0
        in_a, in_b = _incidence(at_a, len(a)), _incidence(at_b, len(b))
        wa, wb = (in_x * np.array([self.weight(t, known) for t in at]) for in_x, at, known in ((in_a, at_a, self.wa), (in_b, at_b, self.wb)))
        of_a = wa @ np.minimum(1.0, to_b @ in_b.T) / wa.sum(axis=1)[:, None]
        of_b = wb @ np.minimum(1.0, to_a.T @ in_a.T) / wb.sum(axis=1)[:, None]
        return of_a, of_b.T

    def rows(self, a: list[list[str]], b: list[list[str]]) -> Callable[[int], tuple[np.ndarray, np.ndarray]]:
        """The rows of scores(), each when it is asked for, in memory that grows with the text alone."""
        place = {t: np.array(js) for t, js in _places(b).items()}
        wb = {t: self.weight(t, self.wb) for t in place}
        whole = np.array([sum(wb[t] for t in c) for c in b])

        def row(i: int) -> tuple[np.ndarray, np.ndarray]:
            of_a, of_b, weights = np.zeros(len(b)), np.zeros(len(b)), 0.0
            back: dict[str, float] = {}
            for t in a[i]:
                known = {u: x for u, x in self.links.get(t, {}).items() if u in place}
                if t in place and not _SPACELESS.match(t):
                    known[t] = (1.0, 1.0)
                w = self.weight(t, self.wa)
                weights += w
                got = np.zeros(len(b))
                for u, (v, r) in known.items():
                    got[place[u]] += v
                    back[u] = back.get(u, 0.0) + r
                of_a += np.minimum(1.0, got) * w
            for u, r in back.items():
                of_b[place[u]] += min(1.0, r) * wb[u]
            return of_a / weights, of_b / whole

        return row

    def weight(self, t: str, known: dict[str, float]) -> float:
        return (known.get(t, self.unseen) + 0.2) * (0.5 if _SPACELESS.match(t) else 1.0)


def align(source: list[str | None], target: list[str | None], lexicon: Lexicon) -> list[tuple[int, int]]:
    """Places of source and target segments that translate each other."""
    a, oa = clauses(source)
    b, ob = clauses(target)
    found = (_aligned_by_rows if _large(a, b) else _aligned)(a, b, lexicon)
    return sorted({(oa[i], ob[j]) for i, j in found})


def _aligned(a: list[list[str]], b: list[list[str]], lexicon: Lexicon) -> list[tuple[int, int]]:
    """Pairs of clauses."""
    if not a or not b:
        return []
    of_a, of_b = lexicon.scores(a, b)
    score = np.sqrt(of_a * of_b)
    found = _path(score - PAIRED, 0.0)
    free_a, free_b = set(range(len(a))) - {i for i, _ in found}, set(range(len(b))) - {j for _, j in found}
    at_a, at_b = np.arange(len(a)) / len(a), np.arange(len(b)) / len(b)
    near = score - 0.2 * np.abs(at_a[:, None] - at_b[None, :])
    # out of order: a left-over clause may also take the place of one that its partner fits worse
    for i, j in sorted(((i, j) for i in free_a for j in free_b if score[i, j] >= MOVED), key=lambda x: (-near[x], x)):
        if i in free_a and j in free_b:
            found.append((i, j))
            free_a.discard(i)
            free_b.discard(j)
    whole_a, whole_b = {j: i for i, j in found}, dict(found)
    for j in sorted(free_b):
        i = int(of_b[:, j].argmax())
        # not a second time what another clause translates already
        if of_b[i, j] >= JOINED and (i not in whole_b or of_a[i, whole_b[i]] + of_a[i, j] < 1.25) and of_a[i, j] > 0.25:
            found.append((i, j))
    for i in sorted(free_a):
        j = int(of_a[i].argmax())
        if of_a[i, j] >= JOINED and (j not in whole_a or of_b[whole_a[j], j] + of_b[i, j] < 1.25) and of_b[i, j] > 0.25:
            found.append((i, j))
    return found


def _aligned_by_rows(a: list[list[str]], b: list[list[str]], lexicon: Lexicon) -> list[tuple[int, int]]:
    """The same pairs as _aligned, without holding all scores at once; leftovers of the whole document meet."""
    if not a or not b:
        return []
    row = lexicon.rows(a, b)

    def score(i: int) -> np.ndarray:
        of_a, of_b = row(i)
        return np.sqrt(of_a * of_b)

    found = _path_by_rows(lambda i: score(i) - PAIRED, len(a), len(b))
    free_a, free_b = set(range(len(a))) - {i for i, _ in found}, set(range(len(b))) - {j for _, j in found}
    left = np.array(sorted(free_b), dtype=np.int64)
    far: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in sorted(free_a) if len(left) else []:
        s = score(i)[left]
        good = s >= MOVED
        js = left[good]
        far.append((s[good] - 0.2 * np.abs(i / len(a) - js / len(b)), np.full(len(js), i), js))
    if far:
        near, x, y = (np.concatenate(c) for c in zip(*far, strict=True))
        for k in np.lexsort((y, x, -near)):
            i, j = int(x[k]), int(y[k])
            if i in free_a and j in free_b:
                found.append((i, j))
                free_a.discard(i)
                free_b.discard(j)
    whole_a, whole_b = {j: i for i, j in found}, dict(found)
    left = np.array(sorted(free_b), dtype=np.int64)
    most, at = np.full(len(left), -1.0), np.zeros(len(left), dtype=np.int64)
    for i in range(len(a)) if len(left) else []:
        of_b = row(i)[1][left]
        at[of_b > most] = i
        most = np.maximum(most, of_b)
    for j, i, v in zip(left.tolist(), at.tolist(), most.tolist(), strict=True):
        if v >= JOINED:
            of_a = row(i)[0]
            if (i not in whole_b or of_a[whole_b[i]] + of_a[j] < 1.25) and of_a[j] > 0.25:
                found.append((i, j))
    for i in sorted(free_a):
        of_a, of_b = row(i)
        j = int(of_a.argmax())
        if of_a[j] >= JOINED and (j not in whole_a or row(whole_a[j])[1][j] + of_b[j] < 1.25) and of_b[j] > 0.25:
            found.append((i, j))
    return found


def _table(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _once(rows: list[dict]) -> list[dict]:
    """One delivery of each script and of each memory row, in the order of their ids; memory rows without id all count."""
    seen: dict[tuple, dict] = {}
    for k, r in enumerate(sorted(rows, key=lambda r: (str(r["src"]), str(r["tgt"]), r["turned"]))):
        if r["script_id"] is not None:
            seen.setdefault(("script", r["script_id"]), r)
        else:
            at = r.get("trans_id")
            seen.setdefault(("memory", at) if at is not None else ("other", k), r)
    return [seen[k] for k in sorted(seen)]


def salted(rows: DataFrame, group: int) -> DataFrame:
    """Adds salt: enough of them that a language pair's groups have about `group` rows, or fewer where those are long."""
    letters = F.length(F.array_join("src", "")) + F.length(F.array_join("tgt", ""))
    most = F.greatest(F.count(F.lit(1)) / group, F.sum(F.coalesce(letters, F.lit(0))) / (group * SCRIPT_LETTERS))
    many = rows.groupBy("pair").agg(F.ceil(most).cast("int").alias("salts"))
    own = [F.col(c).cast("string") for c in ("script_id", "trans_id") if c in rows.columns]
    return rows.join(many, "pair").withColumn("salt", F.pmod(F.xxhash64(F.coalesce(*own, F.col("src")[0])), F.col("salts")).cast("int"))


def links(training: DataFrame) -> DataFrame:
    """pair, a, b, to_b, to_a (probability of b given a, of a given b) of word pairs, and with b null, or a null, the
    count of a word. a is of the alphabetically first
    language of the pair. The rows are bounded by the vocabularies."""

    def train(table: pa.Table) -> pa.Table:
        rows = _once(table.to_pylist())
        pair = table.column("pair")[0].as_py()
        texts: list[tuple[list[str], list[str]]] = []
        seen: tuple[dict[str, int], dict[str, int]] = ({}, {})
        for r in rows:
            a, b = clauses(r["src"] or [])[0], clauses(r["tgt"] or [])[0]
            if r["turned"]:
                a, b = b, a
            for side, cs in zip(seen, (a, b), strict=True):
                for c in cs:
                    for t in c:
                        side[t] = side.get(t, 0) + 1
            if r["script_id"] is None and len(a) == len(b):
                texts += zip(a, b, strict=True)
            elif r["script_id"] is not None:
                texts += [(a[i], b[j]) for i, j in by_length(a, b)]
        out = [(pair, x, y, v) for (x, y), v in expected_counts(texts).items()]
        out += [(pair, t, None, float(n)) for t, n in seen[0].items()] + [(pair, None, t, float(n)) for t, n in seen[1].items()]
        return _table(out, [pa.string()] * 3 + [pa.float64()], ["pair", "a", "b", "n"])

    counts = training.groupBy("pair", "salt").applyInArrow(train, "pair string, a string, b string, n double")
    # evidence spread thinly over many groups counts like that of one: only sums are pruned
    total = counts.groupBy("pair", "a", "b").agg(F.sum("n").alias("n")).where(F.col("n") > LEAST_COUNT)
    # windows instead of joins with sums, so that the training stands in the plan once
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    share = lambda c, d: F.when(both, F.col("n") / F.sum(F.when(both, F.col("n"))).over(W.partitionBy("pair", F.coalesce(c, d)))).otherwise(F.col("n"))
    linked = total.withColumn("to_b", share("a", "b")).withColumn("to_a", share("b", "a"))
    return linked.where(~both | (F.greatest("to_b", "to_a") >= LEAST_LINK)).select("pair", "a", "b", "to_b", "to_a")


def pairs(scripts: DataFrame, trained_links: DataFrame) -> DataFrame:
    """script_id, source_idx, target_idx. scripts is salted; the links go to each salt of their language pair."""

    def realign(left: pa.Table, right: pa.Table) -> pa.Table:
        known: dict[str, dict[str, tuple[float, float]]] = {}
        na: dict[str, float] = {}
        nb: dict[str, float] = {}
        for a, b, v, w in zip(*(right.column(c).to_pylist() for c in ("a", "b", "to_b", "to_a")), strict=True):
            if b is None:
                na[a] = v
            elif a is None:
                nb[b] = v
            else:
                known.setdefault(a, {})[b] = (v, w)
        whole = max([1.0, *na.values(), *nb.values()]) * 2
        weigh = lambda n: {t: math.log(whole / v) for t, v in n.items()}
        wa, wb = weigh(na), weigh(nb)
        unseen = math.log(whole)
        lexicon = Lexicon(known, wa, wb, unseen)
        turned: dict[str, dict[str, tuple[float, float]]] = {}
        for a, row in known.items():
            for b, (v, w) in row.items():
                turned.setdefault(b, {})[a] = (w, v)
        back = Lexicon(turned, wb, wa, unseen)
        out = []
        for r in _once(left.to_pylist()):
            for i, j in align(r["src"] or [], r["tgt"] or [], back if r["turned"] else lexicon):
                out.append((r["script_id"], r["src_idx"][i], r["tgt_idx"][j]))
        return _table([x for x in out if None not in x], [pa.int64()] * 3, ["script_id", "source_idx", "target_idx"])

    salts = scripts.select("pair", "salts").distinct()
    spread = trained_links.join(salts, "pair").select("pair", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "a", "b", "to_b", "to_a")
    left = scripts.groupBy("pair", "salt")
    return left.cogroup(spread.groupBy("pair", "salt")).applyInArrow(realign, "script_id bigint, source_idx bigint, target_idx bigint").distinct()


def _paired(rows: DataFrame) -> DataFrame:
    """Adds pair, the two languages in alphabetical order, and turned, whether the source is the second."""
    a, b = F.coalesce("source_lang", F.lit("?")), F.coalesce("target_lang", F.lit("?"))
    return rows.withColumn("pair", F.concat_ws("-", F.least(a, b), F.greatest(a, b))).withColumn("turned", a > b).drop("source_lang", "target_lang")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = notations(spark, sf_dir)
    kept = lambda c: F.transform(c, lambda x: x["text"])
    place = lambda c: F.transform(c, lambda x: x["seg_idx"].cast("bigint"))
    scripts = spark.read.parquet(f"{sf_dir}/bilingual_scripts.parquet").where("script_id is not null")
    lang = lambda c: F.coalesce(code(F.col(c), names), F.col(c))
    scripts = scripts.select("script_id", kept("source_segments").alias("src"), kept("target_segments").alias("tgt"), place("source_segments").alias("src_idx"), place("target_segments").alias("tgt_idx"), lang("source_lang").alias("source_lang"), lang("target_lang").alias("target_lang"))
    memory = spark.read.parquet(f"{sf_dir}/translations.parquet").select(F.lit(None).cast("bigint").alias("script_id"), "trans_id", F.array("source_text").alias("src"), F.array("translated_text").alias("tgt"), code(F.col("source_lang"), names).alias("source_lang"), code(F.col("target_lang"), names).alias("target_lang"))
    memory = memory.where("source_lang is not null and target_lang is not null and source_lang <> target_lang")
    own = _paired(scripts)
    training = own.select("script_id", F.lit(None).cast("bigint").alias("trans_id"), "src", "tgt", "pair", "turned").unionByName(_paired(memory))
    return pairs(salted(own, GROUP_SCRIPTS), links(salted(training, 2 * GROUP_SCRIPTS)))


QUERIES = {"p3_found": p3_found}
SQL: dict[str, str] = {}
