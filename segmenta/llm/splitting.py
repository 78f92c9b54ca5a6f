"""Cutting oversized texts at natural boundaries, and the queries of problem 10.

Balanced targets: the least number of pieces is computed, cuts are aimed at equal lengths, each cut snaps to the
strongest boundary near its aim (paragraph, line, sentence, word, and inside an oversized word a character), and a
piece is added when any piece exceeds its limit once it is really encoded. Consecutive pieces share up to `overlap`
tokens, from the earliest sentence start, or else word start, or else code point, that keeps within them.

Defined results: null, empty and fitting texts give no piece; pieces cover the text, in order, cut at code points. Where
every boundary is a cut already and a piece is still too large, that piece alone shares less with the one before, down to
nothing; that takes a limit that is hardly larger than the overlap.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmenta.llm.bpe import TOKENIZER, Encoder, encoder

LIMIT, OVERLAP = 2_048, 64
KINDS = ("character", "word", "sentence", "line", "paragraph")
#: A place where a sentence, line or paragraph begins: what precedes it, white space included.
_LINE = "\n\r\v\f\x85\u2028\u2029"
_BREAKS = regex.compile(rf"(?<![^\S{_LINE}])(?:\n[^\S\n]*+\n|\u2029|\r\n[^\S\n]*+\r\n)\s*|[{_LINE}]\s*|[.!?…।][\"'”’»)\]]*\s+|[。！？．｡][”’」』）】]*\s*")


class Boundaries:
    """Places where a text may be cut, with the tokens before each and the strength of each."""

    def __init__(self, text: str, enc: Encoder, limit: int, overlap: int):
        self.text, self.enc = text, enc
        fine = max(8, min(limit // 8, overlap) if overlap else limit // 8)
        place, tokens, strength = [0], [0], [4]
        breaks = {}
        for m in _BREAKS.finditer(text):
            g = m.group()
            breaks[m.end()] = 4 if g.count("\n") > 1 or "\u2029" in g else 3 if any(c in g for c in _LINE) else 2
        spans = [m.span() for m in enc.words.finditer(text)]
        rows = enc.rows_of([text[a:b] for a, b in spans])
        at = 0
        for (a, b), row in zip(spans, rows.tolist(), strict=True):
            n = int(enc.length[row])
            if a:
                # a word takes the space before it; a cut before the space belongs to the break that ends after it
                lead = a + (text[a] == " ")
                place.append(a)
                tokens.append(at)
                strength.append(breaks.get(a, breaks.get(lead, 1)))
            if n > fine:
                inside, ends = text[a:b].encode(), np.cumsum(enc.token_bytes[enc.flat[enc.start[row] : enc.start[row] + n]]).tolist()
                done = 0
                for k, end in enumerate(ends[:-1], 1):
                    if inside[end] & 0xC0 != 0x80:
                        place.append(place[-1] + len(inside[done:end].decode()) if done else a + len(inside[:end].decode()))
                        tokens.append(at + k)
                        strength.append(0)
                        done = end
            at += n
        self.total = at
        self.place, self.tokens, self.strength = [*place, len(text)], [*tokens, at], [*strength, 4]

    def snap(self, low: int, aim: float, high: int, reach: float) -> int:
        """Index of the strongest boundary within reach of the aim, the nearest of equals, between two indices. Where no
        sentence, line or paragraph begins within reach, twice and three times as far is looked for one."""
        first = None
        for far in (reach, 2 * reach, 3 * reach):
            a = max(low + 1, bisect_left(self.tokens, aim - far))
            b = min(high, bisect_right(self.tokens, aim + far))
            if a < b:
                best = max(range(a, b), key=lambda i: (self.strength[i], -abs(self.tokens[i] - aim)))
                if self.strength[best] > 1:
                    return best
                first = best if first is None else first
        return first if first is not None else min(max(low + 1, bisect_left(self.tokens, aim)), high)

    def earlier(self, low: int, at: int, shared: int) -> int:
        """Where a piece begins, after `low`, so that it shares at most `shared` tokens with the one that ends at `at`: at the
        first sentence, else word, else code point within them. What is cut inside a word counts as it is encoded alone."""
        a = max(low + 1, bisect_left(self.tokens, self.tokens[at] - shared))
        for least in (2, 1, 0):
            for i in range(a, at):
                if self.strength[i] >= least and (0 < least <= self.strength[at] or self.enc.counts([self.text[self.place[i] : self.place[at]]])[0] <= shared):
                    return i
        return at


def split_text(text: str, enc: Encoder, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int, str]]:
    """(start, end, tokens, tokens shared with the piece before, boundary at the start) of each piece; none if it fits."""
    bounds = Boundaries(text, enc, limit, overlap)
    total, last = bounds.total, len(bounds.place) - 1
    if total <= limit:
        return []
    n = -(-(total - overlap) // (limit - overlap))
    while True:
        cuts, reach = [0], total / n / 8
        for i in range(1, n):
            k = bounds.snap(cuts[-1], total * i / n, last, reach)
            if k >= last:
                break
            cuts.append(k)
        ends = [*cuts[1:], last]
        room = [bounds.tokens[e] - bounds.tokens[k] for k, e in zip(cuts, ends, strict=True)]
        # what is cut between words has as many tokens as its words, so most tries need no encoding
        done = n > last
        if done or max(room) <= limit:
            starts = [0, *(bounds.earlier(c, k, min(overlap, limit - r) if done else overlap) if overlap else k for c, k, r in zip(cuts, cuts[1:], room[1:], strict=False))]
            if done or max(bounds.tokens[e] - bounds.tokens[s] for s, e in zip(starts, ends, strict=True)) <= limit:
                spans = [(bounds.place[s], bounds.place[e]) for s, e in zip(starts, ends, strict=True)]
                sizes = enc.counts([text[a:b] for a, b in spans])
                if max(sizes) <= limit:
                    shared = [0, *enc.counts([text[spans[i + 1][0] : spans[i][1]] for i in range(len(spans) - 1)])]
                    return [(a, b, t, s, KINDS[bounds.strength[k]]) for (a, b), t, s, k in zip(spans, sizes, shared, cuts, strict=True)]
                if done and overlap:
                    overlap = 0
        n += max(1, n // 32)


def pieces(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, path: str = TOKENIZER) -> DataFrame:
    """The pieces of each text of more than `limit` tokens. No shuffle; texts with at most `limit` bytes, which can't
    have more tokens than bytes, are passed over in the scan."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(k, i, *p) for i, p in enumerate(split_text(t, enc, limit, overlap))]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [batch.schema.field(0).type, *[pa.int64()] * 5, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["k", "piece_no", "start_pos", "end_pos", "n_tokens", "n_shared", "cut_at"])

    long = df.where(F.octet_length(text) > limit).select(F.col(key).alias("k"), text)
    out = long.mapInArrow(cut, f"k {df.schema[key].dataType.simpleString()}, piece_no bigint, start_pos bigint, end_pos bigint, n_tokens bigint, n_shared bigint, cut_at string")
    return out.withColumnRenamed("k", key)


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the operator cut: those that have a second piece."""
    return p10_pieces(spark, sf_dir).where(F.col("piece_no") == 1).select("doc_id")


def p10_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document put together again from its pieces without what they share, or its text where it has none. A document's
    pieces are one document, so a group is small by nature."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is not null and text is not null").select("doc_id", "text")
    near = p10_pieces(spark, sf_dir).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("piece_no", "start_pos", "end_pos", "n_tokens", "n_shared"))).alias("x"))
    good = F.forall("x", lambda p: (p["n_tokens"] <= LIMIT) & (p["n_shared"] <= OVERLAP))
    part = lambda p, i: F.when(i == 0, p["start_pos"]).otherwise(F.get(F.col("x"), i - 1)["end_pos"])
    own = F.transform("x", lambda p, i: F.substring(F.col("text"), (part(p, i) + 1).cast("int"), (p["end_pos"] - part(p, i)).cast("int")))
    return docs.join(near, "doc_id", "left").select("doc_id", F.coalesce(F.array_join(own, ""), "text").alias("text"), F.coalesce(good, F.lit(True)).alias("within"))


QUERIES = {"p10_found": p10_found, "p10_pieces": p10_pieces, "p10_rebuilt": p10_rebuilt}
SQL = {"p10_rebuilt": "SELECT doc_id, text, true AS within FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL"}
