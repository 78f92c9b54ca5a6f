"""Byte-pair encoding by speculation and verification, and the queries of problem 8.

Greedy longest match proposes the tokens of each different word. A token sequence is the one that the merges produce
exactly when every adjacent pair of it is stable, that is, when merging the two tokens' bytes alone ends in the same two
tokens. The pairs of a batch are tested together in numpy by unwinding the merges at their border; only words with an
unstable pair are merged step by step.

Defined results: null and empty texts have no ids; strings of special tokens in a text are ordinary text; white space
counts. No word and no text is too long: exact merging takes n log n.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

#: Where the public vocabularies lie; a parameter of every operator that counts tokens.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the split of text into words that belongs to the vocabulary.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that are encoded at a time, and different words that a worker remembers.
CHUNK_CHARS, REMEMBERED = 1_000_000, 400_000
_NEVER = 1 << 30


def _byte_alphabet() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary: printable Latin-1 for itself, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    def __init__(self, path: str = TOKENIZER):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        alphabet = _byte_alphabet()
        vocab = model["vocab"]
        as_bytes = {s: bytes(alphabet[c] for c in s) for s in vocab if all(c in alphabet for c in s)}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        n = len(vocab)
        self.left, self.right = np.arange(n), np.arange(n)
        self.pairs: dict[tuple[int, int], int] = {}
        for a, b in merges:
            i, x, y = vocab[a + b], vocab[a], vocab[b]
            self.left[i], self.right[i] = x, y
            self.pairs[x, y] = i
        self.atom = np.asarray(self.left == np.arange(n))
        keys = np.array([x * n + y for x, y in self.pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ids = keys[order], np.array(list(self.pairs.values()), dtype=np.int64)[order]
        self.n = n
        # what is whole: bytes and results of merges; other entries (special tokens) are never proposed
        made = set(self.pairs.values())
        self.ids = {b: vocab[s] for s, b in as_bytes.items() if len(b) == 1 or vocab[s] in made}
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        self.token_bytes = np.zeros(n, dtype=np.int64)
        self.longest: dict[bytes, int] = {}
        for b, i in self.ids.items():
            self.token_bytes[i] = len(b)
            self.longest[b[:2]] = max(self.longest.get(b[:2], 1), len(b))
        self.words = regex.compile(WORDS)
        self._forget()

    def _forget(self) -> None:
        self.row: dict[str, int] = {}
        self.flat = np.empty(0, dtype=np.int64)
        self.start, self.length = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def propose(self, word: bytes) -> list[int]:
        """The longest token at each place."""
        ids, longest, out, i, n = self.ids, self.longest, [], 0, len(word)
        if (whole := ids.get(word)) is not None:
            return [whole]
        while i < n:
            for j in range(min(n, i + longest.get(word[i : i + 2], 1)), i, -1):
                if (t := ids.get(word[i:j])) is not None:
                    out.append(t)
                    i = j
                    break
        return out

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens: do their bytes alone merge into just these two?

        The border is walked back in time. x and y touch it, and each is itself consumed by its own token's next merge
        at times until_x and until_y; a merge of x and y before that would cross the border. Of equal merges the left
        one comes first, so y's own merge loses a tie and x's own merge wins it.
        """
        x, y = a.astype(np.int64), b.astype(np.int64)
        until_x, until_y = np.full(len(x), _NEVER), np.full(len(x), _NEVER)
        good, left = np.ones(len(x), dtype=bool), np.arange(len(x))
        while len(left):
            key = x * self.n + y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            merged = np.where(self.pair_keys[at] == key, self.pair_ids[at], _NEVER)
            crossed = (merged < until_x) & (merged <= until_y)
            good[left[crossed]] = False
            on = ~crossed & ~(self.atom[x] & self.atom[y])
            left, x, y, until_x, until_y = left[on], x[on], y[on], until_x[on], until_y[on]
            back = ~self.atom[x] & ((x > y) | self.atom[y])
            until_x, x, until_y, y = np.where(back, x, until_x), np.where(back, self.right[x], x), np.where(back, until_y, y), np.where(back, y, self.left[y])
        return good

    def merge(self, word: bytes) -> list[int]:
        """The merges one by one, the lowest and leftmost first."""
        t = [self.byte_ids[b] for b in word]
        n, pairs = len(t), self.pairs
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i, t[i], t[i + 1]) for i in range(n - 1) if (m := pairs.get((t[i], t[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, x, y = heapq.heappop(heap)
            j = nxt[i]
            if t[i] != x or j >= n or t[j] != y:
                continue
            t[i], t[j] = m, -1
            nxt[i] = k = nxt[j]
            if k < n:
                prv[k] = i
                if (v := pairs.get((m, t[k]))) is not None:
                    heapq.heappush(heap, (v, i, m, t[k]))
            if (h := prv[i]) >= 0 and (v := pairs.get((t[h], m))) is not None:
                heapq.heappush(heap, (v, h, t[h], m))
        return [x for x in t if x >= 0]

    def learn(self, words: list[str]) -> None:
        """Encodes words that aren't remembered yet, all together."""
        if len(self.row) + len(words) > REMEMBERED:
            self._forget()
        raw = [w.encode("utf-8", "replace") for w in words]
        found = [self.propose(w) for w in raw]
        count = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        flat = np.fromiter(chain.from_iterable(found), dtype=np.int64, count=int(count.sum()))
        owner = np.repeat(np.arange(len(found)), count)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pair, where = np.unique(flat[inner] * self.n + flat[inner + 1], return_inverse=True)
        failed = np.unique(owner[inner[~self.stable(pair // self.n, pair % self.n)[where]]]) if len(inner) else []
        if len(failed):
            for k in failed:
                found[k] = self.merge(raw[k])
            count = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            flat = np.fromiter(chain.from_iterable(found), dtype=np.int64, count=int(count.sum()))
        first = len(self.start)
        self.row.update(zip(words, range(first, first + len(words)), strict=True))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(count) - count])
        self.length = np.concatenate([self.length, count])
        self.flat = np.concatenate([self.flat, flat])

    def rows_of(self, words: list[str]) -> np.ndarray:
        new = [w for w in set(words) if w not in self.row]
        if new:
            if len(self.row) + len(new) > REMEMBERED:
                new = list(set(words))
            self.learn(sorted(new))
        return np.fromiter(map(self.row.__getitem__, words), dtype=np.int64, count=len(words))

    def ids_of(self, rows: np.ndarray) -> np.ndarray:
        """The ids of remembered words, one after the other."""
        length = self.length[rows]
        ends = np.cumsum(length)
        return self.flat[np.repeat(self.start[rows] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the number of each."""
        split = [self.words.findall(t) if t else [] for t in texts]
        rows = self.rows_of(list(chain.from_iterable(split)))
        per_word = np.concatenate([[0], np.cumsum(self.length[rows])])
        ends = np.cumsum(np.fromiter(map(len, split), dtype=np.int64, count=len(split)))
        return self.ids_of(rows), np.diff(per_word[ends], prepend=0) if len(ends) else ends

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_batch([text])[0]

    def counts(self, texts: list[str | None]) -> list[int]:
        return self.encode_batch(texts)[1].tolist()


@lru_cache(maxsize=2)
def encoder(path: str = TOKENIZER) -> Encoder:
    """One encoder per Python worker."""
    return Encoder(path)


def chunks(texts: list[str | None], size: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `size` characters."""
    first = held = 0
    for i, t in enumerate(texts):
        held += len(t or "") + 1
        if held >= size:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def encode_column(df: DataFrame, key: str, text: str, path: str = TOKENIZER) -> DataFrame:
    """key and ids (array of bigint) of each row's text. No shuffle; a row stands alone."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts):
                ids, count = enc.encode_batch(texts[a:b])
                ends = np.concatenate([[0], np.cumsum(count)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int64()))], names=[key, "ids"])

    return df.select(key, text).mapInArrow(encode, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<bigint>")


def decode_column(df: DataFrame, key: str, ids: str, path: str = TOKENIZER) -> DataFrame:
    """key and text of each row's ids. Null and empty lists give an empty text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        as_bytes = {i: b for b, i in enc.ids.items()}
        for batch in batches:
            texts = [b"".join(map(as_bytes.__getitem__, row or [])).decode("utf-8", "replace") for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return df.select(key, ids).mapInArrow(decode, f"`{key}` {df.schema[key].dataType.simpleString()}, text string")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_column(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")


def p8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that the ids of p8_ids stand for: the documents' own."""
    return decode_column(p8_ids(spark, sf_dir), "doc_id", "ids")


QUERIES = {"p8_ids": p8_ids, "p8_round_trip": p8_round_trip}
SQL = {"p8_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
