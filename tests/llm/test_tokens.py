"""Encoding, splitting and packing against exact versions."""

import random

import pytest

from segmenta.llm.bpe import encoder
from segmenta.llm.packing import first_fit_decreasing, items, pack
from segmenta.llm.splitting import split_text

TEXTS = [
    "", " ", "don't we'll  go\t\tnow \n\n x", "a" * 3000, "ab" * 2000, "<|endoftext|> stays text", "日本語のテキスト" * 200, "ééé  x", "👩‍👩‍👧 " * 50,
    "Ünïcödé—dash… “quotes”", "नमस्ते दुनिया" * 30, "x" + " " * 500 + "y", "Привет, мир! 123,456.78", "\u0000\u0001 control", "aaaaaaabaaaaaab" * 40,
]


@pytest.fixture(scope="module")
def enc():
    return encoder()


def test_equals_public_library(enc):
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    other.encode_special_tokens = True
    rng = random.Random(5)
    letters = "abcdeéо日本 0.,'\n"
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(500)]
    ids, count = enc.encode_batch(texts)
    at = 0
    for t, n, ref in zip(texts, count, other.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids[at : at + n].tolist() == ref.ids, t
        at += n


def test_proposals_are_verified(enc):
    """Words whose greedy proposal is wrong exist, and verification finds each of them."""
    rng = random.Random(1)
    words = {"".join(rng.choice("aeinorstlhdcumpg") for _ in range(rng.randint(4, 12))).encode() for _ in range(3000)}
    wrong = [w for w in words if enc.propose(w) != enc.merge(w)]
    assert wrong
    enc.learn(sorted({w.decode() for w in wrong} - enc.row.keys()))
    for w in wrong:
        assert enc.encode(w.decode()).tolist() == enc.merge(w)


def test_null_and_empty_have_no_ids(enc):
    assert enc.encode(None).tolist() == enc.encode("").tolist() == []
    assert enc.counts([None, "", "a"]) == [0, 0, 1]


def test_long_word_is_not_quadratic(enc):
    assert len(enc.encode("qz" * 100_000)) > 1000


@pytest.mark.parametrize(("limit", "overlap"), [(64, 8), (2048, 64), (50, 0)])
def test_pieces_keep_the_limit_and_cover_the_text(enc, limit, overlap):
    for text in [*TEXTS, "Ein Satz. Noch ein Satz!\n\nAbsatz zwei. " * 200, "字" * 4000, "\n" * 3000]:
        pieces = split_text(text, enc, limit, overlap)
        assert bool(pieces) == (enc.counts([text])[0] > limit)
        if pieces:
            assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
            for a, b in zip(pieces, pieces[1:], strict=False):
                assert a[0] < b[0] <= a[1] < b[1]
            for start, end, n, shared, _ in pieces:
                assert n == enc.counts([text[start:end]])[0] <= limit and shared <= overlap


def test_pieces_without_words_share_code_points(enc):
    """Han letters without a word start, and words longer than the overlap: pieces share nearly as much as they may."""
    rng = random.Random(7)
    for text in ("字" * 9000, "".join(rng.choice("天地人你我他好看说话") for _ in range(9000)), "qz" * 20000, ("x" * 400 + " ") * 60):
        shared = [p[3] for p in split_text(text, enc)[1:]]
        assert shared and min(shared) > 32 and max(shared) <= 64


def test_rows_without_id_and_copies_spread_over_groups(spark):
    df = spark.createDataFrame([(None, "same")] * 300 + [(7, "copy")] * 300, "doc_id bigint, text string").repartition(3)
    out = pack(df, "doc_id", "text", capacity=64, group_rows=100).collect()
    assert len(out) == 600 and len({r.container >> 32 for r in out if r.doc_id is None}) == 6 == len({r.container >> 32 for r in out if r.doc_id == 7})


def test_natural_boundaries_win(enc):
    text = "\n\n".join("Satz eins ist hier. Satz zwei ist da. " * 6 for _ in range(8))
    assert {p[4] for p in split_text(text, enc, 200, 0)[1:]} == {"paragraph"}


def test_first_fit_decreasing_equals_plain_search():
    rng = random.Random(3)
    for _ in range(60):
        sizes = [rng.randint(0, 100) for _ in range(rng.randint(0, 60))]
        free, out = [], [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            k = next((k for k, f in enumerate(free) if f >= sizes[i]), len(free))
            if k == len(free):
                free.append(100)
            free[k] -= sizes[i]
            out[i] = k
        assert first_fit_decreasing(sizes, 100) == out


def test_packing_keeps_all_and_fits(spark):
    rows = [(i, "wort " * (i % 37)) for i in range(200)] + [(200, None), (201, ""), (202, "wort " * 700), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = pack(df, "doc_id", "text", capacity=256, group_rows=60).collect()
    assert {r.doc_id for r in out} == {r[0] for r in rows}
    load = {}
    for r in out:
        load[r.container] = load.get(r.container, 0) + r.n_tokens
    assert max(load.values()) <= 256
    total = sum(r.n_tokens for r in items(df, "doc_id", "text", 256).collect())
    assert sum(load.values()) == total and len(load) <= total / 256 * 1.1 + 4
    assert sum(r.doc_id == 202 for r in out) == -(-encoder().counts(["wort " * 700])[0] // 256)
