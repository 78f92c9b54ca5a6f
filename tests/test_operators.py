"""Core operators against brute force on random data, ties, nulls, hot entities and shard borders."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from segmenta import models, pipeline, sinks
from segmenta.functions import labels, matching, phonemes, phrases, rewrite, signal, text as X
from segmenta.functions.phrases import features
from segmenta.operators import folds, vectors as V
from segmenta.operators.energy import voiced
from segmenta.operators.intervals import best_span, points_in_spans
from segmenta.operators.ordered import islands, neighbourhood, running, sequenced
from segmenta.operators.quantiles import percentiles, value_range
from segmenta.operators.run_bitmaps import periods, periods_and_gaps
from segmenta.operators.runs import value_runs
from segmenta.sources.tables import latest, millis


def brute_periods(intervals):
    out = []
    for s, e in sorted(set(intervals)):
        if out and s <= out[-1][1]:
            out[-1] = [out[-1][0], max(out[-1][1], e), out[-1][2] + 1]
        else:
            out.append([s, e, 1])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("shard", [7, 50, 10_000])
def test_periods_equal_brute_force(spark, shard):
    """Intervals within, over and far beyond shards; copies; one entity with most rows."""
    rng = random.Random(shard)
    rows = []
    for key, n in (("hot", 300), ("a", 40), ("b", 1), ("c", 0)):
        for _ in range(n):
            s = rng.randint(-200, 1500)
            rows.append((key, s, s + rng.choice([1, 2, 5, 30, 400])))
    rows += rows[:30] + [("a", 5, 5), ("a", 9, 3), ("a", None, 4), ("a", 4, None), (None, 1, 2)]
    df = spark.createDataFrame(rows, "k string, start_ms bigint, end_ms bigint")
    by = {}
    for k, s, e in rows:
        if k and s is not None and e is not None and e > s:
            by.setdefault(k, []).append((s, e))
    want = {(k, *p) for k, v in by.items() for p in brute_periods(v)}
    assert {tuple(r) for r in periods(df, ["k"], shard).select("k", "start_ms", "end_ms", "n_intervals").collect()} == want
    gaps = {(k, a[1], b[0]) for k, v in by.items() for a, b in itertools.pairwise(brute_periods(v))}
    got = periods_and_gaps(df, ["k"], shard).collect()
    assert {(r.k, r.start_ms, r.end_ms) for r in got if r.kind == "gap"} == gaps
    assert {(r.k, r.start_ms, r.end_ms, r.n_intervals) for r in got if r.kind == "period"} == want


def test_millis(spark):
    df = spark.createDataFrame([(1.0005,), (None,), (float("nan"),), (float("inf"),), (5.8790000001,), (-1.25,)], "x double")
    assert [r[0] for r in df.select(millis(F.col("x"))).collect()] == [1001, None, None, None, 5879, -1250]


def _series(seed, n_hot=400):
    rng = random.Random(seed)
    rows = [("hot", i, i // 9, rng.choice("ab")) for i in range(n_hot)] + [("x", i, i // 9, rng.choice("abc")) for i in range(25)] + [("one", 0, 0, "a")]
    rng.shuffle(rows)
    return rows


def test_order_over_shards(spark):
    rows = _series(1)
    df = spark.createDataFrame(rows, "k string, t bigint, shard bigint, v string")
    got = sequenced(df, ["k"], "shard", ["t"], ["v", "t"]).collect()
    for r in got:
        assert r.idx == r.t and (r.prev.t if r.prev else -1) == r.t - 1
        assert (r.next is None) == (r.t == max(x[1] for x in rows if x[0] == r.k))
    total = running(df, ["k"], "shard", ["t"], F.col("t"), "s").collect()
    assert all(r.s == r.t * (r.t + 1) // 2 for r in total)
    runs = islands(df, ["k"], "shard", ["t"], ["v"], F.col("v") != F.col("prev.v"), "run").collect()
    for k in ("hot", "x", "one"):
        v = [x[3] for x in sorted(y for y in rows if y[0] == k)]
        want = np.cumsum([0, *(a != b for a, b in itertools.pairwise(v))]).tolist()
        assert [r.run for r in sorted((r for r in runs if r.k == k), key=lambda r: r.t)] == want


def test_runs_over_shards(spark):
    rows = _series(2) + _series(2)[:50]  # redelivered rows count once
    df = spark.createDataFrame(rows, "k string, t bigint, shard bigint, v string")
    want = set()
    for k in ("hot", "x", "one"):
        seq = [(x[1], x[3]) for x in sorted(set(y for y in rows if y[0] == k))]
        for v, run in itertools.groupby(seq, key=lambda x: x[1]):
            run = list(run)
            want.add((k, run[0][0], v, len(run)))
    assert {(r.k, r.head.t, r.v, r.n_rows) for r in value_runs(df, ["k"], "shard", ["t"], "v").collect()} == want


def test_one_run_over_many_shards(spark):
    df = spark.createDataFrame([("k", i, i // 3, None if i < 20 else "a") for i in range(40)], "k string, t bigint, shard bigint, v string")
    assert {(r.head.t, r.v, r.n_rows) for r in value_runs(df, ["k"], "shard", ["t"], "v").collect()} == {(0, None, 20), (20, "a", 20)}


def test_window_with_halo(spark):
    rng = random.Random(4)
    v = [rng.random() for _ in range(103)]
    df = spark.createDataFrame([("k", i, x) for i, x in enumerate(v)], "k string, idx bigint, v double")
    near, order = neighbourhood(df, ["k"], "idx", 3, 2, block=10)
    got = {r.idx: r.m for r in near.withColumn("m", F.max("v").over(order.rowsBetween(-3, 2))).where("not halo").collect()}
    assert got == {i: max(v[max(0, i - 3) : i + 3]) for i in range(len(v))}


def test_percentiles_equal_numpy(spark):
    rng = random.Random(5)
    rows = [("hot", float(rng.choice([1, 2, 2.5, 90, 90.25, rng.random() * 300]))) for _ in range(500)] + [("b", 3.0), ("c", None)]
    got = {r.k: (r.a, r.b, r.c) for r in percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"a": 0.2, "b": 0.5, "c": 0.8}).collect()}
    x = [v for k, v in rows if k == "hot"]
    assert np.allclose(got["hot"], np.percentile(x, [20, 50, 80])) and got["b"] == (3.0, 3.0, 3.0) and "c" not in got


def test_voice_activity_equals_loop(spark):
    rng = random.Random(6)
    v = [rng.choice([0.0, 1.0, 50.0, 100.0]) for _ in range(300)]
    df = spark.createDataFrame([("k", i, 0, x) for i, x in enumerate(v)] + [("quiet", 0, 0, 0.0)], "k string, idx bigint, shard bigint, rms double")
    p20, p50, p80 = np.percentile(v, [20, 50, 80])
    thr = max(1.8 * p20, 0.35 * p50, p20 + 0.15 * (p80 - p20))
    speech = [x > thr for x in v]
    mask = [any(speech[max(0, i - 2) : i + 2]) for i in range(len(v))]
    want = [(a, b) for m, a, b in _spans(mask) if m and b - a >= 3]
    got = voiced(df, ["k"]).collect()
    assert sorted((r.start, r.end) for r in got if r.k == "k") == want
    assert [(r.start, r.end, r.openness) for r in got if r.k == "quiet"] == [(0, 1, 0.5)]


def _spans(mask):
    at = 0
    for m, run in itertools.groupby(mask):
        n = len(list(run))
        yield m, at, at + n
        at += n


def test_interval_joins_equal_nested_loops(spark):
    rng = random.Random(7)
    spans = [("k", s, s + rng.choice([3, 40, 500]), i) for i, s in enumerate(sorted(rng.randint(0, 900) for _ in range(40)))]
    segs = [("k", s, s + rng.choice([1, 7, 90]), i) for i, s in enumerate(rng.randint(0, 1200) for _ in range(80))] + [("none", 1, 5, 99)]
    left = spark.createDataFrame(segs, "k string, ls bigint, le bigint, id bigint")
    right = spark.createDataFrame([(k, s, e, i, f"s{i}") for k, s, e, i in spans], "k string, rs bigint, re bigint, ro bigint, who string")
    got = {r.id: r.who for r in best_span(left, right, ["k"], ["id"], "who", 50).collect()}
    for k, s, e, i in segs:
        own = [x for x in spans if x[0] == k]
        hit = [x[3] for x in own if 2 * x[1] <= s + e < 2 * x[2]]
        over = [(min(e, x[2]) - max(s, x[1]), -x[3]) for x in own]
        best = min(hit) if hit else (-max(over)[1] if over and max(over)[0] > 0 else None)
        assert got[i] == (None if best is None else f"s{best}")
    points = spark.createDataFrame([("k", p) for p in range(0, 1500, 13)], "k string, p bigint")
    inside = {(r.p, r.id) for r in points_in_spans(points, left, ["k"], "p", "ls", "le", 64).collect()}
    assert inside == {(p, i) for p in range(0, 1500, 13) for k, s, e, i in segs if k == "k" and s <= p < e}


def _segs(seed):
    rng = random.Random(seed)
    t, out = 0, []
    for i in range(160):
        t += rng.choice([0, 0, 60, 200, 450, 700, 900])
        n = rng.choice([90, 200, 400, 1500])
        out.append({"rec_id": "r", "idx": i, "start_ms": t, "end_ms": t + n, "speaker": rng.choice(["A", "A", "B"]), "text": rng.choice(["我们先把", "说话人分离坐稳。", "ory", "The line of", "goes on here", "好", "", "Hello there.", "今天天气很好"])})
        t += n - rng.choice([0, 0, 0, 80])
    return out


@pytest.mark.parametrize(("build", "fold"), [(folds.crumb_glue, folds.glued), (folds.short_fragment_merge, folds.short_merged), (folds.phrase_merge, folds.phrases)])
def test_folds_equal_a_fold_of_the_whole_recording(spark, build, fold):
    for seed in range(3):
        segs = _segs(seed)
        df = spark.createDataFrame([(s["rec_id"], s["idx"], s["idx"], s["start_ms"] // 5000, s["start_ms"], s["end_ms"], s["speaker"], s["text"]) for s in segs], "rec_id string, seg_idx bigint, seg_id bigint, shard bigint, start_ms bigint, end_ms bigint, speaker string, text string")
        got = sorted((r.idx, r.end_ms, r.text) for r in build(df).collect())
        assert got == sorted((s["idx"], s["end_ms"], s["text"]) for s in fold(segs))


def _fixpoint(segs, fits):
    """Left folds over the row until one changes nothing."""
    out = [dict(s, n=1) for s in segs]
    while True:
        new = out[:1]
        for s in out[1:]:
            p = new[-1]
            if fits(p, s):
                new[-1] = dict(p, end_ms=s["end_ms"], text=folds.joined(p["text"], s["text"]), n=p["n"] + s["n"])
            else:
                new.append(s)
        if len(new) == len(out):
            return new
        out = new


def test_phrases_equal_the_fixpoint():
    as_phrase = lambda s: folds.Phrase(s["idx"], s["start_ms"], s["end_ms"], s["text"], 1, features(s["text"]))
    for seed in range(40):
        segs = _segs(seed)
        want = _fixpoint(segs, lambda p, s: folds.belongs(as_phrase(p), as_phrase(s)))
        assert [(p["idx"], p["end_ms"], p["text"], p["n"]) for p in folds.phrases(segs)] == [(p["idx"], p["end_ms"], p["text"], p["n"]) for p in want]
    assert folds.phrases([]) == []


def test_crumbs_equal_looking_back():
    """For each crumb the segments before it are looked at one by one."""
    for seed in range(40):
        out = [dict(s) for s in _segs(seed)]
        for i, s in enumerate(out):
            back = next((j for j in range(i - 1, -1, -1) if out[j]["speaker"] != s["speaker"] or s["start_ms"] - out[j]["end_ms"] > 800 or out[j]["text"].strip()), None)
            if back is not None and folds.is_crumb(s["text"]) and out[back]["speaker"] == s["speaker"] and s["start_ms"] - out[back]["end_ms"] <= 800:
                out[back]["text"] = (out[back]["text"].rstrip() + s["text"].strip()).strip()
                out[back]["end_ms"], s["text"] = max(out[back]["end_ms"], s["end_ms"]), ""
        assert [(s["end_ms"], s["text"]) for s in folds.glued(_segs(seed))] == [(s["end_ms"], s["text"]) for s in out]


@pytest.mark.parametrize(
    ("text", "closed", "hangs", "on"),
    [("我们先把", False, True, True), ("我們先", False, True, True), ("The line of", False, True, False), ("听感也一般，真的不太好说吧", False, False, True), ("聽感。", True, False, True), ("然后我们走", False, False, False), ("Okay then", False, False, False), ("and so on.", True, False, True), ("", False, False, False), ("再提升一下", False, False, False), ("done;", True, False, True)],
)
def test_open_ends(spark, text, closed, hangs, on):
    f = features(text)
    assert (f.closed, f.hangs, f.goes_on) == (closed, hangs, on)
    t = F.col("t")
    assert tuple(spark.createDataFrame([(text,)], "t string").select(phrases.closed(t), phrases.ends_open(t), phrases.goes_on(t)).first()) == (closed, hangs, on)


def test_blank_translations_are_made_again():
    g = [("A", "a", ""), ("A", "b", ""), ("A", "c", "C"), ("A", "d", "D"), ("B", "e", ""), ("A", "f", "F")]
    out = folds.empties_retried([dict(zip(("speaker", "text", "tgt"), x, strict=True)) for x in g], str.upper)
    assert [x["tgt"] for x in out] == ["ABC", "", "", "D", "", "F"]
    # where the joint attempt fails, the rest of the bundle tries by itself
    out = folds.empties_retried([dict(zip(("speaker", "text", "tgt"), x, strict=True)) for x in g[:3]], lambda s: "" if s.startswith("a") else s)
    assert [(x["tgt"], x["retried"]) for x in out] == [("", False), ("bc", True), ("", True)]


def test_blank_groups_over_shards_equal_one_fold(spark):
    rng = random.Random(11)
    rows = [("r", i // 5, i, rng.choice("AAB"), f"t{i}", rng.choice(["", "", "x"])) for i in range(120)]
    want = folds.empties_retried([dict(zip(("rec_id", "shard", "grp", "speaker", "text", "tgt"), r, strict=True)) for r in rows], str.upper)
    got = folds.retry_empty(spark.createDataFrame(rows, "rec_id string, shard bigint, grp bigint, speaker string, text string, tgt string"), str.upper).collect()
    assert sorted((r.grp, r.tgt, r.retried) for r in got) == [(w["grp"], w["tgt"], w["retried"]) for w in want]


def test_text_chunks(spark):
    df = spark.createDataFrame([("One. Two! Three? Four. " + "x" * 300,), ("",), ("no mark",)], "t string")
    assert [r[0] for r in df.select(folds.text_chunks(F.col("t"))).collect()] == [["One. Two! Three?", "Four.", "x" * 300 + "."], [], ["no mark."]]


def test_syllables(spark):
    cases = [("你好世界", "zh", 4), ("hello world", "zh", 3), ("こんにちは世界", "ja", 7), ("안녕", "ko", 2), ("The listening room", "en", 5), ("", "en", 0), ("rhythm", "en", 1)]
    df = spark.createDataFrame([c[:2] for c in cases], "t string, l string")
    assert [r[0] for r in df.select(X.syllables(F.col("t"), F.col("l"))).collect()] == [c[2] for c in cases]


def test_word_error_rate_equals_recursion():
    def edits(a, b):
        return len(a) + len(b) if not a or not b else min(edits(a[1:], b) + 1, edits(a, b[1:]) + 1, edits(a[1:], b[1:]) + (a[0] != b[0]))

    rng = random.Random(8)
    for _ in range(40):
        a, b = ([rng.choice("xyz") for _ in range(rng.randint(0, 5))] for _ in range(2))
        want = edits(a, b) / len(a) if a else float(bool(b))
        assert math.isclose(matching.word_error_rate(" ".join(a), " ".join(b)), want)
    assert matching.word_error_rate(None, None) == 0.0


def test_overlap_equals_all_substrings():
    rng = random.Random(9)
    for _ in range(60):
        t, p = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        best = max((j - i for i in range(len(p)) for j in range(i + 2, len(p) + 1) if p[i:j] in t), default=0)
        assert matching.overlap(t, p) == (best / len(t) if t and p else 0.0)
    assert matching.hallucinated("talk about weather talk", "talk about weather", ("weather",)) == (True, 1.0, "banned:weather")
    assert matching.hallucinated("quite normal speech", "other words")[0] is False


def test_fuzzy_hint():
    assert matching.hinted("the old pieno plays", "oldpiano") == "the oldpiano plays"
    assert matching.hinted("nothing alike", "完全不同") == "nothing alike" and matching.hinted(None, "x") is None


def test_clusterings():
    rng = np.random.default_rng(1)
    a, b = np.eye(6)[0], np.eye(6)[1]
    v = np.array([x + rng.normal(0, 0.05, 6) for x in (a, b, a, b, b, a)])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    for how in (V.greedy, V.average_linkage, V.farthest_split):
        assert how(v) == [0, 1, 0, 1, 1, 0] and how(v[:1]) == [0]


def test_blocks_of_centroids_give_what_one_block_gives(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(80)] + [(80, None), (81, [1.0]), (82, [None, 1.0, 0.0, 0.0, 0.0, 0.0]), (3, [0.0] * 6)], "vec_id int, embedding array<double>")
    cen = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(40)] + [(99, [0.0] * 6)], "cl int, centroid array<double>")
    key = lambda x: sorted((r.vec_id, r.place, r.cl, round(r.sim, 9)) for r in x.collect())
    one, many = (key(V.nearest(rows, "vec_id", "embedding", cen, "cl", 3, block_bytes=n)) for n in (1 << 20, 6 * 8 * 5))
    assert one == many and len(one) == 82 * 3
    unit = lambda x: np.array(x) / max(np.linalg.norm(x), 1e-8)
    centroids = [(r.cl, unit(r.centroid)) for r in cen.collect()]
    for r in rows.where("size(embedding) = 6").collect():
        v = unit([x or 0.0 for x in r.embedding])
        want = sorted((-round(float(v @ c), 9), k) for k, c in centroids)[:3]
        assert any([k for _, k in want] == [c for i, _, c, _ in one[j : j + 3]] for j in range(len(one)) if one[j][0] == r.vec_id and one[j][1] == 1) or r.vec_id == 3
    assert V.nearest(rows, "vec_id", "embedding", cen.where("false"), "cl").collect() == []


def test_average_linkage_equals_search_of_all_pairs():
    def plain(v, apart, most):
        groups, d = [[i] for i in range(len(v))], 1 - v @ v.T
        while len(groups) > 1:
            best = min((float(d[np.ix_(a, b)].mean()), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
            if best[0] > apart and len(groups) <= most:
                break
            groups[best[1]] += groups.pop(best[2])
        label = {i: k for k, g in enumerate(groups) for i in g}
        return V.first_seen([label[i] for i in range(len(v))])

    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 9, 30):
        for spread in (0.1, 0.5, 2.0):
            v = np.array([np.eye(5)[rng.integers(0, 4)] + rng.normal(0, spread, 5) for _ in range(n)])
            v /= np.linalg.norm(v, axis=1, keepdims=True)
            for apart, most in ((0.4, 8), (0.1, 3), (0.9, 2)):
                assert V.average_linkage(v, apart, most) == plain(v, apart, most)
    assert len(set(V.average_linkage(np.repeat(np.eye(3), 700, axis=0)))) == 3


def test_value_ranges_keep_order_at_every_scale(spark):
    values = sorted([-1e9, -3.0, -1e-12, 0.0, 1e-300, 1e-12, 0.1, 0.2, 0.5, 1.0, 1.01, 90.25, 1e6, 1e6 + 1, 1e12, float("inf")])
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(value_range(F.col("v"))).collect()]
    assert got == sorted(got) and len(set(got)) >= 14
    rng = random.Random(2)
    for scale in (1e-6, 1.0, 1e7):
        x = [rng.random() * scale for _ in range(400)]
        r = percentiles(spark.createDataFrame([("k", v) for v in x] + [("k", None), ("n", None)], "k string, v double"), ["k"], "v", {"a": 0.2, "b": 0.55}, summary=True).collect()
        k = next(r for r in r if r.k == "k")
        assert np.allclose([k.a, k.b], np.percentile(x, [20, 55])) and k.n_frames == 401 and k.peak == max(x) and math.isclose(k.mean, np.mean(x))
        assert next((r.a, r.n_frames) for r in r if r.k == "n") == (None, 1)


def test_latest_keeps_one_row_per_key(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "a", 7), (2, None, 1), (None, "x", 1)], "id int, t string, at int")
    assert sorted(tuple(r) for r in latest(df, "id", "at").collect()) == [(1, "a", 5), (2, None, 1)]


def test_model_slots(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "ccc")], "id int, text string")
    for slot in models.SLOTS:
        assert models.apply(df, slot).count() == 3
    bad = lambda p: p.assign(tgt="", engine="bad")
    some = lambda p: p.assign(tgt=p["text"].fillna("").map(lambda t: t.upper() if len(t) < 3 else ""), engine="some")
    out = models.with_fallbacks(df, [bad, some], lambda p: p["tgt"] != "").collect()
    assert sorted((r.id, r.tgt, r.engine) for r in out) == [(1, "A", "some"), (2, "", "failed"), (3, "", "failed")]


def test_pipeline_and_artifacts(spark, data, tmp_path):
    tables = pipeline.run(spark, data)
    n = tables["segments"].count()
    assert n == tables["translations"].count() == tables["report"].count() == tables["glued"].count()
    seg = tables["translations"]
    doc = sinks.nested(seg, tables["groups"]).collect()
    assert sum(len(r.segments) for r in doc) == n and all([s.idx for s in r.segments] == list(range(len(r.segments))) for r in doc)
    states = sinks.openness(tables["states"], "user_id").collect()
    assert all(0 <= r.open_ratio <= 1 for r in states)
    md = [r.line for r in sinks.markdown(spark.createDataFrame([(2, "b"), (1, "a")], "n int, s string"), ["n", "s"], F.col("n")).collect()]
    assert md == ["| n | s |", "|---|---|", "| 1 | a |", "| 2 | b |"]
    for kind in ("json", "csv", "parquet"):
        sinks.write(tables["report"], str(tmp_path / kind), kind, "1")
    assert set(pipeline.run(spark, data, steps=("turns",))) == {"segments", "turns"}


def test_corrections_in_order_and_without_white_space(spark):
    rules = rewrite.merged_rules([("想遇个", "相遇"), ("", "x"), ("a.b", "$1")], [("想遇个", "相遇"), ("相 遇", "X")])
    assert rules == [("想遇个", "相遇"), ("a.b", "$1"), ("相 遇", "X")]
    cases = [("想遇个想 遇 个", "X想 遇 个"), ("想 遇\u3000个 想 遇个", "X 想 遇个"), ("a.b a. b", "$1 a. b"), ("a . b", "$1"), ("nothing", "nothing"), (None, None), ("", "")]
    got = [r[0] for r in spark.createDataFrame([(a,) for a, _ in cases], "t string").select(rewrite.corrected(F.col("t"), rules)).collect()]
    assert got == [b for _, b in cases]


def test_cleaning_and_budgets(spark):
    cases = [("I'm sorry. Translation: good", "good"), ("Sure!", ""), ('"quoted"', "quoted"), ("a ```x``` b", "a  b"), ("抱歉，翻译：好", "好")]
    got = [r[0] for r in spark.createDataFrame([(a,) for a, _ in cases], "t string").select(rewrite.cleaned(F.col("t"))).collect()]
    assert got == [b for _, b in cases]
    cut = [("Well, this is really the the big piano.", 5, "en", "this is the big"), ("你好世界，再见", 2, "zh", "你好"), ("こんにちは", 3, "ja", "こんに"), ("안녕하세요", 2, "ko", "안녕"), ("tout va bien", 2, "fr", "tout va"), ("OK", 1, "en", "OK")]
    df = spark.createDataFrame(cut, "t string, b int, l string, want string")
    for r in df.select("want", X.within_budget(F.col("t"), F.col("b"), F.col("l")).alias("got")).collect():
        assert r.got == r.want


def test_phrase_table_equals_all_pairs(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("天地人你我他好看") for _ in range(rng.randint(1, 26))) for _ in range(40)]
    texts = [w[rng.randint(0, 2) : len(w) - rng.randint(0, 2)] for w in words for _ in range(4)] + words + ["x" + w + "y" for w in words]
    table = list(dict.fromkeys(words))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r.id: r.dst for r in rewrite.phrase(df, ["id"], "text", spark.createDataFrame([(i, w, f"d{i}") for i, w in enumerate(table)], "ord int, src string, dst string")).collect()}
    for i, t in enumerate(texts):
        fit = [(p != t, -len(p), k) for k, p in enumerate(table) if t and (p == t or len(p) >= 4 and (p in t and len(p) >= 0.7 * len(t) or t in p and len(t) >= 0.7 * len(p)))]
        assert got.get(i) == (f"d{min(fit)[2]}" if fit else None)


def test_labels(spark):
    df = spark.createDataFrame([("Joy", ["anger/x", "b"], {"label": "Calm"}), (" |happy", [], {"x": "fear"}), (None, None, None), ("UNhappy", [None], {"emotion": "sad", "z": "q"})], "s string, l array<string>, m map<string,string>")
    got = [tuple(r) for r in df.select(*[labels.category(labels.coerced(F.col(c), df.schema[c].dataType)) for c in "slm"]).collect()]
    assert got == [("happy", "angry", "neutral"), ("neutral", "neutral", "fearful"), ("neutral", "neutral", "neutral"), ("happy", "neutral", "sad")]
    scores = spark.createDataFrame([({"happy": 0.4},), (None,)], "m map<string,double>").select(labels.all_scores(F.col("m")).alias("m"))
    got = [(len(r.m), r.m.get("happy"), r.i) for r in scores.select("m", labels.intensity(F.col("m")).alias("i")).collect()]
    assert got == [(7, 0.4, 0.5), (7, 0.0, 0.5)]


def test_phonemes(spark):
    cases = [("zhang1", "ang", "open", 0.75), ("hao3", "ao", "open", 0.75), ("AA1", None, "open", 0.8), ("EH0", "e", None, None), ("IY1", None, "closed", 0.25), ("b", None, "closed", 0.1), ("ə", None, "mid", 0.5), ("好", None, "mid", 0.5), ("æ", None, "open", 0.85), ("er2", None, "mid", 0.55), ("s", None, "mid", 0.4)]
    df = spark.createDataFrame([(c[0],) for c in cases], "p string")
    p = F.col("p")
    for r, (_, final, kind, value) in zip(df.select(phonemes.final(p), phonemes.openness(phonemes.described(p))).collect(), cases, strict=True):
        if kind:
            assert (r[0], r[1]["class"], r[1]["openness"]) == (final, kind, value)


def test_signals(spark):
    df = spark.createDataFrame([([0.5, -0.25], [1.0, 1.0, 9.0]), ([0.0, 0.0], [4.0]), ([], []), (None, [1.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    got = df.select(signal.normalised(a, 0.0), signal.mixed(a, b), signal.crossings(a), signal.duration(a, F.lit(4))).collect()
    assert [r[0] for r in got] == [[1.0, -0.5], [0.0, 0.0], [], None]
    assert [r[1] for r in got] == [[0.75, 0.375], [1.0], [], None]
    assert [r[2] for r in got] == [1.0, 0.0, None, None] and got[0][3] == 0.5
