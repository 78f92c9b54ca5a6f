"""Speaker labelling, splitting of long segments, stage times."""

import numpy as np

from segmenta.metrics import Stages
from segmenta.operators import diarize as D
from segmenta.operators.long_segments import cut, split_long


def _voices(labels, spread, seed=0):
    rng = np.random.default_rng(seed)
    base = np.eye(8)
    v = np.array([base[x] + rng.normal(0, spread, 8) for x in labels])
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_kmeans_and_confidence():
    v = _voices([0, 1, 1, 0, 2], 0.05)
    assert D.kmeans(v, 3) == [0, 1, 1, 0, 2] == D.kmeans(v, 3)
    assert min(D.confidences(v, [0, 1, 1, 0, 2])) > 0.9
    assert D.kmeans(v[:1], 2) == [0]


def test_collapsed_speakers_are_told_apart_on_retry():
    n = np.array([0, 1, 0, 1, 0, 1])
    v = np.ones((6, 8)) + 0.25 * _voices(n, 0.01)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    start = list(range(0, 6000, 1000))
    labels, retried = D.label(start, [s + 900 for s in start], v)
    assert retried and labels == n.tolist()
    assert D.label([0], [1], v[:1]) == ([0], False)


def test_score_prefers_two_balanced_speakers():
    start, end = [0, 1000, 2000, 3000], [600, 1600, 2600, 3600]
    score = lambda x: D.labelling_score(start, end, x)
    assert score([0, 1, 0, 1]) > score([0, 0, 1, 1]) > score([0, 0, 0, 0])
    assert D.alternating([0, 100, 200, 300], [90, 190, 290, 390]) == [0, 1, 0, 1]


def test_diarize_by_recording(spark):
    rows = []
    for rec in ("a", "b"):
        for i, x in enumerate(_voices([0, 1, 0, 1], 0.05, seed=len(rec)).tolist()):
            rows.append((rec, i, i * 1000, i * 1000 + 800, x))
    rows += [("c", 0, 0, 1, None), (None, 0, 0, 1, None)]
    got = D.diarize(spark.createDataFrame(rows, "rec_id string, idx bigint, start_ms bigint, end_ms bigint, embedding array<double>")).collect()
    assert {(r.rec_id, r.idx): r.speaker for r in got} == {(k, i): f"SPEAKER_0{i % 2}" for k in "ab" for i in range(4)} | {("c", 0): "SPEAKER_00"}


def test_parts_cover_the_segment_and_are_short(spark):
    rng = np.random.default_rng(3)
    for n in (3, 80, 400, 3000):
        energy = rng.random(n) + 1
        parts = cut(energy)
        assert parts[0][0] == 0 and parts[-1][1] == n * 10 and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
        assert all(b - a <= 2800 * 1.15 for a, b in parts)
    silent = np.concatenate([np.ones(150), np.zeros(50), np.ones(150)])
    assert cut(silent) == [(0, 1750), (1750, 3500)]
    df = spark.createDataFrame([(1, 100, silent.tolist()), (2, 0, None), (3, 0, [])], "id int, start_ms bigint, energy array<double>")
    assert [tuple(r) for r in split_long(df, "id").collect()] == [(1, 0, 100, 1850), (1, 1, 1850, 3600)]


def test_stage_times(spark):
    ticks = iter([0.0, 1.0, 1.0, 4.0])
    stages = Stages(lambda: next(ticks))
    assert stages.run("a", lambda: 7) == 7
    stages.run("b", lambda: None)
    assert [(r.stage, r.seconds, r.share) for r in stages.table(spark).orderBy("at").collect()] == [("a", 1.0, 0.25), ("b", 3.0, 0.75)]
