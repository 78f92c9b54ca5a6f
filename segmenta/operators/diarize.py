"""Speaker labels of the segments of a recording: cluster, retry when speakers collapse, pick the best candidate.

A recording's embeddings are one group, as they are compared with each other; recordings are independent. Labels are
numbered by first appearance. No embeddings, or one segment, give one speaker.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from segmenta.operators.vectors import average_linkage, farthest_split, first_seen

APART, TIGHTEST, EXPECTED, MOST, TURN_GAP_MS = 0.40, 0.22, 2, 8, 350


def kmeans(v: np.ndarray, k: int, rounds: int = 20, seed: int = 42) -> list[int]:
    """Seeded k-means on unit vectors; the seeds of the best of ten starts."""
    if len(v) <= k:
        return list(range(len(v)))
    rng, best = np.random.default_rng(seed), (np.inf, np.zeros(len(v), int))
    for _ in range(10):
        c = v[rng.choice(len(v), k, replace=False)]
        for _ in range(rounds):
            near = (v @ c.T).argmax(axis=1)
            c = np.stack([v[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(k)])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-8)
        cost = float((1 - (v @ c.T).max(axis=1)).sum())
        if cost < best[0] - 1e-12:
            best = (cost, near)
    return first_seen(best[1].tolist())


def confidences(v: np.ndarray, labels: list[int]) -> list[float]:
    """Cosine of each vector with the nearest centroid of the labels."""
    c = np.stack([v[np.array(labels) == i].mean(axis=0) for i in sorted(set(labels))])
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-8)
    return (v @ c.T).max(axis=1).tolist()


def labelling_score(start: list[int], end: list[int], labels: list[int], expected: int = EXPECTED) -> float:
    """Near the expected number of speakers, switching between them, also after pauses, and balanced."""
    n = len(set(labels))
    steps = list(itertools.pairwise(range(len(labels))))
    switches = sum(labels[a] != labels[b] for a, b in steps)
    same = sum(labels[a] == labels[b] and start[b] - end[a] >= TURN_GAP_MS for a, b in steps)
    sizes = [labels.count(x) for x in set(labels)]
    score = 3.0 if n == expected else 1.5 if n > 1 else -2.0
    score -= 0.5 * (n - expected) if n > expected + 1 else 0.0
    return score + min(0.25 * switches, 1.5) - 0.4 * same + min(sizes) / max(sizes)


def alternating(start: list[int], end: list[int], first: int = 0) -> list[int]:
    """Turns by pauses, two speakers in turn; four segments or more without a pause are a turn each."""
    turn = np.cumsum([0, *(start[b] - end[a] >= TURN_GAP_MS for a, b in itertools.pairwise(range(len(start))))]).tolist()
    if len(start) >= 4 and turn[-1] == 0:
        turn = list(range(len(start)))
    return [(first + t) % 2 for t in turn]


def label(start: list[int], end: list[int], v: np.ndarray, expected: int = EXPECTED) -> tuple[list[int], bool]:
    """The best of the candidates, and whether a retry was needed. The first of equal scores wins."""
    if len(v) < 2:
        return [0] * len(v), False
    found = [average_linkage(v, APART, MOST)]
    retry = len(set(found[0])) < expected
    if retry:
        for apart in (max(TIGHTEST, APART / 2), TIGHTEST):
            found.append(average_linkage(v, apart, MOST))
        found += [farthest_split(v, expected), kmeans(v, min(max(expected, 2), len(v))), first_seen(alternating(start, end))]
    scores = [labelling_score(start, end, x, expected) for x in found]
    return found[int(np.argmax(scores))], retry


def diarize(rows: DataFrame, expected: int = EXPECTED) -> DataFrame:
    """rec_id, idx, speaker, label_confidence, retried of segments (rec_id, idx, start_ms, end_ms, embedding)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        e = table.column("embedding").to_pylist()
        least = min((len(x) for x in e if x), default=1)
        v = np.array([(x or [0.0] * least)[:least] for x in e], dtype=np.float64)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-8)
        labels, retried = label(table.column("start_ms").to_pylist(), table.column("end_ms").to_pylist(), v, expected)
        out = table.select(["rec_id", "idx"]).append_column("speaker", pa.array([f"SPEAKER_{x:02d}" for x in labels]))
        return out.append_column("label_confidence", pa.array(confidences(v, labels), pa.float64())).append_column("retried", pa.array([retried] * len(labels)))

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("rec_id", "idx"))
    used = rows.where("rec_id is not null").select("rec_id", "idx", "start_ms", "end_ms", "embedding")
    return used.groupBy("rec_id").applyInArrow(run, f"{kinds}, speaker string, label_confidence double, retried boolean")
