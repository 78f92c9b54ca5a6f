"""Cutting long segments at silences, or else at the quietest place near equal parts, until none is too long.

Each row brings the energy of its own frames, so a row stands alone: no shuffle. Times are milliseconds, a frame is ten.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

HOP_MS, SILENCE_MS, LEAST_MS, MOST_MS, NEAR_MS, SLACK = 10, 320, 450, 2_800, 250, 1.15


def silences(energy: np.ndarray, silence_ms: int, least_ms: int) -> list[float]:
    """Middles, in milliseconds from the start, of the silent stretches that are long enough and not near an edge."""
    n = len(energy)
    if n * HOP_MS < 2 * least_ms:
        return []
    silent = energy < max(float(np.percentile(energy, 20)) * 1.2, float(energy.max()) * 0.08)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], silent.astype(int), [0]])))
    out = [(a + b) / 2 * HOP_MS for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= max(1, silence_ms // HOP_MS)]
    return [t for t in out if least_ms <= t <= n * HOP_MS - least_ms]


def quietest(energy: np.ndarray, at_ms: float) -> float:
    """The frame with the least energy near a time."""
    a, b = int(max(0, at_ms - NEAR_MS) // HOP_MS), int(min(len(energy) * HOP_MS, at_ms + NEAR_MS) // HOP_MS)
    return (a + int(np.argmin(energy[a:b]))) * HOP_MS if b > a else at_ms


def cut(energy: np.ndarray, silence_ms: int = SILENCE_MS, least_ms: int = LEAST_MS, most_ms: int = MOST_MS) -> list[tuple[int, int]]:
    """Parts of a segment, in milliseconds from its start, in order and without gaps. Kept on a list instead of the stack,
    so no segment is too long. A part that no cut shortens stays as it is."""
    todo, done = [(0, len(energy) * HOP_MS)], []
    while todo:
        s, e = todo.pop()
        own, long = energy[s // HOP_MS : e // HOP_MS], e - s > most_ms
        places = silences(own, int(silence_ms * 0.7) if long else silence_ms, least_ms) if len(own) else []
        if long and not places:
            n = -(-(e - s) // most_ms)
            places = [quietest(own, k * (e - s) / n) for k in range(1, n)]
        places = sorted({int(p // HOP_MS * HOP_MS) for p in places if least_ms <= p <= e - s - least_ms})
        edges = [s, *(s + p for p in places if 0 < p < e - s), e]
        parts: list[tuple[int, int]] = []
        for a, b in zip(edges, edges[1:], strict=False):
            if parts and b - a < least_ms * 0.35:
                parts[-1] = (parts[-1][0], b)
            else:
                parts.append((a, b))
        if len(parts) == 1:
            done.append((s, e))
            continue
        done += [p for p in parts if p[1] - p[0] <= most_ms * SLACK]
        todo += [p for p in parts if p[1] - p[0] > most_ms * SLACK]
    return sorted(done)


def split_long(rows: DataFrame, key: str) -> DataFrame:
    """key, part, start_ms, end_ms of rows (key, start_ms, energy: array of double). A null or empty energy gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, s, e in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s is not None and e:
                    out += [(k, i, s + a, s + b) for i, (a, b) in enumerate(cut(np.nan_to_num(np.array([x or 0.0 for x in e], dtype=float))))]
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.schema.field(0).type, *[pa.int64()] * 3), strict=True)], names=["k", "part", "start_ms", "end_ms"])

    schema = f"k {rows.schema[key].dataType.simpleString()}, part bigint, start_ms bigint, end_ms bigint"
    return rows.select(key, rows["start_ms"].cast("bigint"), "energy").mapInArrow(run, schema).withColumnRenamed("k", key)
