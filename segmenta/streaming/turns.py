"""Streaming twins, an extension: the batch operators are the ones that hold.

`talk_per_window` counts speech in tumbling windows with a watermark; `turn_stream` closes a turn of a recording when its
speaker changes or a pause passes, keeping only the open turn as state.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TURN = "rec_id string, speaker string, start_ms bigint, end_ms bigint, n_segments bigint"


def talk_per_window(rows: DataFrame, at: str = "ingested_at", late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Segments and milliseconds of speech by recording and window of arrival; rows later than `late` are dropped."""
    rows = rows.withWatermark(at, late).groupBy("rec_id", F.window(at, window).alias("w"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("talk_ms")).select("rec_id", "w.start", "w.end", "n", "talk_ms")


def turn_stream(rows: DataFrame, gap_ms: int = 350, silent_ms: int = 1_800_000) -> DataFrame:
    """Closed turns of a stream of segments (rec_id, start_ms, end_ms, speaker) that come in order per recording. A recording
    of which nothing has come for `silent_ms` is over: its last turn is closed and its state is dropped."""

    def close(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_turn = list(state.get) if state.exists else None
        done = []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], *open_turn)] if open_turn else [], columns=["rec_id", "speaker", "start_ms", "end_ms", "n_segments"])
            return
        for part in parts:
            for s in part.sort_values(["start_ms", "end_ms"]).itertuples():
                if open_turn and open_turn[0] == s.speaker and s.start_ms - open_turn[2] < gap_ms:
                    open_turn = [open_turn[0], open_turn[1], max(open_turn[2], s.end_ms), open_turn[3] + 1]
                else:
                    if open_turn:
                        done.append((key[0], *open_turn))
                    open_turn = [s.speaker, s.start_ms, s.end_ms, 1]
        if open_turn:
            state.update(tuple(open_turn))
            state.setTimeoutDuration(silent_ms)
        yield pd.DataFrame(done, columns=["rec_id", "speaker", "start_ms", "end_ms", "n_segments"])

    return rows.groupBy("rec_id").applyInPandasWithState(close, TURN, "speaker string, start_ms bigint, end_ms bigint, n bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)
