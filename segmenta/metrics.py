"""Time taken by each stage of a run, as rows."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Stages:
    """Runs stages and keeps their seconds; `table` gives them with each one's share."""

    def __init__(self, clock: Callable[[], float] = time.perf_counter):
        self.clock, self.rows = clock, []

    def run(self, name: str, stage: Callable[[], object]) -> object:
        began = self.clock()
        try:
            return stage()
        finally:
            self.rows.append((name, self.clock() - began))

    def table(self, spark: SparkSession) -> DataFrame:
        whole = sum(s for _, s in self.rows) or 1.0
        return spark.createDataFrame([(i, n, s, s / whole) for i, (n, s) in enumerate(self.rows)], "at int, stage string, seconds double, share double")
