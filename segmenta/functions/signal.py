"""Arithmetic on arrays of samples. Null and empty arrays stay as they are or give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _peak(samples: Column) -> Column:
    return F.array_max(F.transform(samples, lambda x: F.abs(x)))


def normalised(samples: Column, db: float = -3.0) -> Column:
    """Samples whose greatest amount lies at so many decibels under full scale; silence stays."""
    return F.when(_peak(samples) > 0, F.transform(samples, lambda x: x / _peak(samples) * 10.0 ** (db / 20))).otherwise(samples)


def mixed(a: Column, b: Column, weight_a: float = 0.5, weight_b: float = 0.5) -> Column:
    """Two signals as one, as long as the shorter, scaled down where it would exceed full scale."""
    n = F.least(F.size(a), F.size(b))
    sum_ = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: weight_a * x + weight_b * y)
    top = F.greatest(F.coalesce(_peak(sum_), F.lit(0.0)), F.lit(1.0))
    return F.transform(sum_, lambda x: x / top)


def duration(samples: Column, rate: Column) -> Column:
    return F.size(samples) / rate


def crossings(samples: Column) -> Column:
    """Share of neighbours of different sign (zero counts as positive); null for fewer than two."""
    n = F.size(samples) - 1
    flips = F.zip_with(F.slice(samples, 1, F.greatest(n, F.lit(0))), F.slice(samples, 2, F.greatest(n, F.lit(0))), lambda x, y: ((x < 0) != (y < 0)).cast("int"))
    return F.when(n > 0, F.aggregate(flips, F.lit(0), lambda s, x: s + x) / n)
