"""All queries of this folder, with the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from segmenta.llm import bilingual, bpe, languages, lookalikes, packing, pairs, sentences, splitting, turns

MODULES = [bilingual, bpe, languages, lookalikes, packing, pairs, sentences, splitting, turns]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
