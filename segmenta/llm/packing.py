"""Filling containers of fixed capacity, and the queries of problem 9.

First-fit decreasing in randomised groups: a row's group is a hash of its id and its place in the scan, so groups are even
and independent however often an id or a null repeats, and the number of groups follows the number of rows so that a
group's size is bounded. In a group a tournament tree over
the bins' free space finds the first bin that an item fits. A text larger than the capacity is first cut by the
splitting operator, without overlap.

Defined results: null and empty texts have size 0 and share a container; every row gets a container; the containers of
different groups are different. Documents without an id spread over all groups like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmenta.llm.bpe import TOKENIZER, chunks, encoder
from segmenta.llm.splitting import split_text

CAPACITY = 4_096
#: Rows of a group on average, and the container numbers that a group may use.
GROUP_ROWS, GROUP_NUMBERS = 20_000, 1 << 32


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item. Larger items first, in the given order among equals, each into the first bin with room."""
    width = 1
    while width < max(1, len(sizes)):
        width *= 2
    tree = [capacity] * (2 * width)
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at, s = 1, sizes[i]
        while at < width:
            at *= 2
            if tree[at] < s:
                at += 1
        out[i] = at - width
        tree[at] -= s
        while at > 1:
            at //= 2
            best = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == best:
                break
            tree[at] = best
    return out


def items(df: DataFrame, key: str, text: str, capacity: int = CAPACITY, path: str = TOKENIZER) -> DataFrame:
    """key, piece_no, n_tokens of each text, or of its pieces if it is larger than the capacity. No shuffle."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            keys, marks, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for a, b in chunks(texts):
                rows = []
                for k, h, t, n in zip(keys[a:b], marks[a:b], texts[a:b], enc.counts(texts[a:b]), strict=True):
                    rows += [(k, h, 0, n)] if n <= capacity else [(k, h, i, p[2]) for i, p in enumerate(split_text(t, enc, capacity, 0))]
                kinds = (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows, strict=True), kinds, strict=True)], names=["k", "h", "piece_no", "n_tokens"])

    # copies of an id, or rows without one, may be a third of all: their place tells them apart
    mark = F.xxhash64(key, F.monotonically_increasing_id())
    rows = df.select(F.col(key).alias("k"), mark.alias("h"), text)
    return rows.mapInArrow(measure, f"k {df.schema[key].dataType.simpleString()}, h bigint, piece_no bigint, n_tokens bigint")


def pack(df: DataFrame, key: str, text: str, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, path: str = TOKENIZER) -> DataFrame:
    """key, piece_no, n_tokens, container. One shuffle, of a few numbers per item. Counting the rows, for the number of
    groups, reads only the files' footers."""
    groups = max(1, -(-df.count() // group_rows))

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["h", "piece_no"], kind="stable")
        bins = first_fit_decreasing(rows["n_tokens"].tolist(), capacity)
        return rows.assign(container=[int(rows["g"].iloc[0]) * GROUP_NUMBERS + b for b in bins])[["k", "piece_no", "n_tokens", "container"]]

    grouped = items(df, key, text, capacity, path).withColumn("g", F.pmod(F.xxhash64("h", F.lit("group")), F.lit(groups)))
    schema = f"k {df.schema[key].dataType.simpleString()}, piece_no bigint, n_tokens bigint, container bigint"
    return grouped.groupBy("g").applyInPandas(fill, schema).withColumnRenamed("k", key)


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: how many documents and containers there are, how many containers are too full, and whether every document
    has a place. How full they are on average is in `p9_containers`."""
    rows = p9_containers(spark, sf_dir)
    load = rows.groupBy("container").agg(F.sum("n_tokens").alias("load"))
    full = load.agg(F.count_if(F.col("load") > CAPACITY).alias("too_full"), (F.count(F.lit(1)) * CAPACITY >= F.sum("load")).alias("holds_all"))
    return rows.groupBy(F.lit(1).alias("_k")).agg(F.countDistinct("doc_id").alias("documents"), F.count_if(F.col("n_tokens") > CAPACITY).alias("too_large")).join(full.withColumn("_k", F.lit(1)), "_k").drop("_k")


QUERIES = {"p9_containers": p9_containers, "p9_fill": p9_fill}
#: What must hold of any packing.
SQL = {"p9_fill": "SELECT count(DISTINCT doc_id) AS documents, 0::BIGINT AS too_large, 0::BIGINT AS too_full, CASE WHEN count(*) > 0 THEN true END AS holds_all FROM documents"}
