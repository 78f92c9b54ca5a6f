"""Vectors: norms, centroids, nearest centroids, small clusterings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of centroids that are sent to the tasks at once.
BLOCK_BYTES = 32 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def by_dimension(rows: DataFrame, keep: list[str], vector: str) -> DataFrame:
    return rows.select(*keep, F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def means(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """label and centroid (array): means by dimension, by a partial aggregate."""
    per = by_dimension(rows, [label], vector).groupBy(label, "dim").agg(F.avg("x").alias("m"))
    return per.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("centroid"))


def nearest(rows: DataFrame, key: str, vector: str, centroids: DataFrame, label: str, most: int = 1, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """key, label, sim, place of the `most` nearest centroids of each vector by cosine (equal to nine places: the least label
    first). Batches of vectors are multiplied with blocks of centroids, of block_bytes at most, and only the nearest leave
    the batch; with several blocks the nearest of each meet in one aggregate. Null elements count as 0; vectors that are
    null or of another length than the centroids get no row; labels are whole numbers or strings."""
    kinds = {f.name: f.dataType.simpleString() for f in (*rows.schema.fields, *centroids.schema.fields)}
    arrow = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[kinds[label]]
    schema = f"k {kinds[key]}, row bigint, l {kinds[label]}, sim double, place bigint"
    size = centroids.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("centroid")).alias("d")).first()
    per = max(1, block_bytes // (8 * max(1, size.d or 1)))
    blocks = max(1, -(-size.n // per))
    usable = rows.where(F.col(vector).isNotNull() & (F.size(vector) == F.lit(size.d or 0))).select(key, vector, F.monotonically_increasing_id().alias("row"))

    def against(part: list) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        part.sort(key=lambda r: r[label])
        names = pa.array([r[label] for r in part], arrow)
        c = np.array([r["centroid"] for r in part], dtype=np.float64)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-8)

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    v = np.nan_to_num(np.array([[np.nan if x is None else x for x in r] for r in batch.column(1).to_pylist()], dtype=np.float64))
                    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-8)
                    s = v @ c.T
                    best = np.argsort(-np.round(s, 9), axis=1, kind="stable")[:, :most]
                    of = pa.array(np.repeat(np.arange(len(v)), best.shape[1]))
                    place = pa.array(np.tile(np.arange(1, best.shape[1] + 1), len(v)), pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(2).take(of), names.take(pa.array(best.ravel())), pa.array(np.take_along_axis(s, best, axis=1).ravel()), place], names=["k", "row", "l", "sim", "place"])

        return multiply

    found = None
    for b in range(blocks if size.n else 0):
        block = centroids if blocks == 1 else centroids.where(F.pmod(F.xxhash64(label), F.lit(blocks)) == b)
        part = block.select(label, "centroid").collect()
        if part:
            got = usable.mapInArrow(against(part), schema)
            found = got if found is None else found.unionByName(got)
    if found is None:
        found = rows.sparkSession.createDataFrame([], schema)
    named = [F.col("k").alias(key), F.col("l").alias(label), "sim", "place"]
    if blocks <= 1:
        return found.select(*named)
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.round("sim", 9)).alias("r"), "l", "sim"))), 1, most)
    best = F.transform(best, lambda x, i: F.struct(x["l"].alias("l"), x["sim"].alias("sim"), (i + 1).cast("bigint").alias("place")))
    return found.groupBy("k", "row").agg(best.alias("_x")).select("k", F.inline("_x")).select(*named)


def per_group(rows: DataFrame, keys: list[str], key: str, vector: str, cluster: Callable[[np.ndarray], list[int]]) -> DataFrame:
    """keys, key, cluster: a clustering of each small group (the segments of one recording) by itself.
    Vectors are cut to the shortest of their group; null ones are left out, null elements count as 0."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(key)
        rows = table.column(vector).to_pylist()
        least = min(map(len, rows))
        v = np.array([[np.nan if x is None else x for x in r[:least]] for r in rows], dtype=np.float64)
        v = np.nan_to_num(v)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-8)
        return table.select([*keys, key]).append_column("cluster", pa.array(cluster(v), pa.int64()))

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (*keys, key)) + ", cluster bigint"
    return rows.where(F.col(vector).isNotNull()).select(*keys, key, vector).groupBy(*keys).applyInArrow(run, schema)


def first_seen(labels: list[int]) -> list[int]:
    """Labels numbered by their first appearance."""
    seen: dict[int, int] = {}
    return [seen.setdefault(x, len(seen)) for x in labels]


def greedy(v: np.ndarray, apart: float = 0.4, most: int = 8) -> list[int]:
    """One pass: a vector joins the nearest centroid within `apart`, or opens a cluster until there are `most`."""
    sums: list[np.ndarray] = []
    out = []
    for x in v:
        near = [float(x @ s / max(np.linalg.norm(s), 1e-8)) for s in sums]
        best = int(np.argmax(near)) if near else -1
        if best >= 0 and (near[best] >= 1 - apart or len(sums) >= most):
            sums[best] = sums[best] + x
        else:
            best = len(sums)
            sums.append(x.copy())
        out.append(best)
    return first_seen(out)


def average_linkage(v: np.ndarray, apart: float = 0.4, most: int = 8) -> list[int]:
    """Clusters merge by the least mean cosine distance while it is within `apart` or there are more than `most`.

    The mean cosine of two clusters of unit vectors is the product of their sums over that of their sizes, so no table of
    distances is needed: memory grows with the vectors alone. Chains of nearest neighbours find the merges, in time that
    grows with the square of the group; mean distances never fall along a chain, so merges in order of distance are those
    that a search for the least distance would make."""
    n = len(v)
    total, size, alive = v.astype(np.float64, copy=True), np.ones(n), np.ones(n, dtype=bool)
    merges: list[tuple[float, int, int]] = []
    chain: list[int] = []
    while len(merges) < n - 1:
        if not chain:
            chain.append(int(np.argmax(alive)))
        a = chain[-1]
        near = np.where(alive, total @ total[a] / (size * size[a]), -np.inf)
        near[a] = -np.inf
        b = int(np.argmax(near))
        if len(chain) > 1 and near[chain[-2]] >= near[b] - 1e-12:
            b = chain[-2]
            chain = chain[:-2]
            low, high = min(a, b), max(a, b)
            merges.append((1.0 - float(near[b]), low, high))
            total[low] += total[high]
            size[low] += size[high]
            alive[high] = False
        else:
            chain.append(b)
    owner = list(range(n))

    def root(i: int) -> int:
        while owner[i] != i:
            owner[i] = owner[owner[i]]
            i = owner[i]
        return i

    left = n
    for distance, a, b in sorted(merges, key=lambda m: m[0]):
        if distance > apart and left <= most:
            break
        x, y = sorted((root(a), root(b)))
        owner[y] = x
        left -= 1
    return first_seen([root(i) for i in range(n)])


def farthest_split(v: np.ndarray, k: int = 2) -> list[int]:
    """k seeds, each the farthest from those before, and every vector to its nearest seed."""
    if not len(v):
        return []
    seeds = [0]
    while len(seeds) < min(k, len(v)):
        seeds.append(int(np.argmin((v @ v[seeds].T).max(axis=1))))
    return first_seen((v @ v[seeds].T).argmax(axis=1).tolist())
