"""Exact k-means over integer vectors by lookup tables.

Components become integers, floor(scale * x). In each round a task tabulates,
for each dimension, each integer that occurs in it and each centroid, the
squared difference; a vector's distances to all centroids are then gathers from
those tables and their sum, without a multiplication for any vector. Tables
hold only values that occur in the slice of vectors at hand, so they are bounded
by SLICE whatever the range of values, and centroids are taken BLOCK at a time.

Vectors are never shuffled. A task gives out the component sums of its clusters
(k rows), Spark adds them up, and only the k centroids pass the driver. All
sums are integers, so results don't depend on the order or the partitions.

Defined results: a vector with another number of components, or with a null or
non-finite one, is left out, and so is a null vector. Integers beyond 2^27 are
taken as that bound, so that all distances fit a long. Equal distances: the
smaller number of centroid; repeated rows are rows, and equal ids as starts are
ordered by their components; a null id hashes as the empty text. With fewer
vectors than centroids there are as many centroids as vectors; without any, no
rows. Texts are not read; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import cut, lean

#: Integers are cut off here: 64 squared differences of twice this fit a long.
BOUND = 1 << 27

#: Vectors of which the tables are made at once, and centroids of a table.
SLICE = 1 << 13
BLOCK = 64


def quantised(vectors: DataFrame, dims: int = 64, scale: float = 64.0) -> DataFrame:
    """vec_id and v (array of int) of the vectors of `dims` finite components."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    kept = vectors.where((F.size("embedding") == dims) & finite)
    one = lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(float(-BOUND))), F.lit(float(BOUND)))).cast("int")
    return kept.select("vec_id", F.transform("embedding", one).alias("v"))


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(-1, dims)


def _occurring(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values that occur, ascending, and the place of each value among them."""
    low, high = int(values.min()), int(values.max())
    if high - low <= 4 * len(values) + 1024:  # by counting instead of sorting
        there = np.bincount(values - low) > 0
        place = np.cumsum(there) - 1
        return np.flatnonzero(there) + low, place[values - low]
    return np.unique(values, return_inverse=True)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each vector; ties: the smaller number."""
    best = np.full(len(vectors), np.iinfo(np.int64).max)
    cluster = np.zeros(len(vectors), np.int64)
    occurring = [_occurring(vectors[:, d]) for d in range(vectors.shape[1])] if len(vectors) else []
    for at in range(0, len(centroids), BLOCK):
        some = centroids[at : at + BLOCK]
        total = np.zeros((len(vectors), len(some)), np.int64)
        for d, (values, places) in enumerate(occurring):
            table = (values[:, None] - some[None, :, d]) ** 2
            total += table[places]
        nearer = total.argmin(axis=1)
        distance = total[np.arange(len(vectors)), nearer]
        less = distance < best
        best[less], cluster[less] = distance[less], nearer[less] + at
    return cluster, best


def _assigned(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster, distance of each vector."""
    centres = np.asarray(centroids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                cluster, distance = nearest(_matrix(part.column("v"), centres.shape[1]), centres)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def _means(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: the floor of each cluster's component means; empty clusters stay."""
    centres = np.asarray(centroids, np.int64)
    k, dims = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in lean(batches):
            for at in range(0, batch.num_rows, SLICE):
                vectors = _matrix(batch.slice(at, SLICE).column("v"), dims)
                cluster, _ = nearest(vectors, centres)
                np.add.at(sums, cluster, vectors)
                counts += np.bincount(cluster, minlength=k)
        some = np.flatnonzero(counts)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * dims), pa.array(sums[some].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some]), lists], ["cluster", "n", "sums"])

    partial = rows.select("v").mapInArrow(run, "cluster int, n long, sums array<long>")
    added = partial.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[d].cast("decimal(38,0)")).alias(f"s{d}") for d in range(dims)])
    out = [list(c) for c in centroids]
    for r in added.collect():  # a row for each centroid
        out[r["cluster"]] = [int(r[f"s{d}"]) // r["n"] for d in range(dims)]
    return out


def starts(rows: DataFrame, k: int) -> list[list[int]]:
    """The k vectors with the smallest sha256 of `1:<vec_id>`, in that order."""
    key = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r["v"]) for r in rows.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()]


def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: float = 64.0) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector of vectors (vec_id, embedding); the centroids)."""
    rows = cut(quantised(vectors, dims, scale))
    centroids = starts(rows, k)
    for _ in range(rounds if centroids else 0):
        centroids = _means(rows, centroids)
    empty = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return rows.sparkSession.createDataFrame([], empty), []
    assigned = cut(_assigned(rows, centroids))
    by_cluster = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()  # a row for each centroid
    total = sum(int(r["d"]) for r in by_cluster)
    sums = {r["cluster"]: int(r["d"]) for r in by_cluster}
    named = [(i, sums.get(i, 0), total, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    top = (1 << 63) - 1
    table = rows.sparkSession.createDataFrame([(i, min(s, top), min(t, top), h) for i, s, t, h in named], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids
