"""An inverted-file index of vectors: k-means cells, probed by question, scored exactly within.

build() fits the cells by distributed k-means (cosine) on a sample of at most
`per_cell` vectors a cell, puts every vector into its nearest cell, and writes
a table that is partitioned by cell. It then measures, against brute force for
a sample of stored vectors, in how many of a question's nearest cells one must
look for the wanted recall: few where vectors form clusters, about half of all
where they don't. search() reads the files of those cells (`probes` overrides
their number), and an equi-join on the cell brings questions and vectors
together; scores of what it finds are exact, and search_exact() looks into all cells. add() puts further vectors into
the cells as they are; build again when they have outgrown the sample.

Tables are sorted by cell and a hash over all tasks, so that a hot cell (equal
vectors, for instance) is split among tasks and files.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import nearest
from .shared import written


@dataclass(frozen=True)
class VectorIndex:
    """A written index: its vectors (chunk_id, vector, other columns, cell), the cells' centroids, a row each, and how many cells to look into."""

    path: str
    vectors: DataFrame
    centroids: np.ndarray
    probes: int


def _lengths(vectors: DataFrame) -> int:
    found = vectors.where("vector IS NOT NULL").select(F.size("vector").alias("d")).first()
    return found["d"] if found else 0


def _in_cells(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vectors with their nearest cell (the smaller number of equally near ones); zero vectors are in cell 0."""
    centres = nearest.unit(centroids)

    @F.pandas_udf("int")
    def cell(column: pd.Series) -> pd.Series:
        out = np.zeros(len(column), np.int32)
        step = max(1, nearest.SCORES // len(centres))
        for at in range(0, len(column), step):
            some = np.stack(column.iloc[at : at + step].to_numpy()).astype(np.float64)
            out[at : at + step] = np.round(some @ centres.T, 12).argmax(axis=1)
        return pd.Series(out)

    return vectors.where(F.size("vector") == centres.shape[1]).withColumn("cell", cell("vector"))


def _write(rows: DataFrame, path: str, mode: str) -> None:
    rows.repartitionByRange("cell", F.xxhash64("chunk_id")).sortWithinPartitions("cell").write.partitionBy("cell").mode(mode).parquet(f"{path}/vectors")


def build(vectors: DataFrame, path: str, cells: int | None = None, per_cell: int = 256, rounds: int = 10, seed: int = 1, wanted: float = 0.95, k: int = 10, asked: int = 256) -> VectorIndex:
    """Index vectors (chunk_id, vector, further columns to filter by) under path.

    cells: by default the square root of the number of vectors. wanted: the
    recall at k that `asked` stored vectors (a sample by hash) must reach.
    Vectors of another length than the first, and null ones, are left out.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    dims = _lengths(vectors)
    fit = vectors.where(F.size("vector") == dims)
    n = fit.count()
    if not n:
        raise ValueError("no vectors to index")
    cells = min(n, cells or int(np.ceil(np.sqrt(n))))
    long = F.exists("vector", lambda x: x != 0)  # k-means by cosine takes no zero vectors
    sample = fit.where(long & (F.pmod(F.xxhash64("chunk_id", F.lit(seed)), F.lit(n)) < per_cell * cells))
    features = written(sample.select(array_to_vector(F.transform("vector", lambda x: x.cast("double"))).alias("features")))
    if features.isEmpty():
        centroids = np.zeros((1, dims))
    else:
        model = KMeans(k=cells, distanceMeasure="cosine", maxIter=rounds, seed=seed).fit(features)
        centroids = np.stack(model.clusterCenters())
    _write(_in_cells(fit, centroids), path, "error")
    spark = vectors.sparkSession
    stored = VectorIndex(path, spark.read.parquet(f"{path}/vectors"), centroids, len(centroids))
    some = stored.vectors.where(F.pmod(F.xxhash64("chunk_id", F.lit(seed + 1)), F.lit(n)) < asked)
    probes = _needed(stored, some.select(F.col("chunk_id").alias("qid"), F.col("vector").alias("question_vector")), k, wanted)
    spark.createDataFrame([(i, c.tolist(), probes) for i, c in enumerate(centroids)], "cell int, centroid array<double>, probes int").write.parquet(f"{path}/centroids")
    return load(spark, path)


def _needed(index: VectorIndex, questions: DataFrame, k: int, wanted: float) -> int:
    """In how many nearest cells lie the wanted share of the questions' k nearest vectors."""
    exact = search_exact(index, questions, k).join(index.vectors.select("chunk_id", "cell"), "chunk_id")
    places = exact.join(probed(index, questions, len(index.centroids)), ["qid", "cell"]).groupBy("place").agg(F.count("*").alias("n")).orderBy("place").collect()  # a row for each place
    total, seen = sum(r["n"] for r in places), 0
    for r in places:
        seen += r["n"]
        if seen >= wanted * total:
            return r["place"] + 1
    return len(index.centroids)


def load(spark: SparkSession, path: str) -> VectorIndex:
    found = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # a row for each cell
    return VectorIndex(path, spark.read.parquet(f"{path}/vectors"), np.array([r["centroid"] for r in found]), found[0]["probes"])


def add(index: VectorIndex, vectors: DataFrame) -> VectorIndex:
    """The index with further vectors (same columns), in the cells it has."""
    _write(_in_cells(vectors, index.centroids), index.path, "append")
    return load(vectors.sparkSession, index.path)


def probed(index: VectorIndex, questions: DataFrame, probes: int) -> DataFrame:
    """qid, place (from 0), cell of the `probes` cells nearest to each question."""
    centres = nearest.unit(index.centroids)
    probes = min(probes, len(centres))

    @F.pandas_udf("array<int>")
    def near(column: pd.Series) -> pd.Series:
        out = []
        step = max(1, nearest.SCORES // len(centres))
        for at in range(0, len(column), step):
            scores = np.stack(column.iloc[at : at + step].to_numpy()).astype(np.float64) @ centres.T
            out += np.argsort(-np.round(scores, 12), axis=1, kind="stable")[:, :probes].astype(np.int32).tolist()
        return pd.Series(out)

    asked = questions.where(F.size("question_vector") == centres.shape[1])
    return asked.select("qid", F.posexplode(near("question_vector")).alias("place", "cell"))


def search(index: VectorIndex, questions: DataFrame, k: int = 10, probes: int | None = None, filters: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """qid, chunk_id, dense_score, rank of the k nearest vectors in a question's `probes` cells (default: the index's number).

    filters: columns of the index and the questions (qid, question_vector); a
    question with a value takes only vectors with that value, one without takes
    all. A narrow filter leaves fewer vectors in the same cells, so raise probes
    with it, or use search_exact().
    """
    cells = written(probed(index, questions, probes or index.probes).select("qid", "cell"))
    some = [r["cell"] for r in cells.select("cell").distinct().collect()]  # as many as there are cells, at most
    return nearest.best(index.vectors.where(F.col("cell").isin(some)), questions, k, digits, filters, cells)


def search_exact(index: VectorIndex, questions: DataFrame, k: int = 10, filters: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """search() in all cells."""
    return nearest.best(index.vectors, questions, k, digits, filters)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact rows (qid, chunk_id) that were found."""
    n = exact.count()
    return exact.join(found, ["qid", "chunk_id"], "left_semi").count() / n if n else 1.0
