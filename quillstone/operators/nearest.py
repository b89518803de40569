"""Best rows of each question by cosine similarity, scored where the rows are.

Rows stream past the questions' matrix a batch at a time; a task keeps the k
best of each question and gives out those alone, so pairs are neither shuffled
nor sorted. Questions are a stated set: they go to the tasks in blocks of at
most BLOCK_BYTES, and more blocks mean more passes over the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of question vectors that go to the tasks at once.
BLOCK_BYTES = 64 << 20

#: Scores that are held at once.
SCORES = 1 << 22


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay."""
    size = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, size, out=np.zeros_like(matrix), where=size > 0)


def matrix_of(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _ranked(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best, ties by id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids = scores[scores >= least], ids[scores >= least]
    by_id = np.argsort(ids, kind="stable")
    order = by_id[np.argsort(-scores[by_id], kind="stable")][:k]
    return scores[order], ids[order]


class _Best:
    """The k best rows so far of each question."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = _ranked(scores, ids, self.k)
        if q in self.held:
            scores, ids = _ranked(np.concatenate([self.held[q][0], scores]), np.concatenate([self.held[q][1], ids]), self.k)
        self.held[q] = scores, ids


def _fits(rows: pa.RecordBatch, asked: pd.DataFrame, which: np.ndarray, filters: Sequence[str]) -> np.ndarray | None:
    """Which rows fit which questions by optional equality; None: all."""
    out = None
    for name in filters:
        want = asked[name].iloc[which]
        if want.isna().all():
            continue
        codes, _ = pd.factorize(pd.concat([pd.Series(rows.column(name).to_pandas()), want], ignore_index=True))
        fit = (codes[: rows.num_rows, None] == codes[None, rows.num_rows :]) | want.isna().to_numpy()[None, :]
        out = fit if out is None else out & fit
    return out


def filled(cells: DataFrame, key: str, name: str, dims: int) -> DataFrame:
    """(key, name): whole vectors of cells (key, bucket, weight), a row each."""
    kind = cells.schema[key].dataType.simpleString()
    gathered = cells.groupBy(key).agg(F.collect_list("bucket").alias("at"), F.collect_list("weight").alias("w"))  # at most dims of each

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1 << 10):
                part = batch.slice(first, 1 << 10)
                at, w = part.column("at"), part.column("w")
                sizes = np.diff(np.asarray(at.offsets))
                out = np.zeros((part.num_rows, dims))
                out[np.repeat(np.arange(part.num_rows), sizes), at.flatten().to_numpy()] = w.flatten().to_numpy()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * dims), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(key), lists], [key, name])

    return gathered.mapInArrow(fill, f"{key} {kind}, {name} array<double>")


def _fitting(vector: Column, dims: int) -> Column:
    """The vector, or zeros for one that is null, of another length or has null components."""
    fits = (F.size(vector) == dims) & ~F.exists(vector, lambda x: x.isNull())
    return F.when(fits, vector).otherwise(F.array_repeat(F.lit(0.0), dims))


def best(rows: DataFrame, questions: DataFrame, k: int, digits: int = 6, filters: Sequence[str] = (), cells: DataFrame | None = None, all_rows: bool = False) -> DataFrame:
    """qid, chunk_id, dense_score, rank of the k rows (chunk_id, vector) nearest to each question (qid, question_vector).

    filters: columns of both; a question takes rows with its own value, or all
    if it has none. cells: (qid, cell) of the cells in which a question looks;
    rows then have a cell. Scores are cosines cut off to [0, 1]; ties are
    ordered by chunk_id. Vectors of another length than the questions' and null
    ones are left out; with all_rows they, and those with null components, score
    0 as zero vectors do, and scores that are no number count as 1, as in SQL.
    """
    asked = questions.select("qid", "question_vector", *filters)
    first = asked.where("question_vector IS NOT NULL").select(F.size("question_vector").alias("d")).first()
    if all_rows and first is None and not asked.isEmpty():
        first = {"d": 1}  # no question has a vector: all score 0
    kind, qkind = rows.schema["chunk_id"].dataType.simpleString(), questions.schema["qid"].dataType.simpleString()
    if first is None:
        return rows.sparkSession.createDataFrame([], f"qid {qkind}, chunk_id {kind}, dense_score double, rank int")
    dims = first["d"]
    if all_rows:
        asked, rows = (df.withColumn(c, _fitting(F.col(c), dims)) for df, c in ((asked, "question_vector"), (rows, "vector")))
    asked = asked.where(F.size("question_vector") == dims)
    blocks = max(1, -(-asked.count() * dims * 8 // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("qid"), F.lit(blocks))
    parts = [_passed(rows, asked.where(block == i), k, digits, filters, dims, cells, all_rows) for i in range(blocks)]
    w = Window.partitionBy("qid").orderBy(F.col("dense_score").desc(), "chunk_id")
    found = reduce(DataFrame.unionByName, parts)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _passed(rows: DataFrame, block: DataFrame, k: int, digits: int, filters: Sequence[str], dims: int, cells: DataFrame | None, all_rows: bool = False) -> DataFrame:
    asked = block.toPandas()  # at most BLOCK_BYTES of vectors
    kind, qkind = rows.schema["chunk_id"].dataType.simpleString(), block.schema["qid"].dataType.simpleString()
    schema = f"q int, chunk_id {kind}, dense_score double"
    if len(asked):
        matrix = unit(np.stack(asked["question_vector"].to_numpy()).astype(np.float64))
        asked = asked.drop(columns="question_vector")
    else:
        matrix = np.zeros((0, dims))
    numbers = rows.sparkSession.createDataFrame([(i, q) for i, q in enumerate(asked["qid"].tolist())], f"q int, qid {qkind}")
    names = ["chunk_id", "vector", *filters]
    rows = rows.where(F.size("vector") == dims)
    if cells is not None:
        # an equi-join on the cell, which also prunes a table that is partitioned by cells; a row for each cell
        by_cell = cells.join(F.broadcast(numbers), "qid").groupBy("cell").agg(F.array_sort(F.collect_list("q")).alias("asked"))
        rows = rows.join(F.broadcast(by_cell), "cell").select(*names, "cell", "asked")
    else:
        rows = rows.select(*names)

    rows_kind, celled = to_arrow_type(rows.schema["chunk_id"].dataType), cells is not None

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _Best(k)
        everyone = np.arange(len(matrix))
        for batch in batches:
            if not celled:
                groups = [(0, batch.num_rows, everyone)]
            else:
                cell = batch.column("cell").to_numpy()
                edges = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1), batch.num_rows]
                groups = [(a, b, np.asarray(batch.column("asked")[a].as_py())) for a, b in zip(edges, edges[1:]) if a < b]
            for a, b, which in groups:
                step = max(1, SCORES // max(1, len(which)))
                for at in range(a, b, step):
                    part = batch.slice(at, min(step, b - at))
                    vectors = unit(matrix_of(part.column("vector"), dims))
                    scores = np.clip(np.round(vectors @ matrix[which].T, digits), 0.0, 1.0)
                    if all_rows:
                        scores[np.isnan(scores)] = 1.0
                    fits, ids = _fits(part, asked, which, filters), part.column("chunk_id").to_numpy(zero_copy_only=False)
                    for j, q in enumerate(which):
                        own = slice(None) if fits is None else fits[:, j]
                        if fits is None or own.any():
                            kept.add(int(q), scores[own, j], ids[own])
        if kept.held:
            q = np.repeat(np.fromiter(kept.held, np.int32), [len(s) for s, _ in kept.held.values()])
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.concatenate([i for _, i in kept.held.values()]).tolist(), rows_kind), pa.array(np.concatenate([s for s, _ in kept.held.values()]))], ["q", "chunk_id", "dense_score"])

    return rows.mapInArrow(scored, schema).join(F.broadcast(numbers), "q").select("qid", "chunk_id", "dense_score")
