"""Inner products of all rows with blocks of stated query vectors, as matrix products in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Query vectors that the tasks hold at once.
BLOCK = 1024


def matrix(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows x dimension) of a list column and which rows are vectors of that length without nulls."""
    size = np.asarray(column.value_lengths().fill_null(-1))
    ok = size == dimension
    flat = column.filter(pa.array(ok)).flatten()
    out = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(-1, dimension)
    good = ~np.isnan(out).any(axis=1)
    at = np.flatnonzero(ok)[good]
    return out[good], at


def _scorer(ids: pa.Array, queries: np.ndarray, groups: np.ndarray | None, k: int, least: float | None):

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors, at = matrix(b.column(1), queries.shape[1])
            score = vectors @ queries.T
            if groups is not None:
                own = np.asarray(b.column(2).to_pylist(), object)[at]
                score = np.where(own[:, None] == groups[None, :], score, -np.inf)
            keep = score > -np.inf if least is None else score > least
            if len(score) > k:  # a query's k best of the batch, and what ties with the last of them
                keep &= score >= np.partition(score, len(score) - k, axis=0)[len(score) - k]
            row, query = np.nonzero(keep)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(query)), b.column(0).take(pa.array(at[row])), pa.array(score[row, query])], ["query", "key", "score"])

    return run


def best_pairs(rows: DataFrame, queries: DataFrame, k: int, key: str, vector: str, query_key: str, query_vector: str, least: float | None = None, same: str | None = None) -> DataFrame:
    """(query_key, key, score): for each query at least its k best rows, with score over least; a few more where batches meet.

    queries is a stated query set and is worked off in blocks of BLOCK vectors, one pass over rows a block. With same, a
    query sees the rows of its own value there. Null vectors and those of another length have no score.
    """
    qt, rt = dict(queries.dtypes)[query_key], dict(rows.dtypes)[key]
    listed = queries.select(query_key, query_vector, *([same] if same else [])).toLocalIterator()
    scan = rows.select(key, vector, *([same] if same else []))
    out = None
    while held := [r for r in islice(listed, BLOCK)]:
        held = [r for r in held if r[1] is not None]
        for size in sorted({len(r[1]) for r in held}):
            own = [r for r in held if len(r[1]) == size]
            groups = np.array([r[2] for r in own], object) if same else None
            run = _scorer(pa.array([r[0] for r in own], to_arrow_type(queries.schema[query_key].dataType)), np.array([r[1] for r in own], float), groups, k, least)
            part = scan.mapInArrow(run, f"query {qt}, key {rt}, score double")
            out = part if out is None else out.unionAll(part)
    if out is None:
        out = rows.sparkSession.createDataFrame([], f"query {qt}, key {rt}, score double")
    return out.select(F.col("query").alias(query_key), F.col("key").alias(key), "score")
