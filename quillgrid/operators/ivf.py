"""Approximate vector search by inverted cells (K29, T01): a table laid out by cell, of which a search reads the cells it probes.

Cells are as many as the square root of the rows, each the surroundings of a k-means centroid; large cells are split into
parts. `tuned` measures the recall of a sample of queries against the exact search: the probes that reach the wanted
recall, or None where that takes over a tenth of the rows, as on vectors without clusters. `topk` then searches exactly.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import shared_dir, written
from .ranking import vector_topk_many
from .scoring import matrix

#: Rows that the centroids are fitted on at most (every row is indexed); cells at most; rows of a cell's part; queries that measure the recall at most.
SAMPLE, MOST_CELLS, PART, MEASURED = 100_000, 4096, 50_000, 200
#: Share of the rows that a search may score.
SHARE = 0.1


@dataclass(frozen=True)
class Index:
    """table: (id, vector, cell, part), partitioned by cell; sizes: rows of each cell."""

    table: DataFrame
    centres: np.ndarray
    sizes: dict[int, int]


def _some(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most about `most` rows, chosen by the hash of a column."""
    keep = min(1.0, most / max(1, rows.count()))
    return rows.filter(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1_000_000)) < math.ceil(keep * 1_000_000))


def centroids(vectors: DataFrame, nlist: int, vector: str = "vector", seed: int = 7) -> np.ndarray:
    """At most nlist centroids of at most about SAMPLE rows."""
    rows = _some(vectors.filter(F.col(vector).isNotNull()), vector, SAMPLE)
    model = KMeans(k=max(2, nlist), seed=seed, featuresCol="_v").fit(rows.select(array_to_vector(F.col(vector).cast("array<double>")).alias("_v")))
    return np.array(model.clusterCenters())


def assign(vectors: DataFrame, centres: np.ndarray, vector: str = "vector", probes: int = 1) -> DataFrame:
    """vectors with the nearest cells, one row for each of `probes` cells; vectors of another length, and null ones, have none."""
    kept = vectors.columns
    half = (centres**2).sum(axis=1) / 2

    def run(batches):
        for b in batches:
            own, at = matrix(b.column(kept.index(vector)), centres.shape[1])
            near = np.argsort(half - own @ centres.T, axis=1, kind="stable")[:, :probes]
            rows = pa.array(np.repeat(at, near.shape[1]))
            yield pa.RecordBatch.from_arrays([c.take(rows) for c in b.columns] + [pa.array(near.ravel().astype(np.int32))], [*kept, "cell"])

    return vectors.mapInArrow(run, vectors.withColumn("cell", F.lit(0)).schema)


def build(records: DataFrame, key: str = "id", vector: str = "vector", nlist: int | None = None) -> Index:
    """The index of all records with a vector. Repeated keys are rows of their own; vectors shorter than the longest, and
    those with nulls, are left out; a table of fewer than two vectors has one cell.
    """
    spark = records.sparkSession
    rows = records.select(F.col(key).alias("id"), F.col(vector).alias("vector")).filter(F.col("vector").isNotNull())
    size = rows.agg(F.max(F.size("vector"))).first()[0] or 1
    rows = rows.filter((F.size("vector") == size) & ~F.exists("vector", lambda x: x.isNull()))
    n = rows.count()
    nlist = min(MOST_CELLS, max(1, round(math.sqrt(n)))) if nlist is None else nlist
    centres = centroids(rows, nlist) if nlist > 1 and n > 1 else np.zeros((1, size))
    filed = written(assign(rows, centres), "ivf-rows")
    sizes = {r.cell: r.n for r in filed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # MOST_CELLS rows at most
    parts = F.element_at(F.create_map(*[F.lit(x) for c, m in sizes.items() for x in (c, -(-m // PART))]), F.col("cell")) if sizes else F.lit(1)
    path = f"{shared_dir(spark)}/ivf-{uuid.uuid4().hex}"
    filed = filed.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
    filed.repartition("cell", "part").write.partitionBy("cell").option("compression", "zstd").parquet(path)
    stored = spark.read.schema(filed.select("id", "vector", "part", "cell").schema).parquet(path)
    return Index(stored, centres, sizes)


def _pairs(index: Index, queries: DataFrame, probes: int) -> tuple[DataFrame, list[int]]:
    """Queries (query_id, query_vector, cell), and the cells that they probe."""
    asked = written(assign(queries.select("query_id", "query_vector"), index.centres, "query_vector", probes), "ivf-queries")
    return asked, [r[0] for r in asked.select("cell").distinct().collect()]


def scored_rows(index: Index, queries: DataFrame, probes: int) -> int:
    """How many pairs of a query and a row a search scores."""
    asked, _ = _pairs(index, queries, probes)
    return sum(r.n * index.sizes.get(r.cell, 0) for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect())


def search(index: Index, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """(query_id, id, score, rank): the k best of the rows in each query's nearest cells, ties by id.

    Only the folders of probed cells are read. Each part of a cell is scored against the cell's queries by matrix products
    in one task, which keeps k rows a query.
    """
    asked, cells = _pairs(index, queries, probes)
    kind, qkind = dict(index.table.dtypes)["id"], dict(queries.dtypes)["query_id"]
    rows = index.table.filter(F.col("cell").isin(cells))
    parts = F.element_at(F.create_map(*[F.lit(x) for c, m in index.sizes.items() for x in (c, -(-m // PART))]), F.col("cell")) if index.sizes else F.lit(1)
    asked = asked.filter(F.col("cell").isin(list(index.sizes))).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))

    size = index.centres.shape[1]

    def score(own: pa.Table, some: pa.Table) -> pa.Table:
        found: list[pa.Table] = []
        vectors, at = matrix(own["vector"].combine_chunks(), size)
        ids = own["id"].take(pa.array(at))
        for start in range(0, some.num_rows if len(at) else 0, 1024):
            block = some.slice(start, 1024)
            qs, qat = matrix(block["query_vector"].combine_chunks(), size)
            s = vectors @ qs.T
            keep = s >= np.partition(s, len(s) - k, axis=0)[len(s) - k] if len(s) > k else np.ones(s.shape, bool)
            row, q = np.nonzero(keep)
            found.append(pa.table({"query_id": block["query_id"].take(pa.array(qat[q])), "id": ids.take(pa.array(row)), "score": s[row, q]}))
        return pa.concat_tables(found) if found else pa.table({"query_id": some["query_id"].slice(0, 0), "id": own["id"].slice(0, 0), "score": pa.array([], pa.float64())})

    scored = rows.groupBy("cell", "part").cogroup(asked.groupBy("cell", "part")).applyInArrow(score, f"query_id {qkind}, id {kind}, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def recall(found: DataFrame, records: DataFrame, queries: DataFrame, k: int) -> float:
    """Share of the exact k best that were found."""
    exact = vector_topk_many(records, queries, k).select("query_id", "id")
    both = exact.join(found.select("query_id", "id"), ["query_id", "id"], "left_semi").count()
    return both / max(1, exact.count())


def tuned(index: Index, queries: DataFrame, k: int, least: float = 0.9) -> int | None:
    """The fewest cells (a power of two) that a query must probe for the wanted recall, by at most about MEASURED queries; None if they hold over SHARE of the rows."""
    some = written(_some(queries, "query_id", MEASURED), "ivf-measured")
    records = index.table.select("id", "vector")
    whole, asked, probes = sum(index.sizes.values()), some.count(), 1
    while probes <= len(index.sizes):
        if scored_rows(index, some, probes) > SHARE * whole * asked:
            return None
        if recall(search(index, some, k, probes), records, some, k) >= least:
            return probes
        probes *= 2
    return None


def topk(records: DataFrame, queries: DataFrame, k: int, least: float = 0.9, index: Index | None = None) -> DataFrame:
    """(query_id, id, score, rank): by the index where its recall is at least `least` at SHARE of the rows, else exactly. records: (id, vector)."""
    index = index or build(records)
    probes = tuned(index, queries, k, least)
    return vector_topk_many(records, queries, k) if probes is None else search(index, queries, k, probes)
