"""Top-k, two-bucket ranking, paging and sorted listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot_with
from .scoring import best_pairs


def vector_topk(records: DataFrame, query: list[float], k: int, vector: str = "vector", key: str = "id", least: float | None = None, where: Column | None = None) -> DataFrame:
    """The k records of the highest inner product with one query vector, ties by key.

    Filters come first, so the result is exact; k rows a task survive the partial sort and no shuffle is needed.
    """
    rows = records if where is None else records.filter(where)
    rows = rows.withColumn("score", dot_with(F.col(vector), query)).filter("score is not null")
    rows = rows if least is None else rows.filter(F.col("score") >= least)
    return rows.orderBy(F.col("score").desc(), F.col(key)).limit(k)


def vector_topk_many(records: DataFrame, queries: DataFrame, k: int, key: str = "id", query_key: str = "query_id", vector: str = "vector", query_vector: str = "query_vector", least: float | None = None) -> DataFrame:
    """(query_key, key, score, rank): the k best records of every query, score over least, ties by key.

    queries is a stated query set, scored in blocks. Batches keep their k best, and what is left is ranked within 1,024
    parts of the records first, so that one query's records are never ranked in one task.
    """
    scored = best_pairs(records, queries, k, key, vector, query_key, query_vector, least).withColumn("_part", F.pmod(F.xxhash64(key), F.lit(1024)))
    best = lambda *by: Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col(key))
    local = scored.withColumn("rank", F.row_number().over(best(query_key, "_part"))).filter(F.col("rank") <= k)
    return local.withColumn("rank", F.row_number().over(best(query_key))).filter(F.col("rank") <= k).drop("_part")


def two_buckets(hits: DataFrame, k: int, verified: str = "verified", score: str = "score", key: str = "id", query: str | None = None) -> DataFrame:
    """Text-verified hits alone if there are any, else the others; best k by score, ties by key."""
    if query is None:
        top = hits.agg(F.max(verified).alias("_any"))
        return hits.crossJoin(F.broadcast(top)).filter(F.col(verified) == F.col("_any")).drop("_any").orderBy(F.col(score).desc(), F.col(key)).limit(k)
    top = hits.groupBy(query).agg(F.max(verified).alias("_any"))
    kept = hits.join(top, query).filter(F.col(verified) == F.col("_any")).drop("_any")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.col(score).desc(), F.col(key)))).filter(F.col("rank") <= k)


def reranked(hits: DataFrame, score: Column, n: int, key: str = "id") -> DataFrame:
    """The n best by a reranker's score; where it fails (null) the score counts as 0."""
    return hits.withColumn("rerank_score", F.coalesce(score, F.lit(0.0))).orderBy(F.col("rerank_score").desc(), F.col(key)).limit(n)


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """Page number (from 1) of size rows in the given order."""
    if number < 1 or size < 1:
        raise ValueError("pages and sizes begin at 1")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


#: Order of batch states in lists.
STATE_RANK = {"running": 0, "pending": 1, "failed": 2, "unknown": 3, "done": 4}


def state_rank(status: Column) -> Column:
    return F.coalesce(*(F.when(status == s, n) for s, n in STATE_RANK.items()), F.lit(len(STATE_RANK)))


def batches_in_order(df: DataFrame, status: str = "status", created: str = "created_at") -> DataFrame:
    """By rank of state, then newest first."""
    return df.orderBy(state_rank(F.col(status)), F.col(created).desc_nulls_last())


def newest_first(df: DataFrame, column: str, key: str) -> DataFrame:
    """Listings by time, nulls last, ties by key."""
    return df.orderBy(F.col(column).desc_nulls_last(), F.col(key))


def network_cap(nodes: DataFrame, edges: DataFrame, most: int = 100, order: str = "depth") -> tuple[DataFrame, DataFrame]:
    """The first nodes of a network and the edges between them."""
    kept = nodes.orderBy(order, "id").limit(most)
    ids = kept.select("id")
    inside = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return kept, inside
