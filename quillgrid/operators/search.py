"""Full-text and hybrid retrieval (R01-R11, T03, T13): BM25 over token arrays, vector top-k and their merges."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.permissions import visible
from ..storage import written
from . import filters, joins, ranking

#: Lucene's defaults.
K1, B = 1.2, 0.75
#: Words of letters and digits; each CJK character alone.
TOKEN = r"[0-9a-zà-öø-ÿ]+|[\x{4e00}-\x{9fff}]"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def query_terms(query: str) -> list[str]:
    """Distinct terms of a query, as the tokenizer would cut it; driver-side."""
    import re

    return list(dict.fromkeys(re.findall(r"[0-9a-zà-öø-ÿ]+|[一-鿿]", query.lower())))


def term_count(low: Column, term: str) -> Column:
    """How often a token occurs in lower-cased text, without building its token array."""
    letter = "[0-9a-zà-öø-ÿ]"
    alone = rf"(?<!{letter}){term}(?!{letter})" if term < "\u4e00" else term
    return F.regexp_count(low, F.lit(alone))


def bm25(docs: DataFrame, query: str, key: str = "id", text: str = "text", where: Column | None = None) -> DataFrame:
    """(key, score) of the rows that hold a term of the query.

    One pass over the texts: each becomes its length and the counts of the query's terms in a narrow table (no postings,
    no explode), from which one aggregate gives the corpus statistics. These cover the rows that `where` keeps.
    """
    terms = query_terms(query)
    rows = docs if where is None else docs.filter(where)
    if not terms:
        return rows.select(key, F.lit(0.0).alias("score")).filter("false")
    rows = rows.select(key, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_low"))
    rows = rows.select(key, F.regexp_count("_low", F.lit(TOKEN)).alias("_dl"), *[term_count(F.col("_low"), t).alias(f"_tf{i}") for i, t in enumerate(terms)])
    rows = written(rows, "terms")
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("_dl").alias("avgdl"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    hits = rows.filter(" or ".join(f"_tf{i} > 0" for i in range(len(terms))))
    score = F.lit(0.0)
    for i in range(len(terms)):
        df, tf = stats[f"df{i}"], F.col(f"_tf{i}")
        idf = math.log(1 + (stats["n"] - df + 0.5) / (df + 0.5))
        score = score + idf * tf / (tf + K1 * (1 - B + B * F.col("_dl") / (stats["avgdl"] or 1.0)))
    return hits.select(key, score.alias("score"))


def bm25_topk(docs: DataFrame, query: str, k: int, key: str = "id", text: str = "text", where: Column | None = None) -> DataFrame:
    """The k best rows by BM25, ties by key."""
    return bm25(docs, query, key, text, where).orderBy(F.round("score", 9).desc(), F.col(key)).limit(k)


def full_text_search(records: DataFrame, query: str, k: int = 10, metadata: dict | None = None, allowed: tuple[int, ...] | None = None, kind: str = "") -> DataFrame:
    """BM25 over live rows that metadata and permission let through."""
    where = filters.live(F.col("is_deleted"))
    if metadata:
        where = where & filters.text_clause(F.col("metadata"), metadata, kind)
    if allowed is not None:
        where = where & visible(F.col("permission_level"), allowed)
    best = bm25_topk(records, query, k, where=where)
    return best.join(records.select("id", "text", "metadata"), "id")


def hybrid_search(records: DataFrame, query: str, vector: list[float], k: int = 10, sim_weight: float = 0.7, text_weight: float = 0.3) -> DataFrame:
    """Vector and text hits (2k each) by weighted sum, ties by id."""
    where = filters.live(F.col("is_deleted"))
    near = ranking.vector_topk(records, vector, 2 * k, where=where).select("id", "score")
    text = bm25_topk(records, query, 2 * k, where=where)
    return joins.hybrid(near, text, sim_weight, text_weight).orderBy(F.round("weight", 9).desc(), "id").limit(k)


def similarity_search(
    records: DataFrame,
    query: str,
    vector: list[float],
    k: int = 10,
    collection: str | None = None,
    metadata: dict | None = None,
    rejected: list[str] | None = None,
    least: float = 0.45,
    allowed: tuple[int, ...] | None = None,
    rerank: Callable[[Column, Column], Column] | None = None,
    kind: str = "",
) -> DataFrame:
    """The reference's main search (R01): exact top-k among live, permitted rows, verified by text hits.

    Filters come before top-k (D9), so over-fetching serves verification alone: of 2k vector hits over the threshold,
    those that BM25's 2k hits confirm win if there are any. rerank(query, text) gives a score for the final order.
    """
    where = filters.live(F.col("is_deleted"))
    if collection is not None:
        where = where & (F.col("collection_name") == collection)
    if metadata:
        where = where & filters.metadata_equals(F.col("metadata"), metadata, kind)
    if rejected:
        where = where & filters.not_excluded(F.col("id"), rejected)
    if allowed is not None:
        where = where & visible(F.col("permission_level"), allowed)
    near = ranking.vector_topk(records, vector, 2 * k, where=where, least=least).select("id", "score")
    text = bm25_topk(records, query, 2 * k, where=where)
    hits = ranking.two_buckets(joins.verified_by_text(near, text), k)
    out = joins.hits_with_documents(hits, records.select("id", "text", "metadata", "source_file"))
    if rerank is not None:
        return ranking.reranked(out, rerank(F.lit(query), F.col("text")), k)
    return out.orderBy(F.col("score").desc(), "id")


def diagnose(records: DataFrame, query: str, vector: list[float], nodes: DataFrame, edges: DataFrame, limit: int = 5, rerank: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Canonical faults nearest to the query (2 * limit, reranked, cut) with their solutions."""
    from .graph import diagnosis, solutions

    faults = records.join(nodes.filter("type = 'CanonicalFault'").select("id"), "id", "left_semi")
    hits = ranking.vector_topk(faults, vector, 2 * limit)
    if rerank is not None:
        hits = ranking.reranked(hits, rerank(F.lit(query), F.col("text")), limit)
    hits = hits.limit(limit).select(F.col("id").alias("fault_id"), "text", "score")
    listed = diagnosis(solutions(nodes, edges).join(hits.select("fault_id"), "fault_id", "left_semi"))
    return hits.join(listed, "fault_id", "left").orderBy(F.col("score").desc(), "fault_id")


def add_texts(stored: DataFrame, incoming: DataFrame, least: float = 0.99, same: str | None = None, but_self: bool = False) -> DataFrame:
    """incoming (id, text, vector) with the id each text gets: that of a stored near-equal, or its own."""
    best = joins.nearest(incoming, stored.withColumnRenamed("id", "stored_id"), least, same=same, but_self=but_self)
    return best.withColumn("final_id", F.coalesce("stored_id", "id")).withColumn("is_new", F.col("stored_id").isNull())


def handler_for(collection: str) -> str:
    """Kind of handler by collection type (R08, D3): an unset parameter name is disabled, not matched."""
    from ..functions.metadata import TYPE_NAMES

    names = sorted(((n, t) for t, own in TYPE_NAMES.items() for n in own), key=lambda x: -len(x[0]))
    kind = next((t for n, t in names if n in collection.lower()), "")
    return {"workorder": "workorder", "special_workorder": "workorder", "workorder_graph": "workorder", "manual": "manual", "parameter": "parameter", "parameter_updated": "parameter", "principle": "principle"}.get(kind, "generic")
