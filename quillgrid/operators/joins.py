"""Joins (J01-J18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scoring import best_pairs


def latest_with_ties(df: DataFrame, key: str, at: str) -> DataFrame:
    """Rows of each key's newest time; ties return several rows (J01, A01). Filter afterwards to keep its semantics."""
    newest = df.groupBy(key).agg(F.max(at).alias("_newest"))
    return df.join(newest, key).filter(F.col(at) == F.col("_newest")).drop("_newest")


def latest_one(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the given order (W06, W11), as one aggregate over structs of the row."""
    n = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(n)).filter("_n = 1").drop("_n")


def images_in_range(links: DataFrame, images: DataFrame, first: Column, last: Column) -> DataFrame:
    """Images of pages first to last."""
    return links.filter(F.col("page_num").between(first, last)).join(images, "image_id")


def first_per_page(rows: DataFrame, page: str = "page_num", key: str = "image_id", *more: str) -> DataFrame:
    """The first image of each page."""
    return latest_one(rows.withColumn("_key", F.struct(*more, page)), "_key", F.col(key)).drop("_key")


def chapter_bounds(toc: DataFrame, total: str = "total_pages", doc: str = "doc_id", start: str = "page_start") -> DataFrame:
    """Contents with page_end: the next chapter's start less one, the last one's the total."""
    following = F.lead(start).over(Window.partitionBy(doc).orderBy(start, "title"))
    return toc.withColumn("page_end", F.greatest(F.coalesce(following - 1, F.col(total)), F.col(start)))


def chapter_of_page(pages: DataFrame, toc: DataFrame, doc: str = "doc_id", page: str = "page", start: str = "page_start") -> DataFrame:
    """Each page with the last chapter that starts on or before it.

    An as-of join as one sort: chapters and pages are unioned, and the last chapter seen is carried forward.
    """
    kept = [c for c in toc.columns if c not in (doc, start)]
    chapter = F.struct(F.col(start).alias(start), *kept)
    left = toc.select(F.col(doc), F.col(start).alias("_at"), F.lit(0).alias("_side"), chapter.alias("_chapter"), F.lit(None).cast(pages.select(F.struct("*")).schema[0].dataType).alias("_row"))
    right = pages.select(F.col(doc), F.col(page).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(left.schema["_chapter"].dataType).alias("_chapter"), F.struct("*").alias("_row"))
    seen = Window.partitionBy(doc).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = left.unionByName(right).withColumn("_chapter", F.last("_chapter", ignorenulls=True).over(seen)).filter("_side = 1")
    return out.select("_row.*", *[F.col(f"_chapter.{c}").alias(c) for c in (start, *kept)])


def calibrate(toc: DataFrame, footers: DataFrame, least_count: int = 3, least_share: float = 0.3) -> DataFrame:
    """Contents whose page codes are looked up among footers (doc_id, code, page), if enough of them match."""
    first = footers.groupBy("doc_id", F.col("code").alias("_code")).agg(F.min("page").alias("_page"))
    met = toc.withColumn("_code", F.upper(F.trim("toc_page_code"))).join(first, ["doc_id", "_code"], "left").drop("_code")
    gate = met.groupBy("doc_id").agg((F.count("_page") >= least_count).alias("_many"), (F.count("_page") / F.count("*") >= least_share).alias("_share"))
    ok = F.col("_many") & F.col("_share") & F.col("_page").isNotNull()
    return met.join(gate, "doc_id").withColumn("target_page", F.when(ok, F.col("_page")).otherwise(F.col("target_page"))).drop("_page", "_many", "_share")


def hits_with_documents(hits: DataFrame, documents: DataFrame, key: str = "id") -> DataFrame:
    """Hits with their documents; hits without one are dropped."""
    return hits.join(documents, key)


def verified_by_text(vector_hits: DataFrame, text_hits: DataFrame, key: str = "id") -> DataFrame:
    """Vector hits with a flag whether the text search found them too."""
    found = text_hits.select(F.col(key), F.lit(True).alias("_found")).distinct()
    return vector_hits.join(found, key, "left").withColumn("verified", F.coalesce("_found", F.lit(False))).drop("_found")


def hybrid(vector_hits: DataFrame, text_hits: DataFrame, vector_weight: float, text_weight: float, key: str = "id", score: str = "score") -> DataFrame:
    """Both lists by id, weighted scores added."""
    rows = vector_hits.select(key, (F.col(score) * vector_weight).alias("_w")).unionByName(text_hits.select(key, (F.col(score) * text_weight).alias("_w")))
    return rows.groupBy(key).agg(F.sum("_w").alias("weight"))


def with_vectors(rows: DataFrame, vectors: DataFrame, text: str = "text") -> DataFrame:
    """Rows with the vector of their text; rows without one are dropped."""
    return rows.join(vectors, text)


def with_default(rows: DataFrame, lookup: DataFrame, key: str, column: str, default: str) -> DataFrame:
    """Left join with a default for what is missing."""
    return rows.join(lookup.select(key, column), key, "left").withColumn(column, F.coalesce(column, F.lit(default)))


def located(batches: DataFrame, wanted: DataFrame, tasks: str = "task_history", key: str = "task_id") -> DataFrame:
    """Batch items that name a wanted task (J16), by exploding the histories."""
    named = batches.select("*", F.explode_outer(tasks).alias(key))
    return named.join(wanted.select(key).distinct(), key, "left_semi")


def nearest(incoming: DataFrame, stored: DataFrame, least: float, key: str = "id", other: str = "stored_id", vector: str = "vector", same: str | None = None, but_self: bool = False) -> DataFrame:
    """Each incoming row with its most similar stored row of over least, null if none; ties go to the greater id.

    Vectors are unit vectors. incoming is the stated query set of one batch, scored in blocks. With same, only rows of
    equal value there are compared; with but_self, a stored row of the incoming one's own id is not.
    """
    pairs = best_pairs(stored, incoming, 2 if but_self else 1, other, vector, key, vector, least, same)
    pairs = pairs.filter(F.col(key) != F.col(other)) if but_self else pairs
    best = pairs.groupBy(key).agg(F.max_by(F.struct(other, "score"), F.struct("score", other)).alias("_m"))
    return incoming.join(best.select(key, F.col(f"_m.{other}").alias(other), F.col("_m.score").alias("similarity")), key, "left")


def gathered(links: DataFrame, key: str = "document_id", value: str = "image_id", order: str = "sort_order") -> DataFrame:
    """Each document's image ids in their order."""
    return links.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("image_ids"))
