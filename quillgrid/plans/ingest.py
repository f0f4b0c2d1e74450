"""Ingest pipelines: parse, embed, record, registry, report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metadata as M
from ..functions import models
from ..operators import aggregates, chunking, tables


def ingest_rows(chunks: DataFrame, collection: str, source: str, content: bytes, kind: str = "", encoder: models.Encoder | None = None, overlay: dict[str, str] | None = None) -> DataFrame:
    """Records of chunks (text, metadata, local_key) with ids, normalised metadata and vectors.

    overlay is the uploader's metadata; reserved keys in it are refused. Rows whose vector fails keep a null vector.
    """
    given = {k: str(v) for k, v in (overlay or {}).items()}
    bad = [k for k in given if k in tables.RESERVED]
    if bad:
        raise ValueError(f"reserved metadata keys: {bad}")
    if given:
        extra = F.create_map(*[F.lit(x) for pair in given.items() for x in pair])
        chunks = chunks.withColumn("metadata", M.merged(F.col("metadata"), extra))
    rows = tables.records(chunks, F.lit(collection), F.lit(source), F.lit(content), F.lit("hash"), kind)
    return models.embed(rows, encoder or models.hashing_encoder())


def written_rows(records: DataFrame, stored: DataFrame) -> DataFrame:
    """stored with the records that have a vector upserted."""
    return tables.upsert(stored, records.filter(F.col("vector").isNotNull()), "id")


def report(records: DataFrame) -> DataFrame:
    """Counts and status of each file's ingest."""
    return aggregates.ingest_verdict(records, "source_file", F.col("vector").isNotNull())


def ingest_pages(pages: DataFrame, toc: DataFrame, window: int = 2, overlap: int = 1) -> DataFrame:
    """Window chunks of paged documents with the chapter they start in.

    pages: (doc_id, page, text); toc: (doc_id, title, section_number, page_start).
    """
    from ..operators.joins import chapter_of_page

    texts = pages.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]).alias("pages"))
    windows = chunking.page_windows(texts, window=window, overlap=overlap).withColumnRenamed("page_start", "page")
    out = chapter_of_page(windows, toc)
    name = F.concat_ws("__", F.nullif("section_number", F.lit("")), "slice_id")
    return out.select("doc_id", F.col("page").alias("page_start"), "page_end", name.alias("slice_id"), F.col("title").alias("chapter_title"), "section_number", "page_texts")


def ingest_word(docs: DataFrame, chars_per_page: int = 500) -> DataFrame:
    """Virtual pages of word-processor texts."""
    return chunking.virtual_pages(docs, chars_per_page)
