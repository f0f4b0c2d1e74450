"""Windows and chunks of paged and plain texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine


def page_windows(docs: DataFrame, pages: str = "pages", window: int = 2, overlap: int = 1, key: str = "doc_id") -> DataFrame:
    """(key, page_start, page_end, slice_id, page_texts): windows of an array of page texts.

    They start at 1, 1 + step, ... with step = window - overlap, at least 1; the last ones may be shorter.
    """
    step = max(1, window - overlap)
    starts = F.when(F.size(pages) > 0, F.sequence(F.lit(1), F.size(pages), F.lit(step))).otherwise(F.array().cast("array<int>"))
    rows = docs.select(key, F.col(pages).alias("_pages"), F.explode(starts).alias("page_start"))
    end = F.least(F.col("page_start") + window - 1, F.size("_pages"))
    rows = rows.withColumn("page_end", end)
    return rows.select(key, "page_start", "page_end", F.format_string("p%d_%d", "page_start", "page_end").alias("slice_id"), F.slice("_pages", F.col("page_start"), F.lit(window)).alias("page_texts"))


def fixed_chunks(docs: DataFrame, size: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, chunk_id, start, chunk): cuts of size characters (C04, C11). Empty and null texts give none."""
    starts = F.sequence(F.lit(0), F.length(text) - 1, F.lit(size))
    rows = docs.filter(F.length(text) > 0).select(key, F.col(text).alias("_text"), F.posexplode(starts).alias("chunk_id", "start"))
    return rows.select(key, "chunk_id", "start", F.substring("_text", F.col("start") + 1, F.lit(size)).alias("chunk"))


def fixed_slices(docs: DataFrame, pages: str = "total_pages", size: int = 5, key: str = "doc_id") -> DataFrame:
    """Fallback slices of at least five pages each (C11)."""
    size = max(5, size)
    rows = docs.filter(F.col(pages) > 0).select(key, pages, F.posexplode(F.sequence(F.lit(1), F.col(pages), F.lit(size))).alias("_n", "page_start"))
    return rows.select(key, F.format_string("chunk_%04d", F.col("_n") + 1).alias("slice_id"), "page_start", F.least(F.col("page_start") + size - 1, F.col(pages)).alias("page_end"))


def split_long(docs: DataFrame, threshold: int = 15, size: int = 10, key: str = "doc_id") -> DataFrame:
    """Chapters (page_start, page_end, slice_id) of over threshold pages in parts of size pages."""
    span = F.col("page_end") - F.col("page_start") + 1
    starts = F.when(span > threshold, F.sequence("page_start", "page_end", F.lit(size))).otherwise(F.array("page_start"))
    rows = docs.select(key, "slice_id", "page_end", (span > threshold).alias("_long"), F.posexplode(starts).alias("_n", "page_start"))
    name = F.when(F.col("_long"), F.concat("slice_id", F.lit("_part"), F.col("_n") + 1)).otherwise(F.col("slice_id"))
    return rows.select(key, name.alias("slice_id"), "page_start", F.when(F.col("_long"), F.least(F.col("page_start") + size - 1, F.col("page_end"))).otherwise(F.col("page_end")).alias("page_end"))


def slice_ranges(toc: DataFrame, total: str = "total_pages", soft: int = 30, hard: int = 80, key: str = "doc_id") -> DataFrame:
    """Page ranges of contents items (W10): to the next start; the last to the end within the soft cap; all within the hard cap."""
    nxt = F.lead("page_start").over(Window.partitionBy(key).orderBy("page_start"))
    end = F.when(nxt.isNotNull(), F.greatest(nxt - 1, F.col("page_start"))).otherwise(F.least(F.col(total), F.col("page_start") + soft - 1))
    return toc.withColumn("page_end", F.least(end, F.col("page_start") + hard - 1))


def rising_only(toc: DataFrame, key: str = "doc_id", page: str = "target_page", order: str = "position") -> DataFrame:
    """Contents items with pages in range, the first of each page."""
    w = Window.partitionBy(key, page).orderBy(order)
    return toc.filter(F.col(page).between(1, F.col("total_pages"))).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def similar_islands(chunks: DataFrame, key: str = "doc_id", order: str = "chunk_id", vector: str = "vector", least: float = 0.85) -> DataFrame:
    """chunks with similarity to the one before and the number of their island of similar neighbours."""
    w = Window.partitionBy(key).orderBy(order)
    rows = chunks.withColumn("similarity", cosine(F.lag(vector).over(w), F.col(vector)))
    return rows.withColumn("island", F.sum(F.when(F.col("similarity") >= least, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def merged_islands(chunks: DataFrame, key: str = "doc_id", order: str = "chunk_id", text: str = "chunk") -> DataFrame:
    """Text of each island, joined in order."""
    return chunks.groupBy(key, "island").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "").alias("text"))


def toc_pages(pages: DataFrame, key: str = "doc_id", page: str = "page", links: str = "links", most: int = 10, least: int = 3) -> DataFrame:
    """Pages of the first run within the first `most` that have at least `least` links; pages 1 to 5 if there is none."""
    rows = pages.filter(F.col(page) <= most).withColumn("_hit", F.col(links) >= least)
    w = Window.partitionBy(key).orderBy(page)
    run = rows.filter("_hit").withColumn("_run", F.col(page) - F.row_number().over(w))
    first = run.groupBy(key).agg(F.min("_run").alias("_first"))
    hits = run.join(first, key).filter(F.col("_run") == F.col("_first")).select(key, page)
    none = pages.select(key).distinct().join(first, key, "left_anti")
    return hits.unionByName(pages.filter(F.col(page) <= 5).join(none, key, "left_semi").select(key, page))


def _cut(segment: str, size: int, overlap: int) -> list[str]:
    """Cuts of a long segment at its last sentence end within size; the last one ends the loop."""
    out, start = [], 0
    while True:
        end = min(start + size, len(segment))
        if end < len(segment):
            stop = max(segment.rfind(c, start, end) for c in ".?!")
            end = stop + 1 if stop > start else end
        out.append(segment[start:end].strip())
        if end == len(segment):
            return out
        start = max(end - overlap, start + 1)


def split_text(text: str | None, size: int = 1000, overlap: int = 200, separator: str = "\n") -> list[str]:
    """Chunks of whole segments up to size characters; about overlap characters are repeated; long segments are cut."""
    if not text:
        return []
    out: list[str] = []
    held: list[str] = []
    used = 0
    for segment in text.split(separator):
        if len(segment) > size:
            out += [separator.join(held)] if held else []
            held, used = [], 0
            out += _cut(segment, size, overlap)
            continue
        if held and used + len(segment) > size:
            out.append(separator.join(held))
            while held and (used > overlap or used + len(segment) > size):
                used -= len(held.pop(0))
        held.append(segment)
        used += len(segment)
    return out + ([separator.join(held)] if held else [])


def text_chunks(docs: DataFrame, size: int = 1000, overlap: int = 200, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, chunk_id, chunk) of all texts (C03): chunks depend on those before, so a text is split in one go, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, n, c) for k, t in zip(b["key"], b["text"], strict=True) for n, c in enumerate(split_text(t, size, overlap))]
            yield pd.DataFrame(rows, columns=[key, "chunk_id", "chunk"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"{key} {kind}, chunk_id int, chunk string")


def virtual_pages(docs: DataFrame, most: int = 500, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, page, text): paragraphs packed into pages until the next would exceed most characters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b["key"], b["text"], strict=True):
                held, used, page = [], 0, 1
                for p in (p.strip() for p in (t or "").split("\n")):
                    if p and held and used + len(p) > most:
                        rows.append((k, page, "\n".join(held)))
                        held, used, page = [], 0, page + 1
                    if p:
                        held.append(p)
                        used += len(p)
                if held:
                    rows.append((k, page, "\n".join(held)))
            yield pd.DataFrame(rows, columns=[key, "page", "text"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"{key} {kind}, page int, text string")


def visual_windows(windows: DataFrame, page_types: str = "page_types") -> DataFrame:
    """windows with has_visual_content: a page in it is a drawing or mixed."""
    return windows.withColumn("has_visual_content", F.exists(page_types, lambda t: t.isin("drawing", "mixed")))
