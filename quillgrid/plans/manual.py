"""Ingest of manuals in two layers (R22, R23): chapters, graph chunks, page-image links and the report.

Pages and contents come from any reader (`sources.pdf`, `sources.word`, or tables). Every distinct text is embedded once,
in a table of its own, so that a service is paid once however often the plan is read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, models
from ..operators import tables
from ..storage import written
from . import handlers

#: What an extractor answers about a chunk, as JSON.
GRAPH = "summary string, entities array<struct<name string, type string, description string>>, relations array<struct<src string, rel string, tgt string, description string>>"


@dataclass(frozen=True)
class Layers:
    """chapters and chunks: records with vectors; images: (id, page_num, layer) links; report: a row for each document."""

    chapters: DataFrame
    chunks: DataFrame
    images: DataFrame
    report: DataFrame


def _id(collection: str, source: Column, digest: Column, model: str, namespace: str, local_key: Column) -> Column:
    return ids.record_id(F.lit(collection), source, digest, F.lit(model), F.lit(namespace), local_key)


def assembled(pages: DataFrame, toc: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Manuals as `ingest_manuals` takes them, of pages (doc_id, page, text), contents (doc_id, title, section_number, page_start)
    and fingerprints (doc_id, source_file, fingerprint)."""
    paged = pages.groupBy("doc_id").agg(F.collect_list(F.struct("page", "text")).alias("pages"))
    listed = toc.groupBy("doc_id").agg(F.collect_list(F.struct("page_start", "title", "section_number")).alias("toc"))
    return paged.join(listed, "doc_id", "left").join(fingerprints.select("doc_id", "source_file", "fingerprint"), "doc_id", "left")


def _sorted(manuals: DataFrame) -> DataFrame:
    """manuals that have a fingerprint, with pages and contents in order; of contents on the same page the last by title stays."""
    kept = manuals.filter("source_file is not null or fingerprint is not null")
    toc = F.sort_array(F.filter(F.coalesce("toc", F.array().cast(dict(manuals.dtypes)["toc"])), lambda c: c["page_start"].isNotNull()))
    out = kept.select("doc_id", "source_file", "fingerprint", F.sort_array("pages").alias("pages"), toc.alias("toc"))
    following = lambda i: F.get("toc", i + 1)["page_start"]
    return out.withColumn("toc", F.filter("toc", lambda c, i: F.coalesce(following(i) > c["page_start"], F.lit(True))))


def _bounds() -> Column:
    """The contents, each with the start of the following one."""
    return F.transform("toc", lambda c, i: F.struct(c["page_start"].cast("int").alias("start"), F.get("toc", i + 1)["page_start"].cast("int").alias("following"), c["title"].alias("title"), c["section_number"].alias("section_number")))


def _joined(pages: Column, sep: str) -> Column:
    return F.array_join(F.transform(pages, lambda p: F.coalesce(p["text"], F.lit(""))), sep)


def chapters(manuals: DataFrame, model: str, collection: str) -> DataFrame:
    """Chapter records without vectors: the text is that of the chapter's pages.

    A chapter ends before the next one, the last one on the document's last page; pages before the first chapter belong
    to none. A manual's row has its pages and contents, so nothing is shuffled. digest (MD5) stands for the text where
    texts are compared or counted.
    """
    in_row = F.size(F.filter("pages", lambda p, i: ~p["page"].eqNullSafe(i + 1))) == 0  # page n is the nth
    rows = _sorted(manuals).select("*", _bounds().alias("bounds"), in_row.alias("in_row"), F.size("pages").alias("n"), F.element_at("pages", -1)["page"].alias("last"))

    def own(c: Column) -> Column:
        first, end = F.greatest(c["start"], F.lit(1)), F.least(F.coalesce(c["following"], F.col("n") + 1), F.col("n") + 1)
        held = F.when(F.col("in_row"), F.slice("pages", first, F.greatest(end - first, F.lit(0)))).otherwise(F.filter("pages", lambda p: (p["page"] >= c["start"]) & (c["following"].isNull() | (p["page"] < c["following"]))))
        page_end = F.greatest(F.coalesce(c["following"] - 1, F.col("last")), c["start"])
        return F.struct(c["start"].alias("page_start"), page_end.alias("page_end"), c["title"].alias("title"), c["section_number"].alias("section_number"), F.size(held).alias("n"), _joined(held, "\n").alias("text"))

    rows = rows.filter("n > 0").select("doc_id", "source_file", "fingerprint", F.explode(F.transform("bounds", own)).alias("c")).select("doc_id", "source_file", "fingerprint", "c.*").filter("n > 0")
    slice_id = F.coalesce(F.nullif(F.trim("section_number"), F.lit("")), F.concat(F.lit("p"), F.col("page_start").cast("string")))
    rows = rows.withColumn("slice_id", slice_id)
    return rows.select(
        "doc_id", _id(collection, F.col("source_file"), F.col("fingerprint"), model, "chapter", F.concat_ws("@", "slice_id", "page_start")).alias("id"), "text", F.md5("text").alias("digest"), F.lit(model).alias("model"), "title", "slice_id",
        F.col("slice_id").alias("section_number"), "page_start", "page_end", "source_file", F.lit("chapter").alias("chunk_type"), F.lit(f"{model}机型操作手册").alias("manual_type"),
    )


def windows(manuals: DataFrame, window: int = 2, overlap: int = 1) -> DataFrame:
    """(doc_id, source_file, fingerprint, slice_id, page_start, page_end, chapter_title, section_number, text): the windows of
    `ingest.ingest_pages`, each with the last chapter that starts on or before it, taken along the chapters within a row."""
    step = max(1, window - overlap)
    rows = _sorted(manuals).select("*", _bounds().alias("bounds"), F.size("pages").alias("n")).filter("n > 0")
    before = F.struct(F.lit(1).alias("start"), F.get("bounds", F.lit(0))["start"].alias("following"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("section_number"))
    rows = rows.withColumn("bounds", F.concat(F.array(before), "bounds"))

    def own(c: Column) -> Column:
        first = (F.ceil((F.greatest(c["start"], F.lit(1)) - 1) / step) * step + 1).cast("int")
        last = F.least(F.coalesce(c["following"] - 1, F.col("n")), F.col("n"))
        starts = F.filter(F.sequence(first, F.greatest(first, last), F.lit(step)), lambda s: s <= last)
        return F.transform(starts, lambda s: F.struct(s.alias("page_start"), F.least(s + window - 1, F.col("n")).alias("page_end"), c["title"].alias("chapter_title"), c["section_number"].alias("section_number"), _joined(F.slice("pages", s, F.lit(window)), "\n\n").alias("text")))

    rows = rows.select("doc_id", "source_file", "fingerprint", F.explode(F.flatten(F.transform("bounds", own))).alias("w")).select("doc_id", "source_file", "fingerprint", "w.*")
    name = F.concat_ws("__", F.nullif("section_number", F.lit("")), F.format_string("p%d_%d", "page_start", "page_end"))
    return rows.select("doc_id", "source_file", "fingerprint", name.alias("slice_id"), "page_start", "page_end", "chapter_title", "section_number", "text")


def graph_chunks(windows: DataFrame, extractor: Callable[[list[str]], list[str | None]], model: str, collection: str, tasks: int = 6) -> DataFrame:
    """Graph records without vectors: of each window a summary, its entities and its relations.

    A window whose answer is null or no such JSON has none; entities without a name and relations without a description
    are skipped; of repeated names in a window the first stays. The answers are stored with their windows once, and the
    extractor runs where the windows lie, in at most `tasks` tasks.
    """
    told = written(handlers.extract_graphs(windows, extractor, tasks, dealt=True), "graphs")
    told = told.withColumn("g", F.from_json("answer", GRAPH)).filter("g is not null")
    some = lambda c: F.trim(F.coalesce(c, F.lit("")))
    item = lambda kind, key, said, name: F.struct(F.lit(kind).alias("entity_type"), key.alias("key"), said.alias("said"), name.alias("name"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    named = F.filter(F.transform(none(F.col("g.entities"), "array<struct<name:string,type:string,description:string>>"), lambda e: F.struct(some(e["name"]).alias("name"), some(e["description"]).alias("about"))), lambda e: e["name"] != "")
    told = told.withColumn("named", named)
    told = told.withColumn("named", F.filter("named", lambda e, i: F.array_position(F.col("named.name"), e["name"]) == i + 1))
    summary = F.array(item("summary", F.lit("summary"), some(F.col("g.summary")), F.lit(None).cast("string")))
    entities = F.transform("named", lambda e: item("entity", F.concat(F.lit("entity|"), e["name"]), F.when(e["about"] != "", F.concat_ws(": ", e["name"], e["about"])).otherwise(e["name"]), e["name"]))
    links = none(F.col("g.relations"), "array<struct<src:string,rel:string,tgt:string,description:string>>")
    relations = F.transform(links, lambda r, n: item("relation", F.concat(F.lit("relation|"), n.cast("string")), some(r["description"]), F.concat_ws(" ", r["src"], r["rel"], r["tgt"])))
    rows = told.select(*windows.columns, F.explode(F.concat(summary, entities, relations)).alias("x")).select(*windows.columns, "x.*").filter("said <> ''")
    own = _id(collection, F.col("source_file"), F.col("fingerprint"), model, "chunk", F.concat_ws("|", "slice_id", "key"))
    return rows.select(
        "doc_id", own.alias("id"), F.col("said").alias("text"), F.lit(model).alias("model"), F.col("chapter_title").alias("title"), "slice_id", "section_number", "page_start", "page_end",
        "source_file", F.lit("sliding_window").alias("chunk_type"), "entity_type", F.col("name").alias("entity_name"), F.col("text").alias("chunk_raw_text"),
    )


def _key(text: Column) -> Column:
    """What texts are told apart by: short ones by themselves, longer ones by their digest."""
    return F.when(F.octet_length(text) <= 32, text).otherwise(F.sha2(text, 256))


def embedded(records: DataFrame, encoder: models.Encoder) -> DataFrame:
    """records with vectors; each distinct text is embedded once, and records without a vector are left out.

    The stored vectors have the texts' keys alone, and the records stay a plan over what is stored: a use of them carries
    the columns that it reads.
    """
    vectors = models.embed(records.select("text").distinct(), encoder).filter(F.col("vector").isNotNull())
    vectors = written(vectors.select(_key(F.col("text")).alias("_key"), "vector"), "vectors")
    return records.withColumn("_key", _key(F.col("text"))).join(vectors, "_key").drop("_key")


def ingest_manuals(
    manuals: DataFrame,
    extractor: Callable[[list[str]], list[str | None]],
    encoder: models.Encoder,
    model: str = "",
    collections: tuple[str, str] = ("manual_total", "manual_chunks"),
    window: int = 2,
    overlap: int = 1,
) -> Layers:
    """Both layers of manuals, their image links and the report.

    manuals: (doc_id, source_file, fingerprint, pages, toc), a row each, where pages is an array of structs (page, text) and
    toc one of (page_start, title, section_number). Documents without contents have chunks alone. Null page text is empty;
    empty tables give empty layers. Where manuals share a file name and a fingerprint, their equal records are one.
    """
    top = chapters(manuals, model, collections[0])
    low = graph_chunks(windows(manuals, window, overlap), extractor, model, collections[1])
    same = [F.coalesce(c, F.lit("")).alias(c) for c in ("source_file", "fingerprint")]
    if not manuals.select(*same).groupBy("source_file", "fingerprint").count().filter("count > 1").isEmpty():
        low = low.dropDuplicates(["id"])
    asked = top, low
    stored = tuple(embedded(x, encoder) for x in asked)
    images = [tables.page_images(x).withColumn("layer", F.lit(n)) for x, n in zip(stored, ("chapter", "chunk"), strict=True)]
    count = lambda df, name, *cond: df.groupBy("doc_id").agg(F.count("*").alias(name), *cond)
    kinds = [F.count_if(F.col("entity_type") == k).alias(f"n_{k}") for k in ("summary", "entity", "relation")]
    report = manuals.filter(F.size("pages") > 0).select("doc_id").distinct()
    for part in (count(asked[0], "chapters"), count(stored[0], "chapters_stored"), count(asked[1], "chunks"), count(stored[1], "chunks_stored", *kinds)):
        report = report.join(part, "doc_id", "left")
    return Layers(stored[0], stored[1], images[0].unionByName(images[1]).distinct(), report.na.fill(0))


def ingest_manual(pages: DataFrame, toc: DataFrame, fingerprints: DataFrame, *args, **more) -> Layers:
    """`ingest_manuals` of manuals whose pages, contents and fingerprints are tables (`assembled`), which are stored as rows first."""
    return ingest_manuals(written(assembled(pages, toc, fingerprints), "manuals"), *args, **more)
