"""Point lookups, criteria, projections and small record builders around the stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metadata as M
from ..functions import text as T
from .filters import live, metadata_equals


def by_ids(rows: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """Live rows of the wanted ids (S18, S20, R19, H13): a semi join, so a long list is no long predicate."""
    found = rows.join(wanted.select(key).distinct(), key, "left_semi")
    return found.filter(live(F.col("is_deleted"))) if "is_deleted" in rows.columns else found


def by_collection(rows: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """Live rows of a collection, by id."""
    found = rows.filter((F.col("collection_name") == name) & live(F.col("is_deleted"))).orderBy("id")
    return found if most is None else found.limit(most)


def ids_where(rows: DataFrame, wanted: dict, kind: str = "") -> DataFrame:
    """Ids by metadata; a key that ends in __ne must differ, rows without it included."""
    same = {k: v for k, v in wanted.items() if not k.endswith("__ne")}
    where = metadata_equals(F.col("metadata"), same, kind)
    for k, v in wanted.items():
        if k.endswith("__ne"):
            where = where & F.coalesce(F.element_at("metadata", F.lit(k[:-4])) != str(v), F.lit(True))
    return rows.filter(where).select("id")


def batch_ids(rows: DataFrame, batch: str) -> DataFrame:
    """Distinct non-blank ids of a batch's live rows."""
    return rows.filter((F.col("batch_id") == batch) & live(F.col("is_deleted")) & (F.trim(F.col("id").cast("string")) != "")).select("id").distinct()


def keys_like(rows: DataFrame, pattern: str, key: str = "key") -> DataFrame:
    """Rows whose key fits a * pattern."""
    return rows.filter(F.col(key).like(pattern.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_").replace("*", "%")))


def find(rows: DataFrame, criteria: dict | None = None, key: str = "id", skip: int = 0, most: int | None = None) -> DataFrame:
    """Rows that equal all criteria, newest key first."""
    for c, v in (criteria or {}).items():
        rows = rows.filter(F.col(c).isNull() if v is None else F.col(c) == v)
    rows = rows.orderBy(F.col(key).desc())
    rows = rows.offset(skip) if skip else rows
    return rows if most is None else rows.limit(most)


def exists(rows: DataFrame, criteria: dict) -> bool:
    """Whether any row equals the criteria."""
    return not find(rows, criteria).isEmpty()


def device_data(payload: Column) -> Column:
    """The data of a device answer, an object or the first of a list, as JSON text."""
    data = F.get_json_object(payload, "$.data")
    return F.when(data.startswith("["), F.get_json_object(payload, "$.data[0]")).otherwise(data)


def upload_errors(files: DataFrame, kind: str, most_bytes: int = 10 << 20) -> DataFrame:
    """files (name, size) with what speaks against each: name, suffix or size; null if nothing."""
    from .filters import EXTENSIONS

    bad = F.when(F.trim(F.coalesce("name", F.lit(""))) == "", "no_name").when(~T.suffix(F.col("name")).isin(*EXTENSIONS[kind]), "suffix").when(F.col("size") > most_bytes, "too_large").when(F.coalesce("size", F.lit(0)) == 0, "empty")
    return files.withColumn("problem", bad)


def postings(docs: DataFrame, key: str = "id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(term, id, tf) and (id, dl): the inverted index as tables (K04). Terms are counted within a text before the shuffle."""
    from .search import tokens

    rows = docs.select(key, tokens(F.col(text)).alias("_tokens"))
    terms = rows.select(key, F.explode("_tokens").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    return terms.select("term", key, "tf"), rows.select(key, F.size("_tokens").alias("dl"))


def records_with_files(records: DataFrame, files: DataFrame) -> DataFrame:
    """Records with their file's columns."""
    return records.join(files.withColumnRenamed("id", "file_id"), "file_id")


def batch_collections(items: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Every collection that a batch or its items name."""
    names = items.select(batch, F.explode(F.array("batch_collection", "item_collection")).alias("collection"))
    return names.filter(F.trim("collection") != "").distinct()


def toc_items(links: DataFrame) -> DataFrame:
    """Contents items of link rows (doc_id, title_text, target_page): number, title, page code."""
    s = T.section_and_title(F.col("title_text"))
    return links.select("doc_id", s["section_number"].alias("section_number"), s["title"].alias("title"), "target_page", T.page_code(F.col("title_text")).alias("toc_page_code"))


def slices(toc: DataFrame, quality: DataFrame, docs: DataFrame, least: int = 60, size: int = 5) -> DataFrame:
    """Chapter slices where the contents' score is good enough, fixed ones elsewhere.

    toc: (doc_id, title, page_start, total_pages); quality: (doc_id, score); docs: (doc_id, total_pages).
    """
    from .chunking import fixed_slices, slice_ranges

    good = quality.filter(F.col("score") >= least).select("doc_id")
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_start"))
    a = slice_ranges(toc.join(good, "doc_id", "left_semi")).withColumn("slice_id", F.format_string("section_%04d", n)).withColumn("is_fallback", F.lit(False))
    b = fixed_slices(docs.join(good, "doc_id", "left_anti"), size=size).withColumn("is_fallback", F.lit(True))
    return a.select("doc_id", "slice_id", "page_start", "page_end", "is_fallback").unionByName(b)


def chapter_records(chapters: DataFrame, collection: str) -> DataFrame:
    """Chapters as records keyed by slice."""
    return chapters.select("doc_id", F.col("slice_id").alias("local_key"), F.lit(collection).alias("collection_name"), F.lit("chapter").alias("chunk_type"), F.col("title").alias("text"), "page_start", "page_end")


def split_metadata(values: Column, known: tuple[str, ...]) -> tuple[Column, Column]:
    """(known options, free entries) of a form's metadata."""
    return M.only(values, known), M.without(values, known)


def knowledge_node(rows: DataFrame, field: str, level: Column) -> DataFrame:
    """Rows (id, text, metadata) as graph nodes with fixed tags, then the metadata as text, tonnage as a whole number."""
    tags = F.create_map(F.lit("field"), F.lit(field), F.lit("permission_level"), level.cast("string"), F.lit("is_deleted"), F.lit("false"))
    whole = F.transform_values("metadata", lambda k, v: F.when(k == "tonnage", M.tonnage(v).cast("string")).otherwise(v))
    return rows.select("id", F.lit(field).alias("type"), F.col("text").alias("name"), F.to_json(M.merged(tags, whole)).alias("metadata"))


def node_metadata(text: Column) -> Column:
    """A node's metadata map; empty for none or broken JSON."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def fault_pairs(rows: DataFrame, fault: str, solution: str) -> tuple[DataFrame, DataFrame]:
    """Raw nodes and edges of fault and solution rows (R25): one node a distinct text, rows without a fault are skipped."""
    some = rows.filter(F.trim(F.col(fault)) != "")
    node = lambda c, kind: some.select(F.sha1(F.concat(F.lit(kind), F.trim(F.col(c)))).alias("id"), F.lit(kind).alias("type"), F.trim(F.col(c)).alias("name")).filter("name <> ''").distinct()
    key = lambda c, kind: F.sha1(F.concat(F.lit(kind), F.trim(F.col(c))))
    edges = some.filter(F.trim(F.col(solution)) != "").select(key(fault, "RawFault").alias("src"), key(solution, "RawSolution").alias("dst"), F.lit("HAS_SOLUTION").alias("type")).distinct()
    return node(fault, "RawFault").unionByName(node(solution, "RawSolution")), edges


def utc(x: Column, zone: str = "UTC") -> Column:
    """A timestamp from ISO text, epoch seconds, or local time of a zone (X19); null if it is none."""
    text = F.trim(x.cast("string"))
    seconds = text.try_cast("double")
    return F.when(seconds.isNotNull(), F.timestamp_millis((seconds * 1000).cast("long"))).otherwise(F.to_utc_timestamp(text.try_cast("timestamp"), zone))


def groups_of(items: Column, size: int = 500) -> Column:
    """An array cut into arrays of at most size (X20). items may be any expression: it is computed once, not for each group."""

    def cut(own: Column) -> Column:
        n = F.ceil(F.size(own) / size).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(own, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<array<string>>"))

    return F.get(F.transform(F.array(items), cut), 0)


def stored_images(records: DataFrame, links: DataFrame) -> DataFrame:
    """Records with the images of their page range, stored links first."""
    met = records.join(links, (records["doc_id"] == links["document_id"]) & links["page_num"].between(records["page_start"], records["page_end"]), "left")
    return met.groupBy(records["id"]).agg(F.array_sort(F.collect_set("image_id")).alias("image_ids"))


def comparable(x: Column) -> Column:
    """What two values are compared by."""
    return F.trim(x.cast("string"))
