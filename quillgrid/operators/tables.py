"""Mutations as table rewrites: upsert, soft and hard delete, latest batch, registries, reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids as I
from ..functions import metadata as M
from ..functions import text as T


def upsert(old: DataFrame, new: DataFrame, *keys: str, order: str | None = None) -> DataFrame:
    """old without the keys of new, and new.

    Of equal keys in new the last one by order stays, ties and no order by the greatest other columns, so that reruns
    agree. Rows with a null key are neither replaced nor merged.
    """
    rest = [c for c in new.columns if c not in keys]
    if rest:
        sortable = [c for c in rest if not dict(new.dtypes)[c].startswith(("map", "variant")) and "map<" not in dict(new.dtypes)[c]]
        by = F.struct(*([F.col(order)] if order else []), *[F.col(c) for c in sortable], F.lit(0).alias("_"))
        keyed = new.dropna(subset=list(keys)).groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
    else:
        keyed = new.dropna(subset=list(keys)).distinct()
    unkeyed = new.filter(" or ".join(f"`{k}` is null" for k in keys)).select(*keyed.columns)
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(keyed.unionByName(unkeyed), allowMissingColumns=True)


def upsert_counts(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """How many keys of new would be inserted and how many replaced."""
    a, b = old.select(*keys).distinct().withColumn("_old", F.lit(1)), new.select(*keys).distinct()
    return b.join(a, list(keys), "left").agg(F.count_if(F.col("_old").isNull()).alias("inserted"), F.count("_old").alias("replaced"))


def update(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows with the non-null fields of changes (K22, K24, K26); keys only in changes are added."""
    fields = [c for c in old.columns if c != key]
    b = changes.select(key, *[F.col(c).alias(f"_{c}") for c in fields if c in changes.columns])
    out = old.join(b, key, "full_outer")
    return out.select(key, *[F.coalesce(f"_{c}", c).alias(c) if c in changes.columns else F.col(c) for c in fields])


def hard_delete(rows: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not in gone."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def soft_delete(rows: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """Rows with is_deleted set for the keys in gone; the others keep theirs, absent being false."""
    marks = gone.select(key).distinct().withColumn("_gone", F.lit(True))
    flag = F.coalesce("_gone", "is_deleted", F.lit(False)) if "is_deleted" in rows.columns else F.coalesce("_gone", F.lit(False))
    return rows.join(marks, key, "left").withColumn("is_deleted", flag).drop("_gone")


def batch_delete(rows: DataFrame, batch: str, batch_column: str = "batch_id") -> DataFrame:
    """Rows with is_deleted set for one batch."""
    return rows.withColumn("is_deleted", F.coalesce(F.col("is_deleted"), F.lit(False)) | F.coalesce(F.col(batch_column) == batch, F.lit(False)))


def residual(rows: DataFrame, batch: str, batch_column: str = "batch_id") -> DataFrame:
    """What of a batch is still live."""
    return rows.filter((F.col(batch_column) == batch) & ~F.coalesce("is_deleted", F.lit(False)))


def drop_collection(rows: DataFrame, name: str) -> DataFrame:
    """Rows of all other collections."""
    return rows.filter(F.coalesce(F.col("collection_name") != name, F.lit(True)))


def latest_batch_wins(rows: DataFrame, owner: str, batch_time: str) -> DataFrame:
    """rows with is_deleted set for all but each owner's newest batch (K18). The newest is an aggregate, so a large owner is no hot group.

    Rows without an owner stay live; a null time is older than any other.
    """
    newest = rows.groupBy(owner).agg(F.max(batch_time).alias("_newest"))
    return rows.join(newest, owner, "left").withColumn("is_deleted", F.coalesce(F.col(batch_time) < F.col("_newest"), F.col("_newest").isNotNull())).drop("_newest")


def records(chunks: DataFrame, collection: Column, source: Column, content: Column, model: Column, kind: str = "") -> DataFrame:
    """Chunks (text, metadata, local_key) as records with deterministic ids and normalised metadata."""
    digest = I.fingerprint(content)
    rows = chunks.withColumn("id", I.record_id(collection, source, digest, model, F.lit(""), F.col("local_key")))
    rows = rows.withColumn("collection_name", collection).withColumn("source_file", source).withColumn("metadata", M.normalised(F.col("metadata"), kind))
    return rows.withColumn("is_deleted", F.lit(False))


def file_records(files: DataFrame) -> DataFrame:
    """File registry listing: name fallbacks, status, previews, folder label."""
    name = F.coalesce(F.nullif(F.trim("original_name"), F.lit("")), F.nullif(F.trim("source_file"), F.lit("")), T.basename(F.col("file_path")), F.col("id").cast("string"))
    return files.select(
        "id",
        name.alias("filename"),
        F.when(F.coalesce("is_deleted", F.lit(False)), "archived").otherwise("active").alias("status"),
        T.truncated(F.col("text"), 100).alias("preview"),
        T.truncated(F.col("text"), 2000).alias("long_preview"),
        F.array_join("folder_path", " / ").alias("folder_label"),
        F.col("file_size").try_cast("long").alias("file_size"),
    )


def registry(rows: DataFrame) -> DataFrame:
    """Record registry rows: preview of 500 characters and business columns by their aliases."""
    pick = lambda *names: F.coalesce(*[M.filled(F.element_at("metadata", F.lit(n))) for n in names])
    return rows.select(
        "id",
        "file_id",
        F.substring("text", 1, 500).alias("chunk_text_preview"),
        pick("work_order_number", "派工单号").alias("work_order_number"),
        pick("fault_type", "故障类型").alias("fault_type"),
        pick("product_model", "产品型号").alias("product_model"),
    )


def preview(rows: DataFrame, most: int = 20000) -> DataFrame:
    """What a file's preview shows: steps, JSON, file text, content, or a download."""
    kind = F.when(F.size("steps") > 0, "steps").when(F.try_parse_json("content").isNotNull(), "json").when(F.length("file_text") > 0, "text").when(F.length("content") > 0, "content").otherwise("download")
    body = F.when(kind == "text", F.substring("file_text", 1, most)).when(kind.isin("json", "content"), F.substring("content", 1, most))
    return rows.select("id", kind.alias("kind"), body.alias("body"), F.coalesce((F.length(F.coalesce(F.when(kind == "text", F.col("file_text")), F.col("content"))) > most), F.lit(False)).alias("truncated"))


def citations(hits: DataFrame, query: str = "query_id", most: int = 200) -> DataFrame:
    """A query's hits as citation structs, best first."""
    item = F.struct((-F.col("score")).alias("_o"), "id", T.truncated(F.col("text"), most).alias("text"), "source_file", "score")
    return hits.groupBy(query).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.dropFields("_o")).alias("citations"))


#: Metadata keys that callers may not set.
RESERVED = ("id", "vector", "text", "chunk_raw_text", "is_deleted")


def upload_metadata(base: Column, given: Column) -> tuple[Column, Column]:
    """(merged metadata, reserved keys that were given)."""
    return M.merged(base, M.without(given, RESERVED)), F.filter(F.map_keys(given), lambda k: k.isin(*RESERVED))


def graph_records(chunks: DataFrame) -> DataFrame:
    """Chunks (id, slice_id, summary, entities, relations) as one summary, entity and relation row each (P05, U06); blanks are skipped."""
    some = lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""
    base = chunks.select("id", F.col("slice_id").alias("local_key"), F.lit("summary").alias("kind"), F.col("summary").alias("text"))
    base = base.withColumn("local_key", F.concat("local_key", F.lit("|summary")))
    e = chunks.select("id", "slice_id", F.posexplode("entities").alias("_n", "_e")).filter(some(F.col("_e.name")))
    e = e.select("id", F.concat("slice_id", F.lit("|entity|"), "_e.name").alias("local_key"), F.lit("entity").alias("kind"), T.graph_text(F.col("_e.name"), F.col("_e.description")).alias("text"))
    r = chunks.select("id", "slice_id", F.posexplode("relations").alias("_n", "_r")).filter(some(F.col("_r.src")) & some(F.col("_r.tgt")))
    r = r.select("id", F.concat("slice_id", F.lit("|relation|"), F.col("_n").cast("string")).alias("local_key"), F.lit("relation").alias("kind"), F.concat_ws(" ", "_r.src", "_r.rel", "_r.tgt").alias("text"))
    return base.unionByName(e).unionByName(r).filter(some(F.col("text")))


def reconciliation(key: str, **stores: DataFrame) -> DataFrame:
    """Keys that some store lacks, with a flag for each store and the list of those that lack them."""
    rows = reduce(lambda a, b: a.unionByName(b), [df.select(F.col(key).alias("key"), F.lit(n).alias("_store")).distinct() for n, df in stores.items()])
    g = rows.groupBy("key").agg(*[F.max((F.col("_store") == n).cast("int")).alias(f"in_{n}") for n in stores])
    missing = F.array_compact(F.array(*[F.when(F.col(f"in_{n}") == 0, F.lit(n)) for n in stores]))
    return g.withColumn("missing", F.array_join(missing, ",")).filter("missing <> ''")


def schema_changes(old: DataFrame, new: DataFrame) -> dict[str, list[str]]:
    """Columns added, dropped and modified between two schemas (U05); driver-side, no data."""
    a, b = dict(old.dtypes), dict(new.dtypes)
    return {"added": sorted(b.keys() - a.keys()), "dropped": sorted(a.keys() - b.keys()), "modified": sorted(k for k in a.keys() & b.keys() if a[k] != b[k])}


def column_changes(old: DataFrame, new: DataFrame, key: str = "table_name") -> DataFrame:
    """(key, name, change) between two column registries (key, name, type): added, dropped or modified (U05). Rows given twice count once."""
    a = old.select(key, "name", F.col("type").alias("_old")).distinct()
    b = new.select(key, "name", F.col("type").alias("_new")).distinct()
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "dropped").when(F.col("_old") != F.col("_new"), "modified")
    return a.join(b, [key, "name"], "full").select(key, "name", change.alias("change")).filter("change is not null")


def page_images(records_: DataFrame, key: str = "id") -> DataFrame:
    """(key, page_num) of records with a page range; blank and non-positive ones are skipped, reversed ones are an error."""
    ok = records_.filter((F.col("page_start") > 0) & (F.col("page_end") > 0))
    last = F.when(F.col("page_end") < F.col("page_start"), F.raise_error(F.lit("a page range is reversed")).cast("int")).otherwise(F.col("page_end"))
    return ok.select(key, F.explode(F.sequence(F.col("page_start"), last)).alias("page_num"))


def dedup_numbered(rows: DataFrame, *by: str) -> DataFrame:
    """The first row of each key by `position`."""
    w = Window.partitionBy(*by).orderBy("position")
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
