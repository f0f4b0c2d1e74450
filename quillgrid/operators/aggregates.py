"""Aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def folder_counts(docs: DataFrame, path: str = "folder_path") -> DataFrame:
    """(prefix, depth, document_count, direct_document_count) of every folder prefix, the root included."""
    rows = docs.select(F.col(path).alias("_path"), F.explode(F.transform(F.sequence(F.lit(0), F.size(path)), lambda n: F.slice(path, 1, n))).alias("prefix"))
    # rows of one prefix are summed before the shuffle, so a folder that holds most documents is no hot group
    return rows.groupBy("prefix").agg(F.size(F.first("prefix")).alias("depth"), F.count("*").alias("document_count"), F.count_if(F.size("_path") == F.size("prefix")).alias("direct_document_count"))


def batch_status(items: DataFrame, batch: str = "batch_id", status: str = "status", progress: str = "progress") -> DataFrame:
    """Counters, derived status and progress of each batch."""
    s = F.col(status)
    out = items.groupBy(batch).agg(
        F.count("*").alias("total"),
        *[F.count_if(s == x).alias(x) for x in ("pending", "running", "done", "failed")],
        F.floor(F.avg(F.least(F.greatest(F.coalesce(F.col(progress), F.lit(0)), F.lit(0)), F.lit(100)))).cast("int").alias("_mean"),
    )
    state = F.when(F.col("failed") == F.col("total"), "failed").when(F.col("done") == F.col("total"), "done").when((F.col("running") > 0) | (F.col("pending") > 0), "running").when(F.col("failed") > 0, "partial").otherwise("unknown")
    return out.withColumn("status", state).withColumn("progress", F.when(state == "done", 100).otherwise(F.least("_mean", F.lit(99)))).drop("_mean")


def task_progress(step: Column, steps: Column, part: Column, parts: Column, status: Column) -> Column:
    """Whole percent of a task: done steps and the fraction of the current one, 0 to 99; done is 100."""
    fraction = F.when(parts > 0, F.least(part / parts, F.lit(1.0))).otherwise(0.0)
    percent = F.when(steps > 0, ((F.greatest(step - 1, F.lit(0)) + fraction) * 100 / steps).cast("int")).otherwise(0)
    return F.when(status == "done", 100).otherwise(F.least(F.greatest(percent, F.lit(0)), F.lit(99)))


#: Which item of a batch stands for it.
ACTIVE_RANK = {"running": 0, "pending": 1, "failed": 2, "done": 3}


def active_item(items: DataFrame, batch: str = "batch_id", status: str = "status", position: str = "position", item: str = "item_id") -> DataFrame:
    """The item of the foremost status, the first of its list."""
    rank = F.coalesce(*(F.when(F.col(status) == s, n) for s, n in ACTIVE_RANK.items()), F.lit(9))
    return items.groupBy(batch).agg(F.min_by(item, F.struct(rank, F.col(position))).alias("active_item"))


def ingest_verdict(rows: DataFrame, file: str, ok: Column) -> DataFrame:
    """(file, total, written, failed, status, success) of each file (A07, K07): active, partial or failed; over half failed is no success."""
    out = rows.groupBy(file).agg(F.count("*").alias("total"), F.count_if(ok).alias("written"))
    failed = F.greatest(F.col("total") - F.col("written"), F.lit(0))
    status = F.when(F.col("written") == 0, "failed").when(failed > 0, "partial").otherwise("active")
    return out.select(file, "total", "written", failed.alias("failed"), status.alias("status"), (failed * 2 < F.col("total")).alias("success"))


def counts_by(df: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """One row with the count of each value."""
    return df.agg(*[F.count_if(F.col(column) == v).alias(v) for v in values], F.count("*").alias("total"))


def token_usage(df: DataFrame, model: str = "model", *sums: str) -> DataFrame:
    """Totals by model and over all (model null, grand 1) (A10)."""
    return df.groupingSets([[model], []], model).agg(F.grouping(model).alias("grand"), F.count("*").alias("calls"), *[F.sum(c).alias(c) for c in sums])


def distinct_in_order(df: DataFrame, value: str, position: str) -> DataFrame:
    """Each value once with its first position."""
    return df.groupBy(value).agg(F.min(position).alias(position))


def merged_models(df: DataFrame, key: str, models: str = "models") -> DataFrame:
    """Sorted union of comma lists by key, and how many rows were merged (A16, U03). Lists are exploded and deduplicated before the shuffle."""
    parts = df.select(key, F.explode_outer(F.transform(F.split(models, ","), lambda x: F.trim(x))).alias("_m")).filter("_m is null or _m <> ''")
    names = parts.groupBy(key, "_m").agg(F.count("*").alias("_n")).groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("_m")), ",").alias("models"))
    counts = df.groupBy(key).agg(F.count("*").alias("merge_count"))
    return counts.join(names, key, "left").select(key, F.coalesce("models", F.lit("")).alias("models"), "merge_count")


def deleted_count(*counts: Column) -> Column:
    """The largest of the stores' counters."""
    return F.greatest(*[F.coalesce(c.cast("long"), F.lit(0)) for c in counts], F.lit(0))


def item_tasks(items: DataFrame, key: str = "batch_id", history: str = "task_history") -> DataFrame:
    """Distinct task ids of each batch in order of first use."""
    rows = items.select(key, "position", F.posexplode(history).alias("_p", "task"))
    first = rows.groupBy(key, "task").agg(F.min(F.struct("position", "_p")).alias("_at"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "task"))), lambda x: x["task"]).alias("task_ids"))


def controller_types(values: Column) -> Column:
    """A parameter row's controller type under either name."""
    return F.coalesce(F.element_at(values, F.lit("controller_type")), F.element_at(values, F.lit("控制器型号")))


def ids_by_collection(df: DataFrame, collection: str = "collection_name", key: str = "id") -> DataFrame:
    """How many distinct ids each collection would lose."""
    return df.select(collection, key).distinct().groupBy(collection).agg(F.count("*").alias("documents"))


#: Seconds up to which a request is of each speed.
SPEEDS = ((0.5, "fast"), (2.0, "normal"), (5.0, "slow"), (10.0, "very_slow"))


def speed(seconds: Column) -> Column:
    """Performance band of a duration."""
    out = F.lit("critical")
    for most, name in reversed(SPEEDS):
        out = F.when(seconds <= most, name).otherwise(out)
    return F.when(seconds.isNotNull(), out)


def toc_quality(toc: DataFrame, total: str = "total_pages", doc: str = "doc_id", page: str = "target_page", least: int = 3, most_span: int = 30) -> DataFrame:
    """Score 0 to 100 of each document's contents (A11): items, rising pages, coverage, oversized sections."""
    from pyspark.sql import Window

    w = Window.partitionBy(doc).orderBy("position")
    rows = toc.filter(F.col(page).between(1, F.col(total)))
    nxt = F.lead(page).over(w)
    rows = rows.withColumn("_up", F.when(nxt.isNotNull(), (nxt > F.col(page)).cast("int"))).withColumn("_span", F.greatest(F.coalesce(nxt, F.col(total) + 1) - F.col(page), F.lit(1)))
    g = rows.groupBy(doc).agg(
        F.coalesce(F.avg("_up"), F.lit(1.0)).alias("rising"),
        ((F.max(page) - F.min(page) + 1) / F.greatest(F.max(total), F.lit(1))).alias("coverage"),
        F.avg((F.col("_span") > most_span).cast("int")).alias("oversized"),
    )
    g = toc.groupBy(doc).agg(F.count("*").alias("items")).join(g, doc, "left")
    score = F.when(F.col("items") >= least, 30).otherwise(10) + F.when(F.col("rising") > 0.95, 25).when(F.col("rising") > 0.8, 15).otherwise(5)
    score = score + F.when(F.col("coverage").between(0.08, 0.95), 20).otherwise(10) + F.when(F.col("oversized") <= 0.2, 25).when(F.col("oversized") <= 0.4, 10).otherwise(0)
    return g.select(doc, "items", F.when(F.col("rising").isNull(), 0).otherwise(score).alias("score"))


def slice_alerts(slices: DataFrame, doc: str = "doc_id", large: int = 30) -> DataFrame:
    """Flags and level of each document's slices (A12): fallback used, missing range, oversized."""
    span = F.col("page_end") - F.col("page_start") + 1
    g = slices.groupBy(doc).agg(
        F.max(F.coalesce(F.col("is_fallback"), F.lit(False))).alias("_fallback"),
        F.count_if(F.col("page_start").isNull() | F.col("page_end").isNull()).alias("missing"),
        F.max(span).alias("max_span"),
        (F.count_if(span > large) / F.count("*")).alias("large_ratio"),
    )
    flags = F.array_compact(F.array(F.when(F.col("_fallback"), "fallback"), F.when(F.col("missing") > 0, "missing_range"), F.when(F.col("max_span") > 2 * large, "oversized"), F.when(F.col("large_ratio") > 0.3, "many_large")))
    return g.select(doc, "missing", "max_span", "large_ratio", flags.alias("flags"), F.when(F.size(flags) == 0, "ok").when(F.size(flags) == 1, "warn").otherwise("alert").alias("level"))
