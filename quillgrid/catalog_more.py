"""Further registered queries: sources, chunk ranges, record projections, mutations, lookups and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import _ITEMS, _TOC, _doc_pages, _items, _records, _t, _toc, query
from .functions import ids, metadata, models, text
from .functions import json as J
from .operators import aggregates, chats, chunking, filters, graph, joins, ranking, tables, tasks
from .sources import readers


@query("""SELECT 'row:' || event_id AS local_key, 'event_type: ' || event_type || chr(10) || 'props: ' || props AS text, user_id::VARCHAR AS owner FROM events""")
def table_row_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a sheet as labelled text with metadata."""
    e = _t(spark, sf_dir, "events").select("event_id", "event_type", "props", "user_id")
    c = filters.filled_rows(readers.table_chunks(e, ("event_type", "props"), "event_id"), "text", ("event_type", "props"))
    return c.select("local_key", "text", F.element_at("metadata", F.lit("user_id")).alias("owner"))


@query("""SELECT event_type AS text, props || '://page/' || user_id AS url FROM events WHERE trim(event_type) <> ''""")
def parameter_row_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S06."""
    c = readers.parameter_chunks(_t(spark, sf_dir, "events"), "event_type", "props", "user_id")
    return c.select("text", F.element_at("metadata", F.lit("url")).alias("url"))


@query()
def virtual_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy packing depends on what came before; the tests hold it to fixed cases."""
    return chunking.virtual_pages(_t(spark, sf_dir, "documents")).select("doc_id", "page", F.length("text").alias("n"))


@query(f"""WITH {_TOC}, b AS (SELECT doc_id, 's' || page_start AS slice_id, page_start AS a, greatest(total_pages, page_start) AS z FROM toc),
x AS (SELECT *, unnest(CASE WHEN z - a + 1 > 6 THEN generate_series(a, z, 4) ELSE [a] END) AS s FROM b), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, slice_id ORDER BY s) AS k FROM x)
SELECT doc_id, CASE WHEN z - a + 1 > 6 THEN slice_id || '_part' || k ELSE slice_id END AS slice_id, s::INTEGER AS page_start, (CASE WHEN z - a + 1 > 6 THEN least(s + 3, z) ELSE z END)::INTEGER AS page_end FROM n""")
def long_chapters_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W09."""
    c = _toc(spark, sf_dir).select("doc_id", F.concat(F.lit("s"), "page_start").alias("slice_id"), "page_start", F.greatest("total_pages", "page_start").alias("page_end"))
    return chunking.split_long(c, threshold=6, size=4)


@query(f"""WITH {_TOC}, n AS (SELECT *, lead(page_start) OVER (PARTITION BY doc_id ORDER BY page_start) AS nx FROM toc)
SELECT doc_id, page_start::INTEGER AS page_start, least(CASE WHEN nx IS NOT NULL THEN greatest(nx - 1, page_start) ELSE least(total_pages, page_start + 29) END, page_start + 79)::INTEGER AS page_end FROM n""")
def slice_page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W10."""
    return chunking.slice_ranges(_toc(spark, sf_dir)).select("doc_id", "page_start", "page_end")


@query(f"""WITH {_TOC} SELECT doc_id, (page_start // 2)::INTEGER AS target_page, min(position)::INTEGER AS position FROM toc WHERE page_start // 2 BETWEEN 1 AND total_pages GROUP BY doc_id, page_start // 2""")
def rising_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W03."""
    t = _toc(spark, sf_dir).withColumn("target_page", F.floor(F.col("page_start") / 2).cast("int"))
    return chunking.rising_only(t).select("doc_id", "target_page", "position")


@query("""SELECT doc_id, printf('chunk_%04d', k) AS slice_id, (5 * k - 4)::INTEGER AS page_start, least(5 * k, n)::INTEGER AS page_end
FROM (SELECT doc_id, n, unnest(generate_series(1, (n + 4) // 5)) AS k FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents))""")
def fallback_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11."""
    d = _t(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("total_pages"))
    return chunking.fixed_slices(d)


@query("""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents), h AS (SELECT doc_id, page, len(string_split(l, ',')) - 1 >= 2 AS hit FROM p WHERE page <= 10),
r AS (SELECT doc_id, page, page - row_number() OVER (PARTITION BY doc_id ORDER BY page) AS run FROM h WHERE hit), f AS (SELECT doc_id, min(run) AS run FROM r GROUP BY doc_id)
SELECT doc_id, page::INTEGER AS page FROM r JOIN f USING (doc_id, run) UNION ALL SELECT doc_id, page::INTEGER FROM p WHERE page <= 5 AND doc_id NOT IN (SELECT doc_id FROM f)""")
def contents_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commas stand for links."""
    p = _doc_pages(spark, sf_dir).withColumn("links", F.size(F.split("text", ",")) - 1)
    return chunking.toc_pages(p, least=2)


@query(r"""WITH t AS (SELECT doc_id, trim(regexp_replace(string_split(text, chr(10))[1], '\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(t, '^(.+?)\s*(?:[._·…-]{2,}|\s{2,})\s*([IVXLCDMivxlcdm]+|\d+(?:[.\-]\d+){0,6})\s*$') THEN 'leader'
 WHEN regexp_matches(t, '^((?:\d+[.\-])*\d+)\s*[\)\]】）\.、:\-]?\s*(.+)$') THEN trim(regexp_extract(t, '^((?:\d+[.\-])*\d+)\s*[\)\]】）\.、:\-]?\s*(.+)$', 1))
 WHEN regexp_matches(t, '^([IVXLCDMivxlcdm]+)\s*[\)\]】）\.、:\-]?\s*(.+)$') THEN trim(regexp_extract(t, '^([IVXLCDMivxlcdm]+)\s*[\)\]】）\.、:\-]?\s*(.+)$', 1)) ELSE '' END AS section_number FROM t""")
def contents_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section numbers of first lines (leader lines are marked)."""
    x = F.split("text", "\n")[0]
    d = _t(spark, sf_dir, "documents").select("doc_id", text.section_and_title(x).alias("s"), text.toc_text(x).rlike(text.TOC_LINES[1][0]).alias("leader"))
    return d.select("doc_id", F.when(F.col("leader"), "leader").otherwise(F.col("s.section_number")).alias("section_number"))


@query("""SELECT doc_id, doc_id % 4 IN (1, 3) AS has_visual_content FROM documents""")
def visual_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C13."""
    kinds = F.array(F.lit("toc"), F.lit("drawing"), F.lit("description"), F.lit("mixed"))
    d = _t(spark, sf_dir, "documents").select("doc_id", F.array(F.lit("toc"), F.get(kinds, (F.col("doc_id") % 4).cast("int"))).alias("page_types"))
    return chunking.visual_windows(d).select("doc_id", "has_visual_content")


@query("""WITH g AS (SELECT user_id, bool_or(event_id % 50 = 0) AS fb, count(*) FILTER (value IS NULL) AS missing, max(floor(value)::INTEGER + 1) AS max_span, count(*) FILTER (floor(value) + 1 > 30) / count(*) AS large_ratio FROM events GROUP BY user_id),
f AS (SELECT *, fb::INT + (missing > 0)::INT + (max_span > 60)::INT + (large_ratio > 0.3)::INT AS k FROM g)
SELECT user_id, max_span, round(large_ratio, 6) AS large_ratio, CASE k WHEN 0 THEN 'ok' WHEN 1 THEN 'warn' ELSE 'alert' END AS level FROM f""")
def slice_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12."""
    s = _t(spark, sf_dir, "events").select("user_id", F.lit(1).alias("page_start"), (F.floor("value") + 1).cast("int").alias("page_end"), (F.col("event_id") % 50 == 0).alias("is_fallback"))
    return aggregates.slice_alerts(s, "user_id").select("user_id", "max_span", F.round("large_ratio", 6).alias("large_ratio"), "level")


@query(f"""WITH {_ITEMS}, x AS (SELECT batch_id, position, unnest(['t' || position % 7, 't' || position % 3]) AS task, unnest([0, 1]) AS p FROM items), f AS (SELECT batch_id, task, min(position * 10 + p) AS pos FROM x GROUP BY ALL)
SELECT batch_id, string_agg(task, ',' ORDER BY pos) AS task_ids FROM f GROUP BY batch_id""")
def batch_task_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18, A19."""
    i = _items(spark, sf_dir).withColumn("task_history", F.array(F.concat(F.lit("t"), F.col("position") % 7), F.concat(F.lit("t"), F.col("position") % 3)))
    return aggregates.item_tasks(i).select("batch_id", F.array_join("task_ids", ",").alias("task_ids"))


@query(f"""WITH {_ITEMS} SELECT count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed, count(*) AS total FROM items""")
def extraction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A08, A09."""
    return aggregates.counts_by(_items(spark, sf_dir), "status", ("done", "failed"))


@query("""SELECT source AS collection_name, count(DISTINCT doc_id) AS documents FROM documents GROUP BY source""")
def collection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S22, A21, K15."""
    return aggregates.ids_by_collection(_records(spark, sf_dir, False))


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN 'archived' ELSE 'active' END AS status, 'f' || doc_id || '.txt' AS filename, lang || ' / ' || source || ' / d' || (doc_id % 3) AS folder_label, CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS preview FROM documents""")
def file_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File listing rows with their fallbacks."""
    r = _records(spark, sf_dir, False).withColumns({"original_name": F.lit(" "), "source_file": F.lit(None).cast("string"), "file_path": F.concat(F.lit("/up/f"), "id", F.lit(".txt")), "file_size": F.lit("x")})
    return tables.file_records(r).select("id", "status", "filename", "folder_label", "preview")


@query("""SELECT doc_id AS id, substring(text, 1, 500) AS chunk_text_preview, CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END AS fault_type FROM documents""")
def record_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K06."""
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("f").alias("file_id"), "text", F.create_map(F.lit("fault_type"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(" "), F.lit("故障类型"), F.col("source")).alias("metadata"))
    return tables.registry(d).select("id", "chunk_text_preview", "fault_type")


@query("""SELECT count(*) FILTER (doc_id % 2 <> 0) AS inserted, count(*) FILTER (doc_id % 2 = 0) AS replaced FROM (SELECT DISTINCT doc_id FROM labels)""")
def upsert_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K03."""
    old = _t(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select("doc_id")
    return tables.upsert_counts(old, _t(spark, sf_dir, "labels"), "doc_id")


@query("""SELECT doc_id, coalesce(CASE WHEN quality = 1 THEN 'good' END, lang) AS lang FROM documents LEFT JOIN labels USING (doc_id)""")
def partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null fields of a change leave what is there."""
    old = _t(spark, sf_dir, "documents").select("doc_id", "lang")
    new = _t(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").alias("lang"))
    return tables.update(old, new, "doc_id")


@query("""SELECT doc_id AS id FROM documents WHERE source = 'src3' AND doc_id % 7 <> 0""")
def batch_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of a batch is still live."""
    return tables.residual(_records(spark, sf_dir, False).withColumnRenamed("collection_name", "batch_id"), "src3").select("id")


@query("""SELECT l_orderkey AS src, l_partkey AS dst, min(l_linenumber) AS first_line FROM lineitem GROUP BY l_orderkey, l_partkey""")
def unique_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge keeps the properties of its first creation."""
    l = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit("HAS").alias("type"), F.col("l_linenumber").alias("created_at"))
    return graph.create_edges(l.filter("false"), l).select("src", "dst", F.col("created_at").alias("first_line"))


@query("""WITH e AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem))
SELECT l_orderkey AS fault_id, string_agg(n || '. ' || p_name, chr(10) ORDER BY n) AS solutions FROM e JOIN part ON p_partkey = l_partkey WHERE n <= 3 GROUP BY l_orderkey""")
def diagnosis_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered solutions, capped at three as the listing asks."""
    l = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("fault_id"), F.col("l_partkey").alias("solution_id")).distinct()
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("solution_id"), F.col("p_name").alias("solution"))
    return graph.diagnosis(l.join(p, "solution_id"), 3)


@query("""SELECT l_orderkey AS query_id, l_partkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY min(l_linenumber), l_partkey) AS number FROM lineitem GROUP BY l_orderkey, l_partkey""")
def short_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W08, P14."""
    l = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("id"), F.col("l_linenumber").alias("position"))
    return graph.numbered(l)


@query("""SELECT l_orderkey AS document_id, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS image_ids FROM lineitem GROUP BY l_orderkey""")
def document_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J18, R18."""
    l = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_partkey").alias("image_id"), F.col("l_linenumber").alias("sort_order"))
    return joins.gathered(l).select("document_id", F.array_join("image_ids", ",").alias("image_ids"))


@query("""SELECT doc_id, coalesce(CASE quality WHEN 1 THEN 'done' WHEN 0 THEN 'failed' END, 'unknown') AS status FROM documents LEFT JOIN labels USING (doc_id)""")
def items_with_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J12, J13."""
    states = _t(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "done").when(F.col("quality") == 0, "failed").alias("status"))
    return tasks.with_state(_t(spark, sf_dir, "documents").select("doc_id"), states, "doc_id")


@query("""SELECT event_id, event_type FROM events WHERE event_id % 10 < 4 ORDER BY CASE event_type WHEN 'click' THEN 0 ELSE 1 END, ts DESC, event_id LIMIT 40""")
def batch_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By rank of state, then newest first."""
    e = _t(spark, sf_dir, "events").filter(filters.batch_visible(F.when(F.col("event_id") % 10 < 4, "me"), "me", False))
    s = e.withColumn("status", F.when(F.col("event_type") == "click", "running").otherwise("done"))
    return s.orderBy(ranking.state_rank(F.col("status")), F.col("ts").desc(), "event_id").limit(40).select("event_id", "event_type")


@query("""SELECT event_id, coalesce(nullif(trim(event_type), ''), 'unknown') AS status, CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END::INTEGER AS current_step, (event_id % 3 = 0) AS has_error FROM events""")
def task_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String hashes with casts and defaults."""
    bad = F.col("event_id") % 3 == 0
    e = _t(spark, sf_dir, "events").select(F.col("event_id").alias("task_id"), F.col("event_type").alias("status"), F.when(bad, "x").otherwise(F.col("user_id").cast("string")).alias("current_step"), F.lit("9").alias("total_steps"), F.lit(" ").alias("step_name"), F.when(bad, "soon").otherwise("1.5").alias("elapsed_seconds"), F.lit("").alias("error"), F.lit("0").alias("cancel"))
    s = tasks.snapshot(e)
    return s.select(F.col("task_id").alias("event_id"), "status", "current_step", F.col("error").isNotNull().alias("has_error"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'connection' WHEN event_id % 4 = 1 THEN 'transient' WHEN event_id % 4 = 2 THEN 'too_large' ELSE 'fatal' END AS kind FROM events""")
def error_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E12, E15."""
    said = F.array(*[F.lit(x) for x in ("connection reset by peer", "read timed out", "payload too large", "bad value")])
    return _t(spark, sf_dir, "events").select("event_id", tasks.error_kind(F.get(said, (F.col("event_id") % 4).cast("int"))).alias("kind"))


@query("""SELECT event_id, (json_extract_string(props, '$.k'))::INTEGER AS k FROM events""")
def tolerant_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fenced, wrapped and broken JSON answers."""
    p = F.col("props")
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Here:\n```json\n"), p, F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("so "), F.regexp_replace(p, r"\}$", ",}"), F.lit(" done"))).otherwise(p)
    return _t(spark, sf_dir, "events").select("event_id", F.get_json_object(J.json_in(J.repaired(said)), "$.k").cast("int").alias("k"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN floor(value)::INTEGER END AS tons FROM events""")
def tonnage_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X18, X29."""
    x = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), F.col("value").cast("string"))).when(F.col("event_id") % 3 == 1, "nan").otherwise(" ")
    return _t(spark, sf_dir, "events").select("event_id", metadata.tonnage(x).alias("tons"))


@query("""SELECT event_id, 'controller_type,machine_type,x' AS keys FROM events""")
def renamed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X21, K25."""
    m = F.create_map(F.lit("机型"), F.col("event_type"), F.lit("控制器型号"), F.lit("c"), F.lit("x"), F.lit("y"))
    return _t(spark, sf_dir, "events").select("event_id", F.array_join(F.array_sort(F.map_keys(metadata.renamed(m))), ",").alias("keys"))


@query("""SELECT source AS collection, CASE WHEN source = 'src1' THEN 'manual' WHEN source = 'src2' THEN 'workorder_graph' ELSE '' END AS kind FROM (SELECT DISTINCT source FROM documents)""")
def collection_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M03, X30."""
    s = _t(spark, sf_dir, "documents").select("source").distinct()
    name = F.when(F.col("source") == "src1", "a_manual_total").when(F.col("source") == "src2", "Workorder_Graph-x").otherwise(F.concat("source", F.lit("_plain")))
    return s.select(F.col("source").alias("collection"), metadata.infer_type(F.lit(None).cast("string"), name).alias("kind"))


@query("""SELECT doc_id, md5('{"lang":"' || lang || '","source":"' || source || '"}') AS cache_key FROM documents""")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key of a request does not depend on the order of its fields."""
    m = F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"))
    return _t(spark, sf_dir, "documents").select("doc_id", ids.canonical_md5(m).alias("cache_key"))


@query("""SELECT doc_id, (nullif(regexp_extract(text, '[.!?]', 0), '') IS NOT NULL) AS ended, length(substring(trim(regexp_extract(text, '(?s)^\\s*(.*?[.!?。！？]|.+$)', 1)), 1, 200)) AS n FROM documents""")
def chunk_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offline summary is the first sentence."""
    d = _t(spark, sf_dir, "documents")
    return d.select("doc_id", (F.regexp_extract("text", "[.!?]", 0) != "").alias("ended"), F.length(models.summary(F.col("text"))).alias("n"))


@query("""SELECT c_custkey, arg_max(o_orderkey, o_orderdate::VARCHAR || lpad((1000000000 - o_orderkey)::VARCHAR, 12, '0')) AS o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'O' GROUP BY c_custkey""")
def active_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's newest active session."""
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderstatus") == "O").alias("is_active"))
    return chats.active_session(o).select(F.col("user_id").alias("c_custkey"), F.col("session_id").alias("o_orderkey"))


@query("""WITH s AS (SELECT doc_id, lang, (doc_id % 11) / 20.0 AS score FROM documents), t AS (SELECT lang, max(score) AS top FROM s GROUP BY lang) SELECT doc_id, lang FROM s JOIN t USING (lang) WHERE score >= 0.1 OR top <= 0""")
def rerank_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16."""
    s = _t(spark, sf_dir, "documents").select("doc_id", "lang", ((F.col("doc_id") % 11) / 20.0).alias("score"))
    return filters.reranked(s, "lang", "score").select("doc_id", "lang")


@query("""SELECT page_id, regexp_matches(lower(url), '\\.html$') AS accepted FROM pages""")
def accepted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by suffix."""
    name = text.suffix(F.regexp_replace("url", r"^\w+://[^/]*", ""))
    return _t(spark, sf_dir, "pages").select("page_id", (name == ".html").alias("accepted"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'gap' WHEN doc_id % 4 = 1 THEN 'empty' WHEN doc_id % 4 = 2 THEN 'too_deep' END AS problem FROM documents""")
def folder_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F20, H07."""
    k = F.col("doc_id") % 4
    levels = F.when(k == 0, F.array(F.lit("a"), F.lit(" "), F.lit("c"))).when(k == 1, F.array(F.lit(""))).when(k == 2, F.array(*[F.lit(x) for x in "abcd"])).otherwise(F.array("lang", "source"))
    return _t(spark, sf_dir, "documents").select("doc_id", filters.folder_errors(levels).alias("problem"))
