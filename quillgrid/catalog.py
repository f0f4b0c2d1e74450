"""Registered queries of the reference's own operators, each over whole tables, with DuckDB SQL for the same rows.

The test tables stand for the reference's stores: documents and embeddings are records, events are tasks and batches,
TPC-H keys are a property graph. Rules such as `doc_id % 4` give the columns that they lack.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ids, metadata, permissions, text, vectors
from .operators import aggregates, chats, chunking, filters, graph, joins, pages, postings, ranking, search, tables, tasks, tree
from .storage import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "vector_topk_filtered"


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


def _records(spark: SparkSession, sf_dir: str, vectors_too: bool = True) -> DataFrame:
    """Documents as records; with vectors, those that have one."""
    d = _t(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        "text",
        F.col("source").alias("collection_name"),
        F.col("source").alias("source_file"),
        F.nullif(F.col("doc_id") % 4, F.lit(0)).cast("int").alias("permission_level"),
        (F.col("doc_id") % 7 == 0).alias("is_deleted"),
        F.create_map(F.lit("语言"), F.col("lang"), F.lit("source"), F.col("source")).alias("metadata"),
        F.array("lang", "source", F.concat(F.lit("d"), (F.col("doc_id") % 3).cast("string"))).alias("folder_path"),
    )
    if not vectors_too:
        return d
    e = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return d.join(e, "id")


_RECORDS = """records AS (
  SELECT d.doc_id AS id, d.text, d.source AS collection_name, d.lang, nullif(d.doc_id % 4, 0) AS permission_level, d.doc_id % 7 = 0 AS is_deleted
  FROM documents d)"""
_VECTORS = _RECORDS + """, vecs AS (
  SELECT r.*, e.embedding::DOUBLE[] AS vector FROM records r JOIN embeddings e ON e.vec_id = r.id)"""
_Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1)"


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """One stated query vector."""
    return [float(x) for x in _t(spark, sf_dir, "embeddings").filter("vec_id = 1").select("embedding").first()[0]]


@query(f"""WITH {_VECTORS}
SELECT id, collection_name, round(list_dot_product(vector, {_Q}), 6) AS score FROM vecs
WHERE NOT is_deleted AND (permission_level IS NULL OR permission_level IN (2, 3)) AND lang IN ('en', 'fr') AND list_dot_product(vector, {_Q}) >= -0.5
ORDER BY list_dot_product(vector, {_Q}) DESC, id LIMIT 5""")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T01 with F02, F03, F06, F15: filters first, then exact top five."""
    where = filters.live(F.col("is_deleted")) & permissions.visible(F.col("permission_level"), permissions.allowed_levels(2)) & filters.metadata_equals(F.col("metadata"), {"language": ["en", "fr"]})
    best = ranking.vector_topk(_records(spark, sf_dir), _query_vector(spark, sf_dir), 5, where=where, least=-0.5)
    return best.select("id", "collection_name", F.round("score", 6).alias("score"))


@query("""SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS rank
FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 QUALIFY rank <= 5""")
def vector_topk_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every query vector, queries being the ids divisible by 100."""
    e = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = e.filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    best = ranking.vector_topk_many(e, q, 5)
    return best.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("""WITH p AS (SELECT a.vec_id AS id, b.vec_id AS stored_id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s
  FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id WHERE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.3)
SELECT e.vec_id AS id, arg_max(p.stored_id, p.s) AS stored_id, round(max(p.s), 6) AS similarity
FROM embeddings e LEFT JOIN p ON p.id = e.vec_id WHERE e.vec_id % 100 = 0 GROUP BY e.vec_id""")
def vector_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector of an id divisible by 100 with its nearest among all others."""
    e = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    best = joins.nearest(e.filter("id % 100 = 0"), e.withColumnRenamed("id", "stored_id"), 0.3, but_self=True)
    return best.select("id", "stored_id", F.round("similarity", 6).alias("similarity"))


@query("""WITH p AS (SELECT a.vec_id AS id, b.vec_id AS stored_id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s
  FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id AND a.label = b.label WHERE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.25)
SELECT e.vec_id AS id, coalesce(arg_max(p.stored_id, p.s), e.vec_id) AS final_id, count(p.s) = 0 AS is_new
FROM embeddings e LEFT JOIN p ON p.id = e.vec_id WHERE e.vec_id % 100 = 0 GROUP BY e.vec_id""")
def add_texts_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-equal rows among all others of the same label lend their id."""
    e = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return search.add_texts(e, e.filter("id % 100 = 0"), 0.25, same="label", but_self=True).select("id", "final_id", "is_new")


@query("""WITH s AS (SELECT label, vec_id, list_cosine_similarity(lag(embedding::DOUBLE[]) OVER w, embedding::DOUBLE[]) AS c FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
i AS (SELECT *, sum(CASE WHEN c >= 0.05 THEN 0 ELSE 1 END) OVER (PARTITION BY label ORDER BY vec_id) AS island FROM s)
SELECT label, island::BIGINT AS island, count(*) AS n, min(vec_id) AS first_id FROM i GROUP BY ALL""")
def semantic_merge_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Islands of similar neighbours."""
    rows = chunking.similar_islands(_t(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 0.05)
    return rows.groupBy("label", "island").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"))


@query("""SELECT vec_id, round(list_aggregate([x * x for x in v], 'sum'), 6) AS squared, round(v[1], 6) AS head
FROM (SELECT vec_id, [x / sqrt(list_aggregate([y * y for y in e], 'sum')) for x in e] AS v FROM (SELECT vec_id, [2.0 * x for x in embedding::DOUBLE[]] AS e FROM embeddings))""")
def l2_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X14, X15."""
    e = _t(spark, sf_dir, "embeddings").select("vec_id", vectors.l2_normalise(F.transform("embedding", lambda x: x.cast("double") * 2)).alias("v"))
    return e.select("vec_id", F.round(vectors.dot(F.col("v"), F.col("v")), 6).alias("squared"), F.round(F.col("v")[0], 6).alias("head"))


_WORDS = "regexp_extract_all(lower(text), '[0-9a-zà-öø-ÿ]+|[一-鿿]')"


def _bm25_sql(terms: list[str], source: str) -> str:
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(terms)))
    some = " OR ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""w AS (SELECT id, {_WORDS} AS w FROM {source}), c AS (SELECT id, len(w) AS dl, {tf} FROM w),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM c), hits AS (SELECT id, {score} AS score FROM c, st WHERE {some})"""


@query(f"""WITH {_RECORDS}, {_bm25_sql(["thing", "of", "leau"], "records")}
SELECT id, round(score, 5) AS score FROM hits ORDER BY round(score, 9) DESC, id LIMIT 20""")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R02, T12."""
    return search.bm25_topk(_records(spark, sf_dir, False), "Thing of LEAU", 20).select("id", F.round("score", 5).alias("score"))


_SEARCHES = ("Thing of LEAU", "der that", "est les, her nowhere", "zzz")


@query(" UNION ALL ".join(f"""SELECT * FROM (WITH {_RECORDS}, {_bm25_sql(re.findall("[a-z]+", q.lower()), "records")}
SELECT {i} AS search, id, round(score, 5) AS score FROM hits ORDER BY round(score, 9) DESC, id LIMIT 20)""" for i, q in enumerate(_SEARCHES)))
def postings_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several searches over stored postings of all documents."""
    index = postings.build(_records(spark, sf_dir, False).select("id", "text"))
    found = [postings.topk(index, q, 20).select(F.lit(i).alias("search"), F.col("key").alias("id"), F.round("score", 5).alias("score")) for i, q in enumerate(_SEARCHES)]
    return reduce(DataFrame.unionByName, found)


@query(f"""WITH {_RECORDS}, ok AS (SELECT * FROM records WHERE NOT is_deleted AND lang IN ('en', 'de') AND (permission_level IS NULL OR permission_level IN (2, 3))), {_bm25_sql(["der", "that"], "ok")}
SELECT id, round(score, 5) AS score FROM hits ORDER BY round(score, 9) DESC, id LIMIT 10""")
def postings_permission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored postings of all rows, searched among the permitted ones, whose statistics alone count."""
    records = _records(spark, sf_dir, False)
    allowed = records.filter(~F.col("is_deleted") & F.col("metadata")["语言"].isin("en", "de") & permissions.visible(F.col("permission_level"), permissions.allowed_levels(2))).select("id")
    found = postings.topk(postings.build(records.select("id", "text")), "der that", 10, allowed)
    return found.select(F.col("key").alias("id"), F.round("score", 5).alias("score"))


@query(f"""WITH {_RECORDS}, ok AS (SELECT * FROM records WHERE NOT is_deleted AND lang IN ('en', 'de') AND (permission_level IS NULL OR permission_level IN (2, 3))), {_bm25_sql(["der", "that"], "ok")}
SELECT h.id, round(h.score, 5) AS score, length(r.text) AS n FROM hits h JOIN records r USING (id) ORDER BY round(h.score, 9) DESC, h.id LIMIT 10""")
def full_text_permission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics over the permitted rows alone."""
    got = search.full_text_search(_records(spark, sf_dir, False), "der that", 10, {"language": ["en", "de", ""]}, permissions.allowed_levels(2))
    return got.select("id", F.round("score", 5).alias("score"), F.length("text").alias("n"))


@query(f"""WITH {_VECTORS}, live AS (SELECT * FROM vecs WHERE NOT is_deleted), {_bm25_sql(["that", "est"], "live")},
t AS (SELECT id, score FROM hits ORDER BY round(score, 9) DESC, id LIMIT 40), v AS (SELECT id, list_dot_product(vector, {_Q}) AS score FROM live ORDER BY score DESC, id LIMIT 40),
m AS (SELECT id, sum(x) AS weight FROM (SELECT id, 0.7 * score AS x FROM v UNION ALL SELECT id, 0.3 * score FROM t) GROUP BY id)
SELECT id, round(weight, 5) AS weight FROM m ORDER BY round(weight, 9) DESC, id LIMIT 20""")
def hybrid_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R04, J09, T06."""
    got = search.hybrid_search(_records(spark, sf_dir), "that est", _query_vector(spark, sf_dir), 20)
    return got.select("id", F.round("weight", 5).alias("weight"))


@query(f"""WITH {_VECTORS}, ok AS (SELECT * FROM vecs WHERE NOT is_deleted AND id NOT IN (1, 2)), {_bm25_sql(["her", "les"], "ok")},
t AS (SELECT id FROM hits ORDER BY round(score, 9) DESC, id LIMIT 40), v AS (SELECT id, list_dot_product(vector, {_Q}) AS score FROM ok WHERE list_dot_product(vector, {_Q}) >= 0.0 ORDER BY score DESC, id LIMIT 40),
b AS (SELECT v.*, v.id IN (SELECT id FROM t) AS verified FROM v)
SELECT id, round(score, 6) AS score, verified FROM b WHERE verified = (SELECT max(verified) FROM b) ORDER BY b.score DESC, id LIMIT 20""")
def two_bucket_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main search with text verification."""
    got = search.similarity_search(_records(spark, sf_dir), "her les", _query_vector(spark, sf_dir), 20, rejected=["1", "2", ""], least=0.0)
    return got.select("id", F.round("score", 6).alias("score"), "verified")


@query("""SELECT doc_id, lang, CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS preview
FROM documents WHERE doc_id % 7 <> 0 AND contains(lower(concat_ws(' ', doc_id::VARCHAR, source, substring(text, 1, 500))), 'src1') AND lower(lang) IN ('en') ORDER BY doc_id DESC LIMIT 25 OFFSET 25""")
def file_listing_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R13, F10, F13, F14, T07, P07."""
    r = _records(spark, sf_dir, False).withColumn("lang", F.col("folder_path")[0])
    rows = r.filter(filters.status_is(F.col("is_deleted"), "active") & filters.keyword("SRC1", F.col("id"), F.col("collection_name"), preview=F.col("text")) & filters.in_category(F.slice("folder_path", 1, 1), "EN"))
    return ranking.page(rows, 2, 25, F.col("id").desc()).select(F.col("id").alias("doc_id"), "lang", text.truncated(F.col("text"), 100).alias("preview"))


@query("SELECT doc_id, nullif(doc_id % 4, 0)::INTEGER AS permission_level FROM documents WHERE doc_id % 4 IN (0, 2, 3)")
def permission_visible_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F06, F07, F09."""
    r = _records(spark, sf_dir, False)
    return r.filter(permissions.visible(F.col("permission_level"), permissions.allowed_levels(2))).select(F.col("id").alias("doc_id"), "permission_level")


@query("""WITH p AS (SELECT [lang, source, 'd' || (doc_id % 3)] AS path FROM documents), x AS (SELECT path, unnest([path[1:0], path[1:1], path[1:2], path]) AS prefix FROM p)
SELECT array_to_string(prefix, '/') AS prefix, len(prefix)::INTEGER AS depth, count(*) AS document_count, count(*) FILTER (len(prefix) = len(path)) AS direct_document_count FROM x GROUP BY x.prefix""")
def folder_tree_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A02, R15."""
    got = aggregates.folder_counts(_records(spark, sf_dir, False))
    return got.withColumn("prefix", F.array_join("prefix", "/"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND doc_id % 7 <> 0")
def soft_delete_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic documents are deleted beside those that were."""
    gone = _t(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    left = tables.soft_delete(_records(spark, sf_dir, False), gone)
    return left.filter(filters.live(F.col("is_deleted"))).select(F.col("id").alias("doc_id"))


@query("SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, length(arg_max(text, turn)) AS n FROM conversations GROUP BY conv_id")
def latest_chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W06."""
    return chats.latest_turns(_t(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", F.length("text").alias("n"))


@query("""SELECT e.user_id, e.event_id, e.event_type FROM events e JOIN (SELECT user_id, max(date_trunc('hour', ts)) AS m FROM events GROUP BY user_id) x
ON e.user_id = x.user_id AND date_trunc('hour', e.ts) = x.m WHERE e.event_type <> 'click'""")
def chat_latest_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ties stay, and filters come after the join."""
    e = _t(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    return joins.latest_with_ties(e, "user_id", "hour").filter("event_type <> 'click'").select("user_id", "event_id", "event_type")


@query("SELECT conv_id, turn FROM conversations WHERE role = 'user' AND conv_id % 9 <> 0 ORDER BY turn DESC, conv_id LIMIT 30 OFFSET 10")
def conversation_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """role and liveness, newest first, skip and limit."""
    c = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("message_id"), F.col("turn").alias("updated_at"), "role", (F.col("conv_id") % 9 == 0).alias("is_deleted"))
    got = filters.conversations(c, role="user", skip=10, limit=30)
    return got.select(F.col("message_id").alias("conv_id"), F.col("updated_at").alias("turn"))


@query("""WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS pages FROM documents), x AS (SELECT doc_id, pages, unnest(generate_series(1, len(pages), 2)) AS s FROM p)
SELECT doc_id, s::INTEGER AS page_start, least(s + 2, len(pages))::INTEGER AS page_end, 'p' || s || '_' || least(s + 2, len(pages)) AS slice_id, length(array_to_string(pages[s:s + 2], chr(10))) AS n FROM x""")
def sliding_page_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of three pages that overlap by one."""
    d = _t(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("pages"))
    return chunking.page_windows(d, window=3, overlap=1).select("doc_id", "page_start", "page_end", "slice_id", F.length(F.array_join("page_texts", "\n")).alias("n"))


@query("""WITH x AS (SELECT doc_id, text, unnest(generate_series(0, length(text) - 1, 800)) AS s FROM documents WHERE length(text) > 0)
SELECT doc_id, (s // 800)::INTEGER AS chunk_id, s::INTEGER AS start, md5(substring(text, s + 1, 800)) AS digest FROM x""")
def fixed_cut_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C04, C11."""
    return chunking.fixed_chunks(_t(spark, sf_dir, "documents"), 800).select("doc_id", "chunk_id", "start", F.md5("chunk").alias("digest"))


@query()
def text_splitter_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk depends on the one before; the tests hold it to a plain version."""
    return chunking.text_chunks(_t(spark, sf_dir, "documents")).select("doc_id", "chunk_id", F.md5("chunk").alias("digest"), F.length("chunk").alias("n"))


def _doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text"))
    return d.withColumn("page", F.col("page") + 1)


_PAGES = r"""pg AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents),
t AS (SELECT doc_id, page, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS t FROM pg), c AS (SELECT *, replace(t, ' ', '') AS c, lower(t) AS lt, lower(replace(t, ' ', '')) AS lc FROM t),
f AS (SELECT doc_id, page, t,
  (contains(lt, 'contents') OR contains(lc, 'contents'))::INT + contains(lc, 'ht_toc')::INT AS toc,
  len(regexp_extract_all(t, '\b\d+\.\d+(?:\.\d+)?-\d+\b')) AS codes,
  list_sum([(length(c) - length(replace(c, u, ''))) // length(u) for u in ['mm', 'kn', 'mpa', 'kw', 'cm3', 'g/s', 'r/min', '℃', '%']]) AS units,
  len(regexp_extract_all(c, '\d+(?:\.\d+)?')) AS numbers,
  len(regexp_extract_all(t, '\b(?:[A-Z]{1,3}\d+(?:\.\d+)?(?:/[A-Z]?\d+(?:\.\d+)?)?)\b')) AS hydraulic,
  len(regexp_extract_all(t, '(?:=[0-9A-Z+\-./]+|-[A-Z]{1,4}\d+|&[A-Z]{2,}=[0-9A-Z+\-./]+)')) AS electric,
  CASE WHEN length(t) < 180 THEN 0.0 ELSE least(4.0, length(t) / 320.0 + 0.3 * (length(t) - length(translate(t, '。；：.;:', '')))) END AS long_text,
  list_sum([contains(lt, u)::INT for u in ['email', 'www.', 'zipcode', 'add:']]) AS noise FROM c),
s AS (SELECT *, (hydraulic >= 4)::INT * least(3.5, hydraulic / 4.0) + (electric >= 3)::INT * least(4.0, electric / 3.0) AS drawing,
  (units >= 2 OR numbers >= 25)::INT * least(3.5, units * 0.8 + numbers / 18.0) AS catalog_table,
  (electric >= 3)::INT * least(2.0, electric / 5.0) AS legend, long_text AS description,
  toc * 3.0 + (codes >= 2)::INT * least(4.0, codes / 2.0) + (page <= 4 AND (contains(t, 'ht_toc') OR codes >= 2))::INT * 3.2 + (codes >= 3 AND page <= 3)::INT * 2.0 AS toc_score FROM f),
k AS (SELECT *, drawing + catalog_table + legend + description + toc_score AS total FROM s),
b AS (SELECT *, list_max([{'s': round_even(v.s / total, 4), 'o': v.o, 'k': v.k} for v in [{'s': drawing, 'o': 0, 'k': 'drawing'}, {'s': catalog_table, 'o': -1, 'k': 'catalog_table'}, {'s': legend, 'o': -2, 'k': 'legend_or_rule'}, {'s': description, 'o': -3, 'k': 'description'}, {'s': toc_score, 'o': -4, 'k': 'toc'}]]) AS best FROM k),
typed AS (SELECT *, CASE WHEN total <= 0 THEN 'mixed' WHEN (page <= 2 AND codes >= 3) OR (page <= 4 AND contains(t, 'ht_toc')) THEN 'toc' WHEN best.s < 0.34 THEN 'mixed' ELSE best.k END AS page_type FROM b)"""


@query(f"WITH {_PAGES} SELECT doc_id, page::INTEGER AS page, page_type FROM typed")
def page_type_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C15, C16, A13, X01-X06."""
    return pages.classify_pages(_doc_pages(spark, sf_dir)).select("doc_id", "page", "page_type")


@query(f"""WITH {_PAGES}, g AS (SELECT doc_id, count(*) AS pages, count(*) FILTER (page_type = 'drawing') AS drawing, count(*) FILTER (page_type = 'catalog_table') AS catalog_table,
  count(*) FILTER (page_type = 'legend_or_rule') AS legend_or_rule, count(*) FILTER (page_type = 'description') AS description, count(*) FILTER (page_type = 'toc') AS toc, count(*) FILTER (page_type = 'mixed') AS mixed,
  avg(length(t)) AS len, sum(noise) AS noise, count(*) FILTER (numbers >= 20 OR units >= 2) AS dense, count(DISTINCT page_type) AS kinds FROM typed GROUP BY doc_id),
fs AS (SELECT *, [{{'s': drawing * 2.2 + catalog_table * 1.1 + legend_or_rule * 1.5, 'o': 0, 'k': 'drawing-heavy'}}, {{'s': description * 2.0 + toc * 1.2 + CASE WHEN len > 450 THEN 0.8 ELSE 0 END, 'o': -1, 'k': 'manual-like'}},
  {{'s': catalog_table * 2.4 + CASE WHEN noise >= 2 THEN 1.0 ELSE 0 END + dense * 1.4 + CASE WHEN catalog_table >= 1 AND dense >= 2 THEN 1.8 ELSE 0 END, 'o': -2, 'k': 'table-heavy'}}, {{'s': mixed * 1.2 + sqrt(pages) + CASE WHEN kinds >= 4 THEN 1.0 ELSE 0 END, 'o': -3, 'k': 'mixed'}}] AS l FROM g),
fb AS (SELECT *, list_max([{{'s': round_even(x.s::DOUBLE / list_sum([y.s::DOUBLE for y in l]), 4), 'o': x.o, 'k': x.k}} for x in l]) AS best FROM fs)
SELECT doc_id, pages, CASE WHEN drawing >= greatest(4, floor(pages * 0.3)) THEN 'drawing-heavy' WHEN description >= greatest(4, floor(pages * 0.5)) THEN 'manual-like' WHEN catalog_table >= 1 AND dense >= 2 THEN 'table-heavy'
  WHEN best.s < 0.38 THEN 'mixed' ELSE best.k END AS family FROM fb""")
def document_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14."""
    return pages.classify_documents(_doc_pages(spark, sf_dir)).select("doc_id", "pages", "family")


def _toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of contents of each document: every third line starts a chapter."""
    d = _t(spark, sf_dir, "documents").withColumn("lines", F.split("text", "\n"))
    d = d.select("doc_id", F.size("lines").alias("total_pages"), F.posexplode("lines").alias("n", "line")).filter("n % 3 = 0")
    return d.select("doc_id", "total_pages", (F.col("n") + 1).alias("page_start"), F.col("line").alias("title"), (F.col("n") / 3).cast("int").alias("position"))


_TOC = """l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), toc AS (
  SELECT doc_id, len(lines) AS total_pages, n AS page_start, lines[n] AS title, (n - 1) // 3 AS position FROM (SELECT *, unnest(generate_series(1, len(lines), 3)) AS n FROM l))"""


@query(f"WITH {_TOC} SELECT doc_id, page_start::INTEGER AS page_start, greatest(coalesce(lead(page_start) OVER (PARTITION BY doc_id ORDER BY page_start) - 1, total_pages), page_start)::INTEGER AS page_end FROM toc")
def toc_chapter_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W02, J04."""
    return joins.chapter_bounds(_toc(spark, sf_dir)).select("doc_id", "page_start", "page_end")


@query(f"""WITH {_TOC}, p AS (SELECT doc_id, unnest(generate_series(1, len(lines))) AS page FROM l)
SELECT p.doc_id, p.page::INTEGER AS page, toc.page_start::INTEGER AS page_start, toc.title FROM p ASOF JOIN toc ON p.doc_id = toc.doc_id AND p.page >= toc.page_start""")
def page_to_chapter_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J04, J05."""
    p = _doc_pages(spark, sf_dir).select("doc_id", "page")
    return joins.chapter_of_page(p, _toc(spark, sf_dir).select("doc_id", "page_start", "title")).select("doc_id", "page", "page_start", "title")


@query(f"""WITH {_TOC}, n AS (SELECT *, lead(page_start) OVER (PARTITION BY doc_id ORDER BY position) AS nx FROM toc),
g AS (SELECT doc_id, count(*) AS items, coalesce(avg(CASE WHEN nx IS NOT NULL THEN (nx > page_start)::INT END), 1) AS rising, (max(page_start) - min(page_start) + 1) / max(total_pages) AS coverage,
  avg((greatest(coalesce(nx, total_pages + 1) - page_start, 1) > 30)::INT) AS oversized FROM n GROUP BY doc_id)
SELECT doc_id, items, (CASE WHEN items >= 3 THEN 30 ELSE 10 END + CASE WHEN rising > 0.95 THEN 25 WHEN rising > 0.8 THEN 15 ELSE 5 END + CASE WHEN coverage BETWEEN 0.08 AND 0.95 THEN 20 ELSE 10 END + CASE WHEN oversized <= 0.2 THEN 25 WHEN oversized <= 0.4 THEN 10 ELSE 0 END)::INTEGER AS score FROM g""")
def toc_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11."""
    return aggregates.toc_quality(_toc(spark, sf_dir).withColumnRenamed("page_start", "target_page"))


def _event_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    m = F.create_map(F.lit("machine_code"), k, F.lit("机型码"), F.when(F.col("event_id") % 3 == 0, k).otherwise(F.concat(k, F.lit("x"))), F.lit("系列"), F.when(F.col("event_id") % 2 == 0, F.lit(" ")).otherwise(F.col("event_type")), F.lit("version"), F.lit("1"), F.lit("free"), F.lit("f"))
    return e.select("event_id", m.alias("m"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS model, CASE WHEN event_id % 2 <> 0 THEN event_type END AS series, (CASE WHEN event_id % 2 <> 0 THEN 'free,model,series' ELSE 'free,model' END) AS keys FROM events""")
def metadata_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases to canonical fields; another type's fields go."""
    n = _event_maps(spark, sf_dir).select("event_id", metadata.normalised(F.col("m"), "workorder").alias("n"))
    return n.select("event_id", F.element_at("n", F.lit("model")).alias("model"), F.element_at("n", F.lit("series")).alias("series"), F.array_join(F.array_sort(F.map_keys("n")), ",").alias("keys"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'model' END AS conflicts FROM events")
def metadata_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M04."""
    return _event_maps(spark, sf_dir).select("event_id", F.array_join(metadata.conflicts(F.col("m"), "workorder"), ",").alias("conflicts"))


@query("SELECT event_id, user_id FROM (SELECT *, max(date_trunc('day', ts)) OVER (PARTITION BY user_id) AS m FROM events) WHERE date_trunc('day', ts) = m")
def latest_batch_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each owner's newest day of events stays live."""
    e = _t(spark, sf_dir, "events").withColumn("batch", F.date_trunc("day", "ts"))
    return tables.latest_batch_wins(e, "user_id", "batch").filter(filters.live(F.col("is_deleted"))).select("event_id", "user_id")


_ITEMS = """items AS (SELECT event_id, user_id // 5 AS batch_id, event_id AS position, ['pending', 'running', 'done', 'done', 'failed', 'done'][event_id % 6 + 1] AS status, (value::INTEGER) AS progress FROM events)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    states = F.array(*[F.lit(s) for s in ("pending", "running", "done", "done", "failed", "done")])
    return e.select("event_id", F.floor(F.col("user_id") / 5).alias("batch_id"), F.col("event_id").alias("position"), F.get(states, (F.col("event_id") % 6).cast("int")).alias("status"), F.bround("value").cast("int").alias("progress"))


@query(f"""WITH {_ITEMS}, g AS (SELECT batch_id, count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'done') AS done,
  count(*) FILTER (status = 'failed') AS failed, floor(avg(least(greatest(progress, 0), 100)))::INTEGER AS mean FROM items GROUP BY batch_id),
s AS (SELECT *, CASE WHEN failed = total THEN 'failed' WHEN done = total THEN 'done' WHEN running > 0 OR pending > 0 THEN 'running' WHEN failed > 0 THEN 'partial' ELSE 'unknown' END AS status FROM g)
SELECT batch_id, total, pending, running, done, failed, status, CASE WHEN status = 'done' THEN 100 ELSE least(mean, 99) END AS progress FROM s""")
def batch_status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A03, A04."""
    return aggregates.batch_status(_items(spark, sf_dir))


@query("""SELECT event_id, CASE WHEN event_id % 6 = 2 THEN 100 ELSE least(greatest(trunc((greatest(event_id % 5 - 1, 0) + CASE WHEN user_id % 4 > 0 THEN least((event_id % 3)::DOUBLE / (user_id % 4), 1.0) ELSE 0.0 END) * 100 / 4)::INTEGER, 0), 99) END AS percent FROM events""")
def task_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A05, X17."""
    e = _t(spark, sf_dir, "events")
    return e.select("event_id", aggregates.task_progress(F.col("event_id") % 5, F.lit(4), F.col("event_id") % 3, F.col("user_id") % 4, F.when(F.col("event_id") % 6 == 2, "done").otherwise("running")).alias("percent"))


@query(f"""WITH {_ITEMS} SELECT batch_id, arg_min(event_id, (CASE status WHEN 'running' THEN 0 WHEN 'pending' THEN 1 WHEN 'failed' THEN 2 ELSE 3 END) * 1000000000000 + position) AS active_item FROM items GROUP BY batch_id""")
def active_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A06."""
    return aggregates.active_item(_items(spark, sf_dir), item="event_id")


@query("""WITH g AS (SELECT user_id, count(*) AS total, count(*) FILTER (value > 5) AS written FROM events GROUP BY user_id)
SELECT user_id, total, written, total - written AS failed, CASE WHEN written = 0 THEN 'failed' WHEN written < total THEN 'partial' ELSE 'active' END AS status, (total - written) * 2 < total AS success FROM g""")
def ingest_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A07, K07."""
    return aggregates.ingest_verdict(_t(spark, sf_dir, "events"), "user_id", F.col("value") > 5)


@query("SELECT event_id FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 24 HOURS AND event_id % 5 <> 0")
def expiry_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Older than a day at the newest event, and not revoked."""
    e = _t(spark, sf_dir, "events")
    now = e.agg(F.max("ts").alias("now"))
    old = tasks.expired(e.crossJoin(F.broadcast(now)), "ts", F.col("now"))
    return old.filter(filters.live(F.col("event_id") % 5 == 0)).select("event_id")


@query("""WITH k AS (SELECT doc_id AS key FROM documents UNION SELECT doc_id FROM labels UNION SELECT vec_id FROM embeddings), f AS (SELECT key, key IN (SELECT doc_id FROM documents) AS d, key IN (SELECT doc_id FROM labels) AS l, key IN (SELECT vec_id FROM embeddings) AS e FROM k)
SELECT key, d::INTEGER AS in_documents, l::INTEGER AS in_labels, e::INTEGER AS in_vectors, concat_ws(',', CASE WHEN NOT d THEN 'documents' END, CASE WHEN NOT l THEN 'labels' END, CASE WHEN NOT e THEN 'vectors' END) AS missing FROM f WHERE NOT (d AND l AND e)""")
def store_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each store lacks."""
    ids_ = lambda t, c: _t(spark, sf_dir, t).select(F.col(c).alias("key"))
    return tables.reconciliation("key", documents=ids_("documents", "doc_id"), labels=ids_("labels", "doc_id"), vectors=ids_("embeddings", "vec_id"))


_EDGES = "edges AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier)"


@query(f"""WITH {_EDGES}, b AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges), s AS (SELECT 'r' || r_regionkey AS id FROM region),
p1 AS (SELECT s.id AS start, b.dst AS id FROM s JOIN b ON b.src = s.id), p2 AS (SELECT p1.start, b.dst AS id FROM p1 JOIN b ON b.src = p1.id), a AS (SELECT id AS start, id, 0 AS depth FROM s UNION ALL SELECT start, id, 1 FROM p1 UNION ALL SELECT start, id, 2 FROM p2)
SELECT start, id, min(depth)::INTEGER AS depth FROM a GROUP BY start, id""")
def graph_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J15, R20, U02."""
    n, s = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "supplier")
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = n.select(key("r", "n_regionkey").alias("src"), key("n", "n_nationkey").alias("dst")).unionByName(s.select(key("n", "s_nationkey").alias("src"), key("s", "s_suppkey").alias("dst")))
    return graph.expand(edges, _t(spark, sf_dir, "region").select(key("r", "r_regionkey").alias("id")), 2)


@query("""SELECT o.o_orderkey AS fault_id, p.p_partkey AS solution_id, p.p_name AS solution FROM orders o LEFT JOIN (lineitem l JOIN part p ON l.l_partkey = p.p_partkey AND l.l_returnflag = 'R') ON l.l_orderkey = o.o_orderkey WHERE o.o_orderpriority = '1-URGENT'""")
def fault_solution_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders as faults, their returned parts as solutions; faults without one stay."""
    o = _t(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("fault_id"))
    links = _t(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("fault_id"), F.col("l_partkey").alias("solution_id"))
    parts = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("solution_id"), F.col("p_name").alias("solution"))
    return o.join(links.join(parts, "solution_id"), "fault_id", "left").select("fault_id", "solution_id", "solution")


@query("""SELECT id, path, depth FROM (SELECT r_regionkey AS id, r_name AS path, 1 AS depth FROM region UNION ALL SELECT 100 + n_nationkey, r_name || '/' || n_name, 2 FROM nation JOIN region ON n_regionkey = r_regionkey)""")
def parameter_tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of an adjacency list by a recursive query."""
    r = _t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("int").alias("parent_id"))
    n = _t(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("parent_id"))
    return tree.paths(r.unionByName(n)).select("id", "path", "depth")


@query("""WITH x AS (SELECT label, trim(unnest(string_split('m' || (vec_id % 5) || ', m' || (vec_id % 3), ','))) AS m FROM embeddings)
SELECT label, string_agg(DISTINCT m, ',' ORDER BY m) AS models, (SELECT count(*) FROM embeddings e WHERE e.label = x.label) AS merge_count FROM x GROUP BY label""")
def canonical_merge_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16, R12, U03."""
    e = _t(spark, sf_dir, "embeddings").select("label", F.concat(F.lit("m"), F.col("vec_id") % 5, F.lit(", m"), F.col("vec_id") % 3).alias("models"))
    return aggregates.merged_models(e, "label")


@query("SELECT doc_id, sha256(text) AS fingerprint, sha256(text || source) AS named FROM documents")
def record_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P01."""
    d = _t(spark, sf_dir, "documents")
    return d.select("doc_id", ids.fingerprint(F.col("text")).alias("fingerprint"), ids.fingerprint(F.col("text"), F.col("source")).alias("named"))


@query("""WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(concat_ws('|', source, 'doc', sha256(text), 'hash', '', 'row:' || doc_id))) AS h FROM documents)
SELECT doc_id, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-' || translate(substring(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substring(h, 18, 3) || '-' || substring(h, 21, 12) AS id FROM h""")
def record_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name-based UUIDs without a UDF."""
    d = _t(spark, sf_dir, "documents")
    return d.select("doc_id", ids.record_id(F.col("source"), F.lit("doc"), ids.fingerprint(F.col("text")), F.lit("hash"), F.lit(""), F.concat(F.lit("row:"), F.col("doc_id"))).alias("id"))


@query("""SELECT event_type, grouping(event_type)::TINYINT AS grand, count(*) AS calls, round(sum(value), 2) AS value FROM events GROUP BY GROUPING SETS ((event_type), ())""")
def token_usage_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10."""
    return aggregates.token_usage(_t(spark, sf_dir, "events"), "event_type", "value").withColumn("value", F.round("value", 2))


@query("""WITH w AS (SELECT doc_id, string_split(text, ' ') AS w, string_split(text, chr(10))[1] AS s FROM documents)
SELECT doc_id AS id, doc_id || '|summary' AS local_key, 'summary' AS kind, s AS text FROM w WHERE trim(s) <> '' UNION ALL
SELECT doc_id, doc_id || '|entity|' || w[1], 'entity', w[1] || ': ' || lang FROM w JOIN documents USING (doc_id) WHERE trim(w[1]) <> '' UNION ALL
SELECT doc_id, doc_id || '|relation|0', 'relation', w[1] || ' near ' || w[2] FROM w WHERE trim(w[1]) <> '' AND trim(coalesce(w[2], '')) <> ''""")
def graph_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule stands for the extractor."""
    w = F.split("text", " ")
    d = _t(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("doc_id").cast("string").alias("slice_id"),
        F.split("text", "\n")[0].alias("summary"),
        F.array(F.struct(w[0].alias("name"), F.lit("word").alias("type"), F.col("lang").alias("description"))).alias("entities"),
        F.array(F.struct(F.get(w, F.lit(0)).alias("src"), F.lit("near").alias("rel"), F.get(w, F.lit(1)).alias("tgt"), F.lit("").alias("description"))).alias("relations"),
    )
    return tables.graph_records(d)


@query("SELECT sha256(text) AS digest, min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedupe_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15."""
    d = _t(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("digest"), "doc_id")
    return aggregates.distinct_in_order(d, "digest", "doc_id")


@query("""WITH i AS (SELECT page_id AS image_id, page_id % 40 AS page_num, url FROM pages WHERE page_id % 40 BETWEEN 3 AND 12) SELECT page_num, min(image_id) AS image_id, arg_min(url, image_id) AS url FROM i GROUP BY page_num""")
def image_pages_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J02, J03, W07."""
    p = _t(spark, sf_dir, "pages")
    got = joins.images_in_range(p.select(F.col("page_id").alias("image_id"), (F.col("page_id") % 40).alias("page_num")), p.select(F.col("page_id").alias("image_id"), "url"), F.lit(3), F.lit(12))
    return got.groupBy("page_num").agg(F.min("image_id").alias("image_id"), F.min_by("url", "image_id").alias("url"))


@query("SELECT user_id, max_by(event_type, ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')) AS event_type, max_by(event_id, ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')) AS event_id FROM events GROUP BY user_id")
def task_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest event of each task, ties by id."""
    return tasks.latest_state(_t(spark, sf_dir, "events"), "user_id").select("user_id", "event_type", "event_id")


@query("SELECT event_id, CASE WHEN value <= 0.5 THEN 'fast' WHEN value <= 2 THEN 'normal' WHEN value <= 5 THEN 'slow' WHEN value <= 10 THEN 'very_slow' ELSE 'critical' END AS band FROM events")
def performance_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A22."""
    return _t(spark, sf_dir, "events").select("event_id", aggregates.speed(F.col("value")).alias("band"))


@query("""SELECT doc_id, coalesce(q.quality, d.doc_id % 2)::INTEGER AS quality FROM (SELECT doc_id FROM documents WHERE doc_id % 2 = 0 UNION SELECT doc_id FROM labels) d LEFT JOIN labels q USING (doc_id)""")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels upserted over defaults."""
    old = _t(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    return tables.upsert(old, _t(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


@query("""WITH x AS (SELECT page_id, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS p FROM pages), f AS (SELECT page_id, p, list_filter(string_split(p, '/'), lambda s: s <> '') AS a FROM x)
SELECT page_id, array_to_string(a[1:len(a) - 1], '/') AS folder, coalesce(a[len(a)], '') AS name FROM f""")
def url_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders and base names of paths."""
    p = F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1)
    return _t(spark, sf_dir, "pages").select("page_id", F.array_join(text.folders(p), "/").alias("folder"), text.basename(F.rtrim(p, F.lit("/"))).alias("name"))


@query("""SELECT event_id, translate(rtrim(base64(encode('{"type":"' || event_type || '","id":' || event_id || '}')), '='), '+/', '-_') AS node FROM events""")
def tree_node_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X12."""
    return _t(spark, sf_dir, "events").select("event_id", ids.node_id(F.struct(F.col("event_type").alias("type"), F.col("event_id").alias("id"))).alias("node"))


_ENTITIES = """WITH RECURSIVE e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id > a.vec_id WHERE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.4),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w(id, entity) AS (SELECT DISTINCT a, a FROM l UNION SELECT l.b, w.entity FROM w JOIN l ON l.a = w.id)
SELECT id, min(entity) AS entity FROM w GROUP BY id"""


@query(_ENTITIES)
def canonical_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R12 in its order-free form: entities are components of the accepted pairs of whole labels."""
    e = _t(spark, sf_dir, "embeddings")
    pairs = graph.similar_links(e, "vec_id", "embedding", "label", 0.4).select("a", "b", F.lit(0.9).alias("similarity"))
    return graph.entities(graph.canonical_merge(pairs, 0.95, lambda s: s > 0.4, 0.4))


@query(_ENTITIES)
def canonical_entities_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R12 in its order-free form over whole labels: no pair is left out for the distance of its ids."""
    return graph.entities(graph.similar_links(_t(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", 0.4))


@query()
def canonical_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R12 as the reference runs it, row by row: each joins the most similar earlier entity of its label, else founds one."""
    e = _t(spark, sf_dir, "embeddings").withColumn("position", F.col("vec_id"))
    return graph.resolved_in_order(e, "vec_id", "position", "embedding", "label", 0.3).withColumnRenamed("vec_id", "id")
