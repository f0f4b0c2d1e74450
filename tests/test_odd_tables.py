"""Queries over small tables with odd rows, held to DuckDB's rows for their SQL."""

import json

import duckdb

from quillgrid import catalog, catalog_files, catalog_more, catalog_stores  # noqa: F401
from quillgrid.functions import models
from quillgrid.plans import manual


def both(spark, folder, name, **tables):
    """Rows of a query and of its SQL over the given tables, in order."""
    c = duckdb.connect()
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, str(folder))
    want = c.execute(f"SELECT {','.join(df.columns)} FROM ({catalog.ORACLES[name]})").fetchall()
    return sorted((tuple(r) for r in df.collect()), key=repr), sorted(want, key=repr)


def documents(spark, rows):
    return spark.createDataFrame([(k, t, "en", s, len(t)) for k, (t, s) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars int")


def test_texts_whose_hashed_words_cancel_have_a_vector(spark, tmp_path):
    by_sign = {}
    for w in (f"w{k}" for k in range(200)):
        v = models.hashing_encoder(32)([w], False)[0]
        at = max(range(32), key=lambda i: abs(v[i]))
        by_sign.setdefault((at, v[at] > 0), w)
    up, down = next((w, by_sign[at, False]) for (at, plus), w in by_sign.items() if plus and (at, False) in by_sign)
    assert all(v is not None and abs(sum(x * x for x in v) - 1) < 1e-9 for v in models.hashing_encoder(32)([f"{up} {down}", f"{up} {up} {down}"], False))
    assert models.hashing_encoder(32)(["", " ", None], False) == [None] * 3
    rows = [("x", "a"), (f"{up} {down}", "a"), (f"{up} {down}", "b"), ("x", "b"), ("", "b"), ("x", None)]
    got, want = both(spark, tmp_path, "ingested_rows", documents=documents(spark, rows))
    assert got == want and dict((s, n) for s, _, n in got) == {"a": 1, "b": 1, None: 1}


def test_headings_that_begin_with_numbers_stay_whole(spark, tmp_path):
    rows = [("56.187.231.175 Keit in\nb\nc\nd\n4763047826333361 Of the", "a"), ("1.2 First\n2024", "b"), ("none", "a")]
    got, want = both(spark, tmp_path, "word_contents", documents=documents(spark, rows))
    assert got == want and len(got) == 4


def _told(texts):
    return [json.dumps({"summary": f"s{len(t)}", "entities": [{"name": " a ", "description": "x"}, {"name": "a"}, {}], "relations": [{"description": ""}, {"src": "a", "rel": "b", "description": t[:3]}]}) if t.strip() else None for t in texts]


def test_manuals_of_page_rows(spark):
    asked = []
    pages = spark.createDataFrame([(1, 1, "p1"), (1, 2, None), (1, 4, "p4"), (1, 5, "p5"), (2, 1, "q1"), (3, 1, "r1"), (4, 1, "p1"), (5, 1, "no print")], "doc_id long, page int, text string")
    toc = spark.createDataFrame([(1, "A", "1", 2), (1, "B", "", 4), (1, "late", "9", 9), (2, "C", None, 1)], "doc_id long, title string, section_number string, page_start int")
    prints = spark.createDataFrame([(1, "m1", "f1"), (2, "m2", "f2"), (3, "m3", "f3"), (4, "m3", "f3")], "doc_id long, source_file string, fingerprint string")
    got = manual.ingest_manual(pages, toc, prints, _told, lambda ts, q: [None if t == "q1" else [float(len(t))] for t in ts], "X")
    assert sorted((r.doc_id, r.slice_id, r.page_start, r.page_end, r.text, r.vector) for r in got.chapters.collect()) == [(1, "1", 2, 3, "", [0.0]), (1, "p4", 4, 8, "p4\np5", [5.0])]
    windows = sorted({(r.doc_id, r.slice_id, r.title, r.chunk_raw_text) for r in got.chunks.filter("doc_id < 3").collect()})
    assert windows == [(1, "1__p2_3", "A", "\n\np4"), (1, "1__p3_4", "A", "p4\n\np5"), (1, "p1_2", None, "p1\n\n"), (1, "p4_4", "B", "p5"), (2, "p1_1", "C", "q1")]
    assert sorted((r.doc_id, r.chapters, r.chapters_stored, r.n_summary, r.n_entity, r.n_relation) for r in got.report.filter("doc_id not in (3, 4)").collect()) == [(1, 2, 2, 4, 4, 4), (2, 1, 0, 1, 1, 0), (5, 0, 0, 0, 0, 0)]
    assert got.chunks.filter("doc_id in (3, 4)").select("id").distinct().count() == got.chunks.filter("doc_id in (3, 4)").count() == 3
    assert got.images.count() == got.images.distinct().count() > 0


def test_texts_of_manuals_are_shuffled_only_to_be_embedded(spark, tmp_path, monkeypatch):
    kept = []
    monkeypatch.setattr(manual, "written", lambda df, name, own=manual.written: (kept.append((name, df._jdf.queryExecution().executedPlan().toString())), own(df, name))[1])
    documents(spark, [("a\nb\nc\nd", "s"), ("x", "s")]).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    report = catalog.QUERIES["manual_report"](spark, str(tmp_path))
    plans = dict(kept)
    assert "hashpartitioning" not in plans["graphs"] and sorted(n for n, _ in kept) == ["graphs", "vectors", "vectors"]
    assert "chunk_raw_text" not in report._jdf.queryExecution().executedPlan().toString()
