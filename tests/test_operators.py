import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillgrid.operators import aggregates, chats, chunking, filters, graph, joins, pages, ranking, search, tables, tasks, tree
from quillgrid.plans import ingest
from quillgrid.sources import readers


def test_filters(spark):
    df = spark.createDataFrame([(1, {"machine_code": "A"}), (2, {"model": "B"}), (3, {}), (4, None)], "id int, m map<string,string>")
    keep = lambda c: [r.id for r in df.filter(c).orderBy("id").collect()]
    m = F.col("m")
    assert keep(filters.metadata_equals(m, {"model": "A"})) == [1] and keep(filters.metadata_equals(m, {"机型码": ["A", "B"]})) == [1, 2]
    assert keep(filters.metadata_equals(m, {"model": []})) == [] and keep(filters.metadata_equals(m, {})) == [1, 2, 3, 4]
    assert keep(filters.text_clause(m, {"model": ["B", "", None]})) == [2] and keep(filters.text_clause(m, {"model": [""]})) == []
    assert keep(filters.metadata_contains(m, "model")) == [2] and keep(filters.metadata_contains(m, "model", " b ")) == [2]
    assert keep(filters.not_excluded(m["model"], ["B", " "])) == [1, 3, 4]
    assert keep(filters.solution_included(m, "model", ["A"])) == [1, 3, 4] and keep(filters.solution_excluded(m, "model", ["B"])) == [2]
    rows = spark.createDataFrame([("a: \nb: ",), ("a: 1\nb: ",), (None,)], "t string")
    assert filters.filled_rows(rows, "t", ("a", "b")).count() == 1
    levels = spark.createDataFrame([(["x", "y"],), (["x", "", "z"],), (["", ""],), (["a"] * 4,)], "l array<string>")
    assert [r[0] for r in levels.select(filters.folder_errors(F.col("l"))).collect()] == [None, "gap", "empty", "too_deep"]
    with pytest.raises(ValueError):
        filters.check_selection(["a"], "n", None)
    q = spark.createDataFrame([(1, 0.0), (1, 0.0), (2, 0.05), (2, 0.5)], "q int, s double")
    assert sorted((r.q, r.s) for r in filters.reranked(q, "q", "s").collect()) == [(1, 0.0), (1, 0.0), (2, 0.5)]
    j = spark.createDataFrame([('{"a": {"b": 1}}',), ('{"a": 2}',), ("no",), (None,)], "j string")
    assert [r[0] for r in j.select(filters.structure_fits(F.col("j"), ["$.a.b"])).collect()] == [True, False, False, False]


def test_text_splitter():
    cases = ["", "a", "a\nb\nc", "x" * 25, "One. Two? Three! " * 5, "aa\n" * 20, "long. " * 30 + "\nshort\n" + "y" * 50]
    for t in cases:
        for size, overlap in ((10, 0), (10, 4), (1000, 200)):
            got = chunking.split_text(t, size, overlap)
            assert all(len(c.replace("\n", "")) <= size for c in got)
            if t:
                assert not overlap or "".join("".join(got).split()) != ""
                joined = "".join(got)
                assert set("".join(t.split())) <= set(joined) | {" "}
            if overlap == 0 and t:
                assert "".join("".join(got).split()) == "".join(t.split())


def test_chunking(spark):
    d = spark.createDataFrame([(1, ["a", "b", "c"]), (2, []), (3, None)], "doc_id int, pages array<string>")
    got = [(r.doc_id, r.page_start, r.page_end, r.page_texts) for r in chunking.page_windows(d).collect()]
    assert got == [(1, 1, 2, ["a", "b"]), (1, 2, 3, ["b", "c"]), (1, 3, 3, ["c"])]
    c = spark.createDataFrame([(1, "s", 1, 25), (1, "t", 26, 30)], "doc_id int, slice_id string, page_start int, page_end int")
    assert [(r.slice_id, r.page_start, r.page_end) for r in chunking.split_long(c).collect()] == [("s_part1", 1, 10), ("s_part2", 11, 20), ("s_part3", 21, 25), ("t", 26, 30)]
    t = spark.createDataFrame([(1, 1, 200), (1, 100, 200), (1, 110, 200)], "doc_id int, page_start int, total_pages int")
    assert sorted((r.page_start, r.page_end) for r in chunking.slice_ranges(t).collect()) == [(1, 80), (100, 109), (110, 139)]
    f = spark.createDataFrame([(1, 12), (2, 0)], "doc_id int, total_pages int")
    assert [(r.slice_id, r.page_start, r.page_end) for r in chunking.fixed_slices(f, size=3).collect()] == [("chunk_0001", 1, 5), ("chunk_0002", 6, 10), ("chunk_0003", 11, 12)]
    v = spark.createDataFrame([(1, "aa\nbb\n\ncccc\nd"), (2, None)], "doc_id int, text string")
    assert [(r.page, r.text) for r in chunking.virtual_pages(v, 4).collect()] == [(1, "aa\nbb"), (2, "cccc"), (3, "d")]
    links = spark.createDataFrame([(1, 1, 0), (1, 2, 3), (1, 3, 5), (1, 5, 9), (2, 1, 0), (2, 7, 0)], "doc_id int, page int, links int")
    assert sorted((r.doc_id, r.page) for r in chunking.toc_pages(links).collect()) == [(1, 2), (1, 3), (2, 1)]
    items = spark.createDataFrame([(1, 3, 0, 9), (1, 3, 1, 9), (1, 12, 2, 9), (1, 5, 3, 9)], "doc_id int, target_page int, position int, total_pages int")
    assert sorted((r.target_page, r.position) for r in chunking.rising_only(items).collect()) == [(3, 0), (5, 3)]


def test_pages_with_cjk(spark):
    rows = [(1, "目录 ht_toc 1.1-2 1.2-3 1.3-4"), (2, "序号 名称 代号 型号 参数 5mm 6mm"), (3, "动作图 A1 B2 C3 D4 E5"), (4, "故障 操作 保养 调整"), (5, None), (6, "原理图 回路 接线图")]
    df = spark.createDataFrame(rows, "page int, text string").withColumn("doc_id", F.lit(1))
    assert [r.page_type for r in pages.classify_pages(df).orderBy("page").collect()] == ["toc", "catalog_table", "legend_or_rule", "description", "mixed", "drawing"]
    assert pages.classify_documents(df).first().family in ("drawing-heavy", "manual-like", "table-heavy", "mixed")
    assert pages.classify_documents(df.limit(0)).count() == 0


def test_joins(spark):
    toc = spark.createDataFrame([(1, "A", 1, "i"), (1, "B", 4, "ii")], "doc_id int, title string, target_page int, toc_page_code string")
    foot = spark.createDataFrame([(1, "I", 3), (1, "I", 5), (1, "II", 8)], "doc_id int, code string, page int")
    assert [r.target_page for r in joins.calibrate(toc, foot, 2).orderBy("title").collect()] == [3, 8]
    assert [r.target_page for r in joins.calibrate(toc, foot, 3).orderBy("title").collect()] == [1, 4]
    a = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id int, vector array<double>")
    b = spark.createDataFrame([(7, [1.0, 0.0]), (8, [1.0, 0.0])], "stored_id int, vector array<double>")
    assert [(r.id, r.stored_id) for r in joins.nearest(a, b, 0.9).orderBy("id").collect()] == [(1, 8), (2, None)]
    links = spark.createDataFrame([(1, 9, 2), (1, 4, 1)], "document_id int, image_id int, sort_order int")
    assert joins.gathered(links).first().image_ids == [4, 9]
    batches = spark.createDataFrame([("b", ["t1", "t2"]), ("c", [])], "batch_id string, task_history array<string>")
    assert [r.batch_id for r in joins.located(batches, spark.createDataFrame([("t2",)], "task_id string")).collect()] == ["b"]


def test_tables(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", True)], "id int, v string, is_deleted boolean")
    new = spark.createDataFrame([(2, "x", None), (3, "c", None), (3, "d", None)], "id int, v string, is_deleted boolean")
    assert sorted(r.id for r in tables.upsert(old, new, "id").collect()) == [1, 2, 3]
    assert tuple(tables.upsert_counts(old, new, "id").first()) == (1, 1)
    assert {r.id: r.is_deleted for r in tables.soft_delete(old, spark.createDataFrame([(1,), (1,)], "id int")).collect()} == {1: True, 2: True}
    assert [r.id for r in tables.hard_delete(old, new).collect()] == [1]
    assert {r.id: r.v for r in tables.update(old, spark.createDataFrame([(1, None), (9, "z")], "id int, v string"), "id").collect()} == {1: "a", 2: "b", 9: "z"}
    assert tables.schema_changes(old, old.drop("v").withColumn("w", F.lit(1)).withColumn("id", F.lit("x"))) == {"added": ["w"], "dropped": ["v"], "modified": ["id"]}
    p = spark.createDataFrame([(1, 2, 4), (2, 0, 3), (3, None, 1)], "id int, page_start int, page_end int")
    assert [(r.id, r.page_num) for r in tables.page_images(p).collect()] == [(1, 2), (1, 3), (1, 4)]
    with pytest.raises(Exception, match="reversed"):
        tables.page_images(spark.createDataFrame([(1, 4, 2)], "id int, page_start int, page_end int")).collect()
    both = spark.createDataFrame([({"a": "1"}, {"id": "x", "b": "2"})], "m map<string,string>, n map<string,string>")
    assert tuple(both.select(*tables.upload_metadata(F.col("m"), F.col("n"))).first()) == ({"a": "1", "b": "2"}, ["id"])


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("c", "a")], "src string, dst string")
    got = {(r.id, r.depth) for r in graph.expand(e, spark.createDataFrame([("a",)], "id string"), 5).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 1)}
    links = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(50, 51)], "a int, b int")
    assert {r.id: r.entity for r in graph.entities(links).collect()} == {**{i: 0 for i in range(13)}, 50: 50, 51: 50}
    rows = spark.createDataFrame([(1, 0, [1.0, 0.0], "p"), (2, 1, [0.99, 0.14], "p"), (3, 2, [0.0, 1.0], "p"), (4, 0, [1.0, 0.0], "q")], "id long, pos int, v array<double>, part string")
    assert {r.id: r.entity for r in graph.resolved_in_order(rows, "id", "pos", "v", "part").collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    nodes = spark.createDataFrame([("a", "CanonicalFault", "F"), ("s", "CanonicalSolution", "S"), ("t", "CanonicalSolution", "T"), ("z", "CanonicalFault", "G")], "id string, type string, name string")
    edges = spark.createDataFrame([("a", "s", "HAS_SOLUTION"), ("a", "t", "HAS_SOLUTION")], "src string, dst string, type string")
    paths = graph.solutions(nodes, edges)
    assert sorted((r.fault_id, r.solution) for r in paths.collect() if r.solution) == [("a", "S"), ("a", "T")] and paths.count() == 3
    assert graph.diagnosis(paths).first().solutions == "1. S\n2. T"
    n, left = graph.detach(nodes, edges, spark.createDataFrame([("s",)], "id string"))
    assert n.count() == 3 and left.count() == 1
    kept, inside = ranking.network_cap(nodes.withColumn("depth", F.lit(0)), edges, 2)
    assert kept.count() == 2 and inside.count() == 1
    made = graph.create_edges(edges.withColumn("created_at", F.lit(1)), edges.withColumn("created_at", F.lit(2)))
    assert {r.created_at for r in made.collect()} == {1} and made.count() == 2
    t = spark.createDataFrame([(1, "r", None), (2, "a", 1), (3, "b", 2), (4, "b", 2)], "id int, name string, parent_id int")
    assert sorted(r.id for r in tree.with_descendants(t, [2]).collect()) == [2, 3, 4]
    assert {(r.parent_id, r.kind) for r in tree.children_lists(t).collect()} == {(1, "OBJECT"), (2, "LIST")}


def test_tasks_and_chats(spark):
    t = spark.createDataFrame([("a", "", "x", "3", None, "1.5", None, "1"), ("b", "done", "2", None, "s", "zz", "", "0")], "task_id string, status string, current_step string, total_steps string, step_name string, elapsed_seconds string, error string, cancel string")
    a, b = tasks.snapshot(t).orderBy("task_id").collect()
    assert (a.status, a.current_step, a.total_steps, a.elapsed_seconds, a.error, a.cancelled) == ("unknown", 0, 3, 1.5, None, True)
    assert (b.status, b.elapsed_seconds, b.error, b.cancelled) == ("done", None, "invalid elapsed time", False)
    e = spark.createDataFrame([("Connection refused",), ("read timed out",), ("payload too large",), ("boom",), (None,)], "m string")
    assert [r[0] for r in e.select(tasks.error_kind(F.col("m"))).collect()] == ["connection", "transient", "too_large", "fatal", None]
    at = dt.datetime(2024, 1, 1)
    c = spark.createDataFrame([("k", "u", at, False), ("k", "u", at + dt.timedelta(1), True), ("l", "u", at, None), ("l", "u", at, None)], "chat_id string, user_id string, updated_at timestamp, is_deleted boolean")
    assert [r.chat_id for r in chats.chat_list(c, "u").collect()] == ["l", "l"]
    u = spark.createDataFrame([('{"role": "admin"}', None), ("broken", None), (None, True)], "i string, s boolean")
    assert [r[0] for r in u.select(chats.has_role(F.col("i"), F.col("s"), ("admin",))).collect()] == [True, False, True]
    items = spark.createDataFrame([("b", 1, ["t1", "t2"]), ("b", 0, ["t2", "t3"])], "batch_id string, position int, task_history array<string>")
    assert aggregates.item_tasks(items).first().task_ids == ["t2", "t3", "t1"]
    sl = spark.createDataFrame([(1, 1, 90, True), (1, None, None, False), (2, 1, 5, None)], "doc_id int, page_start int, page_end int, is_fallback boolean")
    assert {r.doc_id: r.level for r in aggregates.slice_alerts(sl).collect()} == {1: "alert", 2: "ok"}


def test_search_edges(spark):
    r = spark.createDataFrame([(1, "pump fault 泵", {}, None, None, [1.0, 0.0], "c", "f"), (2, "valve", {}, True, 1, [1.0, 0.0], "c", "f"), (3, "pump", {}, False, 3, [0.9, 0.1], "d", "f")], "id long, text string, metadata map<string,string>, is_deleted boolean, permission_level int, vector array<double>, collection_name string, source_file string")
    assert [x.id for x in search.bm25_topk(r, "泵 pump", 5).collect()] == [1, 3] and search.bm25_topk(r, "?!", 5).count() == 0
    assert [x.id for x in search.similarity_search(r, "valve", [1.0, 0.0], 5).collect()] == [1, 3]
    assert [x.id for x in search.similarity_search(r, "pump", [1.0, 0.0], 5, collection="d", allowed=(3,)).collect()] == [3]
    assert [search.handler_for(c) for c in ("my_workorder_1", "manual_total", "parameter_updated", "other")] == ["workorder", "manual", "parameter", "generic"]


def test_ingest(spark, tmp_path):
    rows = spark.createDataFrame([(1, " leak ", "fix", "A", "nan"), (2, None, None, "B", "x")], "n int, fault string, solution string, machine_code string, other string")
    chunks = readers.table_chunks(rows, ("fault", "solution"), "n")
    assert chunks.first().text == "fault: leak\nsolution: fix" and chunks.first().metadata == {"machine_code": "A"} and chunks.first().local_key == "row:1"
    chunks = filters.filled_rows(chunks, "text", ("fault", "solution"))
    first = ingest.ingest_rows(chunks, "workorder", "f.xlsx", b"bytes", "workorder", overlay={"batch_id": "b1"})
    again = ingest.ingest_rows(chunks, "workorder", "f.xlsx", b"bytes", "workorder")
    a = first.collect()
    assert len(a) == 1 and a[0].metadata == {"model": "A", "batch_id": "b1"} and a[0].id == again.first().id and a[0].vector
    assert ingest.written_rows(first, first).count() == 1
    assert ingest.report(first).first().status == "active"
    with pytest.raises(ValueError, match="reserved"):
        ingest.ingest_rows(chunks, "workorder", "f", b"", overlay={"id": "1"})
    with pytest.raises(ValueError, match="missing"):
        readers.table_chunks(rows, ("none",), "n")
    p = spark.createDataFrame([(1, n, f"t{n}") for n in (1, 2, 3)], "doc_id int, page int, text string")
    toc = spark.createDataFrame([(1, "One", "1", 1), (1, "Two", "2", 3)], "doc_id int, title string, section_number string, page_start int")
    got = [(r.slice_id, r.chapter_title, r.page_texts) for r in ingest.ingest_pages(p, toc).orderBy("page_start").collect()]
    assert got == [("1__p1_2", "One", ["t1", "t2"]), ("1__p2_3", "One", ["t2", "t3"]), ("2__p3_3", "Two", ["t3"])]
    (tmp_path / "a.txt").write_text("hello\nthere")
    (tmp_path / "b.csv").write_text("x,y\n1,\n2,3\n")
    assert readers.read_file(spark, f"{tmp_path}/a.txt").first().text == "hello\nthere"
    assert [r.text for r in readers.read_file(spark, f"{tmp_path}/b.csv").collect()] == ["1 | ", "2 | 3"]
    with pytest.raises(ValueError, match="no reader"):
        readers.read_file(spark, "a.doc")
    got = readers.binary_pages(spark, f"{tmp_path}/a.txt", lambda raw: raw.decode().split("\n")).collect()
    assert [(r.page, r.text) for r in got] == [(1, "hello"), (2, "there")]
