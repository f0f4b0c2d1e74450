import pytest
from pyspark.sql import functions as F

from quillgrid.operators import ivf, lookups
from quillgrid.plans import handlers


def test_lookups(spark):
    r = spark.createDataFrame([(1, "c", {"a": "1"}, None, "b"), (2, "c", {"a": "2"}, False, "b"), (3, "d", {}, True, "b")], "id int, collection_name string, metadata map<string,string>, is_deleted boolean, batch_id string")
    ids = lambda df: sorted(x.id for x in df.collect())
    assert ids(lookups.by_ids(r, spark.createDataFrame([(1,), (3,), (3,)], "id int"))) == [1]
    assert ids(lookups.by_collection(r, "c")) == [1, 2] and ids(lookups.batch_ids(r, "b")) == [1, 2]
    assert ids(lookups.ids_where(r, {"a__ne": "1"})) == [2, 3] and ids(lookups.ids_where(r, {"a": "1"})) == [1]
    assert [x.id for x in lookups.find(r, {"collection_name": "c"}, most=1).collect()] == [2] and lookups.exists(r, {"is_deleted": None}) and not lookups.exists(r, {"id": 9})
    k = spark.createDataFrame([("task:1",), ("task_x",), ("other",)], "key string")
    assert [x.key for x in lookups.keys_like(k, "task:*").collect()] == ["task:1"] and lookups.keys_like(k, "task_*").count() == 1
    p = spark.createDataFrame([('{"data": {"x": 1}}',), ('{"data": [{"x": 2}]}',), ("no",)], "p string")
    assert [x[0] for x in p.select(lookups.device_data(F.col("p"))).collect()] == ['{"x":1}', '{"x":2}', None]
    u = spark.createDataFrame([("a.pdf", 5), ("a.txt", 5), (" ", 5), ("a.pdf", 0), ("a.pdf", 11 << 20)], "name string, size long")
    assert [x.problem for x in lookups.upload_errors(u, "manual").collect()] == [None, "suffix", "no_name", "empty", "too_large"]
    terms, size = lookups.postings(spark.createDataFrame([(1, "Ab ab 泵泵"), (2, None)], "id int, text string"))
    assert sorted((x.term, x.id, x.tf) for x in terms.collect()) == [("ab", 1, 2), ("泵", 1, 2)] and {x.id: x.dl for x in size.collect()} == {1: 4, 2: 0}
    n, e = lookups.fault_pairs(spark.createDataFrame([("f", "s"), ("f", "t"), (" ", "u"), ("g", None)], "a string, b string"), "a", "b")
    assert n.count() == 4 and e.count() == 2
    t = spark.createDataFrame([("2024-01-01T00:00:00",), ("1704067200",), ("x",), (None,)], "t string").select(lookups.utc(F.col("t")).cast("long").alias("s"))
    assert [x.s for x in t.collect()] == [1704067200, 1704067200, None, None]
    a = spark.createDataFrame([(list("abcde"),), ([],)], "a array<string>").select(lookups.groups_of(F.col("a"), 2))
    assert [x[0] for x in a.collect()] == [[["a", "b"], ["c", "d"], ["e"]], []]
    node = lookups.knowledge_node(spark.createDataFrame([(1, "n", {"tonnage": "90.5", "k": "v"})], "id int, text string, metadata map<string,string>"), "f", F.lit(2))
    back = node.select(lookups.node_metadata(F.col("metadata")).alias("m")).first().m
    assert back == {"field": "f", "permission_level": "2", "is_deleted": "false", "tonnage": "90", "k": "v"}


def test_handlers(spark):
    assert handlers.handler("workorder_v2").kind == "workorder" and handlers.handler("x").kind == "" and handlers.handler("principle").ingest is None
    old = spark.createDataFrame([(1, "a", 1)], "id int, v string, created_at int")
    new = spark.createDataFrame([(1, "b", 9), (2, "c", 9)], "id int, v string, created_at int")
    assert sorted(map(tuple, handlers.upsert_messages(old, new, "id").collect())) == [(1, "b", 1), (2, "c", 9)]
    assert handlers.checked_upsert(old, new, "ok_1", "id").count() == 2
    with pytest.raises(ValueError):
        handlers.checked_upsert(old, new, "not ok", "id")
    got = handlers.extract_graphs(spark.createDataFrame([(i, i, f"t{i}") for i in range(5)], "id int, position int, text string"), lambda ts: [t.upper() for t in ts], 2)
    assert [r.answer for r in got.orderBy("position").collect()] == [f"T{i}" for i in range(5)]


def test_ivf_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = e.filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    index = ivf.build(e, nlist=8)
    assert index.table.count() == e.count() == index.table.select("id").distinct().count()
    assert ivf.recall(ivf.search(index, q, 5, 8), e, q, 5) == 1.0
    assert ivf.recall(ivf.search(index, q, 5, 7), e, q, 5) >= 0.9  # the vectors have no clusters, so most cells count


def test_groups_compute_their_array_once(spark):
    df = spark.createDataFrame([(" ".join(["w"] * 9),), ("",), (None,)], "t string").select(lookups.groups_of(F.split("t", " "), 4).alias("g"))
    assert [[len(x) for x in r.g] for r in df.collect()] == [[4, 4, 1], [1], []]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
