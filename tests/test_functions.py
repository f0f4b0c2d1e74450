import hashlib
import hmac
import json
import uuid

from pyspark.sql import functions as F

from quillgrid.functions import ids, metadata, models, permissions, text, vectors
from quillgrid.functions import json as J


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def one(spark, x, column, kind="string"):
    return spark.createDataFrame([(x,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_text(spark):
    assert one(spark, " a \n\t b　c ", text.clean) == "a b c" and one(spark, None, text.clean) == ""
    assert one(spark, "目 录 Contents", lambda x: text.keyword_hits(x, ("目录", "contents", "none"))) == 2
    assert one(spark, "5mm %mm kn", lambda x: text.occurrences(x, text.UNITS)) == 4
    assert one(spark, "１２ 3.4", lambda x: text.count_codes(x, text.NUMBER)) == 2
    assert one(spark, "短. " * 100, text.long_text_signal) == 4.0 and one(spark, "x" * 179, text.long_text_signal) == 0.0
    for raw, want in ((" a/b c.d ", "a_b_c.d"), ("..x..", "x"), (None, "")):
        assert one(spark, raw, text.safe_name) == want
    assert one(spark, "/a/b\\c.tar.GZ", text.suffix) == ".gz" and one(spark, "a/.bashrc", text.suffix) == "" and one(spark, "x/y.pdf", text.stem) == "y"
    assert one(spark, "/a/ /b/c.pdf", text.folders) == ["a", "b"] and one(spark, None, text.folders) == []
    assert one(spark, "abcdef", lambda x: text.truncated(x, 3)) == "abc..." and one(spark, "abc", lambda x: text.truncated(x, 3)) == "abc"
    for raw, want in (
        ("1.2 Start of it ..... 1-3", ("1.2", "Start of it")),
        ("Plain title....iv", ("", "Plain title")),
        ("3) Third", ("3", "Third")),
        ("IV. Fourth", ("IV", "Fourth")),
        ("第三章 安装", ("第三章", "安装")),
        ("无编号", ("", "无编号")),
        ("", ("", "")),
        (None, ("", "")),
    ):
        assert tuple(one(spark, raw, text.section_and_title)) == want, raw
    assert one(spark, "Title .... ix", text.page_code) == "IX" and one(spark, "Title", text.page_code) == ""
    assert sorted(one(spark, "p 1.2-3 and 4-5 mix", text.footer_codes)) == ["1.2-3", "2-3", "4-5", "MIX"]
    assert one(spark, "a.JPG", text.image_mime) == "image/jpeg" and one(spark, "a", text.image_mime) == "image/png"


def test_vectors(spark):
    rows = [([3.0, 4.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 2.0])]
    got = values(spark, rows, "a array<float>, b array<float>", vectors.l2_normalise(F.col("a")), vectors.cosine(F.col("a"), F.col("b")), vectors.dot(F.col("a"), F.col("b")))
    assert got == [([0.6, 0.8], 0.6, 3.0), (None, None, 0.0), (None, None, None)]


def test_ids(spark):
    for name in ("", "a|b|日本", "x" * 300):
        assert one(spark, name, ids.uuid5) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))
        for key in (b"k", b"k" * 100):
            for digest in ("sha256", "md5"):
                assert one(spark, name, lambda x, k=key, d=digest: ids.hmac(k, x, d)) == hmac.new(key, name.encode(), digest).hexdigest()
    node = spark.createDataFrame([("文件夹?>" * 40, 7)], "type string, id int").select(ids.node_id(F.struct("type", "id")).alias("n"))
    back = node.select(ids.node_of(F.col("n"), "type string, id int").alias("x"), "n").first()
    assert (back.x.type, back.x.id) == ("文件夹?>" * 40, 7) and not set(back.n) & set("+/=\r\n")
    m = [tuple(r)[0] for r in spark.createDataFrame([({"b": "1", "a": "2"},), ({"a": "2", "b": "1"},)], "m map<string,string>").select(ids.canonical_md5(F.col("m"))).collect()]
    assert m[0] == m[1] == hashlib.md5(json.dumps({"a": "2", "b": "1"}, separators=(",", ":")).encode()).hexdigest()


def test_permissions(spark):
    raw = [None, "1", " 2 ", "3", "4", "x", "true", ""]
    got = values(spark, [(x,) for x in raw], "x string", permissions.level(F.col("x")), permissions.visible(permissions.level(F.col("x")), (2, 3)), permissions.visible_raw(F.col("x"), (2, 3)), permissions.visible(permissions.level(F.col("x")), ()))
    assert [g[0] for g in got] == [None, 1, 2, 3, None, None, None, None]
    assert [g[1] for g in got] == [True, False, True, True, True, True, True, True]
    assert [g[2] for g in got] == [True, False, True, True, False, False, False, False]
    assert not any(g[3] for g in got)
    assert permissions.allowed_levels(2) == (2, 3) and permissions.allowed_levels(0) == permissions.allowed_levels(None) == ()


def test_metadata(spark):
    m = {"machine_code": "A", "机型码": "B", "系列": " ", "series": "", "派工单号": "9", "version": "1", "other": "o"}
    got = one(spark, m, lambda x: metadata.normalised(x, "workorder"), "map<string,string>")
    assert got == {"model": "A", "series": "", "work_order_number": "9", "other": "o"}
    assert one(spark, m, lambda x: metadata.conflicts(x, "workorder"), "map<string,string>") == ["model"]
    view = one(spark, m, lambda x: metadata.canonical_view(x, "workorder"), "map<string,string>")
    assert view == m | {"model": "A", "work_order_number": "9"}
    names = [("workorder", "workorder"), ("x_workorder_graph_1", "workorder_graph"), ("Manual_Total", "manual"), ("special_workorder-2", "special_workorder"), ("workorders", ""), (None, "")]
    for name, want in names:
        assert one(spark, name, metadata.collection_type) == want, name
    assert metadata.search_filter({"机型码": "B", "machine_code": "A", "free": 1}, "workorder") == {"model": ("A", ("model", "machine_code", "机型码")), "free": (1, ("free",))}
    there = one(spark, {"机型": "M", "x": "y"}, metadata.renamed, "map<string,string>")
    assert there == {"machine_type": "M", "x": "y"} and one(spark, there, lambda x: metadata.renamed(x, back=True), "map<string,string>") == {"机型": "M", "x": "y"}
    assert [one(spark, x, metadata.tonnage) for x in ("120.9", " 7 ", "", "nan", "x", None)] == [120, 7, None, None, None, None]


def test_json(spark):
    for raw, want in (('{"a":1}', '{"a":1}'), ('so:\n```json\n{"a":2}\n```', '{"a":2}'), ('text {"a":{"b":3}} more', '{"a":{"b":3}}'), ("[1,2] tail", "[1,2]"), ("none", None), ("", None), (None, None)):
        assert one(spark, raw, J.json_in) == want, raw
    g = one(spark, '{"summary": "s", "entities": [{"name": "n"},],}', J.chunk_graph)
    assert g.summary == "s" and g.entities[0].name == "n" and g.relations == []
    assert one(spark, '{"entities": []}', J.chunk_graph) is None


def test_models(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["pump fault", "", None, "pump fault"])], "id int, text string")
    got = {r.id: r.vector for r in models.embed(df, models.hashing_encoder(16)).collect()}
    assert got[0] == got[3] and abs(sum(x * x for x in got[0]) - 1) < 1e-9 and got[1] is None and got[2] is None

    def broken(texts, is_query):
        raise OSError("down")

    assert all(r.vector is None for r in models.embed(df, broken).collect())
    assert values(spark, [("a b", "b c")], "q string, t string", models.word_overlap(F.col("q"), F.col("t"))) == [(0.5,)]
    assert one(spark, "First one. Second.", models.summary) == "First one."
