import json
import random

from quillgrid.operators import parameters, tree


def random_tree(r, depth, lists=True):
    """A tree; members of a list's items are no lists."""
    out = {}
    for _ in range(r.randint(1, 3)):
        kind = r.randrange(3 if lists else 2) if depth > 1 else 0
        name = r.choice(['a"b', "c\\d", "é", "x y", "n1", "n2", "z'q"]) + str(r.randrange(100))
        out[name] = ["text " + r.choice(["", '"', "日本", "\n"]), random_tree(r, depth - 1), [random_tree(r, depth - 1, False)]][kind] if kind else "text " + r.choice(["", '"', "日本", "\n"])
    return out


def test_round_trip(spark):
    r = random.Random(2)
    sets = {k: random_tree(r, 4) for k in range(40)}
    df = spark.createDataFrame([(k, json.dumps(v), "x") for k, v in sets.items()], "set_id long, json string, name string")
    nodes = parameters.parse(df)
    assert nodes.filter("problem is not null").count() == 0
    assert {x.set_id: json.loads(x.json) for x in parameters.rebuilt(parameters.accepted(nodes)).collect()} == sets


def test_several_items_and_problems(spark):
    rows = [(1, '{"l": [{"a": "1"}, {"b": {"c": "2"}}], "o": {}}'), (2, '{"n": 5, "t": "x"}'), (3, '{"l": ["x"]}'), (4, '{"l": [{"a": []}]}'), (5, "[1]"), (6, None), (7, "{broken"), (8, "{}")]
    nodes = parameters.parse(spark.createDataFrame(rows, "set_id long, json string"))
    assert {x.set_id for x in nodes.filter("problem is not null").collect()} == {2, 3, 4, 5, 6, 7}
    kept = parameters.accepted(nodes)
    assert {x.set_id: json.loads(x.json) for x in parameters.rebuilt(kept).collect()} == {1: {"l": [{"a": "1", "b": {"c": "2"}}], "o": None}}
    said = {x.set_id: x.text for x in parameters.described(kept).collect()}
    assert said == {1: '该JSON包含以下字段\n- "l"字段是一个列表，每个元素包含以下属性:\n    - "a"字段是一个字符串，表示"1"\n    - "b"字段是一个字典，包含以下字段：\n        - "c"字段是一个字符串，表示"2"\n- "o"字段是一个字符串，表示""'}
    assert parameters.rebuilt(kept.limit(0)).count() == 0 and parameters.parse(spark.createDataFrame([], "set_id long, json string")).count() == 0


def test_cycles_end(spark):
    rows = [(1, "a", None, "root", None), (1, "b", "a", "kid", "t"), (1, "c", "d", "x", "t"), (1, "d", "c", "y", "t")]
    nodes = spark.createDataFrame(rows, "set_id long, id string, parent_id string, name string, description string")
    assert [json.loads(x.json) for x in parameters.rebuilt(nodes).collect()] == [{"root": {"kid": "t"}}]
    loop = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (4, None)], "id long, parent_id long")
    assert sorted(x.id for x in tree.with_descendants(loop, [2]).collect()) == [1, 2, 3]
    assert sorted(x.id for x in tree.with_descendants(loop, [4, 3]).collect()) == [3, 4]


def test_templates(spark):
    template = {"a": "said", "o": {"b c": "said"}, "l": [{"x": "said"}, {"y": {"z": "said"}}], "any": None}
    good = {"a": "1", "o": {"b c": "2", "more": 3}, "l": [{"x": "1"}, {"y": {"z": ""}}], "any": 5, "rest": []}
    cases = [good, {**good, "l": []}, {**good, "a": 1}, {**good, "o": "x"}, {**good, "o": {}}, {**good, "l": {}}, {**good, "l": [{"x": 1}]}, {**good, "l": ["x"]}, {k: v for k, v in good.items() if k != "any"}, []]
    texts = [json.dumps(c) for c in cases] + ["{", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [x.ok for x in df.select("k", parameters.fits(df.t, template).alias("ok")).orderBy("k").collect()]
    assert got == [True, True] + [False] * 10


def test_trees_take_one_shuffle_and_no_join(spark):
    df = spark.createDataFrame([(1, '{"a": "x"}')], "set_id long, json string")
    for made in (parameters.rebuilt, parameters.described):
        plan = made(parameters.accepted(parameters.parse(df)))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Join" not in plan, plan


def test_odd_nodes(spark):
    sets = [(1, '{"a": 1e999999}'), (2, '{"a": "1", "a": "2"}'), (3, ' {"b": "\\ud83d", "a\\u001f": "\\u000b/"} x'), (4, '{"l": [[]]}'), (5, '{"a": NaN}')]
    nodes = parameters.parse(spark.createDataFrame(sets, "set_id long, json string"))
    assert {x.set_id for x in nodes.filter("problem is not null").collect()} == {1, 2, 4, 5}
    assert [(x.set_id, x.json) for x in parameters.rebuilt(parameters.accepted(nodes)).collect()] == [(3, '{"a\\u001F":"\\u000B/","b":"?"}')]
    rows = [(1, "a", None, None, None), (1, "b", "a", "k", "1"), (1, "c", "a", "k", "2"), (2, "x", "y", "n", "t"), (3, "a", None, "r", "LIST"), (3, "a", "a", "s", "t")]
    loose = spark.createDataFrame(rows, "set_id long, id string, parent_id string, name string, description string")
    assert {x.set_id: x.json for x in parameters.rebuilt(loose).collect()} == {1: '{"null":{"k":"2"}}', 3: '{"r":[{"s":"t"}]}'}
