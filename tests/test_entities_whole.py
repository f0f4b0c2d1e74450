"""Entity resolution over whole labels, held to brute force over all pairs."""

import numpy as np
from pyspark.sql import functions as F

from quillgrid import catalog
from quillgrid.operators import graph


def slow_entities(rows, over):
    entity = {k: k for k, _, _ in rows}
    links = [(a, b) for a, x, p in rows for b, y, q in rows if a < b and p == q and np.dot(x, y) > over]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            m = min(entity[a], entity[b])
            moved |= entity[a] != m or entity[b] != m
            entity[a] = entity[b] = m
    return {k: entity[k] for pair in links for k in pair}


def test_blocks_against_brute_force(spark):
    r = np.random.default_rng(3)
    rows = [(int(k) * 50, [float(x) for x in v / np.linalg.norm(v)], int(k) % 2) for k, v in enumerate(r.normal(size=(120, 6)))]
    rows += [(100000 + k, rows[0][1], 0) for k in range(40)] + [(200000, rows[1][1], 1)]
    df = spark.createDataFrame([*rows, (None, rows[0][1], 0), (300000, None, 0)], "k long, v array<double>, p int")
    for block in (16, 1024):
        links = graph.similar_links(df, "k", "v", "p", 0.9, block)
        assert {x.id: x.entity for x in graph.entities(links).collect()} == slow_entities(rows, 0.9)
        assert links.count() < 1000
    assert graph.similar_links(df.limit(0), "k", "v", "p", 0.9).count() == 0


def test_far_ids_meet(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(x.vec_id, np.array(x.embedding, float), x.label) for x in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    ids, m, label = np.array([x[0] for x in rows]), np.stack([x[1] for x in rows]), np.array([x[2] for x in rows])
    near = (m @ m.T > 0.4) & (label[:, None] == label[None, :]) & (ids[:, None] < ids[None, :])
    some = set(ids[np.flatnonzero(near.any(0) | near.any(1))].tolist())
    want = slow_entities([x for x in rows if x[0] in some], 0.4)
    got = {x.id: x.entity for x in catalog.canonical_entities_whole(spark, sf).collect()}
    assert got == want
    assert {x.id: x.entity for x in catalog.canonical_entities(spark, sf).collect()} == want


def test_order_against_a_plain_fold(spark):
    sf = "/root/testdata/sf0.01"
    made, want = {}, {}
    for x in sorted(spark.read.parquet(f"{sf}/embeddings.parquet").collect(), key=lambda x: x.vec_id):
        v = np.array(x.embedding, float)
        best = max(((float(m @ v), -k) for k, m in made.get(x.label, [])), default=(0.0, 0))
        if best[0] > 0.3:
            want[x.vec_id] = -best[1]
        else:
            made.setdefault(x.label, []).append((x.vec_id, v))
            want[x.vec_id] = x.vec_id
    got = {x.id: x.entity for x in catalog.canonical_in_order(spark, sf).collect()}
    assert got == want and len(set(want.values())) < len(want)
    df = spark.createDataFrame([(1, 0, [1.0, 0.0], "p"), (2, 1, None, "p"), (3, 2, [1.0, 0.0], None)], "id long, pos int, v array<double>, part string")
    assert sorted((x.id, x.entity) for x in graph.resolved_in_order(df, "id", "pos", "v", "part").collect()) == [(1, 1), (2, 2), (3, 3)]


def slow_order(rows, least):
    made, out = {}, {}
    for k, v, p in rows:
        best = max(((float(np.dot(m, v)), -n, own) for n, (own, m) in enumerate(made.get(p, []))), default=(-2.0, 0, 0))
        out[k] = best[2] if best[0] > least else k
        if out[k] == k:
            made.setdefault(p, []).append((k, v))
    return out


def test_order_in_batches_and_few_rounds(spark, monkeypatch):
    r = np.random.default_rng(7)
    rows = [(int(k), [float(x) for x in v / np.linalg.norm(v)], int(k) % 3 // 2) for k, v in enumerate(r.normal(size=(700, 8)))]
    df = spark.createDataFrame([(k, v, p) for k, v, p in rows], "k long, v array<double>, p int").withColumn("pos", F.col("k") * 3)
    want = slow_order(rows, 0.5)
    rounds = []
    monkeypatch.setattr(graph, "written", lambda x, name, own=graph.written: (rounds.append(name), own(x, name))[1])
    for first, block in ((4096, 1024), (20, 16), (100, 64)):
        rounds.clear()
        monkeypatch.setattr(graph, "_FIRST", first)
        assert {x.k: x.entity for x in graph.resolved_in_order(df, "k", "pos", "v", "p", 0.5, block).collect()} == want
        assert rounds.count("links") == (1 if first > 1000 else 2 if first == 100 else 3 if first * 16 < 466 else 2) and rounds.count("open") < 15 * rounds.count("links")
    monkeypatch.setattr(graph, "_FIRST", 4096)
    chain = spark.createDataFrame([(k, [float(np.cos(k)), float(np.sin(k))], 0) for k in (x * 0.3 for x in range(12))], "k double, v array<double>, p int")
    slow = slow_order([(x.k, list(x.v), 0) for x in chain.orderBy("k").collect()], 0.95)
    assert {x.k: x.entity for x in graph.resolved_in_order(chain, "k", "k", "v", "p", 0.95).collect()} == slow
    named = df.withColumn("pos", F.format_string("%09d", "k"))
    assert {x.k: x.entity for x in graph.resolved_in_order(named, "k", "pos", "v", "p", 0.5).collect()} == want
