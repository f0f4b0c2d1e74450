import numpy as np
import pytest
import xxhash
from pyspark.sql import Row

from quillgrid.llm import simhash

SCHEMA = "doc_id long, text string, fp string, component_id int, rep int"


def slow_fingerprint(text):
    words = (text or "").encode().lower().replace(b"\t", b" ").replace(b"\n", b" ").split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)) if hs else 0


def slow_components(fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_whole_sample_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    fps = [slow_fingerprint(t) for _, t in rows]
    want = {(d, f"{f:016x}", rows[c][0]) for (d, _), f, c in zip(rows, fps, slow_components(fps), strict=True)}
    got = simhash.simhash_components(docs).collect()
    assert len(got) == len(rows)
    assert {tuple(r) for r in got} == want


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(40000))
    data = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one  TWO"), (6, long), (7, long), (7, long), (9, "a b c d é"), (None, "one two")]
    df = spark.createDataFrame([(d, t, "x", 5, 6) for d, t in data], SCHEMA)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in simhash.simhash_components(df).collect())
    by = {d: (f, c) for d, f, c in got}
    assert len(got) == len(data)
    assert by[1] == by[2] == by[3] == ("0" * 16, 1)
    assert by[4] == by[5] and by[5][1] == 4 and by[-1] == by[4]
    assert by[6] == by[7] and by[6][1] == 6
    assert by[9][0] == f"{slow_fingerprint(data[8][1]):016x}"
    assert simhash.simhash_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_bit_slicing(radius):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    fps = np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, (60, 4)).astype(np.uint64)).sum(axis=1, dtype=np.uint64) for b in base])
    q = fps[:40]
    want = np.bitwise_count(q[:, None] ^ fps[None, :]) <= radius
    masks = simhash.Planes(fps).near(q, radius)
    got = np.unpackbits(masks.view(np.uint8), axis=1)[:, : len(fps)].astype(bool)
    assert (got == want).all()
    assert (simhash.within(q[0] ^ fps, radius) == want[0]).all()
    parent = {i: i for i in range(len(fps))}
    full = slow_components_np(fps, radius)
    for a, b in simhash.forest(fps, radius):
        parent[b] = a
    root = [i if parent[i] == i else parent[i] for i in range(len(fps))]
    assert root == full


def slow_components_np(fps, radius):
    label = np.arange(len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    while True:
        new = np.array([label[near[i]].min() for i in range(len(fps))])
        if (new == label).all():
            return list(label)
        label = new


def test_large_bucket_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 8)
    rng = np.random.default_rng(2)
    flips = (np.uint64(1) << rng.integers(0, 12, (90, 2)).astype(np.uint64)).sum(axis=1, dtype=np.uint64)
    fps = np.unique(flips ^ np.uint64(0xABCDEF0123456789))
    reps = spark.createDataFrame([Row(fp=int(np.int64(f.view(np.int64))), rep=i) for i, f in enumerate(fps)])
    from quillgrid.llm.components import components

    got = {r.vertex: r.component for r in components(simhash.links(reps)).collect()}
    full = slow_components_np(fps, 3)
    assert [got.get(i, i) for i in range(len(fps))] == full


def test_rows_without_id_link_others(spark):
    base = " ".join(f"w{k}" for k in range(400))
    near = lambda *cut: " ".join(w for k, w in enumerate(base.split()) if k not in cut)
    texts = [base] + [near(*range(0, k)) for k in range(1, 60)]
    fps = {r.text: r.fp for r in simhash.fingerprints(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")).join(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"), "doc_id").collect()}
    apart = lambda a, b: bin((fps[a] ^ fps[b]) & (2**64 - 1)).count("1")
    chain = next((a, m, b) for a in texts for m in texts for b in texts if apart(a, m) <= 3 and apart(m, b) <= 3 and apart(a, b) > 3)
    got = {r.doc_id: r.component_id for r in simhash.simhash_components(spark.createDataFrame([(1, chain[0]), (None, chain[1]), (2, chain[2])], "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, None: 1}
    alone = simhash.simhash_components(spark.createDataFrame([(None, "only this")], "doc_id long, text string")).first()
    assert alone.component_id is None and len(alone.fingerprint) == 16
