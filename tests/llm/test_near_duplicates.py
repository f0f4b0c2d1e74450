"""The groups of near-duplicates are those of brute force over all pairs of shingle sets."""

import random

import numpy as np
import pytest

from quillgrid.llm import shingles, simhash


def slow_set(text, width=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())


def slow_groups(rows, least=0.8):
    """For each distinct (doc_id, text): the number of its group, by all pairs."""
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    found = [slow_set(t) for _, t in rows]
    to = list(range(len(rows)))

    def top(k):
        while to[k] != k:
            k = to[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            a, b = found[i], found[j]
            if (not a and not b) or (a and b and len(a & b) >= least * len(a | b) - 1e-9):
                to[top(i)] = top(j)
    return {r: top(k) for k, r in enumerate(rows)}


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, rep string, size int")
    want = slow_groups(rows)
    groups = simhash.near_duplicates(df)
    named = df.selectExpr("doc_id", "text", "xxhash64(text) as text_hash").distinct()
    groups = groups.withColumnsRenamed({"doc_id": "d", "text_hash": "h"})
    both = named.join(groups, named.doc_id.eqNullSafe(groups.d) & (named.text_hash == groups.h)).collect()
    assert len(both) == len(want)
    pairs = {(r.group_id, want[(r.doc_id, r.text)]) for r in both}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    assert sum(r.keeps for r in both) == len(pairs)
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == len(pairs) and {want[r] for r in got} == set(want.values())
    for r in got:  # the least doc_id of the group, null last
        assert r[0] == min((x[0] for x, g in want.items() if g == want[r] and x[0] is not None), default=None)
    return len(pairs)


def edited(r, text, share):
    return " ".join(f"e{r.randrange(9999)}" if r.random() < share else w for w in text.split())


def test_edited_copies_against_all_pairs(spark):
    r = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(r.choices(words, k=r.choice([4, 12, 30, 60, 200])))) for k in range(60)]
    for k in range(240):
        rows.append((100 + k, edited(r, r.choice(rows)[1], r.choice([0.0, 0.004, 0.01, 0.02, 0.05]))))
    n = check(spark, rows)
    assert 60 < n < 280


def test_nulls_repeats_and_one_id_with_several_texts(spark):
    t = [" ".join(f"{c}{k}" for k in range(40)) for c in "abcdef"]
    rows = [(None, t[0]), (None, t[1]), (None, t[2]), (5, t[3]), (5, t[4]), (6, t[5])]
    assert check(spark, rows) == 6
    rows += [(6, t[5]), (None, t[0]), (7, t[0] + " end"), (8, None), (9, ""), (10, " \n"), (11, "a b"), (12, "A  b"), (13, "a")]
    assert check(spark, rows) == 6 + 1 + 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash.drop_near_duplicates(df.limit(0)).count() == 0


def test_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert check(spark, rows) < len(rows)


@pytest.mark.parametrize("radius", [0, 3, 7, 38, 64])
def test_wide_planes(radius):
    r = np.random.default_rng(radius)
    fps = r.integers(0, 1 << 63, (300, 2), dtype=np.uint64)
    for k in range(0, 300, 3):
        fps[k] = fps[0]
        for b in r.integers(0, 128, radius + k % 3):
            fps[k, b // 64] ^= np.uint64(1 << int(b % 64))
    apart = np.array([[bin(int(a[0] ^ b[0])).count("1") + bin(int(a[1] ^ b[1])).count("1") for a in fps] for b in fps[:4]])
    masks = simhash.Planes(fps).near(fps[:4], radius)
    for k in range(4):
        assert (np.unpackbits(masks[k].view(np.uint8))[:300].astype(bool) == (apart[k] <= radius)).all()
        assert (simhash.within(fps[k] ^ fps, radius) == (apart[k] <= radius)).all()


def test_prefixes_and_radius():
    n = np.arange(1, 200)
    assert (shingles.prefix_sizes(n, 0.8) == n - -(-n * 4 // 5) + 1).all()
    assert 30 < shingles.radius(0.8) < 50 and shingles.radius(1.0) == 0
