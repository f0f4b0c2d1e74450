import random
import re

import numpy as np
import pyarrow as pa

from quillgrid.llm import decontam


def slow_words(text):
    small = re.sub("[A-ZÀ-ÖØ-Þ]", lambda m: m[0].lower(), text or "")
    return re.findall(rb"[0-9A-Za-z\x80-\xff]+", small.encode())


def slow_score(a, b):
    best, prev = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, prev[j] + (2 if x == y else -1), prev[j + 1] - 1, row[-1] - 1))
            best = max(best, row[-1])
        prev = row
    return best


def test_alignment_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(150):
        a, b = rng.integers(0, 6, rng.integers(1, 15)).astype(np.uint64), rng.integers(0, 6, rng.integers(1, 30)).astype(np.uint64)
        score, lo, hi = decontam.smith_waterman(a, b)
        assert score == slow_score(a.tolist(), b.tolist())
        assert score == slow_score(a.tolist(), b[lo:hi].tolist())


def test_sample_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = {r.item_id: slow_words(r.text) for r in bench.collect()}
    want = {}
    for r in docs.collect():
        w = slow_words(r.text)
        for i, goal in items.items():
            if len(set(goal) & set(w)) * 3 >= len(set(goal)):
                share = slow_score(goal, w) / (2 * len(goal))
                if share >= decontam.MIN_SCORE:
                    want[r.doc_id, i] = share
    got = {(r.doc_id, r.item_id): r for r in decontam.leaks(docs, bench).collect()}
    assert got.keys() == want.keys() and len(want) >= 3
    for k, r in got.items():
        assert abs(r.score - want[k]) < 1e-9
    kept = {r.doc_id for r in decontam.decontaminate(docs, bench).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


def test_edited_copies(spark):
    rng = random.Random(4)
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").orderBy("item_id").limit(12)
    docs, clean = [], []
    for k, r in enumerate(bench.collect()):
        w = r.text.split()
        edited = [x if rng.random() > 0.15 else f"edit{rng.random()}" for x in w]
        del edited[rng.randrange(len(edited))]
        docs.append((k, "Lead in words. " + " ".join(edited).upper().replace(" ", "***\n") + " and out."))
        rng.shuffle(w)
        clean.append((100 + k, " ".join(w)))
    df = spark.createDataFrame(docs + clean, "doc_id long, text string")
    got = decontam.leaks(df, bench).collect()
    assert {r.doc_id for r in got} == {d for d, _ in docs}
    text = dict(docs)
    for r in got:
        span = text[r.doc_id].encode()[r.lo : r.hi]
        assert b"Lead" not in span and len(slow_words(span.decode())) == r.end_word - r.first_word


def test_edges(spark):
    item = "one two three four five six seven"
    long = "pad " * 100000 + item + " pad" * 100000
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, long, 3), (4, item, 4), (4, item, 4), (None, item, 5), (5, "hi there you", 0)], "doc_id long, text string, _leak int")
    bench = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, "", "x"), (4, "hi there", "x"), (None, "?!", "x")], "item_id long, text string, doc_id string")
    got = sorted((r.doc_id or -1, r.item_id, r.score) for r in decontam.leaks(df, bench).collect())
    assert got == [(-1, 1, 1.0), (3, 1, 1.0), (4, 1, 1.0), (4, 1, 1.0), (5, 4, 1.0)]
    assert decontam.leaks(df, bench.limit(0)).count() == 0 and decontam.leaks(df.limit(0), bench).count() == 0
    assert sorted((r.doc_id or -1) for r in decontam.decontaminate(df, bench).collect()) == [1, 2]


def test_blocks_of_items(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    key = lambda df: sorted((r.doc_id, r.item_id, r.score) for r in df.collect())
    want = key(decontam.leaks(docs, bench))
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 700)
    assert key(decontam.leaks(docs, bench)) == want
    assert pa is not None
