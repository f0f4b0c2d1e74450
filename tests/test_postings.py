import random

import pytest

from quillgrid.operators import postings, search


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(4)
    words = [f"w{k}" for k in range(60)] + ["é", "中"]
    rows = [(k, " ".join(r.choices(words, weights=[1 / (n + 1) for n in range(62)], k=r.randint(0, 60)))) for k in range(3000)] + [(3000, None), (3001, "w50 " * 400), (3002, "W5, w5! w5中w5")]
    return spark.createDataFrame(rows, "id long, text string").repartition(6)


def plain(df):
    return [(r[0], round(r[1], 7)) for r in df.collect()]


@pytest.mark.parametrize("first", [1, 16])
def test_equals_the_scan(spark, corpus, monkeypatch, first):
    monkeypatch.setattr(postings, "BLOCK", 100)
    index = postings.build(corpus)
    assert index.rows == 3003
    for q in ("w5", "w0 w1 w40", "w61 nowhere", "é 中", "w50 w3", "", "nowhere"):
        for k in (1, 7, 5000):
            assert plain(postings.topk(index, q, k, first=first)) == plain(search.bm25_topk(corpus, q, k)), (q, k)
    some = corpus.filter("id % 3 = 0").select("id")
    assert plain(postings.topk(index, "w2 w9", 9, some)) == plain(search.bm25_topk(corpus.filter("id % 3 = 0"), "w2 w9", 9))


def test_reads_its_terms_alone(spark, corpus):
    index = postings.build(corpus)
    plan = postings.read_blocks(index, "w5 w6")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "term" in plan.split("PushedFilters")[1]
    assert {r.term for r in postings.read_blocks(index, "w5 w6").collect()} == {"w5", "w6"}


def test_empty(spark):
    index = postings.build(spark.createDataFrame([], "id long, text string"))
    assert index.rows == 0 and postings.topk(index, "x").count() == 0
