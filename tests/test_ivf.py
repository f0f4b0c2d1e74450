"""The index of inverted cells finds nearly all of the exact best, at a tenth of the rows where these have clusters."""

import numpy as np
from pyspark.sql import functions as F

from quillgrid import catalog, catalog_stores  # noqa: F401  registers its queries
from quillgrid.operators import ivf


def test_recall_of_the_registered_query(spark):
    sf = "/root/testdata/sf0.01"
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = e.filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    got = catalog.QUERIES["ivf_topk"](spark, sf)
    assert got.count() == 5 * q.count() and ivf.recall(got, e, q, 5) >= 0.9


def test_clusters_are_found_at_a_tenth_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(ivf, "PART", 60)
    r = np.random.default_rng(5)
    centres = r.normal(size=(40, 16))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    rows = centres[r.integers(0, 40, 4000)] + 0.08 * r.normal(size=(4000, 16))
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    e = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)] + [(4000, None), (4001, [1.0])], "id long, vector array<double>")
    q = e.filter("id % 100 = 0 and id < 4000").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    index = ivf.build(e)
    assert sum(index.sizes.values()) == 4000 == index.table.count() and max(index.sizes.values()) > 60
    probes = ivf.tuned(index, q, 5)
    assert probes is not None and ivf.scored_rows(index, q, probes) <= 0.1 * 4000 * 40
    found = ivf.search(index, q, 5, probes)
    assert found.count() == 200 and ivf.recall(found, e.filter("id < 4000"), q, 5) >= 0.9
    plan = index.table.filter("cell in (1, 2)")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    # every cell probed: the exact search
    assert ivf.recall(ivf.search(index, q, 5, len(index.centres)), e.filter("id < 4000"), q, 5) == 1.0


def test_without_clusters_the_search_is_exact(spark):
    rows = np.random.default_rng(6).normal(size=(600, 32))
    e = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "id long, vector array<double>")
    q = e.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    assert ivf.tuned(ivf.build(e), q, 5) is None and ivf.recall(ivf.topk(e, q, 5), e, q, 5) == 1.0
    assert ivf.topk(e.limit(0), q, 5).count() == 0
