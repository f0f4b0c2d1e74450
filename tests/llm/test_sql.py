"""Queries of the training-data operators that have SQL give the rows that DuckDB gives."""

import duckdb
import pytest

from quillgrid.llm import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_oracle(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in got.description]
    mine = catalog.QUERIES[name](spark, SF).select(*columns).collect()
    assert sorted(map(tuple, mine), key=repr) == sorted(got.fetchall(), key=repr) and len(mine)
