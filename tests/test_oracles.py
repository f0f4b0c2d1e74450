"""Every registered query with an oracle gives the rows that DuckDB gives for its SQL."""

import duckdb
import pytest

from quillgrid import catalog, catalog_files, catalog_more, catalog_stores  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fix = lambda v: round(v, 4) if isinstance(v, float) else (float(v) if type(v).__name__ == "Decimal" else v)
    return sorted((tuple(fix(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in got.description]
    want = got.fetchall()
    assert sorted(columns) == sorted(df.columns)
    mine = plain([tuple(r) for r in df.collect()], df.columns)
    assert mine == plain(want, columns) and (mine or name in ())


def test_queries_without_oracle(spark):
    for name in catalog.QUERIES.keys() - catalog.ORACLES.keys():
        assert catalog.QUERIES[name](spark, SF).count() > 0
