"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from planloom.plans import catalog_queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def oracle():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    one = lambda v: round(v, 4) if isinstance(v, float) else v
    return [columns[i] for i in order], sorted((tuple(one(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog_queries.QUERIES))
def test_matches_sql(spark, oracle, name):
    df = catalog_queries.QUERIES[name](spark, DATA)
    cursor = oracle.execute(catalog_queries.SQL[name])
    assert plain(df.collect(), df.columns) == plain(cursor.fetchall(), [c[0] for c in cursor.description])
