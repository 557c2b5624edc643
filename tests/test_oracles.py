"""Every registered query against its oracle, on the smallest tables."""

import os

import duckdb
import pytest

from placewright import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, oracle, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(map(str, (r[c] for c in columns))) for r in df.select(columns).collect())
    if name not in catalogue.ORACLES:
        assert got
        return
    told = oracle.execute(catalogue.ORACLES[name])
    names = [d[0] for d in told.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(str(row[i]) for i in at) for row in told.fetchall())
