"""Corpus queries that SQL can express, against it."""

import duckdb
import pytest

from placewright.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    columns = ", ".join(df.columns)
    want = con.execute(f"SELECT {columns} FROM ({queries.ORACLES[name]})").fetchall()
    assert want and sorted(map(tuple, df.collect())) == sorted(want)
