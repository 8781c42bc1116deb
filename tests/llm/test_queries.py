"""Queries of the training-data operators against brute force in SQL, on the small tables."""

import glob
import os

import duckdb
import pytest

from cairnset.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    got, want = queries.QUERIES[name](spark, sf_dir), con.sql(queries.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r) for r in got.select(*want.columns).collect()) == sorted(want.fetchall())
