"""Each query against its SQL on the small tables."""

import glob
import os

import duckdb
import pytest

from cairnset.plans import catalog

@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    return c


def rows(cols, found):
    return sorted(tuple(repr(float(v)) if isinstance(v, float) else str(v) for v in (r[cols.index(c)] for c in sorted(cols))) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, con, sf_dir, name):
    got, want = catalog.QUERIES[name](spark, sf_dir), con.sql(catalog.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_gives_known_rows(spark, sf_dir, name):
    found = catalog.QUERIES[name](spark, sf_dir).limit(1000).collect()
    assert found and all(any(v is not None for v in r) for r in found)
