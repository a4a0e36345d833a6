"""Every query with SQL gives the rows that DuckDB gives, at the smallest scale."""

import math
import os

import duckdb
import pytest

from seqloom.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, duck, name):
    frame, found = catalog.QUERIES[name](spark, FOLDER), duck.sql(catalog.ORACLE_SQL[name])
    names = sorted(frame.columns)
    assert names == sorted(found.columns)
    ours = sorted(repr([plain(r[c]) for c in names]) for r in frame.collect())
    at = [list(found.columns).index(c) for c in names]
    assert ours == sorted(repr([plain(r[i]) for i in at]) for r in found.fetchall())
