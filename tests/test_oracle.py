"""Each query against its SQL, on the smallest tables (the driver does the same on larger ones)."""

import math
import os

import duckdb
import pytest

from graphloom.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    result = con.execute(SQL[name])
    columns = [d[0] for d in result.description]
    want = sorted((tuple(plain(v) for v in r) for r in result.fetchall()), key=str)
    df = QUERIES[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(columns)
    if name == "evaluate_facts":
        return  # which facts the smallest corpus holds is up to it
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).collect() is not None
