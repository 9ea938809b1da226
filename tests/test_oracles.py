"""Every registered query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    if isinstance(x, int):
        return float(x)
    return str(x)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    got = entry.queries()[name](spark, DATA)
    rel = con.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(rel.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in got.collect()]
    at = [rel.columns.index(c) for c in columns]
    want = [tuple(plain(r[i]) for i in at) for r in rel.fetchall()]
    key = lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)
    rows, want = sorted(rows, key=key), sorted(want, key=key)
    assert len(rows) == len(want)
    off = [(a, b) for a, b in zip(rows, want, strict=True) if any(x != y and not (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-5)) for x, y in zip(a, b, strict=True))]
    assert not off[:3]


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
