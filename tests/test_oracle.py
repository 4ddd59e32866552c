"""Every query with SQL gives the SQL's rows, by DuckDB on the same tables; every other one runs."""

from __future__ import annotations

import math

import duckdb
import pandas as pd
import pytest

from roadspark import registry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return con


def rows(frame):
    """Rows as sorted tuples in the order of the column names."""
    names = sorted(frame.columns)
    out = []
    for values in zip(*(frame[n].tolist() for n in names)):
        out.append(tuple(None if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)) else round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in values))
    return names, sorted(out, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n in registry.ORACLE_SQL])
def test_same_rows_as_sql(spark, duck, name):
    got = rows(registry.QUERIES[name](spark, D).toPandas())
    want = rows(duck.execute(registry.ORACLE_SQL[name]).fetchdf())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1]):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5 * max(1, abs(x))), (name, a, b)


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.ORACLE_SQL])
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, D).count() > 0
