"""Every query with an SQL twin, against DuckDB over the small tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__
from neurolake.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def check(spark, duck, name, query, sql):
    want = duck.execute(sql).df()
    got = query(spark, SF).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    want, got = (x[cols].sort_values(cols).reset_index(drop=True) for x in (want, got))
    assert len(want) == len(got)
    for c in cols:
        same = (want[c] == got[c]) | (want[c].isna() & got[c].isna())
        if want[c].dtype.kind == "f":
            same |= (want[c].astype(float) - got[c].astype(float)).abs() <= 2e-6 * want[c].astype(float).abs().clip(lower=1)
        assert same.all(), (name, c, want[~same].head(3).to_dict(), got[~same].head(3).to_dict())


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, duck, name):
    check(spark, duck, name, catalog.QUERIES[name], catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
