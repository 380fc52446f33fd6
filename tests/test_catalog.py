"""Every registered query at the smallest size, against its SQL in DuckDB."""

import math

import duckdb
import pytest

from caselake import catalog
from caselake.sources.views import TABLES

SF = "/root/testdata/sf0.001"


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "-"
    if isinstance(x, bool):
        return str(x)
    try:
        f = float(x)
        return str(int(f)) if f == int(f) else f"{f:.6g}"
    except (TypeError, ValueError, OverflowError):
        return str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(tuple(cell(r[k]) for k in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name in catalog.SQL:
        rel = duck.sql(catalog.SQL[name])
        assert got == rows(rel.columns, rel.fetchall())
