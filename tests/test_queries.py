"""Every core query against its SQL, over the smallest tables."""

import datetime
import decimal
from pathlib import Path

import duckdb
import pytest

from textloom.plans.catalogue import QUERIES, SQL


def plain(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    return str(v) if isinstance(v, (datetime.datetime, dict, list)) else v


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in SQL:
        assert got
        return
    rel = duck.sql(SQL[name])
    assert columns == sorted(rel.columns)
    order = [rel.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in order) for r in duck.execute(SQL[name]).fetchall()), key=repr)
    assert got == want
