"""Every market query against its DuckDB SQL on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from tapeline.plans.oracle import ORACLES
from tapeline.plans.queries import QUERIES

TABLES = ("customer", "part", "orders", "lineitem", "events", "documents", "conversations")


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return str(v.replace(tzinfo=None)) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    r = con.execute(ORACLES[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == columns
    want = sorted(([plain(row[names.index(c)]) for c in columns] for row in r.fetchall()), key=repr)
    assert sorted(([plain(v) for v in row] for row in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_others_give_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
