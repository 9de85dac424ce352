"""Every query of the plans against its SQL, over the smallest of the provided tables."""

from __future__ import annotations

import datetime as dt
import os

import duckdb
import pytest

from tessera.plans import ask, ingest, operate

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = {**ingest.QUERIES, **operate.QUERIES, **ask.QUERIES}
SQL = {**ingest.ORACLE, **operate.ORACLE, **ask.ORACLE}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the provided tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value) if isinstance(value, (dt.datetime, dt.date)) else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR)
    rows = [r.asDict() for r in got.collect()]
    if name not in SQL:
        assert got.columns
        return
    found = duck.execute(SQL[name])
    columns = sorted(d[0] for d in found.description)
    assert columns == sorted(got.columns)
    want = [dict(zip([d[0] for d in found.description], r)) for r in found.fetchall()]
    key = lambda r: repr([plain(r[c]) for c in columns])
    assert sorted(map(key, rows)) == sorted(map(key, want))
