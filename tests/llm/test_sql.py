"""The queries with SQL against it, over the smallest of the provided tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from tessera.llm.queries import ORACLE_SQL, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the provided tables aren't here")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    found = con.execute(ORACLE_SQL[name])
    columns = sorted(d[0] for d in found.description)
    want = [dict(zip([d[0] for d in found.description], r)) for r in found.fetchall()]
    got = QUERIES[name](spark, SF_DIR)
    assert sorted(got.columns) == columns
    key = lambda r: repr([f"{r[c]:.9g}" if isinstance(r[c], float) else r[c] for c in columns])
    assert sorted(map(key, (r.asDict() for r in got.collect()))) == sorted(map(key, want))
