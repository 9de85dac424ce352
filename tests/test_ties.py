"""Halves that rounding decides: queries against their SQL on small tables that are full of them."""

from __future__ import annotations

import math

import duckdb
import pytest

from tessera.plans import ask

COSINES = [k / 100_000 for k in range(40_005, 40_405, 10)] + [0.38835, 0.99995, 0.34995]


def _vectors() -> list[tuple]:
    """Every 50th vector has one other in its plane, at one of the cosines."""
    rows = []
    for k, cosine in enumerate(COSINES):
        for number, (x, y) in ((50 * k, (1.0, 0.0)), (50 * k + 1, (cosine, math.sqrt(1 - cosine * cosine)))):
            vector = [0.0] * (2 * len(COSINES))
            vector[2 * k : 2 * k + 2] = [x, y]
            rows.append((number, vector, number % 10))
    return rows


TABLES = {
    "embeddings": ("vec_id long, embedding array<float>, label int", _vectors),
    "events": ("event_id long, event_type string, value double, props string", lambda: [(k, "view", 10.0 * k, '{"k": 1}') for k in range(-9, 60)]),
}


@pytest.mark.parametrize("name", ["gen_params", "generate_faq", "debug_line"])
def test_ties_as_in_sql(spark, tmp_path, name):
    con = duckdb.connect()
    for table, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows(), schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    found = con.execute(ask.ORACLE[name])
    columns = [d[0] for d in found.description]
    key = lambda rows: sorted(map(repr, map(tuple, rows)))
    assert key(ask.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()) == key(found.fetchall())
