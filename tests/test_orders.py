"""Logs read page by page, and state machines folded in blocks."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import analytics, machines
from tessera.sources.ordered_log import OrderedLog

T0 = dt.datetime(2024, 1, 10, 12, 0, 0)


def log(spark, ids):
    rows = [(k, T0 + dt.timedelta(seconds=(k * 7919 % 997) // 3), ["answered", "refused", "error", None][k * k % 7 % 4], f"q{k}") for k in ids]
    return spark.createDataFrame(rows, "id long, created_at timestamp, status string, question string")


@pytest.mark.parametrize("status", [None, "answered", "error"])
def test_a_walk_gives_all_pages(spark, tmp_path, status):
    store = OrderedLog(spark, f"file://{tmp_path}/log-{status}")
    with pytest.raises(LookupError):
        store.page(10)
    parts = [log(spark, range(0, 600)), log(spark, range(600, 700))]
    assert [store.append(p, 16) for p in parts] == [1, 2]
    every = parts[0].unionByName(parts[1])
    walked, mark = [], None
    while rows := store.page(90, mark, status).collect():
        walked += [r.id for r in rows]
        mark = store.mark(store.page(90, mark, status))
    want = every if status is None else every.where(F.col("status") == status)
    assert walked == [r.id for r in want.orderBy(F.desc("created_at"), F.desc("id")).collect()]
    assert walked[90:180] == [r.id for r in analytics.page(every, 90, 90, status).collect()]
    assert store.page(5, mark or (0, 0), status).count() == 0 and store.mark(store.page(5, (0, 0), status)) is None


def test_depth_costs_no_more_files(spark, tmp_path):
    store = OrderedLog(spark, f"file://{tmp_path}/log")
    store.append(log(spark, range(4000)), 40)
    files, mark = [], None
    for _ in range(30):
        files.append(len(store.files_of(100, mark)))
        mark = store.mark(store.page(100, mark))
    assert max(files) <= 4 and store.index().count() == 40
    plan = store.page(100, mark)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(created_at), LessThanOrEqual(created_at" in plan
    with pytest.raises(ValueError):
        store.append(log(spark, range(3)).withColumn("created_at", F.lit(None).cast("timestamp")))
    assert store.index().count() == 40


def plain_breaker(rows):
    state, out = {}, {}
    for i, queue, _, kind, outcome, slow in rows:
        s, streak, verdict = state.get(queue, ("running", 0, ""))
        counted = (kind == "fetch" and s == "running") or (kind == "probe" and s == "probing") or (kind == "resume" and s == "paused")
        if counted and kind == "fetch":
            streak = 0 if outcome == "ok" else streak + (outcome == "timeout")
            s = "probing" if streak >= 3 else s
        elif counted and kind == "probe":
            s, verdict = "paused", "concurrency" if outcome == "ok" or slow else "unreachable"
        elif counted:
            s, streak, verdict = "running", 0, ""
        state[queue] = (s, streak, verdict)
        out[i] = (*state[queue], counted)
    return out


@pytest.mark.parametrize("block", [4, 5, 4096])
def test_breaker_in_blocks(spark, block):
    dice = random.Random(5)
    rows = []
    for k in range(400):
        queue = dice.choice(["hot"] * 8 + ["a", None])
        kind = dice.choice(["fetch"] * 6 + ["probe", "resume", None])
        rows.append((k, queue, k // 3, kind, dice.choice(["timeout"] * 3 + ["ok", "failed", None]), dice.choice([True, False, None])))
    frame = spark.createDataFrame(rows, "id long, queue string, at long, kind string, outcome string, slow boolean")
    got = {r.id: (r.status, r.streak, r.verdict, r.counted) for r in machines.circuit_breaker(frame.repartition(6), block).collect()}
    assert got == plain_breaker(rows)
    assert len({v[0] for v in got.values()}) == 3 and {v[2] for v in got.values()} == {"", "concurrency", "unreachable"}
    assert machines.circuit_breaker(frame.limit(0), block).count() == 0
