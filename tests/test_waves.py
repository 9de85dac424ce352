"""Waves with a budget, and runs that go on where the one before ended."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from tessera.operators import ranks, waves
from tessera.sources.leases import Lease, Lost
from tessera.sources.tables import Snapshots


def chunks(spark, sizes):
    rows = [(i, k) for i, n in sizes for k in range(n)]
    return spark.createDataFrame(rows, "post_id long, chunk_index int").repartition(7)


def embed(failed=None):
    return lambda rows: rows.withColumns({"embedding": F.array(F.lit(0.5)), "failed": F.lit(False) if failed is None else failed})


def plain_run(sizes, progress, run, size, most, bad):
    """The same, chunk after chunk in one loop."""
    flat = [(i, k) for i, n in sorted(sizes, key=lambda x: (x[0] is not None, x[0] or 0)) if progress.get(i, (0, ""))[1] != "indexed" for k in range(n)]
    cut = [flat[k : k + size] for k in range(0, len(flat), size)]
    state = {}
    for w, wave in enumerate(cut[:most]):
        failed = any(i in bad for i, _ in wave)
        for i, _ in wave:
            state[i] = "failed" if failed or state.get(i) == "failed" else "indexed"
    for i, _ in [x for wave in cut[most:] if most is not None for x in wave]:
        if state.get(i) == "indexed":
            state[i] = "budget"
    return {**progress, **{i: (run, s) for i, s in state.items()}}


def test_numbers_of_all_rows(spark):
    rows = spark.createDataFrame([(k * 37 % 101, None if k % 9 == 0 else k % 5) for k in range(101)], "a long, b long").repartition(5)
    got = [(r.a, r.b) for r in ranks.numbered(rows, [F.desc("b"), F.asc("a")]).orderBy("number").collect()]
    assert got == [(r.a, r.b) for r in rows.orderBy(F.desc("b"), F.asc("a")).collect()]
    assert ranks.numbered(rows.limit(0), [F.asc("a")]).count() == 0


def test_budget_and_resume(spark):
    sizes = [(1, 3), (2, 1), (3, 9), (4, 2), (5, 4), (None, 2), (8, 1)]
    frame, progress, plain = chunks(spark, sizes), spark.createDataFrame([], waves.PROGRESS), {}
    for run, (most, bad) in enumerate([(2, {2}), (1, set()), (3, {5}), (9, set())], 1):
        _, progress = waves.index_run(frame, progress, run, embed(F.col("post_id").isin(*bad) if bad else None), 4, most * 13, 13)
        plain = plain_run(sizes, plain, run, 4, most, bad)
        assert {r.post_id: (r.run, r.state) for r in progress.collect()} == plain
    assert waves.left_over(frame, progress) == 0 and {r.post_id: r.chunks for r in progress.collect()} == dict(sizes)


def test_two_runs_equal_one_without_a_budget(spark):
    frame, none = chunks(spark, [(k, 1 + k % 4) for k in range(1, 20)]), spark.createDataFrame([], waves.PROGRESS)
    first, part = waves.index_run(frame, none, 1, embed(), 5, 40)
    assert first.count() == 20 and waves.left_over(frame, part) > 0
    second, done = waves.index_run(frame, part, 2, embed(), 5, 0)
    _, whole = waves.index_run(frame, none, 1, embed(), 5, 0)
    state = lambda p: {r.post_id: (r.state, r.chunks) for r in p.collect()}
    assert state(done) == state(whole) and waves.left_over(frame, done) == 0
    indexed = {r.post_id for r in part.where("state = 'indexed'").collect()}
    assert not indexed & {r.post_id for r in second.select("post_id").distinct().collect()}


def test_the_first_wave_always_goes(spark):
    assert waves.waves_in(1, 13) == 1 and waves.waves_in(13, 13) == 1 and waves.waves_in(14, 13) == 2 and waves.waves_in(45, 13) == 4 and waves.waves_in(0, 13) is None
    frame = chunks(spark, [(1, 2), (2, 9)])
    sent, progress = waves.index_run(frame, spark.createDataFrame([], waves.PROGRESS), 1, embed(), 3, 0.001)
    assert sent.count() == 3 and {r.post_id: r.state for r in progress.collect()} == {1: "indexed", 2: "budget"}
    sent, progress = waves.index_run(frame.limit(0), progress, 2, embed(), 3)
    assert sent.count() == 0 and progress.count() == 2


def test_no_publication_is_lost(spark, tmp_path):
    store = lambda: Snapshots(spark, f"file://{tmp_path}/published")
    new = lambda k, n: spark.createDataFrame([(k, [f"q{i}" for i in range(n)])], "id long, pairs array<string>")
    failed = []

    def one(k):
        try:
            waves.publish(store(), new(k, 2), ["id"], "pairs")
        except Exception as error:  # told by the assertion below
            failed.append(error)

    threads = [threading.Thread(target=one, args=(k,)) for k in range(5)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert not failed and {r.id for r in store().current().collect()} == set(range(5)) and store().versions() == [1, 2, 3, 4, 5]
    assert waves.publish(store(), new(3, 1), ["id"], "pairs") == 6
    assert {r.id: (len(r.pairs), r.previous and len(r.previous)) for r in store().current().collect()} == {**{k: (2, None) for k in range(5)}, 3: (1, 2)}
    assert waves.unpublish(store(), new(4, 1), ["id"]) == 7 and store().current().count() == 4
    late = Lease(spark, f"file://{tmp_path}/lease", "late")
    with pytest.raises(Lost):
        waves.publish(store(), new(9, 1), ["id"], "pairs", late)
