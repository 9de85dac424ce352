"""Marks that hold their key for a time: log-once and cooldowns, folded in blocks."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import admission
from tessera.operators.machines import Held

T0 = dt.datetime(2024, 1, 10, 12, 0, 0)


def plain_marks(rows, lasts):
    """(marked, held) of each row (time, ...) of one key, in order."""
    until, out = None, []
    for k, at in enumerate(rows):
        held = until is not None and at < until
        mark = not held and lasts[k] is not None
        until = at + lasts[k] if mark else until
        out.append((mark, held))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 25)), max_size=6), min_size=1, max_size=5), st.integers(-5, 60))
def test_blocks_compose(blocks, state):
    at, steps, every = 0, [], []
    for block in blocks:
        times, lasts = [], []
        for gap, last in block:
            at += gap
            times.append(at)
            lasts.append(last)
        every += list(zip(times, lasts))
        steps.append(Held.of_rows(np.array(times, np.int64), np.array(lasts, np.int64)))
    want = state
    for k, (time, last) in enumerate(every):
        want = time + last if time >= want else want
    one = state
    for step in steps:
        one = Held.apply(step, one)
    assert one == want == Held.apply(Held.compose(steps), state) == Held.apply(Held.compose([Held.compose(steps[:2]), *steps[2:]]), state)


@pytest.mark.parametrize("block", [3, 7, 4096])
def test_log_once_of_a_hot_key(spark, block):
    dice = random.Random(3)
    rows = [(k, dice.choice(["hot"] * 9 + [None]), "b", T0 + dt.timedelta(seconds=dice.randint(0, 20_000))) for k in range(300)] + [(500, "hot", None, None), (501, "hot", None, None)]
    frame = spark.createDataFrame(rows, "id long, ip_hash string, bucket string, created_at timestamp").repartition(6)
    got = {r.id: r.written for r in admission.log_once(frame, 600, block, most=10).collect()}
    assert got == {r.id: r.written for r in admission.log_once(frame, 600).collect()}
    want = {500: True, 501: False}
    for ip in ("hot", None):
        own = sorted((at, k) for k, a, b, at in rows if a == ip and b)
        want |= {k: m for (_, k), (m, _) in zip(own, plain_marks([(a - T0).total_seconds() for a, _ in own], [600] * len(own)))}
    assert got == want and sum(got.values()) < 60
    assert admission.log_once(frame.limit(0), 600, block, most=-1).count() == 0


@pytest.mark.parametrize("block", [5, 4096])
def test_cooldowns(spark, block):
    dice = random.Random(4)
    rows = [(k, T0 + dt.timedelta(seconds=dice.randint(0, 30_000)), dice.choice(["p", None]), dice.choice(["m", "n"]), dice.choice([True, False, False, None]), dice.choice(["day", "minute", "", None])) for k in range(400)]
    frame = spark.createDataFrame(rows, "id long, at timestamp, pool string, model string, refused boolean, scope string")
    got = {r.id: (r.starts, r.skipped) for r in admission.cooled_down(frame, block).collect()}
    want = {}
    for key in {(r[2], r[3]) for r in rows}:
        own = sorted((r for r in rows if r[2:4] == key), key=lambda r: (r[1], r[0]))
        lasts = [(3600 if r[5] == "day" else 60) if r[4] else None for r in own]
        want |= {r[0]: x for r, x in zip(own, plain_marks([(r[1] - T0).total_seconds() for r in own], lasts))}
    assert got == want and {(True, False), (False, True), (False, False)} == set(got.values())
