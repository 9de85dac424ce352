"""State machines over the ordered rows of a key, folded block by block.

A row's step says which state follows each. Steps compose, and composition is associative: so the rows of a block make
one step, blocks of blocks make one, until few are left, and the states that these begin with are handed down again.
A key with much of the rows is as many tasks as it has blocks.

Two kinds of machines: with a few states, whose steps are arrays; and with a time until which the key is held, whose
steps are ascending times with what each leads to.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .ranks import numbered

BLOCK = 4096

# States of a crawl queue: timeouts in a row while it runs; a probe is due; paused with the probe's verdict.
RUNNING, PROBING, CONCURRENCY, UNREACHABLE = 0, 3, 4, 5
STATES = ["running", "running", "running", "probing", "paused", "paused"]


class Few:
    """A few states, numbered: a step is an array of the states that follow."""

    state, step = "int", "array<int>"

    @staticmethod
    def apply(step, state: int) -> int:
        return int(step[state])

    @staticmethod
    def compose(steps: list) -> np.ndarray:
        whole = np.asarray(steps[0])
        for step in steps[1:]:
            whole = np.asarray(step)[whole]
        return whole


class Held:
    """A time until which a key is held. A step is (times, until): held until s or earlier, the key's next mark is at the
    first of times that isn't before s, and after all marks it is held until that entry of `until`; without such a time it
    is held until s as before."""

    state, step = "long", "struct<times: array<long>, until: array<long>>"

    @staticmethod
    def apply(step, state: int) -> int:
        at = int(np.searchsorted(np.asarray(step["times"], np.int64), state))
        return state if at == len(step["times"]) else int(step["until"][at])

    @staticmethod
    def compose(steps: list) -> dict:
        times, until = np.empty(0, np.int64), np.empty(0, np.int64)
        for step in reversed(steps):
            leads = np.asarray(step["until"], np.int64)
            at = np.searchsorted(times, leads)
            leads = np.where(at == len(times), leads, np.append(until, 0)[at])
            times, until = np.concatenate([np.asarray(step["times"], np.int64), times]), np.concatenate([leads, until])
            last = np.append(until[1:] != until[:-1], True)[: len(until)]  # of times that lead to the same, the last is enough
            times, until = times[last], until[last]
        return {"times": times.tolist(), "until": until.tolist()}

    @staticmethod
    def marks(times: np.ndarray, lasts: np.ndarray, state: int) -> list[int]:
        """The rows that become marks: the first that isn't before the state, then the first after each mark's time, and so on."""
        found, at = [], int(np.searchsorted(times, state))
        while at < len(times):
            found.append(at)
            at = max(at + 1, int(np.searchsorted(times, times[at] + lasts[at])))
        return found

    @staticmethod
    def of_rows(times: np.ndarray, lasts: np.ndarray) -> dict:
        ends = times + lasts
        then = np.maximum(np.searchsorted(times, ends), np.arange(len(times)) + 1).tolist()
        until = ends.tolist()
        for k in range(len(until) - 1, -1, -1):
            if then[k] < len(until):
                until[k] = until[then[k]]
        return Held.compose([{"times": times, "until": np.array(until, np.int64)}])


def _begins(steps: DataFrame, key: str, kind, start: int, block: int) -> DataFrame:
    """(key, _block, _state): the state that each block of steps(key, _block, _step) begins with."""
    named = f"`{key}` {steps.schema[key].dataType.simpleString()}"
    most = steps.agg(F.max("_block")).first()[0]

    def fold(frame: pd.DataFrame, state: int) -> pd.DataFrame:
        frame, states = frame.sort_values("_block"), []
        for step in frame["_step"]:
            states.append(state)
            state = kind.apply(step, state)
        return frame[[key, "_block"]].assign(_state=states)

    told = f"{named}, _block long, _state {kind.state}"
    if most is None or most < block:
        return steps.groupBy(key).applyInPandas(lambda frame: fold(frame, start), told)
    above = steps.withColumn("_above", F.floor(F.col("_block") / block).cast("long"))
    upper = above.groupBy(key, "_above").applyInPandas(lambda f: pd.DataFrame({key: [f[key].iloc[0]], "_block": [f["_above"].iloc[0]], "_step": [kind.compose(f.sort_values("_block")["_step"].to_list())]}), f"{named}, _block long, _step {kind.step}")
    begun = _begins(written(upper, "blocks"), key, kind, start, block).select(F.col(key).alias("_key"), F.col("_block").alias("_over"), F.col("_state").alias("_first"))
    both = above.join(begun, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_above") == F.col("_over"))).drop("_key", "_over")
    return both.groupBy(key, "_above").applyInPandas(lambda f: fold(f, int(f["_first"].iloc[0])), told)


Rows = dict[str, np.ndarray]


def _parts(frame: pd.DataFrame, key: str, given: list[str]) -> tuple[np.ndarray, list[Rows]]:
    """The first row of each key in a block of rows that is ordered by keys, and each key's rows."""
    keys, none = frame[key].to_numpy(object), frame[key].isna().to_numpy()
    new = (keys[1:] != keys[:-1]) & ~(none[1:] & none[:-1])
    begins = np.concatenate([[0], np.flatnonzero(new) + 1])
    columns = {c: frame[c].to_numpy() for c in given}
    return begins, [{c: v[b:e] for c, v in columns.items()} for b, e in zip(begins, [*begins[1:], len(frame)])]


def _folded(rows: DataFrame, key: str, order: list[str], given: list[str], kind, start: int, block: int, compose: Callable[[Rows], object], run: Callable[[Rows, int], tuple], told: list[str]) -> DataFrame:
    """rows with the columns `told` (name and type) that run gives for a key's rows in a block and the state that they begin with.

    Rows are numbered by key and order and cut into blocks of as many. Only the first and the last key of a block reach
    into others, so only their steps are handed up and their states down.
    """
    placed = written(numbered(rows, [F.asc(key), *(F.asc(c) for c in order)], "_number"), "numbered").withColumn("_block", F.floor(F.col("_number") / block).cast("long"))
    named = f"`{key}` {rows.schema[key].dataType.simpleString()}"
    seen = placed.select(key, "_block", "_number", *given)

    def ends(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_number")
        begins, parts = _parts(frame, key, given)
        which = [0] if len(parts) == 1 else [0, len(parts) - 1]
        keys = frame[key].to_numpy(object)
        return pd.DataFrame({key: pd.Series([keys[begins[k]] for k in which], dtype=frame[key].dtype), "_block": [frame["_block"].iloc[0]] * len(which), "_last": [k > 0 for k in which], "_step": [compose(parts[k]) for k in which]})

    steps = written(seen.groupBy("_block").applyInPandas(ends, f"{named}, _block long, _last boolean, _step {kind.step}"), "blocks")
    found = _begins(steps.drop("_last"), key, kind, start, block).select(F.col(key).alias("_key"), F.col("_block").alias("_of"), "_state")
    states = steps.drop("_step").join(found, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_block") == F.col("_of")))
    begins = states.groupBy("_of").agg(F.max(F.when(~F.col("_last"), F.col("_state"))).alias("_first_state"), F.max(F.when(F.col("_last"), F.col("_state"))).alias("_last_state"))

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_number")
        _, parts = _parts(frame, key, given)
        states = [start] * len(parts)
        states[0] = int(frame["_first_state"].iloc[0])
        if len(parts) > 1:
            states[-1] = int(frame["_last_state"].iloc[0])
        columns = zip(*(run(part, state) for part, state in zip(parts, states)))
        return pd.DataFrame({"_number": frame["_number"].to_numpy(), **{t.split(" ")[0]: np.concatenate(c) for t, c in zip(told, columns)}})

    both = seen.join(begins, F.col("_block") == F.col("_of")).drop("_of")
    marked = both.groupBy("_block").applyInPandas(work, ", ".join(["_number long", *told]))
    return placed.join(marked, "_number")


def states_after(rows: DataFrame, key: str, order: list[str], step: Column, start: int = 0, block: int = BLOCK) -> DataFrame:
    """rows with `state_before` and `state` of their key's machine of a few states, which starts in `start`.

    step: for each state the next one, as an array of ints. A null key is a key like others; nulls in the order come first.
    The rows of a key are read in the order given, which should tell them apart.
    """

    def run(part: Rows, state: int) -> tuple:
        states = [state]
        for step in part["_step"]:
            states.append(int(step[states[-1]]))
        return states[:-1], states[1:]

    stepped = rows.withColumn("_step", step.cast("array<int>"))
    told = _folded(stepped, key, order, ["_step"], Few, start, block, lambda part: Few.compose(list(part["_step"])).tolist(), run, ["state_before int", "state int"])
    return told.select(*rows.columns, "state_before", "state")


def held_marks(rows: DataFrame, key: str, at: str, order: list[str], lasts: Column, block: int = BLOCK) -> DataFrame:
    """rows with `marked` and `held`: a row becomes a mark if its `lasts` (microseconds from its time `at`, null for none)
    isn't null and its key isn't held by the mark before; then the key is held until that time is over.

    Whether a row is a mark depends on all before it, so the rows are folded in blocks. A null key is a key like others;
    null times come before all others, as one time.
    """

    def able(part: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        where = np.flatnonzero(part["_lasts"] >= 0)
        return where, part["_micros"][where], part["_lasts"][where]

    def run(part: Rows, state: int) -> tuple:
        where, times, lasts = able(part)
        found = Held.marks(times, lasts, state)
        marked, until = np.zeros(len(part["_micros"]), bool), np.full(len(part["_micros"]), state, np.int64)
        for k in found:
            marked[where[k]] = True
            until[where[k] + 1 :] = times[k] + lasts[k]
        return marked, part["_micros"] < until

    micros = F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(-(1 << 61)))
    timed = rows.withColumns({"_micros": micros, "_lasts": F.when(lasts.isNotNull(), F.greatest(lasts.cast("long"), F.lit(0))).otherwise(F.lit(-1))})
    told = _folded(timed, key, order, ["_micros", "_lasts"], Held, -(1 << 62), block, lambda part: Held.of_rows(*able(part)[1:]), run, ["marked boolean", "held boolean"])
    return told.select(*rows.columns, "marked", "held")


def breaker_step() -> Column:
    """The transition of a row(kind: fetch, probe or resume; outcome: ok, timeout or failed; slow: whether a probe took nearly
    its whole time).

    While a queue runs, a fetch in time ends the streak of timeouts, and the third timeout in a row calls for a probe; other
    failures change nothing. A probe that gets through, or is slow, says that too many requests run at a time; one that
    fails fast says that the site can't be reached. Either pauses the queue, until it is resumed; fetches don't count then.
    """
    to = lambda *states: F.array(*(F.lit(s) for s in states))
    fetch, probe = F.col("kind") == "fetch", F.col("kind") == "probe"
    through = (F.col("outcome") == "ok") | F.coalesce("slow", F.lit(False))
    return (
        F.when(fetch & (F.col("outcome") == "ok"), to(0, 0, 0, 3, 4, 5))
        .when(fetch & (F.col("outcome") == "timeout"), to(1, 2, PROBING, 3, 4, 5))
        .when(probe & through, to(0, 1, 2, CONCURRENCY, 4, 5))
        .when(probe, to(0, 1, 2, UNREACHABLE, 4, 5))
        .when(F.col("kind") == "resume", to(0, 1, 2, 3, RUNNING, RUNNING))
        .otherwise(to(0, 1, 2, 3, 4, 5))
    )


def circuit_breaker(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """rows(id, queue, at, kind, outcome, slow) with the queue's `status` after each (running, probing or paused), its
    `streak` of timeouts, the `verdict` of a pause (concurrency or unreachable, else empty), and whether the row `counted`:
    fetches only while the queue runs, probes only when one is due, resumes only in a pause."""
    folded = states_after(rows, "queue", ["at", "id"], breaker_step(), RUNNING, block)
    status = F.element_at(F.array(*(F.lit(s) for s in STATES)), F.col("state") + 1)
    streak = F.when(F.col("state") < PROBING, F.col("state")).otherwise(F.lit(3))
    verdict = F.when(F.col("state") == CONCURRENCY, "concurrency").when(F.col("state") == UNREACHABLE, "unreachable").otherwise("")
    counted = F.when(F.col("kind") == "fetch", F.col("state_before") < PROBING).when(F.col("kind") == "probe", F.col("state_before") == PROBING).otherwise((F.col("kind") == "resume") & (F.col("state_before") > PROBING))
    return folded.select(*rows.columns, status.alias("status"), streak.alias("streak"), verdict.alias("verdict"), F.coalesce(counted, F.lit(False)).alias("counted"))
