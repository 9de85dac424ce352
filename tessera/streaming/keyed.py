"""Keyed state with a lifetime: streams that give what their batch forms give, whatever order rows come in.

A key's rows wait in its state until the watermark has passed them, then they are taken up in the order of time and
id; a row that comes again meanwhile is one row. What a key remembers goes once it can't matter any more. Both are done
by event-time timers, as Spark's own lifetimes of values follow the clock, and results would depend on it. Rows
older than the watermark are dropped. Ids and times must be given; rows without them are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.admission import COOLDOWN, DAY_COOLDOWN

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A step takes the time until which the key is held (microseconds; None if it isn't) and a row's time and flag, and gives
#: (what is told of the row, the time until which the key is held then).
Step = Callable[[int | None, int, str | None], tuple[bool, int | None]]


class Ordered(StatefulProcessor):
    """Rows (id, at in microseconds, flag) in order, and until when the key is held."""

    def __init__(self, step: Step):
        self.step = step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long, id long", "flag string")
        self.until = handle.getValueState("until", "until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for i, at, flag in zip(frame["id"], frame["micros"], frame["flag"]):
                self.waiting.updateValue((int(at), int(i)), (None if flag is None or flag != flag else str(flag),))
                self.handle.registerTimer(-(-int(at) // 1000) + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        due = sorted((at, i, flag[0]) for (at, i), flag in self.waiting.iterator() if at < passed)
        until = self.until.get()[0] if self.until.exists() else None
        told = []
        for at, i, flag in due:
            found, until = self.step(until, at, flag)
            told.append((i, at, found))
            self.waiting.removeKey((at, i))
        if until is not None and until > passed:
            self.until.update((until,))
            self.handle.registerTimer(-(-until // 1000) + 1)
        elif self.until.exists():
            self.until.clear()
        if told:
            yield pd.DataFrame({"id": [t[0] for t in told], "key": pd.Series([key[0]] * len(told), dtype=object), "micros": [t[1] for t in told], "told": [t[2] for t in told]})

    def close(self) -> None:
        pass


def _ordered(rows: DataFrame, at: str, late: str, step: Step, name: str) -> DataFrame:
    """rows(id, key, at, flag) as (id, key, at, name)."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    known = rows.where(F.col("id").isNotNull() & F.col(at).isNotNull()).withWatermark(at, late)
    timed = known.select("id", "key", at, F.unix_micros(at).alias("micros"), "flag")
    told = timed.groupBy("key").transformWithStateInPandas(Ordered(step), "id long, key string, micros long, told boolean", "Append", "EventTime")
    return told.select("id", "key", F.timestamp_micros("micros").alias(at), F.col("told").alias(name))


def recently_refused(requests: DataFrame, seconds: int = 3600, late: str = "10 minutes") -> DataFrame:
    """requests(id, question_hash, created_at, refused) as (id, question_hash, created_at, cached_refusal): a refusal of the
    question less than `seconds` before. A key remembers its last refusal for so long."""

    def step(until, at, refused):
        return until is not None and at < until, at + seconds * 1_000_000 if refused == "true" else until

    rows = requests.select("id", F.col("question_hash").alias("key"), "created_at", F.col("refused").cast("string").alias("flag"))
    return _ordered(rows, "created_at", late, step, "cached_refusal").withColumnRenamed("key", "question_hash")


def log_once(requests: DataFrame, seconds: int = 3600, late: str = "10 minutes") -> DataFrame:
    """requests(id, ip_hash, bucket, created_at) as (id, created_at, written)."""

    def step(until, at, flag):
        new = until is None or at >= until
        return new, at + seconds * 1_000_000 if new else until

    key = F.to_json(F.struct("ip_hash", "bucket"))
    return _ordered(requests.select("id", key.alias("key"), "created_at", F.lit(None).cast("string").alias("flag")), "created_at", late, step, "written").drop("key")


def cooled_down(calls: DataFrame, late: str = "10 minutes") -> DataFrame:
    """calls(id, at, pool, model, refused, scope) as (id, at, skipped): inside of a cooldown, as in the batch form."""

    def step(until, at, scope):
        if until is not None and at < until:
            return True, until
        return False, at + (DAY_COOLDOWN if scope == "day" else COOLDOWN) * 1_000_000 if scope is not None else until

    flag = F.when(F.coalesce("refused", F.lit(False)), F.coalesce("scope", F.lit("")))
    return _ordered(calls.select("id", F.to_json(F.struct("pool", "model")).alias("key"), "at", flag.alias("flag")), "at", late, step, "skipped").drop("key")
