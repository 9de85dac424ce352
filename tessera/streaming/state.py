"""Streaming forms of the stateful operators.

The batch forms key their windows by event time; so do these, with a watermark for late rows, which the data
model itself doesn't have.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MARKED = T.StructType([T.StructField("id", T.LongType()), T.StructField("ip_hash", T.StringType()), T.StructField("created_at", T.TimestampType()), T.StructField("admitted", T.BooleanType())])
WRITTEN = T.StructType([T.StructField("id", T.LongType()), T.StructField("ip_hash", T.StringType()), T.StructField("bucket", T.StringType()), T.StructField("created_at", T.TimestampType()), T.StructField("written", T.BooleanType())])


def hourly_counts(requests: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(hour, status, n) of requests(created_at, status), given out once the watermark has passed an hour."""
    counted = requests.withWatermark("created_at", late).groupBy(F.window("created_at", "1 hour").alias("w"), "status").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("hour"), "status", "n")


def rate_limited(requests: DataFrame, limit: int, window: str = "hour", late: str = "10 minutes", failed: str | None = None) -> DataFrame:
    """requests(id, ip_hash, created_at) with `admitted`; an address's window is one integer of state, dropped after it.

    0 or less is no limit. failed: a boolean column of requests whose provider call failed, which are refunded before the
    next one. Both are as in the batch form.
    """

    def admit(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used = state.get[0] if state.exists else 0
        frame = pd.concat(list(frames)).sort_values(["created_at", "id"])
        admitted = []
        for refunded in frame["_failed"]:
            admitted.append(limit <= 0 or used < limit)
            used += not refunded
        state.update((used,))
        state.setTimeoutTimestamp(max(int(pd.Timestamp(key[1]).timestamp() * 1000), state.getCurrentWatermarkMs()) + 86_400_000)
        yield frame[["id", "ip_hash", "created_at"]].assign(admitted=admitted)

    refunded = F.lit(False) if failed is None else F.coalesce(F.col(failed), F.lit(False))
    keyed = requests.withWatermark("created_at", late).withColumn("at", F.date_trunc(window, "created_at")).withColumn("_failed", refunded)
    return keyed.groupBy("ip_hash", "at").applyInPandasWithState(admit, MARKED, "used long", "append", GroupStateTimeout.EventTimeTimeout)


def log_once(requests: DataFrame, seconds: int = 3600, late: str = "10 minutes") -> DataFrame:
    """requests(id, ip_hash, bucket, created_at) with `written`; state is a key's last written time in microseconds, as in the batch form."""

    def mark(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, written = state.get[0] if state.exists else None, []
        frame = pd.concat(list(frames)).sort_values(["created_at", "id"])
        for at in frame["created_at"].map(lambda t: pd.Timestamp(t).value // 1000):
            new = last is None or at - last >= seconds * 1_000_000
            last = at if new else last
            written.append(new)
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs()) + seconds * 1000 + 1)
        yield frame[["id", "ip_hash", "bucket", "created_at"]].assign(written=written)

    return requests.withWatermark("created_at", late).groupBy("ip_hash", "bucket").applyInPandasWithState(mark, WRITTEN, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def crawl_queue(spark: SparkSession, folder: str, schema: str, files: int = 10) -> DataFrame:
    """The crawl queue as a stream of files, so many at most in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder)


def run_batches(stream: DataFrame, handle, checkpoint: str):
    """Each micro-batch once to handle(frame, number); a restart goes on where the checkpoint ends."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
