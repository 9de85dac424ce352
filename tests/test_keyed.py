"""Keyed streams against their batch forms: rows in any order, late, repeated, and after a restart."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from tessera.operators import admission
from tessera.streaming import keyed

T0 = dt.datetime(2024, 1, 10, 12, 0, 0)
SCHEMA = "id long, at timestamp, created_at timestamp, ip_hash string, bucket string, question_hash string, pool string, model string, refused boolean, scope string"


def rows(seed=1, n=240):
    dice = random.Random(seed)
    out = []
    for k in range(n):
        at = T0 + dt.timedelta(seconds=dice.randint(0, 30_000), microseconds=dice.choice([0, 0, 1, 999_999]))
        hot = dice.choice(["hot", "hot", "a", None])
        out.append((k, at, at, hot, "b", hot, "p", hot, dice.choice([True, False, None]), dice.choice(["day", "minute", None])))
    return out


END = (10_000, *[T0 + dt.timedelta(days=9)] * 2, "end", "b", "end", "p", "end", False, None)


def streamed(spark, tmp_path, form, name, parts):
    """What the stream has given after the parts, each a run of its own that ends and starts again from its checkpoint."""
    folder, out = f"{tmp_path}/{name}", f"{tmp_path}/{name}-out"
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").json(folder)
        stream = form(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(folder))
        stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/{name}-ck").option("path", out).outputMode("append").trigger(availableNow=True).start().awaitTermination(100)
    return spark.read.parquet(out).collect()


def test_streams_equal_batches_in_any_order(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    given = rows()
    shuffled = given[:]
    random.Random(2).shuffle(shuffled)
    # every row within a day's lateness, some twice, in two runs; the last row moves the watermark past all others
    parts = [shuffled[:120] + shuffled[:5], shuffled[100:] + [END], [(*END[:1], *[T0 + dt.timedelta(days=19)] * 2, *END[3:])]]
    frame = spark.createDataFrame(given, SCHEMA)
    refused = frame.withColumn("refused", F.coalesce("refused", F.lit(False)))
    cases = {
        "refusals": (lambda s: keyed.recently_refused(s, 3600, "1 day"), {r.id: r.cached_refusal for r in admission.recently_refused(refused).collect()}, "cached_refusal"),
        "marks": (lambda s: keyed.log_once(s, 900, "1 day"), {r.id: r.written for r in admission.log_once(frame, 900).collect()}, "written"),
        "cooldowns": (lambda s: keyed.cooled_down(s, "1 day"), {r.id: r.skipped for r in admission.cooled_down(frame).collect()}, "skipped"),
    }
    for name, (form, want, column) in cases.items():
        got = streamed(spark, tmp_path, form, name, parts)
        told = {r.id: r[column] for r in got if r.id != END[0]}
        assert told == want and len([r for r in got if r.id != END[0]]) == len(given), name
        assert len(set(told.values())) == 2
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_late_rows_and_rows_without_a_time_are_dropped(spark, tmp_path):
    first = [(1, T0, T0, "x", "b", "x", "p", "m", True, "day"), END]
    late = [(2, T0, T0, "x", "b", "x", "p", "m", True, "day"), (3, None, None, "x", "b", "x", "p", "m", True, "day"), (None, T0, T0, "x", "b", "x", "p", "m", True, "day")]
    got = streamed(spark, tmp_path, lambda s: keyed.cooled_down(s, "0 seconds"), "late", [first, late, [(11_000, *[T0 + dt.timedelta(days=30)] * 2, *END[3:])]])
    assert {r.id: r.skipped for r in got} == {1: False, END[0]: False}
