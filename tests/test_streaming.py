from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tessera.operators import admission
from tessera.streaming import state

T0 = dt.datetime(2024, 1, 10, 12, 0, 0)
SCHEMA = "id long, created_at timestamp, ip_hash string, bucket string, status string"


def folder(spark, tmp_path):
    rows = [(k, T0 + dt.timedelta(minutes=7 * k), f"ip{k % 2}", "b", "answered") for k in range(40)]
    path = f"{tmp_path}/in"
    for part in range(4):
        spark.createDataFrame(rows[10 * part : 10 * part + 10], SCHEMA).coalesce(1).write.mode("append").json(path)
    return path, spark.createDataFrame(rows, SCHEMA)


def drained(spark, stream, name, tmp_path):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/ck-{name}").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_streams_agree_with_batches(spark, tmp_path):
    path, rows = folder(spark, tmp_path)
    stream = lambda: state.crawl_queue(spark, path, SCHEMA, files=1)
    want = {r.id: r.admitted for r in admission.rate_limited(rows, 3).collect()}
    # files may come in any order, so each window's count is what must agree
    got = {r.id: r.admitted for r in drained(spark, state.rate_limited(stream(), 3, late="2 days"), "limited", tmp_path)}
    assert got.keys() == want.keys() and sum(got.values()) == sum(want.values())
    one = spark.readStream.schema(SCHEMA).json(path)
    want = {r.id: r.written for r in admission.log_once(rows, 3600).collect()}
    got = {r.id: r.written for r in drained(spark, state.log_once(one, 3600, late="2 days"), "marked", tmp_path)}
    assert got == want
    hours = drained(spark, state.hourly_counts(one, "0 minutes"), "hours", tmp_path)
    counted = {r.hour: r.n for r in rows.groupBy(F.date_trunc("hour", "created_at").alias("hour")).agg(F.count("*").alias("n")).collect()}
    assert {r.hour: r.n for r in hours}.items() <= counted.items()


def test_refunds_and_no_limit_as_in_batches(spark, tmp_path):
    path, rows = folder(spark, tmp_path)
    one = spark.readStream.schema(SCHEMA).json(path).withColumn("failed", F.col("id") % 3 == 0)
    for limit, failed in ((2, "failed"), (-1, None), (0, None)):
        want = {r.id: r.admitted for r in admission.rate_limited(rows.withColumn("failed", F.col("id") % 3 == 0), limit, failed=failed).collect()}
        got = {r.id: r.admitted for r in drained(spark, state.rate_limited(one, limit, late="2 days", failed=failed), f"refunded{limit + 1}", tmp_path)}
        assert got == want and (limit > 0) == (len(set(want.values())) == 2)


def test_batches_go_on_where_they_ended(spark, tmp_path):
    path, _ = folder(spark, tmp_path)
    seen = []
    for _ in range(2):
        state.run_batches(state.crawl_queue(spark, path, SCHEMA), lambda frame, number: seen.append(frame.count()), f"{tmp_path}/ck").awaitTermination(120)
    assert sum(seen) == 40
