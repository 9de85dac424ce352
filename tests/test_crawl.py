"""The crawl's source and sink, and the cache kept up batch by batch: at most once, exactly once."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.operators import admission
from tessera.sources.answer_cache import AnswerCache
from tessera.sources.chunk_table import ChunkTable
from tessera.streaming import crawl

T0 = dt.datetime(2024, 1, 10, 12, 0, 0)


def queued(spark, folder, ids):
    spark.createDataFrame([(i, 100 + i, f"http://x/{i}") for i in ids], crawl.QUEUE).repartition(3).write.mode("append").parquet(folder)


def stored(table):
    return {r.post_id: (r.outcome, r.batch) for r in table.read().collect()}


def test_nothing_is_fetched_or_stored_twice(spark, tmp_path):
    folder, marks = f"file://{tmp_path}/queue", f"file://{tmp_path}/marks"
    table = ChunkTable(spark, f"file://{tmp_path}/texts", crawl.STORED, buckets=4)
    queued(spark, folder, range(25))
    fetched, dies = [], {1: "between mark and write"}

    def fetch(items):
        ids = [r.post_id for r in items.select("post_id").collect()]
        fetched.extend(ids)
        if ids and ids[0] == 110 and dies:
            dies.clear()
            raise RuntimeError("killed")
        return items.select("post_id", F.concat(F.lit("text of "), "url").alias("text"), F.when(F.col("post_id") % 7 == 0, "failed").otherwise("ok").alias("outcome"))

    run = lambda: crawl.crawl(spark, folder, table, marks, fetch, f"{tmp_path}/ck")
    with pytest.raises(Exception, match="killed"):
        run().processAllAvailable()
    assert len(table.read().collect()) == 10 and sorted(fetched) == list(range(100, 120))
    again = run()
    again.processAllAvailable()
    queued(spark, folder, range(25, 28))
    again.processAllAvailable()
    again.stop()
    assert sorted(fetched) == list(range(100, 128))  # each once, also those of the batch that died
    want = {100 + k: (("interrupted" if 10 <= k < 20 else "failed" if (100 + k) % 7 == 0 else "ok"), min(k, 25) // 10 + (k >= 25)) for k in range(28)}
    assert stored(table) == want
    # the same batch again, as after a crash between the write and the checkpoint's commit
    version = table.version()
    crawl.stored_once(table, marks, fetch)(spark.createDataFrame([(1, 101, "u")], crawl.QUEUE), 0)
    assert table.version() == version and stored(table) == want and len(fetched) == 28


def writes(spark, rows):
    return spark.createDataFrame([(i, q, a, 0.5 + i / 100, T0 + dt.timedelta(seconds=s), status) for i, q, a, s, status in rows], "id long, question string, answer string, score double, created_at timestamp, status string")


ROWS = [(k, f"Question  {k % 7}?", f"answer {k}", (k * 37) % 50, "refused" if k % 5 == 4 else "answered") for k in range(60)]


def test_batches_merged_equal_all_writes_at_once(spark, tmp_path):
    cache = AnswerCache(spark, f"file://{tmp_path}/cache", 4)
    for number, part in enumerate([ROWS[40:], ROWS[:20], ROWS[20:40]]):
        cache.write(writes(spark, part), "s1", number)
    columns = ["question_hash", "id", "question", "answer", "score", "created_at"]
    seen = lambda frame: sorted(map(tuple, frame.select(columns).collect()))
    assert seen(cache.read("s1")) == seen(admission.cache_upsert(writes(spark, ROWS)))
    version = cache.table.version()
    assert cache.write(writes(spark, ROWS[:20]), "s1", 1).rewritten == [] and cache.table.version() == version
    one = cache.write(writes(spark, ROWS[:1]), "s1", 3)
    assert len(one.rewritten) == 1


def test_hits_and_snapshots(spark, tmp_path):
    cache = AnswerCache(spark, f"file://{tmp_path}/cache", 4)
    cache.write(writes(spark, ROWS), "s1", 0)
    asked = spark.createDataFrame([("question 3?",), ("QUESTION 3?",), ("question 1?",), ("never asked",)], "question string")
    for number in (0, 1, 1):
        cache.hit(asked, "s1", number)
    hits = {r.question.split()[1]: r.hits for r in cache.read("s1").collect()}
    assert hits["3?"] == 4 and hits["1?"] == 2 and sum(hits.values()) == 6
    cache.write(writes(spark, ROWS[:2]), "s2", 1)
    assert cache.index_changed("s2", complete=False) is None and cache.read("s1").count() == 7
    cache.index_changed("s2", complete=True)
    assert cache.read("s1").count() == 0 and cache.read().count() == cache.read("s2").count() == 2
