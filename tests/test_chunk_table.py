"""The copy-on-write chunk table and leases."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from tessera.operators import knowledge
from tessera.sources.chunk_table import ChunkTable
from tessera.sources.leases import Lease, Lost
from tessera.sources.tables import Conflict

SCHEMA = "post_id long, chunk_index int, content string, updated_at long"


def rows(spark, ids, text="old", chunks=3):
    return spark.createDataFrame([(i, k, f"{text} {i} {k}", 0) for i in ids for k in range(chunks)], SCHEMA)


def seen(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def made(spark, tmp_path, buckets=8, spread=1, ids=range(40)):
    first = rows(spark, ids)
    table = ChunkTable(spark, f"file://{tmp_path}/chunks", first.schema, buckets=buckets, spread=spread)
    table.change(new=first)
    return table, first


def test_only_buckets_that_are_hit_are_rewritten(spark, tmp_path):
    table, first = made(spark, tmp_path)
    before = table.manifest(1)["folders"]
    done = table.replace(rows(spark, [7], "new", 5))
    after = table.manifest(done.version)["folders"]
    assert len(done.rewritten) == 1 and [b for b in after if after[b] != before[b]] == [str(done.rewritten[0])]
    assert seen(table.read()) == seen(knowledge.replace_documents(first, rows(spark, [7], "new", 5)))
    assert seen(table.read(1)) == seen(first)
    assert len(table._folders(done.version, done.rewritten)) == 1
    assert seen(table.documents([7, 8])) == seen(table.read().where("post_id IN (7, 8)"))


def test_delete_and_touch(spark, tmp_path):
    table, first = made(spark, tmp_path, spread=3)
    ids = lambda *some: spark.createDataFrame([(i,) for i in some], "post_id long")
    deleted = table.delete(ids(3, 999))
    assert seen(table.read()) == seen(knowledge.delete_document(first, 3)) and len(deleted.rewritten) <= 2
    table.touch(ids(5, 6), {"updated_at": F.lit(9).cast("long")})
    assert {(r.post_id, r.updated_at) for r in table.read().where("post_id IN (4, 5, 6)").collect()} == {(4, 0), (5, 9), (6, 9)}
    table.delete(first.select("post_id"))
    assert table.read().count() == 0 and table.read().columns == first.columns
    assert table.change() .version == table.version()


def test_null_keys_extra_columns_and_no_rows(spark, tmp_path):
    table, first = made(spark, tmp_path, ids=[1, None])
    new = spark.createDataFrame([(None, "n", 1)], "post_id long, content string, other int")
    table.replace(new)
    assert seen(table.read().where("post_id IS NULL")) == [(None, None, "n", None)]
    version = table.version()
    assert table.replace(new.limit(0)).rewritten == [] and table.version() == version + 1
    assert table.read().where("post_id = 1").count() == 3
    with pytest.raises(ValueError):
        ChunkTable(spark, f"file://{tmp_path}/other", first.schema, buckets=0)


def test_writers_on_different_buckets_both_win(spark, tmp_path):
    table, first = made(spark, tmp_path)
    of = {r.post_id: r.b for r in first.select("post_id", table.bucket(F.col("post_id")).alias("b")).distinct().collect()}
    one = 0
    other = next(i for i in of if of[i] != of[one])
    same = next(i for i in of if of[i] == of[one] and i != one)
    base = table.version()
    table.replace(rows(spark, [one], "a", 1), base=base)
    table.replace(rows(spark, [other], "b", 1), base=base)
    assert table.version() == base + 2
    with pytest.raises(Conflict):
        table.replace(rows(spark, [same], "c", 1), base=base)
    want = knowledge.replace_documents(knowledge.replace_documents(first, rows(spark, [one], "a", 1)), rows(spark, [other], "b", 1))
    assert seen(table.read()) == seen(want)


def test_old_folders_go(spark, tmp_path):
    table, _ = made(spark, tmp_path)
    for k in range(3):
        table.replace(rows(spark, range(40), f"v{k}"))
    now = seen(table.read())
    assert table.expire(1) > 0 and seen(table.read()) == now and table.expire(1) == 0


def test_of_many_one_holds_the_lease(spark, tmp_path):
    clock = [100.0]
    many = [Lease(spark, f"file://{tmp_path}/lease", f"p{k}", 10, lambda: clock[0]) for k in range(10)]

    def race(some):
        got, ready = [], threading.Barrier(len(some))
        threads = [threading.Thread(target=lambda x=x: (ready.wait(), got.append(x) if x.acquire() else None)) for x in some]
        [t.start() for t in threads], [t.join() for t in threads]
        return got

    held = race(many)
    assert len(held) == 1 and held[0].check() == 1 and race(many) == []
    clock[0] = 109
    held[0].renew()
    clock[0] = 118
    assert race(many) == [] and held[0].check() == 1
    clock[0] = 119
    after = race(many)
    assert len(after) == 1 and after[0].check() == 2
    if held[0] is not after[0]:
        with pytest.raises(Lost):
            held[0].check()
    after[0].release()
    assert many[3].acquire() and many[3].number == 3


def test_a_late_holder_cannot_write(spark, tmp_path):
    clock = [0.0]
    table, first = made(spark, tmp_path)
    old, new = (Lease(spark, f"file://{tmp_path}/lease", name, 10, lambda: clock[0]) for name in ("old", "new"))
    assert old.acquire()
    table.fence(old)
    table.replace(rows(spark, [1], "by old"), lease=old)
    clock[0] = 11
    assert new.acquire()
    with pytest.raises(Lost):
        table.replace(rows(spark, [2], "late"), lease=old)
    table.fence(new)
    # even if it doesn't know that its time is over
    old.check = lambda: 1
    with pytest.raises(Conflict):
        table.replace(rows(spark, [2], "late"), lease=old)
    table.replace(rows(spark, [3], "by new"), lease=new)
    assert {r.content.split(" ")[0] for r in table.read().where("post_id IN (1, 2, 3)").collect()} == {"by", "old"}
    assert table.read().where("content LIKE 'late%'").count() == 0 and first.count() == table.read().count()


def test_a_task_writes_a_bounded_number_of_rows_however_many_a_bucket_has(spark, tmp_path):
    first = spark.range(4000).select(F.when(F.col("id") < 1500, 1).otherwise(F.col("id")).alias("post_id"), F.col("id").alias("chunk_index"))
    table = ChunkTable(spark, f"file://{tmp_path}/large", first.schema, buckets=4, rows=200)
    table.change(new=first)
    table.touch(first.where("post_id < 2500").select("post_id"), {"chunk_index": F.col("chunk_index") + 1})
    assert seen(table.read()) == seen(first.withColumn("chunk_index", F.col("chunk_index") + F.when(F.col("post_id") < 2500, 1).otherwise(0)))
    for version in (1, 2):
        files = [r["count"] for r in table.read(version).groupBy(F.input_file_name()).count().collect()]
        assert sum(files) == 4000 and max(files) < 300
