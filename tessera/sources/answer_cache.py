"""The cache of answers as a table that is kept up batch by batch.

An entry is a question hash of an index snapshot: the first id and question, the last answer, score and time, and how
often it was hit. Two entries of a hash merge to one, in any order, so batches merged one after another give what all
writes at once give. A batch that comes again changes nothing, and only the buckets of its questions are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import question_hash
from .chunk_table import ChunkTable, Commit

ENTRY = T.StructType()
for _name, _kind in [
    ("question_hash", T.StringType()), ("snapshot", T.StringType()), ("id", T.LongType()), ("question", T.StringType()), ("first_at", T.TimestampType()),
    ("answer", T.StringType()), ("score", T.DoubleType()), ("last_id", T.LongType()), ("created_at", T.TimestampType()), ("hits", T.LongType()),
]:
    ENTRY.add(_name, _kind)


def entries(writes: DataFrame, snapshot: str) -> DataFrame:
    """Entries of writes(id, question, answer, score, created_at, status): only answers count."""
    rows = writes.where("status = 'answered'").select(question_hash("question").alias("question_hash"), "id", "question", "answer", "score", F.col("created_at").cast("timestamp").alias("created_at"))
    one = rows.select("question_hash", F.lit(snapshot).alias("snapshot"), "id", "question", F.col("created_at").alias("first_at"), "answer", F.col("score").cast("double").alias("score"), F.col("id").alias("last_id"), "created_at", F.lit(0).cast("long").alias("hits"))
    return merged(one)


def merged(rows: DataFrame) -> DataFrame:
    """Entries with those of a hash and snapshot made one."""
    first, last = F.struct("first_at", "id"), F.struct("created_at", "last_id")
    kept = lambda c, by, f: f(c, by).alias(c)
    return rows.groupBy("question_hash", "snapshot").agg(
        kept("id", first, F.min_by), kept("question", first, F.min_by), F.min("first_at").alias("first_at"), kept("answer", last, F.max_by), kept("score", last, F.max_by),
        kept("last_id", last, F.max_by), F.max("created_at").alias("created_at"), F.sum("hits").alias("hits"),
    ).select(*ENTRY.names)


class AnswerCache:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.table = ChunkTable(spark, folder, ENTRY, key="question_hash", buckets=buckets)

    def _merge(self, delta: DataFrame, batch: tuple[str, int]) -> Commit:
        base = self.table.version()
        keys = delta.select("question_hash").distinct()
        hit = sorted(r[0] for r in keys.select(self.table.bucket(F.col("question_hash"))).distinct().collect())
        old = self.table.read(base, hit).join(keys, "question_hash", "left_semi").select(*ENTRY.names)
        return self.table.replace(merged(old.unionByName(delta)), base=base, batch=batch)

    def write(self, writes: DataFrame, snapshot: str, number: int) -> Commit:
        """Merge batch `number` of writes."""
        return self._merge(entries(writes, snapshot), ("writes", number))

    def hit(self, questions: DataFrame, snapshot: str, number: int) -> Commit:
        """Count batch `number` of hits(question): each row of a question that has an entry of the snapshot."""
        counted = questions.select(question_hash("question").alias("question_hash")).groupBy("question_hash").agg(F.count("*").alias("_n"))
        found = self.read(snapshot).join(counted, "question_hash").withColumn("hits", F.col("_n")).select(*ENTRY.names)
        return self._merge(found, ("hits", number))

    def read(self, snapshot: str | None = None) -> DataFrame:
        """All entries, or those that answer for a snapshot."""
        every = self.table.read()
        return every if snapshot is None else every.where(F.col("snapshot") == snapshot)

    def index_changed(self, snapshot: str, complete: bool) -> Commit | None:
        """After a complete run of the index, entries of other snapshots go; a partial run leaves them."""
        if not complete:
            return None
        base = self.table.version()
        other = self.table.read(base).where(F.col("snapshot") != snapshot).select("question_hash").distinct()
        keep = self.table.read(base).where(F.col("snapshot") == snapshot).join(other, "question_hash", "left_semi").select(*ENTRY.names)
        return self.table.change(new=keep, replaced=other, base=base)
