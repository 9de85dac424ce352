"""A log stored in the order that its pages are read in, so that a page costs a few files however deep it lies.

Each append sorts its rows over ranges of (created_at, id) and indexes its files: the least and greatest mark, rows,
and rows of each status. A page goes on after a mark, not after a number of rows: the index tells which files
hold the next rows, and the mark is pushed down to their row groups.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import create_exclusively, file_names, file_text

INDEX = "file string, low struct<at: long, id: long>, high struct<at: long, id: long>, n long, statuses map<string, long>"


def micros(at: str | Column) -> Column:
    return F.unix_micros((F.col(at) if isinstance(at, str) else at).cast("timestamp"))


class OrderedLog:
    """Rows(id, created_at, status, ...) in a folder. Rows without a time or an id have no place in the order: they are refused."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def append(self, rows: DataFrame, files: int | None = None) -> int:
        """Add rows as one append, which readers see whole or not at all; its number."""
        name = uuid.uuid4().hex
        order = [F.col("created_at"), F.col("id")]
        dealt = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
        dealt.sortWithinPartitions(*order).write.parquet(f"{self.folder}/data-{name}")
        stored = self.spark.read.schema(rows.schema).parquet(f"{self.folder}/data-{name}").select("status", F.struct(micros("created_at").alias("at"), F.col("id").cast("long").alias("id")).alias("mark"), F.col("_metadata.file_path").alias("file"))
        counted = stored.groupBy("file", F.coalesce("status", F.lit("")).alias("status")).agg(F.min("mark").alias("low"), F.max("mark").alias("high"), F.count("*").alias("n"), F.count(F.when(F.col("mark.at").isNull() | F.col("mark.id").isNull(), 1)).alias("unplaced"))
        index = counted.groupBy("file").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("status", "n"))).alias("statuses"), F.sum("unplaced").alias("unplaced"))
        index.write.parquet(f"{self.folder}/index-{name}")
        if self.spark.read.parquet(f"{self.folder}/index-{name}").where("unplaced > 0").limit(1).count():
            raise ValueError("rows of a log need a time and an id")
        number = len(self._appends()) + 1
        while not create_exclusively(self.spark, f"{self.folder}/append.{number:012d}", name):
            number += 1
        return number

    def _appends(self) -> list[str]:
        return sorted(n for n in file_names(self.spark, self.folder) if n.startswith("append."))

    def index(self) -> DataFrame:
        """A row for each file."""
        names = [file_text(self.spark, f"{self.folder}/{n}") for n in self._appends()]
        return self.spark.read.schema(INDEX).parquet(*(f"{self.folder}/index-{n}" for n in names)) if names else self.spark.createDataFrame([], INDEX)

    def files_of(self, limit: int, after: tuple[int, int] | None = None, status: str | None = None) -> list[str]:
        """Files that hold the `limit` newest rows (of a status) before the mark: newest ones are taken until they hold
        enough rows that lie before the mark for certain, and with them all that reach into their range."""
        index = self.index()
        own = F.col("n") if status is None else F.coalesce(F.element_at("statuses", F.lit(status)), F.lit(0))
        index = index.withColumn("own", own).where("own > 0")
        if after is not None:
            mark = F.struct(F.lit(after[0]).cast("long").alias("at"), F.lit(after[1]).cast("long").alias("id"))
            index = index.where(F.col("low") < mark).withColumn("sure", F.when(F.col("high") < mark, F.col("own")).otherwise(F.lit(0)))
        else:
            index = index.withColumn("sure", F.col("own"))
        most = 4
        while True:
            some = index.orderBy(F.desc("low"), "file").limit(most).collect()
            if len(some) < most or sum(r.sure for r in some) >= limit:
                break
            most *= 2
        taken, rows = [], 0
        for r in some:  # the fewest that are enough
            taken.append(r)
            rows += r.sure
            if rows >= limit:
                break
        if rows < limit:
            return [r.file for r in some]
        low = min((r.low.at, r.low.id) for r in taken)
        edge = F.struct(F.lit(low[0]).cast("long").alias("at"), F.lit(low[1]).cast("long").alias("id"))
        return [r.file for r in index.where(F.col("high") >= edge).select("file").collect()]

    def page(self, limit: int, after: tuple[int, int] | None = None, status: str | None = None) -> DataFrame:
        """The `limit` newest rows, ids break ties, that come after the mark (microseconds, id), in that order."""
        limit = min(100, max(1, limit))
        files = self.files_of(limit, after, status)
        if not files:
            names = self._appends()
            if not names:
                raise LookupError(f"{self.folder} has no rows yet")
            return self.spark.read.parquet(f"{self.folder}/data-{file_text(self.spark, f'{self.folder}/{names[0]}')}").limit(0)
        rows = self.spark.read.parquet(*files)
        if status is not None:
            rows = rows.where(F.coalesce("status", F.lit("")) == status)
        if after is not None:
            at = F.timestamp_micros(F.lit(after[0])).cast(rows.schema["created_at"].dataType)
            rows = rows.where((F.col("created_at") <= at) & ((F.col("created_at") < at) | (F.col("id") < after[1])))
        return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)

    @staticmethod
    def mark(page: DataFrame) -> tuple[int, int] | None:
        """The mark to go on after: that of the page's last row; None of an empty page."""
        last = page.agg(F.min(F.struct(micros("created_at").alias("at"), F.col("id").cast("long").alias("id"))).alias("m")).first().m
        return None if last is None else (last.at, last.id)
