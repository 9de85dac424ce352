"""The crawl as a stream: a source that hands out a few items of the queue at a time, and a sink that stores each batch once.

The queue is a folder of Parquet files (seq long, post_id long, url string), seq ascending as items are added. An item
is marked, by a file made exclusively, before it is fetched: after a crash it isn't fetched again but told as
interrupted, for the retry policy to decide. What was fetched is written to a chunk table under the batch's number.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from ..sources.chunk_table import ChunkTable, Commit
from ..sources.tables import create_exclusively

#: Fixed value: items of a batch.
ITEMS = 10
QUEUE = "seq long, post_id long, url string"
#: What fetch gives, and what is stored.
FETCHED = "post_id long, text string, outcome string"
STORED = T.StructType().add("post_id", "long").add("seq", "long").add("url", "string").add("text", "string").add("outcome", "string").add("batch", "long")


class QueueReader(SimpleDataSourceStreamReader):
    """Items in the order of seq, so many in a batch; the offset is the next seq."""

    def __init__(self, folder: str, items: int):
        self.folder, self.items = folder, items

    def initialOffset(self) -> dict:
        return {"next": 0}

    def _rows(self, low: int, high: int | None = None) -> Iterator[tuple]:
        wanted = ds.field("seq") >= low if high is None else (ds.field("seq") >= low) & (ds.field("seq") < high)
        for batch in ds.dataset(self.folder, format="parquet", exclude_invalid_files=True).to_batches(columns=["seq", "post_id", "url"], filter=wanted):
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        some = heapq.nsmallest(self.items, self._rows(start["next"]), key=lambda r: r[0])
        return iter(some), {"next": some[-1][0] + 1 if some else start["next"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(sorted(self._rows(start["next"], end["next"]), key=lambda r: r[0]))

    def commit(self, end: dict) -> None:
        pass


class QueueSource(DataSource):
    """spark.readStream.format("crawl_queue").load(folder); option items."""

    @classmethod
    def name(cls) -> str:
        return "crawl_queue"

    def schema(self) -> str:
        return QUEUE

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return QueueReader(self.options["path"].removeprefix("file://"), int(self.options.get("items", ITEMS)))


def queue(spark: SparkSession, folder: str, items: int = ITEMS) -> DataFrame:
    spark.dataSource.register(QueueSource)
    return spark.readStream.format("crawl_queue").option("items", items).load(folder)


def stored_once(table: ChunkTable, marks: str, fetch: Callable[[DataFrame], DataFrame], name: str = "crawl") -> Callable[[DataFrame, int], Commit]:
    """A handler of micro-batches: marks the items, fetches those that weren't marked before, and replaces their texts.

    fetch(items) gives (post_id, text, outcome) for each. A batch holds a few items, by the source; only their numbers come
    to the driver. A batch number that the table has seen is passed over, also after a restart.
    """

    def handle(frame: DataFrame, number: int) -> Commit:
        spark = frame.sparkSession
        if table.manifest(table.version())["batches"].get(name, -1) >= number:
            return Commit(table.version(), [])
        items = [r.seq for r in frame.select("seq").collect()]
        fresh = [s for s in items if create_exclusively(spark, f"{marks.rstrip('/')}/{s}", f"{name} {number}")]
        new = F.col("seq").isin(fresh) if fresh else F.lit(False)
        got = fetch(frame.where(new)).select("post_id", "text", "outcome")
        rows = frame.where(new).join(got, "post_id", "left").unionByName(frame.where(~new).withColumns({"text": F.lit(None).cast("string"), "outcome": F.lit("interrupted")}))
        return table.replace(rows.withColumn("batch", F.lit(number).cast("long")), batch=(name, number))

    return handle


def crawl(spark: SparkSession, folder: str, table: ChunkTable, marks: str, fetch: Callable[[DataFrame], DataFrame], checkpoint: str, items: int = ITEMS, name: str = "crawl") -> StreamingQuery:
    """Start the crawl of a queue; processAllAvailable() waits until it is drained. A restart goes on from the checkpoint."""
    return queue(spark, folder, items).writeStream.foreachBatch(stored_once(table, marks, fetch, name)).option("checkpointLocation", checkpoint).start()
