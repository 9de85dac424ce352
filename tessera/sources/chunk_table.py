"""A table of chunks that is rewritten bucket by bucket: copy on write.

Rows lie in buckets by the hash of their document. A version is a manifest that names the folder of each bucket; a
change writes the buckets that it hits anew and carries the others over by name. Manifests are made exclusively and
in order. A writer whose version is taken looks at what came between: if other buckets were hit it goes on upon the
newer manifest, if one of its own was, it gets a Conflict. A manifest has one entry a bucket, however large the table.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .leases import Lease
from .tables import Conflict, _file_system, create_exclusively, file_names, file_text

MOST_BUCKETS = 10_000
#: Rows that a task sorts and writes, about: a bucket that has more is written as several files.
ROWS = 200_000


@dataclass(frozen=True)
class Commit:
    version: int
    rewritten: list[int]  # buckets whose files are new; the others' are carried over


class ChunkTable:
    """Chunks in a folder, keyed by `key`; schema, key and the number of buckets are fixed when the table is made.

    spread: files of a bucket at least, dealt by the hash of the whole row, so that one document with much of the rows isn't one
    task's; a bucket of more than `rows` rows gets as many files more as these fill. Rows with a null key are a bucket's like others, and a null key replaces, deletes and touches rows of a
    null key. Extra columns of what is written are left out, missing ones are null.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType | None = None, key: str = "post_id", buckets: int = 64, spread: int = 1, rows: int = ROWS):
        self.spark, self.folder, self.rows = spark, folder.rstrip("/"), rows
        if not 0 < buckets <= MOST_BUCKETS:
            raise ValueError(f"buckets must be from 1 to {MOST_BUCKETS}")
        if schema is not None:
            made = {"schema": schema.jsonValue(), "key": key, "buckets": buckets, "spread": spread, "fence": 0, "batches": {}, "hit": [], "folders": {}}
            create_exclusively(spark, self._manifest(0), json.dumps(made))
        first = self.manifest(0)
        self.schema, self.key, self.buckets, self.spread = T.StructType.fromJson(first["schema"]), first["key"], first["buckets"], first["spread"]

    def _manifest(self, version: int) -> str:
        return f"{self.folder}/manifest.{version:012d}"

    def manifest(self, version: int) -> dict:
        return json.loads(file_text(self.spark, self._manifest(version)))

    def version(self) -> int:
        return max(int(n.split(".")[1]) for n in file_names(self.spark, self.folder) if n.startswith("manifest."))

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast(self.schema[self.key].dataType)), F.lit(self.buckets)).cast("int")

    def _folders(self, version: int, buckets: list[int] | None = None) -> list[str]:
        held = self.manifest(version)["folders"]
        wanted = held if buckets is None else [str(b) for b in buckets if str(b) in held]
        return [f"{self.folder}/{held[b]}" for b in wanted]

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows as of a version, the newest if none is named; of these buckets, if given."""
        paths = self._folders(self.version() if version is None else version, buckets)
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def documents(self, ids: list) -> DataFrame:
        """The rows of a few documents: only their buckets are read, and there only row groups that may hold them."""
        given = self.spark.createDataFrame([(i,) for i in ids], T.StructType([T.StructField("k", self.schema[self.key].dataType)]))
        hit = [r[0] for r in given.select(self.bucket(F.col("k"))).distinct().collect()]
        return self.read(buckets=hit).where(F.col(self.key).isin(*ids))

    def _fit(self, rows: DataFrame) -> DataFrame:
        return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema))

    def _files(self, base: int, added: dict[int, int]) -> np.ndarray:
        """Files to write for each bucket; added: rows that the buckets hit get besides those that they hold."""
        held = self.read(base, sorted(added))
        many = dict(added)
        if held.count() + sum(added.values()) > self.rows:
            for b, n in held.groupBy(self.bucket(F.col(self.key)).alias("b")).count().collect():
                many[b] += n
        files = np.zeros(self.buckets, dtype="int64")
        for b, n in many.items():
            files[b] = max(self.spread, -(-n // self.rows))
        return files

    def change(
        self, new: DataFrame | None = None, replaced: DataFrame | None = None, touched: DataFrame | None = None, touch: dict[str, Column] | None = None,
        base: int | None = None, lease: Lease | None = None, batch: tuple[str, int] | None = None,
    ) -> Commit:
        """One transaction: documents of `replaced`(key) lose their chunks, those of `touched`(key) get the columns of
        `touch`, rows of `new` are added; then it is committed upon the version `base`, the newest if none is named.

        With a lease, its holder must still have it, and a table that has seen a later holder refuses it. With a batch
        (a writer's name, number), the change is made once: if the table has seen this number or a later one of the
        writer, nothing is done.
        """
        base = self.version() if base is None else base
        if batch and self.manifest(base)["batches"].get(batch[0], -1) >= batch[1]:
            return Commit(base, [])
        told = [f.select(self.bucket(F.col(self.key)).alias("b"), F.lit(n).alias("n")) for f, n in ((new, 1), (replaced, 0), (touched, 0)) if f is not None]
        if not told:
            return Commit(base, [])
        every = told[0]
        for other in told[1:]:
            every = every.unionByName(other)
        added = {b: n for b, n in every.groupBy("b").agg(F.sum("n")).collect()}  # as many as there are buckets at most
        hit = sorted(added)
        rows = self.read(base, hit)
        if replaced is not None:
            rows = rows.join(replaced.select(F.col(self.key).alias("_key")).distinct(), F.col(self.key).eqNullSafe(F.col("_key")), "left_anti")
        if touched is not None:
            marked = rows.join(touched.select(F.col(self.key).alias("_key"), F.lit(True).alias("_hit")).distinct(), F.col(self.key).eqNullSafe(F.col("_key")), "left")
            rows = marked.select(*(F.when(F.col("_hit"), (touch or {})[c]).otherwise(F.col(c)).alias(c) if c in (touch or {}) else F.col(c) for c in self.schema.names))
        rows = self._fit(rows)
        if new is not None:
            rows = rows.unionByName(self._fit(new))
        name = f"data-{uuid.uuid4().hex}"
        files = self._files(base, added)
        starts = np.cumsum(files) - files
        part = F.pmod(F.xxhash64(*self.schema.names), F.get(F.lit(files), F.col("_bucket")))
        dealt = rows.withColumn("_bucket", self.bucket(F.col(self.key)))
        dealt = dealt.repartitionById(max(1, int(files.sum())), (F.get(F.lit(starts), F.col("_bucket")) + part).cast("int")).sortWithinPartitions("_bucket", self.key)
        dealt.write.partitionBy("_bucket").parquet(f"{self.folder}/{name}")
        fs, path = _file_system(self.spark, f"{self.folder}/{name}")
        written = {int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(path) if f.isDirectory()}
        return self._commit(base, hit, {str(b): f"{name}/_bucket={b}" for b in written}, lease, batch)

    def _commit(self, base: int, hit: list[int], folders: dict[str, str], lease: Lease | None, batch: tuple[str, int] | None = None) -> Commit:
        version = base
        seen = self.manifest(version)
        while True:
            fence = lease.check() if lease else seen["fence"]
            if fence < seen["fence"]:
                raise Conflict(f"{self.folder} has a later holder")
            if batch and seen["batches"].get(batch[0], -1) >= batch[1]:
                return Commit(version, [])
            batches = {**seen["batches"], **({batch[0]: batch[1]} if batch else {})}
            carried = {b: f for b, f in seen["folders"].items() if int(b) not in hit}
            if create_exclusively(self.spark, self._manifest(version + 1), json.dumps({**seen, "fence": fence, "batches": batches, "hit": hit, "folders": {**carried, **folders}})):
                return Commit(version + 1, hit)
            version += 1
            seen = self.manifest(version)
            if both := sorted(set(seen["hit"]) & set(hit)):
                raise Conflict(f"version {version} of {self.folder} has changed buckets {both[:10]} too")

    def fence(self, lease: Lease) -> Commit:
        """Tell the table of the lease's holder, before its first change: earlier holders' late changes are refused from now on."""
        return self._commit(self.version(), [], {}, lease)

    def replace(self, new: DataFrame, **told) -> Commit:
        """Every document of new has its chunks replaced by those of new."""
        return self.change(new=new, replaced=new.select(self.key), **told)

    def delete(self, ids: DataFrame, **told) -> Commit:
        return self.change(replaced=ids, **told)

    def touch(self, ids: DataFrame, values: dict[str, Column], **told) -> Commit:
        return self.change(touched=ids, touch=values, **told)

    def expire(self, keep: int = 2) -> int:
        """Delete the folders that the newest `keep` versions don't name; the number of folders. Versions before them can't
        be read any more. No change may be under way, as its folder isn't named yet."""
        newest = self.version()
        named = {f.split("/")[0] + "/" + f.split("/")[1] for v in range(max(0, newest - keep + 1), newest + 1) for f in self.manifest(v)["folders"].values()}
        fs, top = _file_system(self.spark, self.folder)
        gone = 0
        for data in (f.getPath() for f in fs.listStatus(top) if f.isDirectory() and f.getPath().getName().startswith("data-")):
            for part in (f.getPath() for f in fs.listStatus(data) if f.isDirectory()):
                if f"{data.getName()}/{part.getName()}" not in named:
                    gone += bool(fs.delete(part, True))
        return gone
