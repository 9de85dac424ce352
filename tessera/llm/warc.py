"""Deterministic sharded WARC writer and reader.

Records are range-sorted by (id, payload digest); every task writes gzip members to files under temporary
names and rolls them by compressed size; the commit renames the files of the tasks that succeeded and then
writes the manifest, which alone tells a reader what belongs to the archive. Headers and digests are made
anew from the payload. The writer and the reader are a Spark data source named ``warc``.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import all_salts, new_folder, salt_of, written

MANIFEST = "manifest.json"
SCHEMA = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
#: High halves of the record ids; the low half of a row with an id is that id.
WITH_ID, WITHOUT_ID = 0x7E55E7A0_0000_8000, 0x7E55E7A1_0000_8000
#: The columns that the writer takes, and renames at once in a commit.
ROW, RENAMES = ["page_id", "digest", "kind", "winner", "url", "html"], 32
#: Fixed, so that the same rows make the same bytes.
RECORD_DATE = "1970-01-01T00:00:00Z"


def store(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and its path there; Spark's names of S3 are S3's."""
    return pafs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", folder))


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    if page_id is None:
        low, high = int.from_bytes(hashlib.sha1(f"{url}\n{digest}".encode()).digest()[:8], "big"), WITHOUT_ID
    else:
        low, high = page_id & (2**64 - 1), WITH_ID
    return f"<urn:uuid:{uuid.UUID(int=high << 64 | low)}>"


def page_of(record: str) -> int | None:
    number = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    if number >> 64 != WITH_ID:
        return None
    low = number & (2**64 - 1)
    return low - 2**64 if low >= 2**63 else low


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def one_line(text: str | None) -> str:
    """A header value: line breaks can't stand in it."""
    return "" if text is None else text.replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, url, digest)}",
        f"WARC-Date: {RECORD_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(3, f"WARC-Target-URI: {one_line(url)}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {record_id(refers_to, url, digest)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list[dict] = field(default_factory=list)


class Roller:
    """Writes gzip members of one task to files of about max_bytes under temporary names."""

    def __init__(self, folder: str, part: int, attempt: int, max_bytes: int):
        self.fs, self.root = store(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.part, self.attempt, self.max_bytes = part, attempt, max_bytes
        self.files: list[dict] = []
        self.out = None

    def add(self, record: bytes) -> None:
        if self.out is None:
            final = f"part-{self.part:06d}-{len(self.files):05d}.warc.gz"
            self.files.append({"temporary": f"_temporary-{self.attempt}-{final}", "name": final, "bytes": 0, "records": 0})
            self.out, self.sha = self.fs.open_output_stream(f"{self.root}/{self.files[-1]['temporary']}", compression=None), hashlib.sha256()
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = packer.compress(record) + packer.flush()
        self.out.write(member)
        self.sha.update(member)
        self.files[-1]["bytes"] += len(member)
        self.files[-1]["records"] += 1
        if self.files[-1]["bytes"] >= self.max_bytes:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.files[-1]["sha256"] = self.sha.hexdigest()
            self.out = None


class WarcWriter(DataSourceArrowWriter):
    """Takes batches of rows (page_id, digest, kind, winner, url, html) in order: a row of kind 0 tells that the payload of
    the rows after it with the same id and digest is shared, and which page is its response."""

    def __init__(self, folder: str, max_bytes: int):
        self.folder, self.max_bytes = folder, max_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task = TaskContext.get()
        roller = Roller(self.folder, task.partitionId(), task.taskAttemptId(), self.max_bytes)
        key, winner, shared, first = None, None, False, True
        for page_id, digest, kind, best, url, html in (row for batch in iterator for row in zip(*(batch.column(c) for c in ROW))):
            page_id, digest = page_id.as_py(), digest.as_py()
            if (page_id, digest) != key:
                key, shared, first = (page_id, digest), False, True
            if kind.as_py() == 0:
                shared, winner = True, best.as_py()
                continue
            payload = html.as_buffer().to_pybytes()
            revisit = shared and not (first and page_id == winner)
            roller.add(record_bytes(page_id, url.as_py(), payload, base32_sha1(payload), winner if revisit else None, revisit))
            first = False
        roller.close()
        return Written(files=roller.files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = store(self.folder)
        fs.create_dir(root, recursive=True)
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: f["name"])
        with ThreadPoolExecutor(RENAMES) as pool:
            list(pool.map(lambda f: fs.move(f"{root}/{f['temporary']}", f"{root}/{f['name']}"), files))
        kept = [{k: f[k] for k in ("name", "bytes", "records", "sha256")} for f in files]
        with fs.open_output_stream(f"{root}/_temporary-{MANIFEST}") as out:
            out.write(json.dumps({"format": "WARC/1.1", "files": kept}, indent=1).encode())
        fs.move(f"{root}/_temporary-{MANIFEST}", f"{root}/{MANIFEST}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = store(self.folder)
        for f in (f for m in messages if m for f in m.files):
            try:
                fs.delete_file(f"{root}/{f['temporary']}")
            except OSError:  # not there any more: nothing to take back
                continue


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one record each, with a bounded buffer beside the record itself."""
    unpacker, parts = zlib.decompressobj(31), []
    while chunk := stream.read(1 << 20):
        while chunk:
            parts.append(unpacker.decompress(chunk))
            chunk = unpacker.unused_data
            if unpacker.eof:
                yield b"".join(parts)
                unpacker, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the last record of the file is cut off")


def parsed(record: bytes) -> dict:
    head, block = record.split(b"\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError(f"block digest of {fields['WARC-Record-ID']} differs")
    http, payload = block.split(b"\r\n\r\n", 1)
    digest, revisit = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "revisit"
    if not revisit and base32_sha1(payload) != digest:
        raise ValueError(f"payload digest of {fields['WARC-Record-ID']} differs")
    told = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    return {
        "page_id": page_of(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "payload": None if revisit else payload,
        "payload_bytes": int(told["Content-Length"]),
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": page_of(fields["WARC-Refers-To"]) if revisit else None,
    }


class WarcReader(DataSourceReader):
    """One partition for each file of the manifest; files that it doesn't name are not read."""

    def __init__(self, folder: str, names: list[str]):
        self.folder, self.names = folder, names

    def partitions(self) -> list[InputPartition]:
        fs, root = store(self.folder)
        with fs.open_input_stream(f"{root}/{MANIFEST}") as told:
            files = json.loads(told.read())["files"]
        return [InputPartition(f["name"]) for f in files] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        fs, root = store(self.folder)
        with fs.open_input_stream(f"{root}/{partition.value}", compression=None) as stream:
            for record in members(stream):
                row = parsed(record)
                yield tuple(row[n] for n in self.names)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], schema.fieldNames())

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("max_bytes", 256 << 20)))


def write_warc(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    max_bytes: int = 256 << 20,
    task_bytes: int = 256 << 20,
    salts: int = 16,
) -> None:
    """Write a record per row of pages to folder (an empty or new one in a store that all executors reach).

    Of rows with equal payloads the one with the largest id is a response and the others are revisits of it.
    Null html is an empty payload. A null url leaves the target header out. Rows without an id sort first and
    are never a response that others with an id refer to; among themselves the first is. Of repeated rows (same
    id and payload) the first is the response. A record is held whole in memory, long ones too. No rows: a manifest
    without files. Further columns are ignored, whatever their names.
    """
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    text = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.sha2(text.cast("binary"), 256).alias("digest"), F.col(url_col).alias("url"), text.alias("html")
    )
    keys = written(rows.select("page_id", "digest", F.octet_length("html").alias("bytes")), "warc-keys")
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    groups = keys.groupBy("digest").agg(F.max("page_id").alias("winner"), F.count("*").alias("n")).where("n > 1")
    shared = (
        keys.select("page_id", "digest", salt_of("page_id", salts).alias("salt"))
        .distinct()
        .join(groups.select("digest", "winner", all_salts(salts).alias("salt")), ["digest", "salt"])
        .select("page_id", "digest", F.lit(0).alias("kind"), "winner", F.lit(None).cast("string").alias("url"), F.lit("").alias("html"))
    )
    shared = written(shared, "warc-shared")
    both = rows.select("page_id", "digest", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("winner"), "url", "html").unionByName(shared)
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // task_bytes))
    ordered = both.repartitionByRange(int(tasks), "page_id", "digest").sortWithinPartitions("page_id", "digest", "kind", "url")
    ordered.write.format("warc").option("path", folder).option("max_bytes", max_bytes).mode("append").save()


def read_warc(spark: SparkSession, folder: str, columns: str = SCHEMA) -> DataFrame:
    """The records of the archive in folder, digests checked; columns: those of SCHEMA that are wanted."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").schema(columns).option("path", folder).load()


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives and read back."""
    folder = new_folder(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_warc(spark, folder, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


#: Expected rows: digests computed by DuckDB over the whole pages table. DuckDB has no base 32, so 5 bits at a time pick the letter.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS hex, max(page_id) OVER (PARTITION BY h) AS top, h FROM p),
b AS (SELECT *, array_to_string(list_transform(range(0, 40), lambda i: lpad(bin(('0x' || hex[i + 1])::INT), 4, '0')), '') AS bits FROM d)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + list_sum(list_transform(range(0, 5), lambda j: bits[5 * i + j + 1]::INT * (16 >> j)::INT))::INT]), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM b
"""
