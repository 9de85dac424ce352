"""Readers, and a versioned table: snapshots written whole, and a pointer that names the current one."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None) -> DataFrame:
    """A table of files: parquet, orc, json, csv (with a header) or text."""
    reader = spark.read.schema(schema) if schema else spark.read
    return (reader.option("header", "true") if kind == "csv" else reader).format(kind).load(path)


class Conflict(RuntimeError):
    """Another writer was first."""


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def file_names(spark: SparkSession, folder: str) -> list[str]:
    """The names of the files in a folder that hold something; none where there is no folder."""
    fs, path = _file_system(spark, folder)
    return [f.getPath().getName() for f in fs.listStatus(path) if f.isFile() and f.getLen() > 0] if fs.exists(path) else []


def create_exclusively(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small file with this text; False where there is one. Of several writers one makes it.

    The store must create files exclusively, as HDFS does; folders of this machine are served by links.
    """
    fs, target = _file_system(spark, path)
    if fs.getScheme() == "file":
        # the local file system looks before it creates, which isn't atomic; a link is
        name = target.toUri().getPath()
        os.makedirs(os.path.dirname(name), exist_ok=True)
        own = f"{os.path.dirname(name)}/_{uuid.uuid4().hex}"
        with open(own, "w") as out:
            out.write(text)
        try:
            os.link(own, name)
        except FileExistsError:
            return False
        finally:
            os.remove(own)
        return True
    if fs.exists(target):
        return False
    try:
        out = fs.create(target, False)
    except Exception:  # it was made since; anything else is no reason to go on
        if fs.exists(target):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def file_text(spark: SparkSession, path: str) -> str:
    fs, target = _file_system(spark, path)
    stream = fs.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


class Snapshots:
    """A table in a folder: each commit writes a new snapshot and then its pointer; readers see the newest pointer.

    A pointer's name is its version alone and it is made only where none is, so of two writers one gets a version and
    the other the next one, or a Conflict. The store must create files exclusively, as HDFS does; folders of this
    machine are served by links. A run that dies leaves a snapshot without a pointer, which no reader sees. The
    version before stays readable.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def versions(self) -> list[int]:
        return sorted(int(n.split(".")[1]) for n in file_names(self.spark, self.folder) if n.startswith("pointer."))

    def _pointer(self, version: int) -> str:
        return f"{self.folder}/pointer.{version:012d}"

    def commit(self, table: DataFrame, after: int | None = None) -> int:
        """The version that table is written as. With after, it must be the one that follows this version: if another
        writer has committed since, a Conflict is raised, and what the table was computed from must be read again."""
        name = uuid.uuid4().hex
        table.write.parquet(f"{self.folder}/data-{name}")
        version = (self.versions() or [0])[-1] + 1 if after is None else after + 1
        while not create_exclusively(self.spark, self._pointer(version), name):
            if after is not None:
                raise Conflict(f"version {version} of {self.folder} is there already")
            version += 1
        return version

    def current(self, back: int = 0) -> DataFrame:
        """The table as of the newest version, or `back` versions before."""
        known = self.versions()
        if len(known) <= back:
            raise LookupError(f"{self.folder} has no such version")
        name = file_text(self.spark, self._pointer(known[-1 - back]))
        return self.spark.read.parquet(f"{self.folder}/data-{name}")


def isolated(spark: SparkSession, sources: dict[str, Callable[[], DataFrame]], folder: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Each source's table as written under folder, and (source, ok, docs, error) of all: one that fails, while it is
    planned or read, is left out and reported."""
    good: dict[str, DataFrame] = {}
    report = []
    for name, make in sources.items():
        path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        try:
            make().write.parquet(path)
            good[name] = spark.read.parquet(path)
            report.append((name, True, good[name].count(), None))
        except Exception as error:  # whatever a source raises is its own
            report.append((name, False, 0, f"{type(error).__name__}: {error}"[:500]))
    return good, spark.createDataFrame(report, "source string, ok boolean, docs long, error string")


def write_exports(rows: DataFrame, column: str, folder: str) -> None:
    """One of the export columns as text files."""
    rows.select(column).write.mode("errorifexists").text(folder)
