"""What the training-data operators share: tables, the shared folder, word rules."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII space and U+0009 to U+000D; bytes.split() follows the same rule.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, in local mode only, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """df as a table in the shared folder (or the new one named): cuts lineage, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    folder = folder or new_folder(spark, label)
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared one that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def salt_of(column: str | Column, salts: int) -> Column:
    """A salt from 0 to salts - 1 that depends on the row's own id, so that a rerun task deals rows alike."""
    return F.pmod(F.xxhash64(column), F.lit(salts)).cast("int")


def all_salts(salts: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """About `most` rows of df (all, if it has no more), chosen by the hash of a key, so that a rerun chooses alike.

    A limit by rank would send that many rows of every task to the driver; this sends the chosen ones.
    """
    count = df.count()
    parts = 1 << 40
    return df if count <= most else df.where(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(parts)) < int(parts * most / count))
