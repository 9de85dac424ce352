"""Embedding waves and their failures, a provider's error bodies, publishing with the version before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.leases import Lease
from ..sources.shared import written
from ..sources.tables import Conflict, Snapshots
from .ranks import numbered

#: Chunks of a wave, seconds from one wave to the next, seconds that a run may take.
WAVE, PACE, BUDGET = 500, 13, 45
PROGRESS = "post_id long, run int, state string, chunks long"

#: Fixed value: the longest delay that a provider's hint may ask for, in seconds.
MOST_DELAY = 60


def outcomes(chunks: DataFrame) -> DataFrame:
    """(post_id, chunks, failed) of chunks(post_id, wave, wave_failed): a failed wave fails every document in it."""
    return chunks.groupBy("post_id").agg(F.count("*").alias("chunks"), F.max("wave_failed").alias("failed"))


def waves_in(budget: float, seconds: float) -> int | None:
    """How many waves start within a budget if each takes so many seconds: one always does; None is no limit."""
    return None if budget <= 0 or seconds <= 0 else max(1, -int(-budget // seconds))


def planned(chunks: DataFrame, progress: DataFrame, size: int = WAVE) -> DataFrame:
    """chunks(post_id, chunk_index, ...) of the documents that progress doesn't name as indexed, with `wave` from 0.

    Waves hold `size` chunks in the order of documents and chunks; a document may lie in several. Null ids come first and
    are one document; repeated chunks are chunks of their own.
    """
    done = progress.where("state = 'indexed'").select(F.col("post_id").alias("_done")).distinct()
    left = chunks.join(done, F.col("post_id").eqNullSafe(F.col("_done")), "left_anti")
    placed = numbered(left, [F.asc("post_id"), F.asc("chunk_index")], "_number")
    return placed.withColumn("wave", F.floor(F.col("_number") / size).cast("long")).drop("_number")


def index_run(
    chunks: DataFrame, progress: DataFrame, run: int, embed: Callable[[DataFrame], DataFrame], size: int = WAVE, budget: float = BUDGET, seconds: float = PACE
) -> tuple[DataFrame, DataFrame]:
    """One run of the index: (chunks with wave, embedding and failed; progress after the run).

    Only waves that start within the budget go to `embed`, which adds `embedding` and `failed`; a wave with a failed chunk
    fails whole, and with it its documents. A document is indexed once all of its chunks are; one that the budget
    has cut is left for the next run whole, as it is written whole or not at all. progress(post_id, run, state,
    chunks) has a row for each document that a run has touched, the last run's; the next run takes up whatever isn't
    indexed there, so runs go on until `left_over` is 0.
    """
    waves = planned(chunks, progress, size)
    most = waves_in(budget, seconds)
    inside = F.lit(True) if most is None else F.col("wave") < most
    sent = written(embed(waves.where(inside)), f"run-{run}")
    failed = sent.groupBy("wave").agg(F.max(F.coalesce("failed", F.lit(False))).alias("_failed"))
    both = sent.select("post_id", "wave").unionByName(waves.where(~inside).select("post_id", "wave")).join(failed, "wave", "left")
    state = F.when(F.max(F.coalesce("_failed", F.lit(False))), "failed").when(F.count("_failed") < F.count("*"), "budget").otherwise("indexed")
    touched = both.groupBy("post_id").agg(F.lit(run).cast("int").alias("run"), state.alias("state"), F.count("*").alias("chunks"), F.count("_failed").alias("_sent")).where("_sent > 0").drop("_sent")
    before = progress.join(touched.select(F.col("post_id").alias("_now")), F.col("post_id").eqNullSafe(F.col("_now")), "left_anti")
    return sent, before.unionByName(touched)


def left_over(chunks: DataFrame, progress: DataFrame) -> int:
    """Documents that aren't indexed yet."""
    done = progress.where("state = 'indexed'").select(F.col("post_id").alias("_done")).distinct()
    return chunks.select("post_id").distinct().join(done, F.col("post_id").eqNullSafe(F.col("_done")), "left_anti").count()


def retry_seconds(hint: Column) -> Column:
    """The leading number of a hint if it is from 1 to MOST_DELAY, else 0."""
    number = F.regexp_extract(hint, r"^\s*(\d+)", 1).try_cast("int")
    return F.when(number.between(1, MOST_DELAY), number).otherwise(0)


def quota_scope(violations: Column) -> Column:
    """day or minute, from the ids of a list of violations; day counts first."""
    ids = F.transform(F.from_json(violations, "array<struct<quotaId: string>>"), lambda v: v["quotaId"])
    has = lambda word: F.coalesce(F.exists(ids, lambda i: i.contains(word)), F.lit(False))
    return F.when(has("PerDay"), "day").when(has("PerMinute"), "minute").otherwise("")


def published(before: DataFrame, new: DataFrame, key: list[str], pairs: str) -> DataFrame:
    """The published table: new pairs, and as `previous` what they replace if it wasn't empty."""
    old = before.select(*key, F.when(F.size(pairs) > 0, F.col(pairs)).alias("previous"))
    return new.join(old, key, "left")


def publish(store: Snapshots, new: DataFrame, key: list[str], pairs: str, lease: Lease | None = None, tries: int = 20) -> int:
    """Publish new pairs into a stored table and give its version: each key of new replaces what it had, which stays as
    `previous`; other keys stay as they are. If another writer was first, it is done again upon what that one wrote, so
    no publication is lost. With a lease, its holder must still have it."""
    spark = new.sparkSession
    for _ in range(tries):
        if lease:
            lease.check()
        version = (store.versions() or [0])[-1]
        before = store.current() if version else spark.createDataFrame([], published(new.limit(0), new, key, pairs).schema)
        mine = published(before.select(*key, pairs), new, key, pairs)
        others = before.join(new.select(*key).distinct(), key, "left_anti")
        try:
            return store.commit(others.unionByName(mine.select(others.columns)), after=version)
        except Conflict:
            continue
    raise Conflict(f"{store.folder} was written by others {tries} times")


def unpublish(store: Snapshots, gone: DataFrame, key: list[str], tries: int = 20) -> int:
    """Take the keys of gone out of a stored table; its version."""
    for _ in range(tries):
        version = (store.versions() or [0])[-1]
        if not version:
            return 0
        try:
            return store.commit(store.current().join(gone.select(*key).distinct(), key, "left_anti"), after=version)
        except Conflict:
            continue
    raise Conflict(f"{store.folder} was written by others {tries} times")
