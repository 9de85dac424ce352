"""Limits, caches and other state over a stream of requests, computed for a batch of them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import question_hash
from . import machines


def told_join(rows: DataFrame, told: DataFrame, on: list[str]) -> DataFrame:
    """rows left-joined with told, which has a row for each key at most; a null is a key like others.

    Where told turns out small it goes to every task and rows stay where they are; else both are shuffled, and adaptive
    execution splits the partition of a key that has much of the rows, which a left join allows.
    """
    named = told.select(*(F.col(c).alias(f"_on_{c}") for c in on), *(c for c in told.columns if c not in on))
    matched = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on))
    return rows.join(named, matched, "left").drop(*(f"_on_{c}" for c in on))


def rate_limited(requests: DataFrame, limit: int, window: str = "hour", failed: str | None = None) -> DataFrame:
    """requests(id, created_at, ip_hash) with `admitted`: the first `limit` of an address in each calendar window; 0 or less is no limit.

    failed: a boolean column of requests whose provider call failed; these are refunded before the next request, so
    they don't count. The limit-th request that counts is found by ranks cut before the shuffle and told to the
    address's rows, so an address with much of the rows is no single task's. Requests of a null address share its
    limit, those of a null time a window of their own; null times and ids come first.
    """
    if limit <= 0:
        return requests.withColumn("admitted", F.lit(True))
    keyed = requests.withColumn("_window", F.date_trunc(window, "created_at"))
    counted = keyed if failed is None else keyed.where(~F.coalesce(F.col(failed), F.lit(False)))
    rank = F.row_number().over(Window.partitionBy("ip_hash", "_window").orderBy("created_at", "id"))
    last = counted.select("ip_hash", "_window", "created_at", "id").withColumn("_rank", rank).where(F.col("_rank") <= limit)
    last = last.groupBy("ip_hash", "_window").agg(F.count("*").alias("n"), F.max(F.struct("created_at", "id")).alias("_last")).where(F.col("n") == limit)
    joined = told_join(keyed, last.select("ip_hash", "_window", "_last"), ["ip_hash", "_window"])
    admitted = F.col("_last").isNull() | (F.struct("created_at", "id") <= F.col("_last"))
    return joined.select(*requests.columns, admitted.alias("admitted"))


def within_budget(requests: DataFrame, limit: int) -> DataFrame:
    """The first `limit` requests of each day: ranks are cut before the shuffle, so a day costs limit rows a task."""
    rank = F.row_number().over(Window.partitionBy(F.to_date("created_at")).orderBy("created_at", "id"))
    return requests.withColumn("rank", rank).where(F.col("rank") <= limit).drop("rank")


def cache_upsert(writes: DataFrame) -> DataFrame:
    """The cache after writes(id, question, answer, score, created_at, status): one row a question hash, with the first
    id and question and the last answer, score and time. Only answers are cached."""
    order = F.struct("created_at", "id")
    rows = writes.where("status = 'answered'").withColumn("question_hash", question_hash("question"))
    first, last = (lambda c: F.min_by(c, order).alias(c)), (lambda c: F.max_by(c, order).alias(c))
    return rows.groupBy("question_hash").agg(first("id"), first("question"), last("answer"), last("score"), F.max("created_at").alias("created_at"))


def cache_probe(questions: DataFrame, cache: DataFrame) -> DataFrame:
    """questions with `hit` and the cached answer."""
    probe = questions.withColumn("question_hash", question_hash("question"))
    found = cache.select("question_hash", F.col("answer").alias("cached_answer"), F.lit(True).alias("_hit"))
    return probe.join(found, "question_hash", "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def recently_refused(requests: DataFrame, seconds: int = 3600) -> DataFrame:
    """requests(id, question_hash, created_at, refused) with `cached_refusal`: a refusal of the question less than `seconds` before.

    Time is cut into blocks of `seconds`: only refusals of a row's own block and the last one of the block before can
    count, so a question that is asked all the time is dealt by its blocks.
    """
    block = F.floor(F.unix_micros(F.col("created_at").cast("timestamp")) / (seconds * 1_000_000)).cast("long")
    rows = requests.withColumns({"_block": block, "_carried": F.lit(False)})
    last = rows.where("refused").groupBy("question_hash", "_block").agg(F.max(F.struct("created_at", "id")).alias("_last"))
    carried = last.select("question_hash", (F.col("_block") + 1).alias("_block"), F.col("_last.created_at").alias("created_at"), F.col("_last.id").alias("id"), F.lit(True).alias("refused"), F.lit(True).alias("_carried"))
    before = Window.partitionBy("question_hash", "_block").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, -1)
    at = F.last(F.when(F.col("refused"), F.col("created_at")), ignorenulls=True).over(before)
    marked = rows.unionByName(carried, allowMissingColumns=True).withColumn("cached_refusal", F.coalesce(F.col("created_at") < at + F.make_dt_interval(secs=F.lit(seconds)), F.lit(False)))
    return marked.where("NOT _carried").select(*requests.columns, "cached_refusal")


def log_once(requests: DataFrame, seconds: int = 3600, block: int = machines.BLOCK, most: int = 1_000_000) -> DataFrame:
    """requests(id, ip_hash, bucket, created_at) with `written`: none less than `seconds` after the key's last written one.

    Whether a row is written depends on the one written before. Where a count shows that no key has more than `most` rows,
    a task streams its keys' sorted rows and remembers one mark. Else rows are cut into blocks, each of which tells for
    every time that a key may enter it with which one it leaves; so a key with much of the rows is many tasks.
    """
    micros = F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(-(1 << 61)))
    keyed = requests.select("id", "ip_hash", "bucket", "created_at", F.to_json(F.struct("ip_hash", "bucket")).alias("_log_key"))
    hottest = keyed.groupBy("_log_key").count().agg(F.max("count")).first()[0] or 0
    if hottest > most:
        marked = machines.held_marks(keyed, "_log_key", "created_at", ["created_at", "id"], F.lit(seconds * 1_000_000), block)
        return marked.select("id", "ip_hash", "bucket", "created_at", F.col("marked").alias("written"))
    ordered = keyed.withColumn("_micros", micros).repartition("_log_key").sortWithinPartitions("_log_key", "_micros", "id")

    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, until = None, 0
        for frame in frames:
            written = []
            for own, at in zip(frame["_log_key"].tolist(), frame["_micros"].tolist()):
                new = own != key or at >= until
                key, until = own, at + seconds * 1_000_000 if new else until
                written.append(new)
            yield frame[["id", "ip_hash", "bucket", "created_at"]].assign(written=written)

    return ordered.mapInPandas(mark, keyed.drop("_log_key").withColumn("written", F.lit(True)).schema)


#: Seconds that a model isn't asked after it has refused for a quota a day, and for others.
DAY_COOLDOWN, COOLDOWN = 3600, 60


def cooled_down(calls: DataFrame, block: int = machines.BLOCK) -> DataFrame:
    """calls(id, at, pool, model, refused, scope) with `skipped` and `starts`: a call that is refused for a quota starts a
    cooldown of its pool's model, a long one if the quota is a day's; calls inside of it are skipped, so that what they
    would have got doesn't count."""
    lasts = F.when(F.coalesce("refused", F.lit(False)), F.when(F.col("scope") == "day", F.lit(DAY_COOLDOWN)).otherwise(F.lit(COOLDOWN)).cast("long") * 1_000_000)
    keyed = calls.withColumn("_pool", F.to_json(F.struct("pool", "model")))
    return machines.held_marks(keyed, "_pool", "at", ["at", "id"], lasts, block).select(*calls.columns, F.col("held").alias("skipped"), F.col("marked").alias("starts"))


def timeout_streaks(fetches: DataFrame, block: Column | None = None) -> DataFrame:
    """fetches(id, queue, at, outcome: ok, timeout or failed) with `streak`: timeouts since the last success; other failures
    don't count. Fetches of a null queue are a queue's; a null time is before all others.

    block: an expression that grows with `at` and cuts a queue's time into parts of bounded size, as a queue may hold
    much of the rows. Each part counts for itself, and a window over the few parts of a queue tells what it starts with.
    """
    part = F.lit(0) if block is None else block
    rows = fetches.withColumn("_part", part)
    ok, timeout = F.when(F.col("outcome") == "ok", 1).otherwise(0), F.when(F.col("outcome") == "timeout", 1).otherwise(0)
    order = Window.partitionBy("queue", "_part").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    islands = rows.withColumn("_island", F.sum(ok).over(order))
    inside = Window.partitionBy("queue", "_part", "_island").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = islands.withColumn("_own", F.sum(timeout).over(inside))
    if block is not None:
        ends = rows.groupBy("queue", "_part").agg(F.max(F.when(F.col("outcome") == "ok", F.struct("at", "id"))).alias("_ok"))
        since = told_join(rows, ends, ["queue", "_part"]).where(F.col("_ok").isNull() | (F.struct("at", "id") > F.col("_ok")))
        parts = told_join(ends, since.groupBy("queue", "_part").agg(F.sum(timeout).alias("_tail")), ["queue", "_part"])
        # a part with a success starts the count anew for those after it
        over = Window.partitionBy("queue").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        run = parts.withColumn("_runs", F.sum(F.when(F.col("_ok").isNotNull(), 1).otherwise(0)).over(over))
        within = Window.partitionBy("queue", "_runs").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        after = run.withColumn("_after", F.sum(F.coalesce("_tail", F.lit(0))).over(within))
        start = after.withColumn("_start", F.coalesce(F.lag("_after").over(Window.partitionBy("queue").orderBy("_part")), F.lit(0)))
        counted = told_join(counted, start.select("queue", "_part", "_start"), ["queue", "_part"])
        counted = counted.withColumn("_own", F.when(F.col("_island") == 0, F.col("_start") + F.col("_own")).otherwise(F.col("_own")))
    return counted.select(*fetches.columns, F.col("_own").alias("streak"), (F.col("_own") >= 3).alias("pause"))


def guest(salt: str, ip: Column, forwarded: Column, edge: Column, trusted: Column) -> Column:
    """A guest's hash: of the edge's header, else the last forwarded address, if the proxy is trusted and they are addresses."""
    valid = r"^(\d{1,3}(\.\d{1,3}){3}|[0-9a-fA-F:]*:[0-9a-fA-F:.]+)$"
    last = F.trim(F.element_at(F.split(forwarded, ","), -1))
    told = F.coalesce(F.when(edge.rlike(valid), edge), F.when(last.rlike(valid), last))
    return F.sha2(F.concat_ws("|", F.lit(salt), F.coalesce(F.when(trusted, told), ip)), 256)


def invalidated(cache: DataFrame, snapshot: str) -> DataFrame:
    """The cache entries that belong to the index snapshot."""
    return cache.where(F.col("snapshot") == snapshot)
