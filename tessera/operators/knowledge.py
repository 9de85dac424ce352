"""The chunk table: lookups, rewrites (Parquet has no in-place update, so each gives the new table), statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash, trim


def embedded(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.col("embedding").isNotNull())


def embeddings_page(chunks: DataFrame, limit: int, offset: int) -> DataFrame:
    return embedded(chunks).select("id", "post_id", "embedding").orderBy("id").offset(max(0, offset)).limit(max(1, limit))


def find(rows: DataFrame, row_id: int) -> DataFrame:
    return rows.where(F.col("id") == row_id)


def contents_for(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, content) of the ids asked for, each once."""
    return chunks.join(ids.select("id").distinct(), "id", "left_semi").select("id", "content")


def hash_map(chunks: DataFrame) -> DataFrame:
    """(post_id, hashes): a document's chunk hashes by chunk index. A document bounds the group."""
    return chunks.groupBy("post_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("chunk_index", "content_hash")))).alias("hashes"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(post_id, old_chunks, new_chunks, differing, outcome) of each document of new: unchanged, indexed or cleared.

    Counts of a full outer join on document and chunk decide, so no list of hashes is built.
    """
    o = old.select("post_id", "chunk_index", F.col("content_hash").alias("old_hash"))
    n = new.select("post_id", "chunk_index", F.col("content_hash").alias("new_hash"))
    both = o.join(n, ["post_id", "chunk_index"], "full_outer").groupBy("post_id")
    counted = both.agg(F.count("old_hash").alias("old_chunks"), F.count("new_hash").alias("new_chunks"), F.count(F.when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), 1)).alias("differing"))
    outcome = F.when(F.col("new_chunks") == 0, "cleared").when(F.col("differing") == 0, "unchanged").otherwise("indexed")
    return counted.withColumn("outcome", outcome)


def inserted(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """The table after the rows of new: a hash that isn't given is that of the content, an empty vector is none."""
    given = F.col("content_hash") if "content_hash" in new.columns else F.lit(None).cast("string")
    content = F.coalesce("content", F.lit(""))
    rows = new.withColumns({"content": content, "content_hash": F.coalesce(given, content_hash(content)), "embedding": F.when(F.size("embedding") > 0, F.col("embedding"))})
    return chunks.unionByName(rows.select(chunks.columns))


def cleared(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table without its rows, and (deleted): how many they were."""
    return rows.where(F.lit(False)), rows.agg(F.count("*").alias("deleted"))


def replace_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """The table after every document of new has replaced its chunks."""
    return old.join(new.select("post_id").distinct(), "post_id", "left_anti").select(old.columns).unionByName(new.select(old.columns))


def delete_document(chunks: DataFrame, post_id: int) -> DataFrame:
    return chunks.where(F.col("post_id") != post_id)


def prune_orphans(chunks: DataFrame, keep: DataFrame) -> DataFrame:
    """Chunks of the documents in keep. An empty keep deletes nothing."""
    none = keep.agg(F.count("*") == 0).scalar()
    kept = chunks.join(keep.select("post_id").distinct().withColumn("_kept", F.lit(True)), "post_id", "left")
    return kept.where(F.coalesce("_kept", F.lit(False)) | none).select(chunks.columns)


def touch(chunks: DataFrame, post_ids: DataFrame, at: Column) -> DataFrame:
    marked = chunks.join(post_ids.select("post_id").distinct().withColumn("_hit", F.lit(True)), "post_id", "left")
    return marked.withColumn("updated_at", F.when(F.col("_hit"), at).otherwise(F.col("updated_at"))).drop("_hit")


def stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("chunks"), F.countDistinct("post_id").alias("documents"), F.count("embedding").alias("embedded"), (F.count("*") > 5000).alias("large"))


def top_documents(chunks: DataFrame, n: int = 6) -> DataFrame:
    return chunks.groupBy("post_id").agg(F.count("*").alias("chunks")).orderBy(F.desc("chunks"), "post_id").limit(min(30, max(1, n)))


def profile_sample(chunks: DataFrame, posts: int = 6, max_bytes: int = 4000) -> DataFrame:
    """(sample): first chunks of the documents with most chunks, in order of id, until max_bytes are reached.

    At most 30 chunks are concatenated. The cut falls on a code point, as text can't end inside one.
    """
    first = chunks.where("chunk_index = 0").join(F.broadcast(top_documents(chunks, posts)), "post_id").select("post_id", trim("content").alias("content")).where("content <> ''")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("post_id", "content"))), lambda x: x["content"])
    taken = F.aggregate(parts, F.lit(""), lambda out, x: F.when(F.octet_length(out) >= max_bytes, out).otherwise(F.concat(out, x, F.lit("\n\n"))))
    return first.agg(F.left(trim(taken), F.lit(max_bytes)).alias("sample"))


def stale_count(chunks: DataFrame, posts: DataFrame) -> DataFrame:
    """(stale): documents changed after a chunk of theirs was written."""
    joined = chunks.join(posts, "post_id").where(F.col("post_modified") > F.col("updated_at"))
    return joined.agg(F.countDistinct("post_id").alias("stale"))


def index_state(rows: DataFrame) -> DataFrame:
    """state and reason of rows (saved, current, embedded): ok, partial or stale."""
    parts = F.split("saved", ":", 3)
    partial = (F.size(parts) == 3) & (parts[0] == "partial")
    state = F.when((F.col("saved") == F.col("current")) | (F.col("embedded") == 0), "ok").when(partial & (F.get(parts, F.lit(2)) == F.col("current")), "partial").otherwise("stale")
    reason = F.when(partial & F.get(parts, F.lit(1)).isin("crawl", "errors", "budget"), F.get(parts, F.lit(1))).otherwise("")
    return rows.withColumns({"state": state, "reason": reason})


def index_report(changed: DataFrame, old: DataFrame) -> DataFrame:
    """One row of counts over the outcomes of an index run, and whether documents dropped by 30 percent or more."""
    of = lambda kind: F.count(F.when(F.col("outcome") == kind, 1)).alias(kind)
    after = changed.agg(F.count("*").alias("documents"), of("indexed"), of("unchanged"), of("cleared"), F.coalesce(F.sum("new_chunks"), F.lit(0)).alias("chunks"), F.count(F.when(F.col("new_chunks") > 0, 1)).alias("after"))
    before = old.agg(F.countDistinct("post_id")).scalar()
    drop = (F.lit(1.0) * before - F.col("after")) / before
    return after.withColumn("before", before).withColumn("drop_alert", F.coalesce((F.col("before") > 0) & (drop >= F.lit(0.30)), F.lit(False)))
