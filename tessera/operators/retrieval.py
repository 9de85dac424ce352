"""Exact vector search, the topic guard and the context of an answer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import NO_ANSWER, neutralised, trim

#: The floor of the soft threshold, and the default thresholds.
SOFT_FLOOR, SOFT, HARD = 0.70, 0.70, 0.65
#: Vectors in a block of the batch search; bytes of query vectors that every task takes whole at most.
BLOCK, MOST_QUERY_BYTES = 2048, 64 << 20


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(vector: Column, query: Column) -> Column:
    """The cosine with another vector; null for another length, 0 where either is a zero vector."""
    dot = F.aggregate(F.zip_with(vector, query, lambda x, q: x.cast("double") * q.cast("double")), F.lit(0.0), lambda s, x: s + x)
    lengths = norm(vector) * norm(query)
    return F.when(F.size(vector) == F.size(query), F.when(lengths <= 0, F.lit(0.0)).otherwise(dot / lengths))


def top_k(chunks: DataFrame, query: list[float] | Column, k: int = 5) -> DataFrame:
    """(id, post_id, score) of the k best chunks; ties go to the smaller id. An empty, null or zero query finds nothing, and
    vectors whose score isn't a finite number aren't found, as in the batch form.

    The query is a list of numbers or a column that is the same for all rows, such as a scalar subquery.
    """
    wanted = query if isinstance(query, Column) else F.array(*(F.lit(float(q)) for q in query)).cast("array<double>")
    rows = chunks.select("id", "post_id", "embedding", wanted.alias("_wanted")).where(F.col("embedding").isNotNull() & (norm(F.col("_wanted")) > 0))
    finite = F.abs("score") < F.lit(float("inf"))  # false for NaN too, which is above all numbers
    scored = rows.select("id", "post_id", cosine(F.col("embedding"), F.col("_wanted")).alias("score")).where(finite)
    return scored.orderBy(F.desc("score"), "id").limit(max(1, k))


def _ranked(a: np.ndarray, asked: np.ndarray, b: np.ndarray, ids: np.ndarray, posts: np.ndarray, k: int) -> pd.DataFrame:
    """The k best rows of b for each of the queries a, itself left out; ties go to the smaller id."""
    na, nb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
    lengths = na[:, None] * nb[None, :]
    with np.errstate(invalid="ignore"):
        scores = np.divide(a @ b.T, lengths, out=np.zeros((len(a), len(b))), where=~(lengths <= 0))
    scores[asked[:, None] == ids[None, :]] = -np.inf
    scores[na <= 0] = -np.inf
    scores[~np.isfinite(scores)] = -np.inf
    most = min(k, len(b))
    least = np.partition(scores, len(b) - most, axis=1)[:, len(b) - most]
    q, j = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))
    order = np.lexsort((ids[j], -scores[q, j], q))
    q, j = q[order], j[order]
    place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
    q, j = q[place < k], j[place < k]
    return pd.DataFrame({"query_id": asked[q], "id": ids[j], "post_id": posts[j], "score": scores[q, j]})


NEAR = "query_id long, id long, post_id long, score double"
_NONE = pd.DataFrame({"query_id": [], "id": [], "post_id": [], "score": []}).astype({"query_id": "int64", "id": "int64", "post_id": "int64", "score": "float64"})


def _best(own: pd.DataFrame, asked: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> pd.DataFrame:
    """The k best of own(id, post_id, vector) for the queries, which are given by their vectors' length."""
    found = [_NONE]
    for size, fits in own.groupby(own["vector"].map(len)):
        if size in asked:
            ids, vectors = asked[size]
            b = np.stack(fits["vector"].to_list()).astype(float)
            for begin in range(0, len(ids), 512):
                found.append(_ranked(vectors[begin : begin + 512], ids[begin : begin + 512], b, fits["id"].to_numpy(), fits["post_id"].to_numpy(), k))
    return pd.concat(found)


def _by_size(frame: pd.DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    return {size: (some["query_id"].to_numpy(), np.stack(some["wanted"].to_list()).astype(float)) for size, some in frame.groupby(frame["wanted"].map(len)) if size}


def top_k_batch(chunks: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK, most_bytes: int = MOST_QUERY_BYTES) -> DataFrame:
    """(query_id, id, post_id, score, rank) for each of queries(query_id, embedding), itself left out by id.

    Queries are counted first. Up to most_bytes of them go to every task, which multiplies its chunks batch by batch
    and hands on k rows a query and batch. More are dealt with the chunks into a grid of blocks of bounded size; each
    pair of blocks is one matrix product in a task. The last ranking sees k rows for each query and batch or block.
    """
    asked = queries.select(F.col("query_id").alias("query_id"), F.col("embedding").alias("wanted")).where("wanted IS NOT NULL")
    told = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("wanted")), F.lit(0)).alias("numbers")).first()
    rows = chunks.where(F.col("embedding").isNotNull()).select(F.col("id").cast("long").alias("id"), F.col("post_id").cast("long").alias("post_id"), F.col("embedding").alias("vector"))
    if 8 * told["numbers"] <= most_bytes:
        known = _by_size(asked.toPandas())

        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield _best(frame, known, k)

        near = rows.mapInPandas(work, NEAR)
    else:
        counts = [max(1, -(-n // block)) for n in (rows.count(), told["n"])]
        rows = rows.withColumn("c", F.pmod(F.xxhash64("id"), F.lit(counts[0])).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(counts[1] - 1))))
        asked = asked.withColumn("q", F.pmod(F.xxhash64("query_id"), F.lit(counts[1])).cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(counts[0] - 1))))
        near = rows.groupBy("q", "c").cogroup(asked.groupBy("q", "c")).applyInPandas(lambda own, other: _best(own, _by_size(other), k), NEAR)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def guard(hits: DataFrame, soft: float = SOFT, hard: float = HARD, by: str = "query_id", floor: float = SOFT_FLOOR) -> DataFrame:
    """(by, decision, score, coverage, ids) of top-k hits: refused under the hard threshold; ids are those that pass it."""
    soft = max(soft, floor)
    limit = min(hard, soft) if hard > 0 else soft
    kept = F.array_sort(F.collect_list(F.when(F.col("score") >= limit, F.struct((-F.col("score")).alias("s"), "id"))))
    found = hits.groupBy(by).agg(F.max("score").alias("score"), F.transform(kept, lambda x: x["id"]).alias("ids"))
    passed = F.col("score") >= limit
    coverage = F.when(~passed, "none").when(F.col("score") >= soft, "full").otherwise("weak")
    return found.select(by, F.when(passed, "pass").otherwise("refuse").alias("decision"), "score", coverage.alias("coverage"), F.when(passed, F.col("ids")).otherwise(F.array().cast("array<bigint>")).alias("ids"))


def context(hits: DataFrame, chunks: DataFrame, docs: DataFrame, by: str = "query_id") -> DataFrame:
    """(by, context, context_chars): the hits' contents in rank order, numbered, each with its source.

    hits(by, id, rank) are a few for each query. A content that is blank once neutralised isn't numbered.
    """
    joined = hits.join(chunks.select("id", "post_id", "content"), "id").join(docs.select("post_id", trim("title").alias("title"), trim("url").alias("url")), "post_id", "left")
    rows = joined.select(by, "rank", neutralised(trim("content")).alias("content"), F.array_join(F.filter(F.array("title", "url"), lambda x: x.isNotNull() & (x != "")), " — ").alias("source")).where("content <> ''")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "content", "source")))
    number = lambda i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "))
    told = F.transform(ordered, lambda x, i: F.when(x["source"] == "", F.concat(number(i), x["content"])).otherwise(F.concat(number(i), F.lit("(Źródło: "), x["source"], F.lit(")\n"), x["content"])))
    return rows.groupBy(by).agg(F.array_join(told, "\n\n").alias("context"), F.length(F.array_join(F.transform(ordered, lambda x: x["content"]), "\n\n")).alias("context_chars"))


def classified(answer: str, context_text: str, failed: Column | None = None) -> Column:
    """refused, error or answered, by the context and the model's text."""
    text = trim(answer)
    wrong = failed if failed is not None else F.lit(False)
    return F.when(F.coalesce(F.col(context_text), F.lit("")) == "", "refused").when(wrong | F.coalesce(text == "", F.lit(True)), "error").when(text.contains(NO_ANSWER), "refused").otherwise("answered")


def http_status(status: str = "status", source: str = "source") -> Column:
    limited = F.col(source).isin("rate_limit", "provider_rate_limit")
    return F.when((F.col(status) == "error") & limited, 429).when(F.col(status) == "error", 502).otherwise(200)


def prompt(question: str, context_text: str, language: str = "pl") -> Column:
    """The prompt of an answer: rules, sources, question under section marks that neutralised texts can't hold."""
    rules = F.lit(f"Answer in {language} from the sources below only. If they don't hold the answer, reply {NO_ANSWER}.")
    return F.concat_ws("\n", rules, F.lit("### SOURCES"), F.col(context_text), F.lit("### QUESTION"), neutralised(question), F.lit("### ANSWER"))


def refusal(messages: Column, language: str, default: str = "I can't answer that.") -> Column:
    """The message of the language, else the Polish one, else any (by name), else the default."""
    some = F.filter(F.map_values(messages), lambda v: trim(v) != "")
    pick = lambda name: F.when(trim(messages[name]) != "", messages[name])
    return F.coalesce(pick(language), pick("pl"), F.get(some, F.lit(0)), F.lit(default))
