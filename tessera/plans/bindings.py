"""The provided tables in the roles that the operators expect, for Spark and (as SQL text) for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

NOW = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now() -> F.Column:
    return F.to_timestamp_ntz(F.lit(NOW))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts; labels decide status and password."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    joined = docs.join(labels, "doc_id", "left")
    return joined.select(
        (F.col("doc_id") + 1).alias("post_id"), F.concat_ws("-", "lang", "source").alias("title"), F.concat(F.lit("/d/"), "doc_id").alias("url"), "text", "source", "lang",
        F.when(F.col("quality") == 0, "draft").otherwise("publish").alias("status"), F.when(F.col("toxic") == 1, "secret").otherwise("").alias("password"),
    )


POSTS = """posts AS (SELECT d.doc_id + 1 AS post_id, lang || '-' || source AS title, '/d/' || d.doc_id AS url, text, source, lang,
  CASE WHEN quality = 0 THEN 'draft' ELSE 'publish' END AS status, CASE WHEN toxic = 1 THEN 'secret' ELSE '' END AS password
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as metadata: the role is the key."""
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") + 1).alias("post_id"), F.col("role").alias("key"), F.col("turn").alias("pos"), F.col("text").alias("value"))


META = "meta AS (SELECT conv_id + 1 AS post_id, role AS key, turn AS pos, text AS value FROM conversations)"


def knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as embedded chunks of ten documents."""
    v = table(spark, sf_dir, "embeddings")
    at = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    content = F.concat(F.lit(" chunk "), "vec_id")
    return v.select(F.col("vec_id").alias("id"), F.col("label").alias("post_id"), at.alias("chunk_index"), content.alias("content"), F.sha2(F.btrim(content), 256).alias("content_hash"), F.when(F.col("vec_id") % 7 != 0, F.col("embedding")).alias("embedding"))


KNOWLEDGE = """knowledge AS (SELECT vec_id AS id, label AS post_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INTEGER AS chunk_index,
  ' chunk ' || vec_id AS content, sha256('chunk ' || vec_id) AS content_hash, CASE WHEN vec_id % 7 <> 0 THEN embedding END AS embedding FROM embeddings)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the question log."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "refused").otherwise("answered")
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("props").alias("question"), status.alias("status"),
        F.when(F.col("event_type") == "click", "cache").otherwise("ai").alias("source"), (F.col("value") / 500).alias("score"), "user_id", F.sha2(F.col("user_id").cast("string"), 256).alias("ip_hash"),
    )


LOG = """log AS (SELECT event_id AS id, ts AS created_at, props AS question,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'refused' ELSE 'answered' END AS status,
  CASE WHEN event_type = 'click' THEN 'cache' ELSE 'ai' END AS source, value / 500 AS score, user_id, sha256(user_id::VARCHAR) AS ip_hash FROM events)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's turn and the assistant's next one as question and answer."""
    c = table(spark, sf_dir, "conversations")
    q = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return q.join(a, ["conv_id", "turn"])


PAIRS = """pairs AS (SELECT q.conv_id, q.turn, q.text AS question, a.text AS answer FROM conversations q JOIN conversations a
  ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant')"""

#: SQL pieces: trimming of the six characters (none of the tables has a NUL), Unicode white space.
BLANKS = "(' ' || chr(9) || chr(10) || chr(13) || chr(11))"
SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def sql_trim(value: str) -> str:
    return f"trim({value}, {BLANKS})"
