"""Queries over the chunk table and the question log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import knowledge as K
from ..operators.machines import circuit_breaker as broken
from ..sources.chunk_table import ChunkTable
from ..sources.ordered_log import OrderedLog
from ..sources.shared import new_folder
from .bindings import KNOWLEDGE, LOG, NOW, knowledge, log, now, sql_trim, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _ids(spark, sf):
    return table(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("id"))


@query(f"WITH {KNOWLEDGE} SELECT id, post_id, len(embedding)::INTEGER AS dims, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x)), 6) AS total FROM knowledge WHERE embedding IS NOT NULL")
def embedded_scan(spark, sf):
    total = F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 6)
    return K.embedded(knowledge(spark, sf)).select("id", "post_id", F.size("embedding").alias("dims"), total.alias("total"))


@query(f"WITH {KNOWLEDGE} SELECT id, post_id, len(embedding)::INTEGER AS dims FROM knowledge WHERE embedding IS NOT NULL ORDER BY id LIMIT 200 OFFSET 100")
def embeddings_page(spark, sf):
    return K.embeddings_page(knowledge(spark, sf), 200, 100).select("id", "post_id", F.size("embedding").alias("dims"))


@query(f"WITH {KNOWLEDGE} SELECT id, post_id, chunk_index, content FROM knowledge WHERE id = 123")
def point_lookup(spark, sf):
    return K.find(knowledge(spark, sf), 123).select("id", "post_id", "chunk_index", "content")


@query(f"WITH {KNOWLEDGE} SELECT id, content FROM knowledge WHERE id % 50 = 0")
def contents_for(spark, sf):
    return K.contents_for(knowledge(spark, sf), _ids(spark, sf))


@query(f"WITH {KNOWLEDGE} SELECT post_id, chunk_index, content_hash FROM knowledge")
def hash_map(spark, sf):
    return K.hash_map(knowledge(spark, sf)).select("post_id", F.explode("hashes").alias("chunk_index", "content_hash"))


_NEW = "new AS (SELECT post_id, chunk_index, CASE WHEN post_id = 3 AND chunk_index = 0 THEN 'other' ELSE content_hash END AS content_hash FROM knowledge WHERE post_id <> 4)"


def _new(spark, sf):
    changed = F.when((F.col("post_id") == 3) & (F.col("chunk_index") == 0), "other").otherwise(F.col("content_hash"))
    return knowledge(spark, sf).where("post_id <> 4").withColumn("content_hash", changed)


_CHANGED = f"""WITH {KNOWLEDGE}, {_NEW}, j AS (SELECT coalesce(o.post_id, n.post_id) AS post_id, o.content_hash AS oh, n.content_hash AS nh FROM knowledge o FULL JOIN new n ON o.post_id = n.post_id AND o.chunk_index = n.chunk_index),
c AS (SELECT post_id, count(oh) AS old_chunks, count(nh) AS new_chunks, count(*) FILTER (oh IS DISTINCT FROM nh) AS differing FROM j GROUP BY post_id),
r AS (SELECT *, CASE WHEN new_chunks = 0 THEN 'cleared' WHEN differing = 0 THEN 'unchanged' ELSE 'indexed' END AS outcome FROM c) """


@query(_CHANGED + "SELECT * FROM r")
def change_detect(spark, sf):
    return K.changes(knowledge(spark, sf), _new(spark, sf))


@query(_CHANGED + """SELECT count(*) AS documents, count(*) FILTER (outcome = 'indexed') AS indexed, count(*) FILTER (outcome = 'unchanged') AS unchanged, count(*) FILTER (outcome = 'cleared') AS cleared,
sum(new_chunks)::BIGINT AS chunks, count(*) FILTER (new_chunks > 0) AS after, (SELECT count(DISTINCT post_id) FROM knowledge) AS before,
((SELECT count(DISTINCT post_id) FROM knowledge) - count(*) FILTER (new_chunks > 0))::DOUBLE / (SELECT count(DISTINCT post_id) FROM knowledge) >= 0.30::DOUBLE AS drop_alert FROM r""")
def index_report(spark, sf):
    old = knowledge(spark, sf)
    return K.index_report(K.changes(old, _new(spark, sf)), old)


@query(f"WITH {KNOWLEDGE}, k AS (SELECT post_id FROM knowledge WHERE post_id < 5), a AS (SELECT count(DISTINCT post_id) AS before FROM knowledge), b AS (SELECT count(DISTINCT post_id) AS after FROM k) SELECT before, after, before > 0 AND (before - after)::DOUBLE / before >= 0.30::DOUBLE AS alert FROM a, b")
def drop_alert(spark, sf):
    old = knowledge(spark, sf)
    report = K.index_report(K.changes(old, old.where("post_id < 5")), old)
    return report.select("before", "after", F.col("drop_alert").alias("alert"))


@query(f"WITH {KNOWLEDGE}, {_NEW} SELECT post_id, chunk_index, content_hash FROM knowledge WHERE post_id NOT IN (SELECT post_id FROM new WHERE post_id = 3) UNION ALL SELECT post_id, chunk_index, content_hash FROM new WHERE post_id = 3")
def replace_docs(spark, sf):
    columns = ["post_id", "chunk_index", "content_hash"]
    return K.replace_documents(knowledge(spark, sf).select(columns), _new(spark, sf).where("post_id = 3").select(columns))


@query(ORACLE["replace_docs"])
def replace_docs_table(spark, sf):
    """The same through a table on disk, of which only the buckets of replaced documents are written anew."""
    columns = ["post_id", "chunk_index", "content_hash"]
    old = knowledge(spark, sf).select(columns)
    chunks = ChunkTable(spark, new_folder(spark, "chunks"), old.schema, buckets=16)
    chunks.change(new=old)
    chunks.replace(_new(spark, sf).where("post_id = 3").select(columns))
    return chunks.read()


@query("""SELECT l_orderkey AS post_id, l_linenumber AS chunk_index, CASE WHEN o_orderpriority = '2-HIGH' THEN TIMESTAMP '2024-01-31 00:00:00' ELSE l_shipdate END AS updated_at,
CASE WHEN o_orderpriority = '1-URGENT' THEN l_quantity + 1 ELSE l_quantity END AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE o_orderstatus <> 'P' AND (o_orderpriority <> '1-URGENT' OR l_linenumber < 3)""")
def rewrite_chunks(spark, sf):
    """Line items as the chunks of their orders, in three changes: urgent orders' chunks are replaced by their first two with
    other contents, high ones are touched, and those of pending orders are deleted."""
    chunks = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("post_id"), F.col("l_linenumber").alias("chunk_index"), F.col("l_shipdate").alias("updated_at"), F.col("l_quantity").alias("quantity"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("post_id"), "o_orderpriority", "o_orderstatus")
    urgent, high, pending = orders.where("o_orderpriority = '1-URGENT'"), orders.where("o_orderpriority = '2-HIGH'"), orders.where("o_orderstatus = 'P'")
    kept = ChunkTable(spark, new_folder(spark, "chunks"), chunks.schema, buckets=16)
    kept.change(new=chunks)
    kept.change(new=chunks.where("chunk_index < 3").join(urgent.select("post_id"), "post_id", "left_semi").withColumn("quantity", F.col("quantity") + 1), replaced=urgent)
    kept.touch(high, {"updated_at": now()})
    kept.delete(pending)
    return kept.read()


@query(f"WITH {KNOWLEDGE} SELECT post_id, chunk_index, content, content_hash, len(embedding)::INTEGER AS dims FROM knowledge UNION ALL SELECT conv_id, turn::INTEGER, text, CASE WHEN turn = 1 THEN 'given' ELSE sha256({sql_trim('text')}) END, CASE WHEN turn % 2 = 0 THEN 2 END FROM conversations")
def insert_chunk(spark, sf):
    e = F.expr
    chunks = knowledge(spark, sf).select("post_id", "chunk_index", "content", "content_hash", "embedding")
    new = table(spark, sf, "conversations").select(F.col("conv_id").alias("post_id"), F.col("turn").cast("int").alias("chunk_index"), F.col("text").alias("content"), e("if(turn = 1, 'given', null)").alias("content_hash"), e("if(turn % 2 = 0, array(0.5f, 1f), cast(array() AS array<float>))").alias("embedding"))
    return K.inserted(chunks, new).select("post_id", "chunk_index", "content", "content_hash", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dims"))


@query(f"WITH {KNOWLEDGE} SELECT count(*) AS deleted, 0::BIGINT AS still FROM knowledge")
def clear_all(spark, sf):
    left, told = K.cleared(knowledge(spark, sf))
    return told.crossJoin(left.agg(F.count("*").alias("still")))


@query(f"WITH {KNOWLEDGE} SELECT id, post_id FROM knowledge WHERE post_id <> 3")
def delete_doc(spark, sf):
    return K.delete_document(knowledge(spark, sf), 3).select("id", "post_id")


@query(f"WITH {KNOWLEDGE} SELECT id, post_id FROM knowledge WHERE post_id IN (SELECT label FROM embeddings WHERE label % 2 = 0)")
def prune_orphans(spark, sf):
    keep = table(spark, sf, "embeddings").where("label % 2 = 0").select(F.col("label").alias("post_id"))
    return K.prune_orphans(knowledge(spark, sf), keep).select("id", "post_id")


@query(f"WITH {KNOWLEDGE} SELECT id, CASE WHEN post_id IN (SELECT label FROM embeddings WHERE label < 3) THEN TIMESTAMP '{NOW}' ELSE TIMESTAMP '2024-01-01 00:00:00' END AS updated_at FROM knowledge")
def touch(spark, sf):
    chunks = knowledge(spark, sf).withColumn("updated_at", F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")))
    return K.touch(chunks, table(spark, sf, "embeddings").where("label < 3").select(F.col("label").alias("post_id")), now()).select("id", "updated_at")


@query(f"WITH {KNOWLEDGE} SELECT count(*) AS chunks, count(DISTINCT post_id) AS documents, count(embedding) AS embedded, count(*) > 5000 AS large FROM knowledge")
def knowledge_stats(spark, sf):
    return K.stats(knowledge(spark, sf))


@query(f"WITH {KNOWLEDGE} SELECT post_id, count(*) AS chunks FROM knowledge GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6")
def top_docs(spark, sf):
    return K.top_documents(knowledge(spark, sf), 6)


@query(f"WITH {KNOWLEDGE}, t AS (SELECT post_id FROM knowledge GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 6) SELECT string_agg(trim(content), chr(10) || chr(10) ORDER BY post_id) AS sample FROM knowledge WHERE chunk_index = 0 AND post_id IN (SELECT post_id FROM t)")
def profile_sample(spark, sf):
    return K.profile_sample(knowledge(spark, sf))


@query("SELECT count(DISTINCT l_orderkey) AS stale FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate > l_shipdate")
def stale_count(spark, sf):
    chunks = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("post_id"), F.col("l_shipdate").alias("updated_at"))
    return K.stale_count(chunks, table(spark, sf, "orders").select(F.col("o_orderkey").alias("post_id"), F.col("o_orderdate").alias("post_modified")))


_SAVED = "CASE WHEN vec_id % 4 = 0 THEN 'p|m|64|src2|q:T' WHEN vec_id % 4 = 1 THEN 'partial:budget:p|m|64|src2|q:T' WHEN vec_id % 4 = 2 THEN 'partial:other:p|m|32|src2|q:T' ELSE '' END"


@query(f"""WITH s AS (SELECT vec_id, {_SAVED} AS saved, 'p|m|64|src2|q:T' AS current, CASE WHEN vec_id % 8 = 3 THEN 0 ELSE 1 END AS embedded FROM embeddings)
SELECT vec_id, CASE WHEN saved = current OR embedded = 0 THEN 'ok' WHEN saved LIKE 'partial:%' AND regexp_replace(saved, '^partial:[^:]*:', '') = current THEN 'partial' ELSE 'stale' END AS state,
CASE WHEN saved LIKE 'partial:%' AND split_part(saved, ':', 2) IN ('crawl', 'errors', 'budget') THEN split_part(saved, ':', 2) ELSE '' END AS reason FROM s""")
def index_state(spark, sf):
    signature = F.concat_ws("|", F.lit("p"), F.lit("m"), F.lit("64"), F.lit("src2"), F.lit("q:T"))
    rows = table(spark, sf, "embeddings").select("vec_id", F.expr(_SAVED).alias("saved"), signature.alias("current"), F.expr("CASE WHEN vec_id % 8 = 3 THEN 0 ELSE 1 END").alias("embedded"))
    return K.index_state(rows).select("vec_id", "state", "reason")


@query(f"WITH {LOG} SELECT status, count(*) AS n FROM log GROUP BY status")
def status_counts(spark, sf):
    return A.status_counts(log(spark, sf))


_BACK = "TIMESTAMP '2024-01-20 15:30:00'"


@query(f"""WITH {LOG} SELECT count(*) AS total, count(*) FILTER (created_at >= date_trunc('day', {_BACK})) AS today, count(*) FILTER (created_at >= {_BACK} - INTERVAL 7 DAY) AS week,
count(*) FILTER (status = 'answered') AS answered, count(*) FILTER (status = 'refused') AS refused, count(*) FILTER (status = 'error') AS error, count(*) FILTER (source = 'cache') AS cached,
coalesce(round(avg(score) FILTER (status = 'answered'), 3), 0) AS avg_score, count(*) > 50000 AS large FROM log""")
def qa_stats(spark, sf):
    return A.log_stats(log(spark, sf), F.to_timestamp_ntz(F.lit("2024-01-20 15:30:00")))


@query(f"WITH {LOG} SELECT id, created_at, status, source, score FROM log WHERE status = 'answered' ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 40")
def log_page(spark, sf):
    return A.page(log(spark, sf), 20, 40, "answered").select("id", "created_at", "status", "source", "score")


@query(ORACLE["log_page"])
def log_page_seek(spark, sf):
    """The same page, reached by going on after the marks of the two pages before it, over files in the order of pages."""
    kept = OrderedLog(spark, new_folder(spark, "log"))
    kept.append(log(spark, sf))
    mark = None
    for _ in range(2):
        mark = kept.mark(kept.page(20, mark, "answered"))
    return kept.page(20, mark, "answered").select("id", "created_at", "status", "source", "score")


_ROWS = """e AS (SELECT event_id AS id, user_id % 7 AS queue, ts AS t, CASE event_type WHEN 'purchase' THEN 'probe' WHEN 'click' THEN 'resume' ELSE 'fetch' END AS kind,
  CASE WHEN event_type = 'signup' THEN 'failed' WHEN event_type = 'error' OR value < 60 THEN 'timeout' ELSE 'ok' END AS outcome, event_id % 3 = 0 AS slow FROM events)"""
_STEP = """CASE WHEN kind = 'fetch' AND state < 3 AND outcome = 'ok' THEN 0 WHEN kind = 'fetch' AND state < 3 AND outcome = 'timeout' THEN state + 1 WHEN kind = 'probe' AND state = 3 THEN CASE WHEN outcome = 'ok' OR slow THEN 4 ELSE 5 END
  WHEN kind = 'resume' AND state > 3 THEN 0 ELSE state END"""


@query(f"""WITH RECURSIVE {_ROWS}, n AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY t, id) AS n FROM e),
r AS (SELECT id, queue, n, kind, 0 AS before, {_STEP.replace("state", "0")} AS state FROM n WHERE n = 1
  UNION ALL SELECT n.id, n.queue, n.n, n.kind, r.state, {_STEP.replace("kind", "n.kind").replace("state", "r.state")} FROM r JOIN n ON n.queue = r.queue AND n.n = r.n + 1)
SELECT id, CASE WHEN state < 3 THEN 'running' WHEN state = 3 THEN 'probing' ELSE 'paused' END AS status, least(state, 3)::INTEGER AS streak, CASE state WHEN 4 THEN 'concurrency' WHEN 5 THEN 'unreachable' ELSE '' END AS verdict,
  CASE kind WHEN 'fetch' THEN before < 3 WHEN 'probe' THEN before = 3 ELSE before > 3 END AS counted FROM r""")
def circuit_breaker(spark, sf):
    """Events as fetches, probes and resumes of seven queues."""
    e = F.expr
    rows = table(spark, sf, "events").select(
        F.col("event_id").alias("id"), e("user_id % 7").alias("queue"), F.col("ts").alias("at"), e("CASE event_type WHEN 'purchase' THEN 'probe' WHEN 'click' THEN 'resume' ELSE 'fetch' END").alias("kind"),
        e("CASE WHEN event_type = 'signup' THEN 'failed' WHEN event_type = 'error' OR value < 60 THEN 'timeout' ELSE 'ok' END").alias("outcome"), e("event_id % 3 = 0").alias("slow"),
    )
    return broken(rows).select("id", "status", "streak", "verdict", "counted")


@query("SELECT conv_id AS id, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * (conv_id % 17) AS created_at, text AS topic FROM conversations WHERE turn = 0 ORDER BY 2 DESC, 1 DESC LIMIT 20 OFFSET 20")
def gen_page(spark, sf):
    rows = table(spark, sf, "conversations").where("turn = 0")
    at = F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, cast(conv_id % 17 AS int))")
    return A.page(rows.select(F.col("conv_id").alias("id"), at.alias("created_at"), F.col("text").alias("topic")), 20, 20)


@query(f"WITH {LOG} SELECT count(*) AS total, ceil(count(*) / 25)::BIGINT AS pages, least(100000, ceil(count(*) / 25))::BIGINT AS page, 25 AS per_page FROM log")
def page_envelope(spark, sf):
    return A.page_envelope(log(spark, sf), 100_000, 25)


@query(f"WITH {LOG} SELECT id, created_at FROM log ORDER BY created_at DESC, id DESC LIMIT 10")
def recent(spark, sf):
    return A.page(log(spark, sf), 10, 0).select("id", "created_at")


@query(f"""WITH {LOG}, a AS (SELECT * FROM log WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL 20 DAY), b AS (SELECT min(id) AS low FROM (SELECT id FROM a ORDER BY id DESC LIMIT 5000))
SELECT id, created_at FROM a, b WHERE id >= low""")
def retention(spark, sf):
    return A.retained(log(spark, sf), now(), 20, 5000).select("id", "created_at")


@query("SELECT event_id AS id, CASE WHEN event_type IN ('answered', 'refused', 'error') THEN event_type ELSE 'answered' END AS status FROM events")
def log_normalise(spark, sf):
    return A.normalised_log(table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("status")))


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1")
def latency_pct(spark, sf):
    return A.nearest_rank(table(spark, sf, "events"), "value", [50, 95, 99], ["event_type"])


@query("SELECT ts AS created_at, props AS question, '' AS answer, 'answered' AS status, 'ai' AS source, 0.0::DOUBLE AS score, user_id, '' AS ip_hash FROM events")
def legacy_import(spark, sf):
    return A.import_legacy(table(spark, sf, "events").select(F.col("ts").alias("created_at"), F.col("props").alias("topic"), "user_id"))


@query("SELECT event_id, user_id, CASE WHEN user_id <= 0 THEN '' ELSE coalesce(c_name, user_id::VARCHAR) END AS user_label FROM events LEFT JOIN customer ON c_custkey = user_id")
def user_label(spark, sf):
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("display_name"))
    return A.user_labels(table(spark, sf, "events").select("event_id", "user_id"), users).select("event_id", "user_id", "user_label")


@query(f"WITH {LOG} SELECT created_at::DATE AS day, count(*) AS n, count(*) > 330 AS over FROM log GROUP BY 1")
def daily_usage(spark, sf):
    return A.daily_usage(log(spark, sf), 330)


@query(f"WITH {LOG} SELECT date_trunc('hour', created_at) AS hour, status, count(*) AS n FROM log GROUP BY 1, 2")
def hourly_window(spark, sf):
    return A.hourly_window(log(spark, sf))


@query("SELECT p_partkey, p_name AS name FROM part WHERE NOT (p_name LIKE 'Part 1%' OR p_name LIKE 'Part#00001%')")
def prefix_delete(spark, sf):
    return A.without_prefixes(table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name")), ["Part 1", "Part#00001"])
