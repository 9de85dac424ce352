"""Queries from a question to its answer, and those about question and answer pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import providers as P
from ..functions import text as X
from ..functions import vectors as V
from ..operators import admission as M
from ..operators import faq as Q
from ..operators import retrieval as R
from ..sources.answer_cache import AnswerCache
from ..sources.shared import new_folder, written
from .bindings import KNOWLEDGE, LOG, PAIRS, POSTS, SPACE, knowledge, log, pairs, posts, sql_trim, table
from .ingest import unescaped_sql, without_elements_sql

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


@query(f"SELECT e.vec_id AS id, e.label::BIGINT AS post_id, round({_COS}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.vec_id <> 0 ORDER BY {_COS} DESC, 1 LIMIT 5")
def cosine_topk(spark, sf):
    v = table(spark, sf, "embeddings")
    rows = v.where("vec_id <> 0").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("post_id"), "embedding")
    return R.top_k(rows, v.where("vec_id = 0").select("embedding").scalar(), 5).withColumn("score", F.round("score", 6))


_BATCH = f"h AS (SELECT q.vec_id AS query_id, e.vec_id AS id, e.label::BIGINT AS post_id, {_COS} AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id QUALIFY rank <= 5)"


def hits(spark, sf):
    v = table(spark, sf, "embeddings")
    rows = v.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("post_id"), "embedding")
    return R.top_k_batch(rows, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5)


@query(f"WITH {_BATCH} SELECT query_id, id, post_id, round(s, 6) AS score, rank::INTEGER AS rank FROM h")
def cosine_topk_batch(spark, sf):
    return hits(spark, sf).withColumn("score", F.round("score", 6))


_GUARD = f"""{_BATCH}, g AS (SELECT query_id, max(s) AS score, coalesce(string_agg(id::VARCHAR, ',' ORDER BY rank) FILTER (s >= 0.35), '') AS ids FROM h GROUP BY 1),
d AS (SELECT query_id, CASE WHEN score >= 0.35 THEN 'pass' ELSE 'refuse' END AS decision, round(score, 6) AS score, CASE WHEN score < 0.35 THEN 'none' WHEN score >= 0.4 THEN 'full' ELSE 'weak' END AS coverage, ids FROM g)"""


def guarded(spark, sf):
    return R.guard(hits(spark, sf), 0.4, 0.35, floor=0.0)


@query(f"WITH {_GUARD} SELECT * FROM d")
def topic_guard(spark, sf):
    return guarded(spark, sf).withColumns({"score": F.round("score", 6), "ids": F.array_join("ids", ",")})


_CONTEXT = f"""{_BATCH}, {KNOWLEDGE}, {POSTS}, x AS (SELECT query_id, rank, {sql_trim('content')} AS content, title || ' — ' || p.url AS source FROM h JOIN knowledge k ON k.id = h.id JOIN posts p ON p.post_id = h.post_id + 1),
c AS (SELECT query_id, string_agg('[' || rank || '] (Źródło: ' || source || ')' || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS context, (sum(length(content)) + 2 * (count(*) - 1))::INTEGER AS context_chars FROM x GROUP BY 1)"""


def contexts(spark, sf):
    chunks = knowledge(spark, sf).withColumn("post_id", F.col("post_id") + 1)
    return R.context(hits(spark, sf).select("query_id", "id", "rank"), chunks, posts(spark, sf))


@query(f"WITH {_CONTEXT} SELECT * FROM c")
def context_format(spark, sf):
    return contexts(spark, sf)


@query(f"WITH {_CONTEXT} SELECT query_id, concat_ws(chr(10), 'Answer in pl from the sources below only. If they don''t hold the answer, reply __NO_ANSWER__.', '### SOURCES', context, '### QUESTION', 'Question ' || query_id, '### ANSWER') AS prompt FROM c")
def build_prompt(spark, sf):
    rows = contexts(spark, sf).withColumn("question", F.concat(F.lit("Question "), "query_id"))
    return rows.select("query_id", R.prompt("question", "context").alias("prompt"))


_CACHED = "query_id % 200 = 0"


@query(f"""WITH {_GUARD} SELECT query_id, CASE WHEN {_CACHED} THEN 'answered' WHEN decision = 'refuse' THEN 'refused' ELSE 'answered' END AS status, CASE WHEN {_CACHED} THEN 'cache' ELSE 'ai' END AS source, CASE WHEN {_CACHED} THEN 1.0 ELSE score END::DOUBLE AS score, CASE WHEN {_CACHED} THEN '' ELSE coverage END AS coverage, 200 AS http FROM d""")
def ask_batch(spark, sf):
    """Cached questions first; the others go to search, guard, context, answer and classification."""
    v = table(spark, sf, "embeddings")
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.concat(F.lit("Question "), "vec_id").alias("question"), "embedding")
    cache = M.cache_upsert(asked.where(_CACHED).select(F.col("query_id").alias("id"), F.upper("question").alias("question"), F.lit("known").alias("answer"), F.lit(1.0).alias("score"), F.lit(0).alias("created_at"), F.lit("answered").alias("status")))
    probed = written(M.cache_probe(asked, cache), "probed")  # searched and joined
    rows = v.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("post_id"), "embedding")
    found = R.top_k_batch(rows, probed.where("NOT hit").select("query_id", "embedding"), 5)
    decided = written(R.guard(found, 0.4, 0.35, floor=0.0), "decided")  # for contexts and for statuses
    used = decided.select("query_id", F.posexplode("ids").alias("rank", "id"))
    told = R.context(used, knowledge(spark, sf), posts(spark, sf)).withColumn("question", F.lit(""))
    replies = P.generated(told.select("query_id", "context", R.prompt("question", "context").alias("prompt")), "prompt", P.Offline())
    answered = replies.select("query_id", R.classified("reply", "context").alias("answer_status"))
    all_ = probed.join(decided, "query_id", "left").join(answered, "query_id", "left")
    status = F.when(F.col("hit"), "answered").when(F.coalesce("decision", F.lit("refuse")) == "refuse", "refused").otherwise(F.coalesce("answer_status", F.lit("refused")))
    out = all_.select("query_id", status.alias("status"), F.when(F.col("hit"), "cache").otherwise("ai").alias("source"), F.when(F.col("hit"), 1.0).otherwise(F.round(F.coalesce("score", F.lit(0.0)), 6)).alias("score"), F.when(F.col("hit"), "").otherwise(F.coalesce("coverage", F.lit("none"))).alias("coverage"))
    return out.withColumn("http", R.http_status())


@query(f"SELECT conv_id, turn, sha256({sql_trim(f"regexp_replace(lower(text), '{SPACE}+', ' ', 'g')")}) AS question_hash FROM conversations")
def question_hash(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.question_hash("text").alias("question_hash"))


@query(f"SELECT conv_id, turn, substr({sql_trim("regexp_replace(text, '<[^>]*>', '', 'g')")}, 1, 2000) AS question, CASE WHEN length(text) > 2000 THEN 'long' WHEN {sql_trim('text')} = '' THEN 'empty' ELSE 'ok' END AS verdict FROM conversations")
def sanitize_question(spark, sf):
    verdict = F.when(F.length("text") > 2000, "long").when(X.trim("text") == "", "empty").otherwise("ok")
    return table(spark, sf, "conversations").select("conv_id", "turn", X.clip(X.trim(F.regexp_replace("text", "<[^>]*>", "")), 2000).alias("question"), verdict.alias("verdict"))


_WRITES = f"{LOG}, w AS (SELECT *, sha256({sql_trim(f"regexp_replace(lower(question), '{SPACE}+', ' ', 'g')")}) AS question_hash FROM log WHERE status = 'answered')"


@query(f"WITH {_WRITES} SELECT question_hash, arg_min(id, (created_at, id)) AS id, arg_min(question, (created_at, id)) AS question, arg_max(answer, (created_at, id)) AS answer, arg_max(score, (created_at, id)) AS score, max(created_at) AS created_at FROM (SELECT *, 'answer ' || id AS answer FROM w) GROUP BY 1")
def cache_upsert(spark, sf):
    return M.cache_upsert(log(spark, sf).withColumn("answer", F.concat(F.lit("answer "), "id")))


@query(f"WITH {PAIRS}, k AS (SELECT *, {sql_trim(f"regexp_replace(lower(question), '{SPACE}+', ' ', 'g')")} AS h FROM pairs) SELECT conv_id, turn, true AS hit, last_value(answer) OVER (PARTITION BY h ORDER BY conv_id, turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS cached_answer FROM k UNION ALL SELECT conv_id, turn, false, NULL FROM pairs")
def cache_probe(spark, sf):
    known = pairs(spark, sf)
    writes = known.select(F.expr("conv_id * 1000 + turn").alias("id"), "question", "answer", F.lit(1.0).alias("score"), F.lit(0).alias("created_at"), F.lit("answered").alias("status"))
    asked = known.select("conv_id", "turn", F.concat(F.lit("  "), F.replace("question", F.lit(" "), F.lit(" \t ")), F.lit("\n")).alias("question")).unionByName(known.select("conv_id", "turn", F.concat("question", F.lit(" really?")).alias("question")))
    return M.cache_probe(asked, M.cache_upsert(writes)).select("conv_id", "turn", "hit", "cached_answer")


@query(f"WITH {LOG} SELECT id, row_number() OVER (PARTITION BY CASE WHEN user_id % 10 > 0 THEN ip_hash END, created_at::DATE ORDER BY created_at, id) <= 3 AS admitted FROM log")
def rate_limit(spark, sf):
    """A tenth of the addresses is unknown: null is an address like others."""
    rows = log(spark, sf).withColumn("ip_hash", F.when(F.col("user_id") % 10 > 0, F.col("ip_hash")))
    return M.rate_limited(rows, 3, "day").select("id", "admitted")


@query(f"WITH {LOG}, c AS (SELECT id, count(*) FILTER (status <> 'error') OVER (PARTITION BY ip_hash, created_at::DATE ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - (status <> 'error')::INT AS used FROM log) SELECT id, used < 2 AS admitted FROM c")
def rate_limit_refund(spark, sf):
    """Requests whose provider call failed are refunded."""
    rows = log(spark, sf).withColumn("failed", F.col("status") == "error")
    return M.rate_limited(rows, 2, "day", "failed").select("id", "admitted")


@query(f"WITH {LOG} SELECT id, created_at FROM log QUALIFY row_number() OVER (PARTITION BY created_at::DATE ORDER BY created_at, id) <= 12")
def daily_budget(spark, sf):
    return M.within_budget(log(spark, sf), 12).select("id", "created_at")


@query(f"WITH {LOG}, l AS (SELECT id, created_at, max(CASE WHEN status = 'refused' THEN created_at END) OVER (PARTITION BY question ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM log) SELECT id, coalesce(created_at < last + INTERVAL 3600 SECOND, false) AS cached_refusal FROM l")
def refusal_cache(spark, sf):
    rows = log(spark, sf).select("id", F.col("question").alias("question_hash"), "created_at", (F.col("status") == "refused").alias("refused"))
    return M.recently_refused(rows).select("id", "cached_refusal")


@query(f"""WITH RECURSIVE {LOG}, s AS (SELECT id, ip_hash, status, created_at, row_number() OVER (PARTITION BY ip_hash, status ORDER BY created_at, id) AS n FROM log),
r AS (SELECT id, ip_hash, status, n, created_at AS mark, true AS written FROM s WHERE n = 1 UNION ALL
  SELECT s.id, s.ip_hash, s.status, s.n, CASE WHEN s.created_at >= r.mark + INTERVAL 86400 SECOND THEN s.created_at ELSE r.mark END, s.created_at >= r.mark + INTERVAL 86400 SECOND FROM r JOIN s ON s.ip_hash = r.ip_hash AND s.status = r.status AND s.n = r.n + 1)
SELECT id, written FROM r""")
def log_once(spark, sf):
    return M.log_once(log(spark, sf).withColumnRenamed("status", "bucket"), 86_400).select("id", "written")


_CALLS = "k AS (SELECT id, created_at AS t, user_id % 5 AS pool, source AS model, status = 'error' AS refused, CASE WHEN id % 4 = 0 THEN 3600 ELSE 60 END AS lasts FROM log)"


@query(f"""WITH RECURSIVE {LOG}, {_CALLS}, n AS (SELECT *, row_number() OVER (PARTITION BY pool, model ORDER BY t, id) AS n FROM k),
r AS (SELECT id, pool, model, n, false AS skipped, CASE WHEN refused THEN t + lasts * INTERVAL 1 SECOND END AS until FROM n WHERE n = 1
  UNION ALL SELECT n.id, n.pool, n.model, n.n, coalesce(n.t < r.until, false), CASE WHEN n.refused AND coalesce(n.t >= r.until, true) THEN n.t + n.lasts * INTERVAL 1 SECOND ELSE r.until END FROM r JOIN n ON n.pool = r.pool AND n.model = r.model AND n.n = r.n + 1)
SELECT id, skipped FROM r""")
def cooldown(spark, sf):
    """The log as calls of ten models: a refused one starts a cooldown, a quarter of them for a day's quota."""
    scope = F.when(F.col("id") % 4 == 0, "day").otherwise("minute")
    calls = log(spark, sf).select("id", F.col("created_at").alias("at"), (F.col("user_id") % 5).alias("pool"), F.col("source").alias("model"), (F.col("status") == "error").alias("refused"), scope.alias("scope"))
    return M.cooled_down(calls).select("id", "skipped")


@query(ORACLE["cache_upsert"])
def cache_batches(spark, sf):
    """The same cache, kept up on disk by three batches in no order of time."""
    writes = log(spark, sf).withColumn("answer", F.concat(F.lit("answer "), "id"))
    kept = AnswerCache(spark, new_folder(spark, "cache"), 16)
    for number, part in enumerate((2, 0, 1)):
        kept.write(writes.where(F.col("id") % 3 == part), "s", number)
    return kept.read("s").select("question_hash", "id", "question", "answer", "score", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


@query(f"WITH {LOG}, f AS (SELECT id, CASE WHEN user_id % 10 > 0 THEN user_id END AS queue, created_at AS t, CASE status WHEN 'error' THEN 'timeout' WHEN 'refused' THEN 'failed' ELSE 'ok' END AS outcome FROM log), i AS (SELECT *, sum((outcome = 'ok')::INT) OVER (PARTITION BY queue ORDER BY t, id) AS island FROM f), s AS (SELECT id, sum((outcome = 'timeout')::INT) OVER (PARTITION BY queue, island ORDER BY t, id)::BIGINT AS streak FROM i) SELECT id, streak, streak >= 3 AS pause FROM s")
def timeout_streak(spark, sf):
    outcome = F.when(F.col("status") == "error", "timeout").when(F.col("status") == "refused", "failed").otherwise("ok")
    queue = F.when(F.col("user_id") % 10 > 0, F.col("user_id"))  # null is a queue like others
    rows = log(spark, sf).select("id", queue.alias("queue"), F.col("created_at").alias("at"), outcome.alias("outcome"))
    return M.timeout_streaks(rows, F.date_trunc("day", "at")).select("id", "streak", "pause")


@query("SELECT event_id, sha256('salt|' || CASE event_id % 4 WHEN 1 THEN '198.51.100.' || user_id % 250 WHEN 2 THEN '2001:db8::' || event_id % 9999 ELSE '10.0.' || user_id % 250 || '.' || event_id % 250 END) AS guest FROM events")
def guest_hash(spark, sf):
    e = F.expr
    hashed = M.guest("salt", e("concat('10.0.', user_id % 250, '.', event_id % 250)"), e("CASE event_id % 4 WHEN 1 THEN concat('192.0.2.', event_id % 250, ', 198.51.100.', user_id % 250) WHEN 2 THEN '192.0.2.1' WHEN 3 THEN concat(event_type, ', ', props) ELSE concat('192.0.2.', user_id % 250) END"), e("CASE event_id % 4 WHEN 2 THEN concat('2001:db8::', event_id % 9999) WHEN 3 THEN event_type END"), e("event_id % 4 <> 0"))
    return table(spark, sf, "events").select("event_id", hashed.alias("guest"))


@query("SELECT vec_id, label FROM embeddings WHERE label = 3")
def cache_invalidate(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "label", F.col("label").cast("string").alias("snapshot"))
    return M.invalidated(rows, "3").select("vec_id", "label")


_REPLY = "CASE turn % 5 WHEN 0 THEN '  ' WHEN 1 THEN ' __NO_ANSWER__ sorry' WHEN 2 THEN text || ' __NO_ANSWER__' ELSE text END"


@query(f"SELECT conv_id, turn, CASE WHEN conv_id % 9 = 0 THEN 'refused' WHEN turn % 5 = 0 THEN 'error' WHEN turn % 5 IN (1, 2) THEN 'refused' ELSE 'answered' END AS status FROM conversations")
def answer_classify(spark, sf):
    rows = table(spark, sf, "conversations").withColumns({"reply": F.expr(_REPLY), "context": F.expr("CASE WHEN conv_id % 9 = 0 THEN '' ELSE 'x' END")})
    return rows.select("conv_id", "turn", R.classified("reply", "context").alias("status"))


@query("SELECT event_id, CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 429 WHEN event_type = 'error' THEN 502 ELSE 200 END AS http FROM events")
def ask_http(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.col("event_type").alias("status"), F.expr("CASE WHEN event_id % 2 = 0 THEN 'rate_limit' ELSE 'ai' END").alias("source"))
    return rows.select("event_id", R.http_status().alias("http"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN text WHEN conv_id % 3 = 1 THEN role || ' pl ' || conv_id WHEN conv_id % 3 = 2 THEN 'de ' || text ELSE 'I can''t answer that.' END AS message FROM conversations")
def refusal_msg(spark, sf):
    messages = F.expr("map('en', if(turn % 2 = 1, text, ' \t'), 'pl', if(conv_id % 3 = 1, concat(role, ' pl ', conv_id), ''), 'de', if(conv_id % 3 = 2, concat('de ', text), ' '))")
    return table(spark, sf, "conversations").select("conv_id", "turn", R.refusal(messages, "en").alias("message"))


@query(f"WITH {_GUARD} SELECT query_id, printf('stage=guard cov=%s best=%.4f hard=%.4f soft=%.4f topk=5 used=%d', coverage, score, 0.35::DOUBLE, 0.4::DOUBLE, CASE WHEN ids = '' THEN 0 ELSE len(string_split(ids, ',')) END) AS line FROM d")
def debug_line(spark, sf):
    rows = guarded(spark, sf)
    # format_number rounds the double itself, as C does; %.4f its shortest decimal form, which may be a tie
    best = F.expr("format_number(round(score, 6), '0.0000')")
    line = F.format_string("stage=guard cov=%s best=%s hard=%.4f soft=%.4f topk=5 used=%d", "coverage", best, F.lit(0.35), F.lit(0.4), F.size("ids"))
    return rows.select("query_id", line.alias("line"))


_STRUCTURED = "concat(repeat('#', turn % 4), ' head\n', repeat('=', conv_id % 6), '\n[', turn, if(conv_id % 2 = 0, '] (Źródło: x) ', ']  (ŹRÓDŁO : x) '), repeat('__NO_ANS', conv_id % 15), '__NO_ANSWER__', repeat('WER__', conv_id % 15), text)"


@query("SELECT conv_id, turn, CASE WHEN turn % 4 >= 2 THEN '# # #' ELSE repeat('#', turn % 4) END || ' head' || chr(10) || CASE WHEN conv_id % 6 >= 3 THEN '- - -' ELSE repeat('=', conv_id % 6) END || chr(10) || '[ ' || turn || ' ] ( Źródło : x) ' || regexp_replace(text, '[#＃]{2,}', '# # #', 'g') AS text FROM conversations")
def neutralize(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.neutralised(F.expr(_STRUCTURED)).alias("text"))


@query(f"SELECT conv_id, turn, CASE WHEN length(text) > 90 THEN {sql_trim(f"regexp_replace(substr(text, 1, 90), '{SPACE}+\\S*\\n?$', '')")} ELSE text END AS topic FROM conversations")
def clamp_topic(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.clamp_words("text").alias("topic"))


_EDGES = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || '\"''`.:'"


@query(f"WITH t AS (SELECT conv_id, turn, {sql_trim(f"regexp_replace(trim(string_split({sql_trim('text')}, chr(10))[1], {_EDGES}), '{SPACE}+', ' ', 'g')")} AS t FROM conversations) SELECT conv_id, turn, CASE WHEN t = '' OR lower(t) IN ('nieznany', 'unknown') OR length(t) > 90 OR contains(t, '<') THEN '' ELSE t END AS topic FROM t")
def sanitize_topic(spark, sf):
    from ..functions.profile import sanitised_topic

    return table(spark, sf, "conversations").select("conv_id", "turn", sanitised_topic("text").alias("topic"))


@query(f"WITH t AS (SELECT conv_id, turn, {sql_trim('text')} AS t FROM conversations) SELECT conv_id, turn, CASE WHEN turn = 1 AND conv_id % 4 < 3 THEN '' WHEN length(t) > 90 THEN {sql_trim(f"regexp_replace(substr(t, 1, 90), '{SPACE}+\\S*\\n?$', '')")} ELSE t END AS tagline FROM t")
def tagline(spark, sf):
    from ..functions.profile import tagline as told

    junk = "CASE conv_id % 4 WHEN 0 THEN ' Just  another WordPress site! ' WHEN 1 THEN 'Kolejna witryna oparta na WordPressie...' WHEN 2 THEN '«Another» WordPress\tsite' ELSE text END"
    return table(spark, sf, "conversations").select("conv_id", "turn", told(F.expr(f"if(turn = 1, {junk}, text)")).alias("tagline"))


@query(f"WITH {PAIRS}, d AS (SELECT *, row_number() OVER (PARTITION BY conv_id, lower({sql_trim('question')}) ORDER BY turn) AS n FROM pairs) SELECT conv_id, turn, question, answer FROM d WHERE n = 1 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 50")
def pair_dedup(spark, sf):
    return Q.deduped(pairs(spark, sf), ["conv_id"], "turn").select("conv_id", "turn", "question", "answer")


def pair_lists(spark, sf):
    """Each conversation's pairs as an array; a conversation bounds it."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "question", "answer")))
    return pairs(spark, sf).groupBy("conv_id").agg(F.transform(ordered, lambda p: F.struct(p["question"].alias("question"), p["answer"].alias("answer"))).alias("pairs"))


_NORMAL = f"n AS (SELECT conv_id, turn, substr({sql_trim('question')}, 1, 400) AS question, substr({sql_trim('answer')}, 1, 4000) AS answer FROM pairs), m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM n WHERE question <> '' AND answer <> '')"


@query(f"WITH {PAIRS}, {_NORMAL} SELECT conv_id, (i - 1)::INTEGER AS place, question, answer FROM m WHERE i <= 50")
def pair_normalise(spark, sf):
    return pair_lists(spark, sf).select("conv_id", F.posexplode(Q.normalised_pairs("pairs")).alias("place", "p")).select("conv_id", "place", "p.question", "p.answer")


def replies(spark, sf):
    """Pairs as a model would give them: bare, fenced, wrapped, or with talk around them."""
    body = F.to_json("pairs")
    kind = F.pmod("conv_id", F.lit(4))
    text = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```"))).when(kind == 2, F.concat(F.lit('{"note": [1], "faqs": '), body, F.lit("}"))).otherwise(F.concat(F.lit("Sure! "), body, F.lit(" Bye.")))
    return pair_lists(spark, sf).select("conv_id", text.alias("reply"))


_DUMPED = """'{"question": ' || to_json(question)::VARCHAR || ', "answer": ' || to_json(answer)::VARCHAR || '}'"""


@query(f"""WITH {PAIRS}, j AS (SELECT conv_id, '[' || string_agg({_DUMPED}, ', ' ORDER BY turn) || ']' AS list FROM pairs GROUP BY conv_id)
SELECT conv_id, CASE WHEN conv_id % 4 = 2 THEN '{{"note": [1], "faqs": ' || list || '}}' ELSE list END AS json FROM j""")
def json_repair(spark, sf):
    return replies(spark, sf).select("conv_id", Q.json_repaired("reply").alias("json"))


_PARSED = f"WITH {PAIRS}, d AS (SELECT conv_id, turn, {sql_trim('question')} AS question, {sql_trim('answer')} AS answer, row_number() OVER (PARTITION BY conv_id, lower({sql_trim('question')}) ORDER BY turn) AS n FROM pairs WHERE {sql_trim('question')} <> '' AND {sql_trim('answer')} <> '') SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS place, question, answer FROM d WHERE n = 1"


@query(_PARSED)
def pair_parse(spark, sf):
    return replies(spark, sf).select("conv_id", F.posexplode(Q.pairs_of("reply")).alias("place", "p")).select("conv_id", "place", "p.question", "p.answer")


@query(_PARSED)
def pair_parse_native(spark, sf):
    found = Q.with_pairs(replies(spark, sf), "reply")
    return found.select("conv_id", F.posexplode("pairs").alias("place", "p")).select("conv_id", "place", "p.question", "p.answer")


@query(f"WITH {PAIRS}, d AS (SELECT DISTINCT conv_id, lower({sql_trim('question')}) AS q FROM pairs WHERE {sql_trim('question')} <> '' AND {sql_trim('answer')} <> '') SELECT conv_id, (SELECT count(*) FROM d WHERE d.conv_id = p.conv_id)::INTEGER AS found FROM (SELECT DISTINCT conv_id FROM pairs) p")
def pair_extract(spark, sf):
    return replies(spark, sf).select("conv_id", F.size(Q.pairs_of("reply")).alias("found"))


def _escaped(value: str) -> str:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#039;")):
        value = f"replace({value}, '{plain}', '{entity}')"
    return value


_HTML = f"""'<div class="faq">' || chr(10) || string_agg('  <details class="faq__item">' || chr(10) || '    <summary class="faq__q">' || {_escaped('question')} || '</summary>' || chr(10) || '    <div class="faq__a">' || {_escaped('answer')} || '</div>' || chr(10) || '  </details>', chr(10) ORDER BY turn) || chr(10) || '</div>'"""


@query(f"WITH {PAIRS} SELECT conv_id, {_HTML} AS html FROM pairs GROUP BY conv_id")
def export_html(spark, sf):
    return pair_lists(spark, sf).select("conv_id", Q.as_html("pairs").alias("html"))


_BLOCKS = f"""string_agg('<!-- wp:heading {{"level":3}} -->' || chr(10) || '<h3>' || {_escaped('question')} || '</h3>' || chr(10) || '<!-- /wp:heading -->' || chr(10) || chr(10) || '<!-- wp:paragraph -->' || chr(10) || '<p>' || {_escaped('answer')} || '</p>' || chr(10) || '<!-- /wp:paragraph -->', chr(10) || chr(10) ORDER BY turn)"""


@query(f"WITH {PAIRS} SELECT conv_id, {_BLOCKS} AS blocks FROM pairs GROUP BY conv_id")
def export_gutenberg(spark, sf):
    return pair_lists(spark, sf).select("conv_id", Q.as_gutenberg("pairs").alias("blocks"))


def _harmless(value: str) -> str:
    return f"replace(replace(replace({value}, '<', '\\u003C'), '>', '\\u003E'), '&', '\\u0026')"


_ID = "substr(md5('faq-{}'), 1, 7)"
_JSON = _harmless("""'[ ' || string_agg('{' || chr(10) || '  "question" : ' || to_json(question)::VARCHAR || ',' || chr(10) || '  "answer" : ' || to_json(answer)::VARCHAR || chr(10) || '}', ', ' ORDER BY turn) || ' ]'""")
_ENTITY = "{'@type': 'Question', 'name': question, 'acceptedAnswer': {'@type': 'Answer', 'text': answer}}"
_PUBLISHED = _harmless(f"to_json({{'@context': 'https://schema.org', '@type': 'FAQPage', '@id': 'https://example.org/' || conv_id || '#faq', 'inLanguage': 'pl', 'mainEntity': list({_ENTITY} ORDER BY turn)}})::VARCHAR")
_LINKED = _harmless(f"to_json({{'@context': 'https://schema.org', '@type': 'FAQPage', 'mainEntity': list({_ENTITY} ORDER BY turn)}})::VARCHAR")
_TABS = "list({'tab_title': question, 'tab_content': answer, '_id': substr(md5('faq-' || (k + 2)), 1, 7)} ORDER BY turn)"
_WIDGET = f"{{'id': {_ID.format(2)}, 'elType': 'widget', 'widgetType': 'accordion', 'settings': {{'tabs': {_TABS}}}}}"
_INNER = f"{{'id': {_ID.format(1)}, 'elType': 'column', 'settings': {{'_column_size': 100}}, 'elements': [{_WIDGET}]}}"
_TEMPLATE = _harmless(f"to_json({{'version': '0.4', 'title': 'FAQ', 'type': 'page', 'content': [{{'id': {_ID.format(0)}, 'elType': 'section', 'elements': [{_INNER}]}}]}})::VARCHAR")
_NUMBERED = f"{PAIRS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM pairs)"


@query(f"WITH {PAIRS} SELECT conv_id, {_JSON} AS json FROM pairs GROUP BY conv_id")
def export_json(spark, sf):
    return pair_lists(spark, sf).select("conv_id", Q.as_json("pairs").alias("json"))


@query(f"WITH {_NUMBERED} SELECT conv_id, {_TEMPLATE} AS json FROM numbered GROUP BY conv_id")
def export_elementor(spark, sf):
    return pair_lists(spark, sf).select("conv_id", Q.as_elementor("pairs").alias("json"))


@query(f"WITH {PAIRS} SELECT conv_id, {_PUBLISHED} AS json FROM pairs GROUP BY conv_id")
def export_jsonld(spark, sf):
    return pair_lists(spark, sf).select("conv_id", Q.as_jsonld("pairs", F.concat(F.lit("https://example.org/"), "conv_id"), F.lit("pl")).alias("json"))


@query(f"WITH {_NUMBERED} SELECT conv_id, {_HTML} AS html, {_BLOCKS} AS gutenberg, {_TEMPLATE} AS elementor, {_JSON} AS json, {_LINKED} AS jsonld FROM numbered GROUP BY conv_id")
def export_all(spark, sf):
    return Q.exports(pair_lists(spark, sf)).drop("pairs")


@query("SELECT page_id, to_json({'@context': 'https://schema.org', '@type': 'WebApplication', 'name': 'FAQ', 'url': url, 'inLanguage': 'pl'})::VARCHAR AS json FROM pages")
def page_schema(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.lit("FAQ").alias("name"), "url", F.lit("").alias("description"), F.lit("pl").alias("language"))
    return rows.select("page_id", Q.page_schema("name", "url", "description", "language").alias("json"))


@query(f"WITH {PAIRS} SELECT conv_id, string_agg(question || chr(10) || answer, chr(10) || chr(10) ORDER BY turn) AS text FROM pairs GROUP BY conv_id")
def pairs_text(spark, sf):
    return pair_lists(spark, sf).select("conv_id", Q.as_text("pairs").alias("text"))


_PARAMS = "SELECT event_id, substr(props, 1, 500) AS topic, event_type AS description, CASE WHEN (value / 20)::BIGINT - 3 <= 0 THEN 8 ELSE greatest(5, least(20, (value / 20)::BIGINT - 3)) END::BIGINT AS count, CASE event_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE 'pl' END AS language FROM events"


@query(_PARAMS)
def gen_params(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.col("props").alias("topic"), F.col("event_type").alias("description"), (F.rint(F.col("value") / 20).cast("long") - 3).alias("count"), F.expr("CASE event_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' END").alias("language"))
    return Q.generator_params(rows)


@query("SELECT vec_id, len(embedding)::INTEGER AS dims, true AS same FROM embeddings")
def embedding_codec(spark, sf):
    back = V.decoded(V.encoded("embedding"))
    return table(spark, sf, "embeddings").select("vec_id", F.size(back).alias("dims"), (back == F.col("embedding")).alias("same"))


@query("""SELECT conv_id, turn, CASE WHEN conv_id % 11 = 0 THEN 'parse' WHEN conv_id % 7 = 0 THEN 'blocked' WHEN turn % 4 = 2 THEN 'blocked' WHEN role <> 'system' AND conv_id % 5 > 0 THEN 'ok' WHEN turn % 4 = 1 THEN 'truncated' ELSE 'parse' END AS outcome,
CASE WHEN conv_id % 11 > 0 AND conv_id % 7 > 0 AND turn % 4 <> 2 AND role <> 'system' AND conv_id % 5 > 0 THEN text END AS text, CASE WHEN conv_id % 11 = 0 THEN '' ELSE CASE turn % 4 WHEN 0 THEN 'STOP' WHEN 1 THEN 'MAX_TOKENS' WHEN 2 THEN 'SAFETY' ELSE '' END END AS finish,
conv_id % 11 > 0 AND turn % 4 = 1 AS truncated, CASE WHEN conv_id % 11 = 0 THEN 0 ELSE length(text) END::BIGINT AS prompt_tokens FROM conversations""")
def reply_outcome(spark, sf):
    """Turns as a provider's responses: some broken, some refused, some stopped for a reason, some without a text."""
    from ..operators.replies import reply

    e = F.expr
    finish = e("CASE turn % 4 WHEN 0 THEN 'STOP' WHEN 1 THEN 'MAX_TOKENS' WHEN 2 THEN 'SAFETY' END")
    part = F.when(e("role <> 'system' AND conv_id % 5 > 0"), F.col("text"))
    body = F.to_json(F.struct(
        F.array(F.struct(finish.alias("finishReason"), F.struct(F.array(F.struct(part.alias("text"))).alias("parts")).alias("content"))).alias("candidates"),
        F.struct(F.when(e("conv_id % 7 = 0"), "OTHER").alias("blockReason")).alias("promptFeedback"), F.struct(F.length("text").alias("promptTokenCount")).alias("usageMetadata"),
    ))
    broken = F.when(e("conv_id % 11 = 0"), F.substring(body, 1, 20)).otherwise(body)
    return table(spark, sf, "conversations").select("conv_id", "turn", reply(broken).alias("r")).select("conv_id", "turn", "r.outcome", "r.text", "r.finish", "r.truncated", "r.prompt_tokens")


@query("""WITH a AS (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN 400 ELSE 200 END AS s1, CASE WHEN event_id % 5 > 2 THEN 400 ELSE 200 END AS s2, CASE WHEN event_id % 7 > 3 THEN 503 ELSE 200 END AS s3, value AS t1, value / 4 AS t2, CASE WHEN user_id % 4 > 0 THEN 1024 END AS thinking, (event_id % 4 * 1000)::INTEGER AS tokens FROM events),
b AS (SELECT *, thinking IS NOT NULL AND s1 = 400 AND 100 - t1 >= 5 AS two FROM a), c AS (SELECT *, two AND s2 = 400 AND 100 - (t1 + t2) >= 5 AS three FROM b)
SELECT event_id, CASE WHEN three THEN 3 WHEN two THEN 2 ELSE 1 END AS sent, CASE WHEN three THEN s3 WHEN two THEN s2 ELSE s1 END AS status, CASE WHEN three THEN -2 WHEN two THEN 128 ELSE thinking END AS thinking_sent, CASE WHEN three THEN greatest(tokens, 2048) ELSE tokens END AS tokens_sent FROM c""")
def provider_attempts(spark, sf):
    """Events as generations of which each attempt would get and take so much."""
    from ..operators.replies import attempts

    e = F.expr
    rows = table(spark, sf, "events").select(
        "event_id", e("array(if(event_id % 3 > 0, 400, 200), if(event_id % 5 > 2, 400, 200), if(event_id % 7 > 3, 503, 200))").alias("statuses"), e("array(value, value / 4, 1.0D)").alias("seconds"),
        e("CASE WHEN user_id % 4 > 0 THEN 1024 END").alias("thinking"), e("cast(event_id % 4 * 1000 AS int)").alias("max_tokens"),
    )
    return attempts(rows).select("event_id", "sent", "status", "thinking_sent", "tokens_sent")


@query()
def embed_batches(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return P.embedded(rows, "text", P.Offline(16)).drop("text")


@query(f"""WITH p AS ({_PARAMS}), m AS (SELECT event_id, md5(concat_ws(chr(10), 'Write ' || count || ' questions with answers in ' || language || ' as JSON.', '### TOPIC', topic, '### DESCRIPTION', description)) AS h FROM p)
SELECT event_id, 'What is ' || substr(h, 1, 6) || '?' AS question, 'It is ' || substr(h, 7, 6) || '.' AS answer FROM m""")
def generate_faq(spark, sf):
    rows = gen_params(spark, sf).withColumn("prompt", Q.generation_prompt("topic", "description", "count", "language"))
    told = P.generated(rows.select("event_id", "prompt"), "prompt", P.Offline()).select("event_id", F.explode(Q.normalised_pairs(Q.pairs_of("reply"))).alias("p"))
    return told.select("event_id", "p.question", "p.answer")


@query(f"WITH {PAIRS} SELECT conv_id AS id, TIMESTAMP '2024-01-31' AS created_at, 'topic ' || conv_id AS topic, NULL::VARCHAR AS extra_desc, CASE WHEN conv_id % 2 = 0 THEN 9 ELSE count(*) END::INTEGER AS num_questions, CASE WHEN conv_id % 3 = 0 THEN 'en' ELSE 'pl' END AS language, 0::BIGINT AS user_id, to_json(list({{'question': question, 'answer': answer}} ORDER BY turn))::VARCHAR AS pairs_json FROM pairs GROUP BY conv_id")
def generation_log(spark, sf):
    e = F.expr
    rows = pair_lists(spark, sf).select(F.col("conv_id").alias("id"), e("TIMESTAMP_NTZ '2024-01-31'").alias("created_at"), F.concat(F.lit("topic "), "conv_id").alias("topic"), e("CAST(NULL AS STRING)").alias("extra_desc"), e("CASE WHEN conv_id % 2 = 0 THEN 9 END").alias("num_questions"), e("CASE WHEN conv_id % 3 = 0 THEN 'en' END").alias("language"), e("CAST(NULL AS BIGINT)").alias("user_id"), "pairs")
    return Q.generation_rows(rows)


@query("""SELECT event_id, greatest(1, least(10, n // 10))::INTEGER AS rag_top_k, greatest(0, least(200, n))::INTEGER AS rag_rate_limit, greatest(64, least(2048, n * 9))::INTEGER AS rag_max_tokens, greatest(0, least(20000, n * 100))::INTEGER AS qa_log_keep_rows,
  greatest(0.0::DOUBLE, least(1.0::DOUBLE, round(x, 1))) AS temperature, greatest(0.7::DOUBLE, least(1.0::DOUBLE, round(x, 2))) AS rag_threshold,
  least(greatest(0.7::DOUBLE, least(1.0::DOUBLE, round(x, 2))), greatest(0.65::DOUBLE, least(1.0::DOUBLE, round(1.3::DOUBLE - x, 2)))) AS rag_threshold_hard,
  CASE WHEN n * 90 < -1 THEN -1 WHEN n * 90 = 0 THEN 0 WHEN n * 90 BETWEEN 1 AND 127 THEN 128 WHEN n * 90 > 24576 THEN 24576 ELSE n * 90 END::INTEGER AS rag_thinking_budget,
  CASE WHEN event_id % 3 = 0 THEN 'doba' ELSE 'godzina' END AS rag_rate_window FROM (SELECT event_id, floor(value)::BIGINT - 100 AS n, value / 300 AS x FROM events)""")
def settings_clamp(spark, sf):
    from ..operators.settings import clamped

    e = F.expr
    raw = table(spark, sf, "events").select("event_id", e("cast(floor(value) AS bigint) - 100").alias("n"), (F.col("value") / 300).alias("x"))
    raw = raw.select("event_id", e("n div 10 - if(n < 0 AND n % 10 <> 0, 1, 0)").alias("rag_top_k"), F.col("n").alias("rag_rate_limit"), e("n * 9").alias("rag_max_tokens"), e("n * 100").alias("qa_log_keep_rows"), F.col("x").alias("temperature"), F.col("x").alias("rag_threshold"), (1.3 - F.col("x")).alias("rag_threshold_hard"), e("n * 90").alias("rag_thinking_budget"), e("CASE WHEN event_id % 3 = 0 THEN 'doba' WHEN event_id % 3 = 1 THEN 'week' ELSE 'godzina' END").alias("rag_rate_window"))
    return clamped(raw)


@query()
def site_profile(spark, sf):
    from ..functions.profile import sanitised_topic
    from ..operators.knowledge import profile_sample

    sample = profile_sample(knowledge(spark, sf)).select(F.concat(F.lit("Name the topic of:\n"), "sample").alias("prompt"))
    return P.generated(sample, "prompt", P.Offline()).select(sanitised_topic("reply").alias("topic"))


@query("WITH q AS (SELECT vec_id, vec_id // 50 AS wave, label FROM embeddings) SELECT label::BIGINT AS post_id, count(*) AS chunks, bool_or(wave % 4 = 3) AS failed FROM q GROUP BY label")
def wave_outcome(spark, sf):
    from ..operators.waves import outcomes

    rows = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("post_id"), F.expr("vec_id div 50").alias("wave"), F.expr("(vec_id div 50) % 4 = 3").alias("wave_failed"))
    return outcomes(rows)


_FLAT = "c AS (SELECT doc_id AS post_id, unnest(range(1 + greatest(0, n_chars - 1) // 1000)) AS chunk_index FROM documents)"


@query(f"""WITH {_FLAT}, w1 AS (SELECT *, (row_number() OVER (ORDER BY post_id, chunk_index) - 1) // 100 AS w FROM c),
b1 AS (SELECT DISTINCT w FROM w1 WHERE w < 3 AND post_id % 97 = 5), r1 AS (SELECT post_id, bool_or(w IN (SELECT w FROM b1)) AS bad, min(w) AS low, max(w) AS high, count(*) AS chunks FROM w1 GROUP BY 1),
p1 AS (SELECT post_id, 1 AS run, CASE WHEN bad THEN 'failed' WHEN high >= 3 THEN 'budget' ELSE 'indexed' END AS state, chunks FROM r1 WHERE low < 3),
w2 AS (SELECT *, (row_number() OVER (ORDER BY post_id, chunk_index) - 1) // 100 AS w FROM c WHERE post_id NOT IN (SELECT post_id FROM p1 WHERE state = 'indexed')),
r2 AS (SELECT post_id, min(w) AS low, max(w) AS high, count(*) AS chunks FROM w2 GROUP BY 1),
p2 AS (SELECT post_id, 2 AS run, CASE WHEN high >= 4 THEN 'budget' ELSE 'indexed' END AS state, chunks FROM r2 WHERE low < 4),
p AS (SELECT * FROM p2 UNION ALL SELECT * FROM p1 WHERE post_id NOT IN (SELECT post_id FROM p2))
SELECT post_id, coalesce(run, 0)::INTEGER AS run, coalesce(state, 'waiting') AS state, n.chunks FROM (SELECT post_id, count(*) AS chunks FROM c GROUP BY 1) n LEFT JOIN p USING (post_id)""")
def index_waves(spark, sf):
    """Every document's state after two runs over all of them, a chunk for each 1,000 characters: the first has time for three
    waves, of which some fail, the second, in which all succeed, for four. A wave takes 13 seconds."""
    from ..operators.waves import PROGRESS, index_run

    last = F.floor((F.greatest(F.lit(1), "n_chars") - 1) / 1000)
    chunks = table(spark, sf, "documents").select(F.col("doc_id").alias("post_id"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk_index"))
    sent = lambda failed: lambda rows: rows.withColumns({"embedding": F.array(F.lit(1.0)), "failed": failed})
    _, first = index_run(chunks, spark.createDataFrame([], PROGRESS), 1, sent(F.col("post_id") % 97 == 5), 100, 39)
    progress = index_run(chunks, first, 2, sent(F.lit(False)), 100, 40)[1].select("post_id", "run", "state")
    told = chunks.groupBy("post_id").agg(F.count("*").alias("chunks")).join(progress, "post_id", "left")
    return told.select("post_id", F.coalesce("run", F.lit(0)).alias("run"), F.coalesce("state", F.lit("waiting")).alias("state"), "chunks")


@query("SELECT event_id, CASE WHEN event_id % 3 < 2 AND floor(value) BETWEEN 1 AND 60 THEN floor(value) ELSE 0 END::INTEGER AS seconds FROM events")
def retry_delay(spark, sf):
    from ..operators.waves import retry_seconds

    return table(spark, sf, "events").select("event_id", retry_seconds(F.expr("CASE event_id % 3 WHEN 0 THEN concat(value, 's') WHEN 1 THEN concat('  ', cast(floor(value) AS bigint)) ELSE props END")).alias("seconds"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN '' WHEN user_id % 3 = 0 THEN 'day' WHEN user_id % 3 = 1 THEN 'minute' ELSE '' END AS scope FROM events")
def quota_scope(spark, sf):
    from ..operators.waves import quota_scope as scope

    ids = """CASE user_id % 3 WHEN 0 THEN concat('{"quotaId": "PerMinute', user_id, '"}, {"x": 1}, {"quotaId": "', event_type, 'PerDayPerProject"}') WHEN 1 THEN concat('{"quotaId": "', event_type, 'PerMinutePerModel', event_id, '"}') ELSE concat('{"quotaId": "', event_type, '"}') END"""
    body = F.expr(f"if(event_type = 'error', props, concat('[', {ids}, ']'))")
    return table(spark, sf, "events").select("event_id", scope(body).alias("scope"))


_EDITED = without_elements_sql("regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')", ["script", "style", "noscript", "template", "svg"], "' '")
_EDITED = sql_trim(f"regexp_replace({unescaped_sql(f"regexp_replace({_EDITED}, '(?s)<[^>]*>', ' ', 'g')")}, '{SPACE}+', ' ', 'g')")


@query(f"SELECT page_id, CASE WHEN length(t) <= 6000 THEN t ELSE regexp_replace(substr(t, 1, 6000), '\\s\\S*$', '') END AS text FROM (SELECT page_id, {_EDITED} AS t FROM pages)")
def clean_content(spark, sf):
    from ..functions.profile import editor_text

    return table(spark, sf, "pages").select("page_id", editor_text("html").alias("text"))


@query(f"WITH {PAIRS}, p AS (SELECT conv_id, count(*)::INTEGER AS n, arg_min(question, turn) AS q FROM pairs GROUP BY 1) SELECT conv_id, n AS pairs, CASE WHEN conv_id % 2 = 0 THEN q END AS previous_question FROM p")
def publish_snapshot(spark, sf):
    from ..operators.waves import published

    now = pair_lists(spark, sf)
    before = now.where("conv_id % 2 = 0").select("conv_id", F.slice("pairs", 1, 1).alias("pairs"))
    return published(before, now, ["conv_id"], "pairs").select("conv_id", F.size("pairs").alias("pairs"), F.get(F.col("previous.question"), F.lit(0)).alias("previous_question"))
