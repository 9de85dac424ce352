"""Queries from sources to chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as X
from ..operators import boilerplate as B
from ..operators import chunking as C
from ..operators import sources as S
from .bindings import BLANKS, META, POSTS, SPACE, meta, now, posts, sql_trim, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def unescaped_sql(value: str) -> str:
    """SQL for the entities that the pages hold."""
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "''"), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        value = f"replace({value}, '{entity}', '{plain}')"
    return value


def without_elements_sql(value: str, tags: list[str], gap: str) -> str:
    for tag in tags:
        value = f"regexp_replace({value}, '(?is)<{tag}([\\s/][^>]*)?>.*?</{tag}\\s*>', {gap}, 'g')"
    return value


def _plain(value: str) -> str:
    """SQL for text without entities: comments, bracket codes, breaking tags, other tags, white space."""
    tags = rf"(?i)<({H.LINE_TAGS})([\s/][^>]*)?>"
    out = f"regexp_replace({value}, '(?s)<!--.*?-->', ' ', 'g')"
    out = f"regexp_replace({out}, '\\[[^\\]]*\\]', chr(10), 'g')"
    out = f"regexp_replace({out}, '{tags}', chr(10), 'g')"
    out = f"regexp_replace({out}, '(?is)<script[^>]*?>.*?</script>', '', 'g')"
    out = f"regexp_replace({out}, '(?is)<style[^>]*?>.*?</style>', '', 'g')"
    out = f"regexp_replace({out}, '(?s)<[^>]*>', '', 'g')"
    out = unescaped_sql(out)
    out = f"regexp_replace(replace({out}, chr(160), ' '), '[ \\t]+', ' ', 'g')"
    out = f"regexp_replace({out}, '{SPACE}*\\n{SPACE}*', chr(10), 'g')"
    return sql_trim(f"regexp_replace({out}, '\\n{{2,}}', chr(10), 'g')")


DEDUPED = "(SELECT string_agg(l, chr(10) ORDER BY i) FROM (SELECT l, min(i) AS i FROM (SELECT unnest(a) AS l, generate_subscripts(a, 1) AS i FROM (SELECT list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, " + BLANKS + ")), lambda x: x <> '') AS a)) GROUP BY l))"


@query(f"WITH {POSTS} SELECT post_id, title, url, t AS text FROM (SELECT *, {_plain('text')} AS t FROM posts WHERE status = 'publish' AND password = '') WHERE t <> ''")
def scan_docs(spark, sf):
    return S.scan_posts(posts(spark, sf))


@query(f"WITH {META}, v AS (SELECT post_id, key, pos, {_plain('value')} AS text FROM meta WHERE key IN ('user', 'assistant') AND length({sql_trim('value')}) >= 20) SELECT post_id, string_agg(text, chr(10) ORDER BY key, pos) AS text FROM v WHERE text <> '' GROUP BY post_id")
def meta_text(spark, sf):
    return S.meta_text(meta(spark, sf), ["user", "assist"])


@query("""WITH k AS (SELECT p_partkey, lower(replace(p_name, '#', '_')) AS key FROM part UNION ALL SELECT c_custkey + 1000000, CASE c_custkey % 5 WHEN 0 THEN '_text' WHEN 1 THEN 'a_12_content_3' WHEN 2 THEN 'panels_data' WHEN 3 THEN 'opis_' || c_custkey ELSE lower(c_mktsegment) END FROM customer)
SELECT p_partkey, key, array_to_string(list_filter(string_split(key, '_'), lambda s: s <> '' AND NOT regexp_full_match(s, '\\d+')), '_') AS plain, key <> 'panels_data' AND NOT starts_with(key, '_') AND regexp_matches(key, 'bio|opis|tresc|description|content|text') AS accepted FROM k""")
def meta_key_filter(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", F.lower(F.replace("p_name", F.lit("#"), F.lit("_"))).alias("key"))
    more = F.expr("CASE c_custkey % 5 WHEN 0 THEN '_text' WHEN 1 THEN 'a_12_content_3' WHEN 2 THEN 'panels_data' WHEN 3 THEN concat('opis_', c_custkey) ELSE lower(c_mktsegment) END")
    keys = parts.unionByName(table(spark, sf, "customer").select((F.col("c_custkey") + 1000000).alias("p_partkey"), more.alias("key")))
    return keys.select("p_partkey", "key", S.normal_key("key").alias("plain"), S.key_accepted("key").alias("accepted"))


_VALUE = "CASE WHEN event_id % 6 = 0 THEN props || ' with some more text' WHEN event_id % 6 = 1 THEN 'https://example.org/' || event_id WHEN event_id % 6 = 2 THEN '' || event_id WHEN event_id % 6 = 3 THEN '+48 (22) 123-45-67' WHEN event_id % 6 = 4 THEN 'a:1:{i:0;s:20:\"12345678901234567890\";}' ELSE 'Some plain words about event ' || event_id END"


@query(f"SELECT event_id, CASE WHEN event_id % 6 IN (0, 5) AND length(v) >= 20 THEN v ELSE '' END AS value FROM (SELECT event_id, {_VALUE} AS v FROM events)")
def meta_value_filter(spark, sf):
    return table(spark, sf, "events").select("event_id", S.clean_value(F.expr(_VALUE)).alias("value"))


@query(f"WITH {POSTS} SELECT post_id, title, posts.url, {sql_trim('html')} AS text FROM posts JOIN pages ON post_id = page_id + 1 WHERE {sql_trim('html')} <> ''")
def rendered_docs(spark, sf):
    pages = table(spark, sf, "pages").select((F.col("page_id") + 1).alias("post_id"), "page_id", F.col("html").alias("text"))
    return S.rendered(posts(spark, sf), pages)


_GATED = "posts2 AS (SELECT *, 'slug' || (post_id % 9) AS slug, CASE WHEN post_id % 11 = 0 THEN 'attachment' ELSE 'post' END AS type, CASE WHEN post_id % 13 = 0 THEN ' 1 ' WHEN post_id % 13 = 1 THEN '2' END AS yoast, CASE WHEN post_id % 17 = 0 THEN 'NoIndex,nofollow' END AS rank_math, CASE WHEN post_id % 19 = 0 THEN 'Yes' END AS seopress, CASE WHEN post_id % 23 = 0 THEN 'off' END AS aioseo FROM posts)"


@query(f"WITH {POSTS}, {_GATED} SELECT post_id, post_id > 0 AND status = 'publish' AND password = '' AND type <> 'attachment' AND post_id % 13 <> 0 AND post_id % 17 <> 0 AND post_id % 19 <> 0 AND slug <> 'slug4' AND post_id <> 7 AS indexable FROM posts2")
def indexable_gate(spark, sf):
    return _gate(spark, sf).select("post_id", "indexable")


def _gate(spark, sf):
    e = F.expr
    rows = posts(spark, sf).withColumns({"slug": e("concat('slug', post_id % 9)"), "type": e("CASE WHEN post_id % 11 = 0 THEN 'attachment' ELSE 'post' END"), "yoast": e("CASE WHEN post_id % 13 = 0 THEN ' 1 ' WHEN post_id % 13 = 1 THEN '2' END"), "rank_math": e("CASE WHEN post_id % 17 = 0 THEN 'NoIndex,nofollow' END"), "seopress": e("CASE WHEN post_id % 19 = 0 THEN 'Yes' END"), "aioseo": e("CASE WHEN post_id % 23 = 0 THEN 'off' END")})
    return S.indexable(rows, ["/de/Slug4/"], [7])


@query("SELECT doc_id, source IN ('src3', 'src7') AS excluded FROM documents")
def slug_exclude(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.slug_excluded("source", " /en/SRC3/ ,, src7").alias("excluded"))


_PATH = "string_split(lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '/')"


@query(f"SELECT count(*) AS total, count(*) FILTER (list_has_any({_PATH}, ['en', 'de'])) AS hits, count(*) FILTER (list_has_any({_PATH}, ['en', 'de'])) >= ceil(0.8::DOUBLE * count(*)) AS alert FROM pages")
def exclude_sanity(spark, sf):
    return S.exclude_sanity(table(spark, sf, "pages"), ["en", "de"])


_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1))"


@query(f"SELECT page_id, regexp_replace({_HOST}, '^www\\.', '') AS host, regexp_matches({_HOST}, '^(localhost|127\\.0\\.0\\.1|10(\\.\\d{{1,3}}){{3}}|192\\.168(\\.\\d{{1,3}}){{2}}|.*\\.(local|test|localhost|invalid|example))$') AS local FROM pages")
def host_class(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.host("url").alias("host"), S.is_local("url").alias("local"))


@query("""SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'status' WHEN page_id % 7 = 1 THEN 'type' WHEN page_id % 7 = 2 THEN 'host' WHEN page_id % 7 = 3 THEN 'blank' ELSE 'ok' END AS verdict FROM pages""")
def crawl_accept(spark, sf):
    e = F.expr
    verdict = S.fetch_verdict(e("CASE WHEN page_id % 7 = 0 THEN 404 ELSE 200 END"), e("CASE WHEN page_id % 7 = 1 THEN 'application/pdf' ELSE ' Text/HTML; charset=utf-8' END"), "url", e("CASE WHEN page_id % 7 = 2 THEN 'https://elsewhere.org/' ELSE regexp_replace(url, '://(www[.])?', '://www.') END"), e("CASE WHEN page_id % 7 = 3 THEN ' \n\t' ELSE html END"))
    return table(spark, sf, "pages").select("page_id", verdict.alias("verdict"))


@query("SELECT page_id, contains(lower(html), 'track(0)') OR contains(lower(html), 'the & that') OR contains(lower(html), 'the &amp; that') AS own FROM pages")
def own_site_probe(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.own_site("html", "The & That", "track(0)").alias("own"))


_ATTRS = "CASE event_id % 8 WHEN 0 THEN props WHEN 1 THEN '12.5' WHEN 2 THEN 'www.example.org' WHEN 3 THEN '#ffcc00' WHEN 4 THEN '12px' WHEN 5 THEN 'ab' WHEN 6 THEN repeat('Ab1+', 12) ELSE event_type END"


@query(f"SELECT event_id, event_id % 8 IN (0, 7) AND length({_ATTRS}) >= 3 AS useful FROM events")
def attr_useful(spark, sf):
    return table(spark, sf, "events").select("event_id", H.useful(F.expr(_ATTRS)).alias("useful"))


def _merged(second: str, third: str = "") -> str:
    more = f" UNION ALL SELECT post_id, '', '', text, 2 FROM {third}" if third else ""
    return f"""u AS (SELECT post_id, ' ' AS title, url, text, 0 AS rank FROM posts UNION ALL SELECT post_id, 'page ' || post_id, url, text, 1 FROM {second}{more}),
k AS (SELECT * FROM u WHERE post_id > 0 AND {sql_trim('text')} <> ''),
m AS (SELECT post_id, coalesce(arg_min(title, rank) FILTER ({sql_trim('title')} <> ''), '') AS title, coalesce(arg_min(url, rank) FILTER ({sql_trim('url')} <> ''), '') AS url, string_agg(text, chr(10) ORDER BY rank) AS text, min(rank) AS first_source FROM k GROUP BY post_id)
SELECT post_id, title, url, first_source, coalesce({DEDUPED}, '') AS text FROM m"""


_PAGES = f"every AS (SELECT page_id + 1 AS post_id, url, {_plain('html')} AS text FROM pages)"


def _two_sources(spark, sf):
    """Posts without titles, and every page."""
    first = posts(spark, sf).select("post_id", F.lit(" ").alias("title"), "url", "text")
    second = table(spark, sf, "pages").select((F.col("page_id") + 1).alias("post_id"), F.concat(F.lit("page "), F.col("page_id") + 1).alias("title"), "url", H.plain_text("html").alias("text"))
    return [first, second]


@query(f"WITH {POSTS}, {_PAGES}, {_merged('every')}")
def merge_all_pages(spark, sf):
    return S.merge_sources(_two_sources(spark, sf))


_WORDS = f"words AS (SELECT post_id, string_agg(text, chr(10) ORDER BY key, pos) AS text FROM (SELECT post_id, key, pos, {_plain('value')} AS text FROM meta WHERE key IN ('user', 'assistant') AND length({sql_trim('value')}) >= 20) WHERE text <> '' GROUP BY post_id)"


@query(f"WITH {POSTS}, {META}, {_PAGES}, {_WORDS}, {_merged('every', 'words')}")
def merge_sources(spark, sf):
    """Posts, every page, and the posts' metadata."""
    words = S.meta_text(meta(spark, sf), ["user", "assist"]).select("post_id", F.lit("").alias("title"), F.lit("").alias("url"), "text")
    return S.merge_sources([*_two_sources(spark, sf), words])


@query(f"WITH {POSTS}, {META}, a AS (SELECT 'posts' AS source, text FROM posts WHERE {sql_trim('text')} <> '' UNION ALL SELECT 'meta', value FROM meta WHERE {sql_trim('value')} <> '') SELECT source, count(*) AS docs, sum(length(text))::BIGINT AS chars FROM a GROUP BY source")
def source_stats(spark, sf):
    return S.source_stats({"posts": posts(spark, sf), "meta": meta(spark, sf).withColumnRenamed("value", "text")})


@query("SELECT page_id + 1 AS post_id, url || ' again' AS text FROM pages UNION ALL SELECT doc_id + 1, text FROM documents WHERE doc_id NOT IN (SELECT page_id FROM pages)")
def rendered_store(spark, sf):
    """Documents as what is stored, and every page rendered twice."""
    store = table(spark, sf, "documents").select((F.col("doc_id") + 1).alias("post_id"), "text")
    pages = table(spark, sf, "pages").select((F.col("page_id") + 1).alias("post_id"), "html", "url")
    batch = pages.select("post_id", F.col("html").alias("text"), F.lit(1).alias("at")).unionByName(pages.select("post_id", F.concat("url", F.lit(" again")).alias("text"), F.lit(2).alias("at")))
    return S.stored_texts(store, batch)


_IPAD, _OPAD = ("".join(f"\\x{b ^ pad:02X}" for b in b"secret".ljust(64, b"\0")) for pad in (0x36, 0x5C))


@query(f"SELECT page_id, substr(sha256('{_OPAD}'::BLOB || unhex(sha256('{_IPAD}'::BLOB || encode(url)))), 1, 32) AS token FROM pages")
def crawl_token(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.crawl_token("url", "secret").alias("token"))


# The same with the gate before each source is read, merged or counted.
_OPEN = f"{_GATED}, opened AS (SELECT post_id FROM posts2 WHERE post_id > 0 AND status = 'publish' AND password = '' AND type <> 'attachment' AND post_id % 13 <> 0 AND post_id % 17 <> 0 AND post_id % 19 <> 0 AND slug <> 'slug4' AND post_id <> 7)"


@query(f"WITH {POSTS}, {_OPEN} SELECT post_id, title, posts.url, {sql_trim('html')} AS text FROM posts JOIN pages ON post_id = page_id + 1 WHERE {sql_trim('html')} <> '' AND post_id IN (FROM opened)")
def open_rendered_docs(spark, sf):
    pages = table(spark, sf, "pages").select((F.col("page_id") + 1).alias("post_id"), "page_id", F.col("html").alias("text"))
    return S.rendered(posts(spark, sf), pages, _gate(spark, sf))


@query(f"WITH {POSTS}, {META}, {_OPEN}, v AS (SELECT post_id, key, pos, {_plain('value')} AS text FROM meta WHERE key IN ('user', 'assistant') AND length({sql_trim('value')}) >= 20 AND post_id IN (FROM opened)) SELECT post_id, string_agg(text, chr(10) ORDER BY key, pos) AS text FROM v WHERE text <> '' GROUP BY post_id")
def open_meta_text(spark, sf):
    return S.meta_text(meta(spark, sf), ["user", "assist"], _gate(spark, sf))


@query(f"WITH {POSTS}, {_OPEN}, {_PAGES}, {_merged('every')} WHERE post_id IN (FROM opened)")
def open_merge_all_pages(spark, sf):
    return S.merge_sources(_two_sources(spark, sf), _gate(spark, sf))


@query(f"WITH {POSTS}, {META}, {_OPEN}, a AS (SELECT 'posts' AS source, post_id, text FROM posts WHERE {sql_trim('text')} <> '' UNION ALL SELECT 'meta', post_id, value FROM meta WHERE {sql_trim('value')} <> '') SELECT source, count(*) AS docs, sum(length(text))::BIGINT AS chars FROM a WHERE post_id IN (FROM opened) GROUP BY source")
def open_source_stats(spark, sf):
    return S.source_stats({"posts": posts(spark, sf), "meta": meta(spark, sf).withColumnRenamed("value", "text")}, _gate(spark, sf))


@query(f"SELECT doc_id, coalesce({DEDUPED}, '') AS text FROM documents")
def dedupe_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.deduped_lines("text").alias("text"))


LINES = f"""lines AS (SELECT post_id, i, line, trim(regexp_replace(regexp_replace(lower(line), '{SPACE}+', ' ', 'g'), '\\p{{Nd}}+', '#', 'g'), {BLANKS}) AS key FROM (
  SELECT post_id, i, {sql_trim('a[i]')} AS line FROM (SELECT doc_id + 1 AS post_id, string_split(text, chr(10)) AS a, unnest(range(1, len(a) + 1)) AS i FROM documents)) WHERE line <> '')"""


def _docs(spark, sf):
    return table(spark, sf, "documents").select((F.col("doc_id") + 1).alias("post_id"), "text")


@query(f"WITH {LINES} SELECT key, count(DISTINCT post_id) AS df FROM lines GROUP BY key")
def line_df(spark, sf):
    return B.document_frequency(_docs(spark, sf))


def _without(sink: str) -> str:
    return f"""WITH {LINES}, n AS (SELECT count(*) AS n FROM documents), dfs AS (SELECT key, count(DISTINCT post_id) AS df FROM lines GROUP BY key),
keys AS (SELECT key FROM dfs, n WHERE n >= 5 AND df >= greatest(3, ceil(0.10::DOUBLE * n)) AND df / n >= 0.10::DOUBLE),
m AS (SELECT l.*, k.key IS NOT NULL AS shared FROM lines l LEFT JOIN keys k USING (key)),
s AS (SELECT post_id, sum(CASE WHEN shared THEN length(line) ELSE 0 END) / sum(length(line)) >= 0.60::DOUBLE AS whole FROM m GROUP BY post_id),
g AS (SELECT m.*, whole, shared AND NOT whole AS gone FROM m JOIN s USING (post_id)),
t AS (SELECT {sink} AS target FROM documents),
firsts AS (SELECT key, arg_min(line, (post_id, i)) AS line, min((post_id, i)) AS pos FROM g WHERE gone GROUP BY key),
poured AS (SELECT string_agg(line, chr(10) ORDER BY pos) AS p FROM firsts WHERE key NOT IN (SELECT key FROM g, t WHERE post_id = target AND NOT gone)),
c AS (SELECT post_id, string_agg(line, chr(10) ORDER BY i) FILTER (NOT shared) AS rest, count(*) FILTER (gone) AS removed FROM g GROUP BY post_id),
d AS (SELECT doc_id + 1 AS post_id, CASE WHEN coalesce(removed, 0) > 0 THEN coalesce(rest, '') ELSE text END AS text, coalesce(removed, 0)::BIGINT AS removed FROM documents LEFT JOIN c ON c.post_id = doc_id + 1),
o AS (SELECT post_id, CASE WHEN post_id <> target OR coalesce(p, '') = '' THEN text WHEN {sql_trim('text')} = '' THEN p ELSE text || chr(10) || p END AS text, removed FROM d, t, poured)
SELECT * FROM o WHERE {sql_trim('text')} <> ''"""


@query(_without("min(doc_id) + 1"))
def boilerplate(spark, sf):
    return B.without_boilerplate(_docs(spark, sf), 0.10)


@query(_without("min(201)"))
def boilerplate_sink(spark, sf):
    return B.without_boilerplate(_docs(spark, sf), 0.10, 201)


_NORMAL = sql_trim(r"regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{2,}', chr(10), 'g')")
UNITS = f"""u0 AS (SELECT doc_id, string_split(regexp_replace(regexp_replace({_NORMAL}, '([.!?…]){SPACE}+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)) AS a FROM documents),
u1 AS (SELECT doc_id, i, {sql_trim('a[i]')} AS u FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM u0)),
units AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, u FROM u1 WHERE u <> '')"""


@query(f"WITH {UNITS} SELECT doc_id, (i - 1)::INTEGER AS place, u AS unit FROM units")
def chunk_units(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(X.units("text")).alias("place", "unit"))


PACKED = f"""RECURSIVE {UNITS},
p0 AS (SELECT doc_id, i, k, substr(u, (k * 1000 + 1)::BIGINT, 1000) AS u FROM (SELECT doc_id, i, u, unnest(range(0, ((length(u) - 1) // 1000) + 1)) AS k FROM units)),
p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) AS i, u FROM p0),
w AS (SELECT doc_id, i, u AS cur, 0 AS ci FROM p WHERE i = 1 UNION ALL
  SELECT p.doc_id, p.i, CASE WHEN length(w.cur) + 1 + length(p.u) > 1000 THEN p.u ELSE w.cur || ' ' || p.u END, CASE WHEN length(w.cur) + 1 + length(p.u) > 1000 THEN w.ci + 1 ELSE w.ci END FROM w JOIN p ON p.doc_id = w.doc_id AND p.i = w.i + 1),
base AS (SELECT doc_id, ci, arg_max(cur, i) AS chunk FROM w GROUP BY doc_id, ci)"""


@query(f"WITH {PACKED} SELECT doc_id, ci::INTEGER AS place, chunk FROM base WHERE {sql_trim('chunk')} <> ''")
def chunk_pack(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(C.packed(C.pieces(X.units("text")))).alias("place", "chunk"))


OVERLAPPED = """o AS (SELECT doc_id, ci, chunk, lag(chunk) OVER (PARTITION BY doc_id ORDER BY ci) AS prev FROM base),
q AS (SELECT *, right(prev, 200) AS e FROM o),
t AS (SELECT doc_id, ci, CASE WHEN prev IS NULL THEN chunk ELSE (CASE WHEN length(prev) <= 200 THEN prev WHEN instr(e, ' ') > 0 AND instr(e, ' ') < length(e) THEN substr(e, instr(e, ' ') + 1) ELSE e END) || ' ' || chunk END AS chunk FROM q)"""


@query(f"WITH {PACKED}, {OVERLAPPED} SELECT doc_id, ci::INTEGER AS place, chunk FROM t")
def chunk_overlap(spark, sf):
    base = table(spark, sf, "documents").select("doc_id", C.packed(C.pieces(X.units("text"))).alias("base"))
    return base.select("doc_id", F.posexplode(C.overlapped(F.col("base"))).alias("place", "chunk"))


@query(f"""WITH {PACKED}, {OVERLAPPED}, c AS (SELECT t.doc_id + 1 AS post_id, ci::INTEGER AS chunk_index, lang || '-' || source || chr(10) || chunk AS content FROM t JOIN documents d USING (doc_id))
SELECT post_id, chunk_index, content, sha256({sql_trim("'sig' || chr(10) || content")}) AS content_hash, ceil(length(content) / 4)::INTEGER AS tokens FROM c""")
def chunk_rows(spark, sf):
    return C.chunk_documents(posts(spark, sf), "sig")


@query(f"SELECT page_id, {_plain('html')} AS text FROM pages")
def html_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", H.plain_text("html").alias("text"))


@query(f"SELECT page_id, {_plain(without_elements_sql('html', H.DROPPED, 'chr(10)'))} AS text FROM pages")
def clean_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", H.clean_html("html").alias("text"))


_GATES = [*H.GATE_NAMES, "mepr-x_1", "um_any"]
_GATE = f"element_at(array({', '.join(map(repr, _GATES))}), cast(event_id % {len(_GATES)} + 1 AS int))"
_CODES = f"concat('[', {_GATE}, ' level=\"1\"]hidden ', props, '[/', upper({_GATE}), '] [promo title=\"Offer ', event_id, ' now\" width=\"', user_id, 'px\" alt=''ok ', event_type, '''] ', event_type, ' [um_loggedin]x[/um_loggedin][ihc-b]')"


@query("SELECT event_id, chr(10) || ' [promo title=\"Offer ' || event_id || ' now\" width=\"' || user_id || 'px\" alt=''ok ' || event_type || '''] ' || event_type || ' ' || chr(10) || chr(10) AS text FROM events")
def strip_gated(spark, sf):
    return table(spark, sf, "events").select("event_id", H.without_gated(F.expr(_CODES)).alias("text"))


@query("SELECT event_id, 'Offer ' || event_id || ' now' || chr(10) || 'ok ' || event_type AS vals FROM events")
def shortcode_attrs(spark, sf):
    return table(spark, sf, "events").select("event_id", F.array_join(H.attribute_values(F.expr(_CODES)), "\n").alias("vals"))


_STATE = "SELECT user_id AS post_id, CASE count(*) FILTER (event_type = 'error') WHEN 0 THEN 'queued' ELSE 'failed' END AS state, (count(*) FILTER (event_type = 'error') % 5)::INTEGER AS tries, max(ts) AS last FROM events GROUP BY 1"


def _crawl(spark, sf):
    errors = F.count(F.when(F.col("event_type") == "error", 1))
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("post_id")).agg(F.when(errors == 0, "queued").otherwise("failed").alias("state"), (errors % 5).cast("int").alias("tries"), F.max("ts").alias("last"))


_AT = "TIMESTAMP '2024-01-30 12:00:00'"


def _at():
    return F.to_timestamp_ntz(F.lit("2024-01-30 12:00:00"))


@query(f"WITH s AS ({_STATE}) SELECT count(*) FILTER (state IN ('done', 'queued')) AS total, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'queued') AS queued, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'failed' AND tries < 3 AND last <= {_AT} - INTERVAL 1 HOUR) AS retryable FROM s")
def crawl_diag(spark, sf):
    return S.crawl_diagnostics(_crawl(spark, sf), _at())


@query(f"WITH s AS ({_STATE}) SELECT post_id, tries FROM s WHERE state = 'failed' AND tries < 3 AND last <= {_AT} - INTERVAL 1 HOUR")
def crawl_retry(spark, sf):
    return _crawl(spark, sf).where((F.col("state") == "failed") & S.retryable("tries", "last", _at())).select("post_id", "tries")


@query(f"""WITH s AS ({_STATE}), c AS (SELECT page_id + 1 AS post_id, url FROM pages), done AS (SELECT DISTINCT doc_id + 1 AS post_id FROM labels WHERE quality = 0)
SELECT * FROM c WHERE post_id NOT IN (SELECT post_id FROM done) AND post_id NOT IN (SELECT post_id FROM s WHERE state = 'failed' OR state = 'queued')
UNION ALL SELECT * FROM c WHERE post_id IN (SELECT post_id FROM s WHERE state = 'failed' AND tries < 3 AND last <= {_AT} - INTERVAL 1 HOUR)""")
def crawl_seed(spark, sf):
    candidates = table(spark, sf, "pages").select((F.col("page_id") + 1).alias("post_id"), "url")
    done = table(spark, sf, "labels").where("quality = 0").select((F.col("doc_id") + 1).alias("post_id"))
    state = _crawl(spark, sf)
    return S.crawl_seed(candidates, done, state.where("state = 'queued'").select("post_id"), state.where("state = 'failed'"), _at())
