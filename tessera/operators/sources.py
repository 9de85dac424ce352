"""Documents from posts, metadata and rendered pages; gates, merging, crawl decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import plain_text
from ..functions.text import column, deduped_lines, trim

# Metadata keys never read, and the words that a key must hold.
DENIED_KEYS = ["rank_math_description", "rank_math_title", "rank_math_facebook_description", "rank_math_twitter_description", "rank_math_robots", "rank_math_focus_keyword", "_yoast_wpseo_metadesc", "_yoast_wpseo_title", "_seopress_titles_desc", "_aioseo_description", "et_pb_old_content", "panels_data"]
KEY_WORDS = ["bio", "opis", "tresc", "description", "content", "text"]
#: Fixed value: a metadata value needs so many characters.
LEAST_VALUE = 20
#: Fixed value: share of the pages from which on an exclusion list is taken for a mistake.
EXCLUDE_ALERT = 0.8


def normal_key(key: str | Column) -> Column:
    """A key less its empty and all-digit segments."""
    return F.array_join(F.filter(F.split(column(key), "_", -1), lambda s: (s != "") & ~s.rlike(r"^\d+$")), "_")


def key_accepted(key: str | Column, words: list[str] = KEY_WORDS) -> Column:
    key = F.lower(column(key))
    plain, hit = normal_key(key), F.lit(False)
    for w in words:
        hit = hit | plain.contains(w.lower()) | key.contains(w.lower())
    return ~key.isin(DENIED_KEYS) & ~key.startswith("_") & hit


def clean_value(value: str | Column) -> Column:
    """A metadata value as text; nothing for serialised, numeric, address-like and short ones."""
    value = trim(value)
    # Serialised data, addresses and numbers.
    serialised = value.rlike(r"^([aOsibdC]:[0-9]+[:;]|N;)")
    plainly = value.rlike(r"^(https?://|\d+$|[\d\s+()-]{6,}$)")
    return F.when(value.isNull() | serialised | plainly | (F.length(value) < LEAST_VALUE), "").otherwise(plain_text(value))


def scan_posts(posts: DataFrame) -> DataFrame:
    """Published posts without a password whose text isn't blank, HTML as text."""
    shown = posts.where("status = 'publish' AND password = ''")
    return shown.select("post_id", "title", "url", plain_text("text").alias("text")).where("text <> ''")


def meta_text(meta: DataFrame, words: list[str] = KEY_WORDS, gate: DataFrame | None = None) -> DataFrame:
    """(post_id, text) of the posts that pass the gate: accepted values, one a line, by key and place. A post bounds
    the group.
    """
    kept = gated(meta, gate).where(key_accepted("key", words)).select("post_id", "key", "pos", clean_value("value").alias("text")).where("text <> ''")
    ordered = F.array_sort(F.collect_list(F.struct("key", "pos", "text")))
    return kept.groupBy("post_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))


def truthy(value: str | Column) -> Column:
    return F.lower(trim(value)).isin("1", "yes", "true", "on")


def indexable(posts: DataFrame, excluded_slugs: list[str], own_pages: list[int] | None = None) -> DataFrame:
    """posts with `indexable`: what isn't known to be open is closed.

    Columns: post_id, status, password, type, slug, and the four noindex marks yoast, rank_math, seopress, aioseo.
    """
    noindex = (trim("yoast") == "1") | F.lower("rank_math").contains("noindex") | truthy("seopress") | truthy("aioseo")
    tokens = [t for t in (x.strip("/ \t\n").lower().split("/")[-1] for x in excluded_slugs) if t]
    ok = (F.col("post_id") > 0) & (F.col("status") == "publish") & (F.coalesce("password", F.lit("")) == "") & (F.col("type") != "attachment")
    ok = ok & ~F.coalesce(noindex, F.lit(False)) & ~F.lower("slug").isin(tokens) & ~F.col("post_id").isin(own_pages or [-1])
    return posts.withColumn("indexable", F.coalesce(ok, F.lit(False)))


def gated(source: DataFrame, gate: DataFrame | None) -> DataFrame:
    """The rows of source whose post is open: gate is what indexable() returns. Posts that the gate lacks are closed;
    without a gate all rows stay, which is for sources that have passed it already.
    """
    return source if gate is None else source.join(gate.where("indexable").select("post_id").distinct(), "post_id", "left_semi")


def slug_excluded(slug: str | Column, tokens: str) -> Column:
    """Whether a slug is the last segment of an entry of the comma list."""
    wanted = [t.strip().strip("/ ").lower().split("/")[-1] for t in tokens.split(",")]
    return F.lower(column(slug)).isin([w for w in wanted if w])


def exclude_sanity(pages: DataFrame, tokens: list[str]) -> DataFrame:
    """(total, hits, alert) of pages(url) whose path has one of the tokens as a segment."""
    parts = F.split(F.lower(F.coalesce(F.parse_url("url", F.lit("PATH")), F.lit(""))), "/")
    counted = pages.agg(F.count("*").alias("total"), F.count(F.when(F.arrays_overlap(parts, F.array(*map(F.lit, tokens))), 1)).alias("hits"))
    return counted.withColumn("alert", (F.col("total") > 0) & (F.col("hits") >= F.ceil(F.lit(EXCLUDE_ALERT) * F.col("total"))))


def host(url: str | Column) -> Column:
    """A URL's host in lower case, without a leading www."""
    return F.regexp_replace(F.lower(F.parse_url(column(url), F.lit("HOST"))), r"^www\.", "")


def is_local(url: str | Column) -> Column:
    name = F.lower(F.parse_url(column(url), F.lit("HOST")))
    private = r"^(localhost|127\.0\.0\.1|\[?::1\]?|10(\.\d{1,3}){3}|192\.168(\.\d{1,3}){2}|172\.(1[6-9]|2\d|3[01])(\.\d{1,3}){2}|.*\.(local|test|localhost|invalid|example))$"
    return F.coalesce(name.rlike(private), F.lit(False))


def fetch_verdict(status: str | Column, content_type: str | Column, url: str | Column, final_url: str | Column, body: str | Column) -> Column:
    """Why a fetched page isn't taken, or ok."""
    return (
        F.when(column(status) != 200, "status")
        .when(~F.lower(trim(content_type)).startswith("text/html"), "type")
        .when(~host(url).eqNullSafe(host(final_url)), "host")
        .when(F.coalesce(trim(body), F.lit("")) == "", "blank")
        .otherwise("ok")
    )


def merge_sources(sources: list[DataFrame], gate: DataFrame | None = None) -> DataFrame:
    """Documents (post_id, title, url, text) of several sources by id: texts joined in source order, first titles and
    urls that aren't blank, repeated lines out. Ids must be positive, texts not blank and posts pass the gate. `place` orders them by
    first appearance: source, then id.
    """
    every = None
    for k, source in enumerate(sources):
        rows = source.select("post_id", "title", "url", "text", F.lit(k).alias("rank"))
        every = rows if every is None else every.unionByName(rows)
    kept = gated(every.where((F.col("post_id") > 0) & (trim("text") != "")), gate)
    first = lambda name: F.coalesce(F.min_by(F.when(trim(name) != "", F.col(name)), F.when(trim(name) != "", F.col("rank"))), F.lit("")).alias(name)
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n")
    merged = kept.groupBy("post_id").agg(first("title"), first("url"), texts.alias("text"), F.min("rank").alias("first_source"))
    return merged.withColumn("text", deduped_lines("text"))


def source_stats(sources: dict[str, DataFrame], gate: DataFrame | None = None) -> DataFrame:
    """(source, docs, chars) of each source's documents that pass the gate."""
    every = None
    for name, source in sources.items():
        rows = gated(source.where((F.col("post_id") > 0) & (trim("text") != "")), gate).agg(F.lit(name).alias("source"), F.count("*").alias("docs"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("chars"))
        every = rows if every is None else every.unionByName(rows)
    return every


def rendered(posts: DataFrame, pages: DataFrame, gate: DataFrame | None = None) -> DataFrame:
    """Posts that pass the gate and have a rendered page: its trimmed text, the first page by id; blank ones go."""
    first = pages.groupBy("post_id").agg(F.min_by("text", "page_id").alias("rendered"))
    return gated(posts, gate).join(first, "post_id").select("post_id", "title", "url", trim("rendered").alias("text")).where("text <> ''")


def stored_texts(store: DataFrame, batch: DataFrame) -> DataFrame:
    """The store (post_id, text) after a batch(post_id, text, at): each of its posts has its newest text."""
    newest = batch.groupBy("post_id").agg(F.max_by("text", "at").alias("text"))
    return store.join(newest.select("post_id"), "post_id", "left_anti").select("post_id", "text").unionByName(newest)


def own_site(body: str | Column, site_name: str, mark: str) -> Column:
    """Whether a page bears the mark or the site's name, plain or escaped."""
    escaped = site_name.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&#039;")
    low = F.lower(column(body))
    return low.contains(mark.lower()) | low.contains(site_name.lower()) | low.contains(escaped.lower())


def crawl_seed(candidates: DataFrame, done: DataFrame, queued: DataFrame, failed: DataFrame, now: Column) -> DataFrame:
    """Candidates (post_id, url) neither done nor queued, and those whose failure may be tried again."""
    retry = failed.where(retryable("tries", "last", now)).select("post_id")
    fresh = candidates.join(done, "post_id", "left_anti").join(queued, "post_id", "left_anti").join(failed.select("post_id"), "post_id", "left_anti")
    return fresh.unionByName(candidates.join(retry, "post_id", "left_semi").join(queued, "post_id", "left_anti"))


def retryable(tries: str, last: str, now: Column) -> Column:
    """Fewer than three tries, and the last of them an hour ago or more."""
    return (F.col(tries) < 3) & (F.col(last) <= now - F.expr("INTERVAL 1 HOUR"))


def crawl_diagnostics(state: DataFrame, now: Column) -> DataFrame:
    """(total, done, queued, failed, retryable) of state(post_id, state, tries, last)."""
    count = lambda test: F.count(F.when(test, 1))
    failed = F.col("state") == "failed"
    return state.agg(count(F.col("state").isin("done", "queued")).alias("total"), count(F.col("state") == "done").alias("done"), count(F.col("state") == "queued").alias("queued"), count(failed).alias("failed"), count(failed & retryable("tries", "last", now)).alias("retryable"))
