"""Sources that are merged and gated, over the smallest of the provided tables."""

from __future__ import annotations

import os

import pytest

from tessera.functions import html
from tessera.operators import sources
from tessera.plans import bindings, ingest

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the provided tables aren't here")


def brute_merge(rows):
    """{post_id: (title, text)} of (post_id, title, text) in source order."""
    out = {}
    for post_id, title, text in rows:
        if post_id > 0 and text.strip(" \t\n\r\0\x0b"):
            old = out.get(post_id, ("", []))
            out[post_id] = (old[0] or title.strip(), old[1] + [text])
    lines = lambda texts: dict.fromkeys(x for t in texts for x in (y.strip(" \t\n\r\0\x0b") for y in t.split("\n")) if x)
    return {k: (title, "\n".join(lines(texts))) for k, (title, texts) in out.items()}


def test_every_page_is_merged(spark):
    docs = [(r.post_id, "", r.text) for r in bindings.posts(spark, SF_DIR).collect()]
    pages = [(r.page_id + 1, f"page {r.page_id + 1}", r.text) for r in bindings.table(spark, SF_DIR, "pages").select("page_id", html.plain_text("html").alias("text")).collect()]
    want = brute_merge(docs + pages)
    got = {r.post_id: (r.title, r.text) for r in ingest.QUERIES["merge_all_pages"](spark, SF_DIR).collect()}
    assert got == want
    joined = {i for i, _, t in pages if t} & {i for i, _, t in docs if t.strip()}
    assert joined and all(got[i][0] == f"page {i}" for i in joined)
    assert any(len(got[i][1]) > len(brute_merge([d for d in docs if d[0] == i])[i][1]) for i in joined)


def test_closed_posts_reach_no_source(spark):
    marks = "post_id long, status string, password string, type string, slug string, yoast string, rank_math string, seopress string, aioseo string"
    closed = [(2, "draft", ""), (3, "publish", "secret"), (4, "publish", "")]
    rows = [(i, status, password, "post", "s", None, "noindex" if i == 4 else None, None, None) for i, status, password in [(1, "publish", ""), *closed]]
    gate = sources.indexable(spark.createDataFrame(rows, marks), [])
    docs = spark.createDataFrame([(i, "t", "u", f"text {i}") for i in range(1, 6)], "post_id long, title string, url string, text string")
    pages = spark.createDataFrame([(i, i, f"page {i}") for i in range(1, 6)], "post_id long, page_id long, text string")
    meta = spark.createDataFrame([(i, "description", 0, f"some words of the post {i}") for i in range(1, 6)], "post_id long, key string, pos long, value string")
    assert [(r.post_id, r.text) for r in sources.rendered(docs, pages, gate).collect()] == [(1, "page 1")]
    assert [r.post_id for r in sources.meta_text(meta, gate=gate).collect()] == [1]
    assert [(r.post_id, r.text) for r in sources.merge_sources([docs, docs], gate).collect()] == [(1, "text 1")]
    assert {(r.source, r.docs, r.chars) for r in sources.source_stats({"a": docs, "b": docs.where("post_id > 1")}, gate).collect()} == {("a", 1, 6), ("b", 0, 0)}


@pytest.mark.parametrize("name", ["open_rendered_docs", "open_meta_text", "open_merge_all_pages"])
def test_the_queries_hold_open_posts_only(spark, name):
    allowed = {r.post_id for r in ingest.QUERIES["indexable_gate"](spark, SF_DIR).where("indexable").collect()}
    got = {r.post_id for r in ingest.QUERIES[name](spark, SF_DIR).collect()}
    ungated = {r.post_id for r in ingest.QUERIES[name.removeprefix("open_")](spark, SF_DIR).collect()}
    assert got and got == ungated & allowed < ungated
