"""Character references: queries against their SQL on small tables where references are cut, and the decoder against Python's."""

from __future__ import annotations

import html
import re
from html.entities import html5

import duckdb
import pytest

from tessera.functions.html import unescaped
from tessera.plans import ask, ingest

TABLES = {
    "documents": ("doc_id long, text string, lang string, source string, n_chars long", [(0, "One.\nTwo &amp; three", "en", "web", 1), (1, "Plain", "de", "web", 1)]),
    "labels": ("doc_id long, quality int, toxic int", [(1, 1, 0)]),
    "pages": ("page_id long, url string, html string", [(0, "https://a.org/0", "<title>cut&&&amp</title><p>Un &lt;b&gt; &amp;lt; x&#39;y</p><b>AT&ampT</b>"), (1, "https://a.org/1", "<p>none</p>&copy; &copy")]),
    "conversations": ("conv_id long, turn long, role string, text string", [(0, 0, "user", "What of a reference cut like this &amp"), (1, 1, "assistant", "It stays as it is &amp; so does &lt or &amp")]),
}


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    folder, con = tmp_path_factory.mktemp("cut"), duckdb.connect()
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["html_to_text", "clean_content", "clean_html", "merge_all_pages", "merge_sources", "open_merge_all_pages"])
def test_references_without_a_semicolon_stay(spark, small, name):
    folder, con = small
    found = con.execute({**ask.ORACLE, **ingest.ORACLE}[name])
    columns = [d[0] for d in found.description]
    assert sorted(map(tuple, {**ask.QUERIES, **ingest.QUERIES}[name](spark, folder).select(*columns).collect())) == sorted(found.fetchall())


def test_every_reference_as_in_python(spark):
    texts = [f"x&{name}y" for name in html5] + [f"&#{n};&#x{n:X};" for n in [*range(400), 0xD800, 0xFDD0, 0xFFFE, 0x1F600, 0x10FFFF, 0x110000, 10**30]]
    texts += ["", "&", "&;&#;&#x;", "&amp;lt;", "a & b; c", "&#00000000000038;", "&#38 &amp", "&notit;"]
    known = lambda m: html.unescape(m[0]) if m[1][0] == "#" or m[1] + ";" in html5 else m[0]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", unescaped("t").alias("u"))
    assert [(r.t, r.u) for r in rows.collect() if r.u != re.sub("&(#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);", known, r.t)] == []
    assert spark.sql("SELECT CAST(NULL AS STRING) AS t").select(unescaped("t")).first()[0] is None


def test_references_need_no_python(spark, small):
    """Python workers took as many texts as were in a batch, however long."""
    assert "Python" not in ingest.scan_docs(spark, small[0])._jdf.queryExecution().toString()
    assert "Python" not in ingest.meta_text(spark, small[0])._jdf.queryExecution().toString()
