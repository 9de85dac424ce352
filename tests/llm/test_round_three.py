"""Main text of pages, importance resampling and periodic runs against plain versions."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import extraction, periodic, resampling

from .cases import empty, frame, texts

# main text

BODY = "<p>The first paragraph says a good deal about the matter, and more.</p><p>The second one, with a <a href='x'>link</a> in it, says<b>so</b> too.</p>"
TEXT = "The first paragraph says a good deal about the matter, and more. The second one, with a link in it, saysso too."
MENU = "<ul class='menu'>" + "".join(f"<li><a href='/{k}'>Entry {k} of this menu</a></li>" for k in range(30)) + "</ul>"


def page(inner: str, head: str = "<title>T</title>") -> str:
    return f"<!DOCTYPE html><html><head>{head}</head><body class='has-sidebar'>{inner}</body></html>"


SURROUNDED = page(
    f"<header><h1>Site</h1></header><nav>{MENU}</nav><div id='cookie-notice'>We use cookies.</div><script>var a = '</p><p>no</p>';</script><style>p {{}}</style>"
    f"<main><div class='ad-slot'>Buy now.</div><article class='post comments-open'><header class='entry-header'><h1>The title</h1><span>by A</span></header>{BODY}"
    "<form><label>Mail</label><input name='m'><button>Send</button></form><section class='comments'><article class='comment'>Well said, reader one.</article></section><footer>Tags</footer></article>"
    "<div class='sidebar'>Most read</div></main><div role='alert'>Update your browser</div><!-- gone <p>x</p> --><noscript>Enable it</noscript><footer>&copy; me</footer>"
)

CASES = [
    (SURROUNDED, "The title " + TEXT),
    (page(f"<div class='wrap'><div class='menu'>{MENU}</div><div class='story'>{BODY}</div><div>{MENU}</div></div>"), TEXT),
    (page(f"<article><h1>A&amp;B &#x41;&nbsp;&eacute; &lt;i&gt;</h1>{BODY}"), "A&B A é <i> " + TEXT),
    (page("<article><p>one<p>two<br>three  \n four<ul><li>five<li>six</ul><table><tr><td>seven<td>eight</table>"), "one two three four five six seven eight"),
    (page(f"<article><svg><path d='M0'/><g></g></svg>{BODY}<textarea>no</textarea><iframe src=x>no</iframe></article>"), TEXT),
    (page(f"<form id='aspnet'><div class='content'>{BODY}</div></form>"), TEXT),
    (page(f"<article><p hidden>no</p><p aria-hidden='true'>no</p><div style='display: none'>no</div>{BODY}</article>"), TEXT),
    (page(f"<nav>{MENU}</nav>"), ""),
    (page("<article><p>unclosed <a href=\"x>quote</a> and <b>more"), "unclosed quote and more"),
    (page("<article>a < b and <3 stay <!-- -->x<"), "a < b and <3 stay x<"),
    ("", ""), (None, ""), ("plain text", "plain text"), ("<", "<"), ("<p>cut <em", "cut"), ("<!-- open <p>x", ""), ("<script>open", ""),
]


def test_main_text_of_pages_by_themselves():
    for source, want in CASES:
        assert extraction.extract(source or "", []) == want, source


def test_hostile_pages_take_linear_time():
    for piece in ("<a ", "<!--", '<a b="', "<div>", "</b>", "<b><p>", "<script>", "&", "<p", "<a x='", "<li><ul>", "<table><td>", "<i>", "</p>"):
        extraction.extract(piece * 40_000, ["div/article"])


def pages(spark):
    rows = [(k, "http://many.example.net/%d" % k, page(f"<div class='w'><div class='box-{k}'>{BODY}{BODY}<p>Page {k} says something of its own.</p></div><div class='x'>Short tip of the day.</div></div>")) for k in range(12)]
    # here the tip is longer than the text, so that only the host's other pages tell which is which
    rows += [(50, "http://many.example.net/50", page("<div class='w'><div class='box-9'><p>Short main text of this one page only.</p></div><div class='x'>Tip of the day, somewhat longer than that text is.</div></div>"))]
    rows += [(60 + k, f"https://h{k}.example.org:8080/", source) for k, (source, _) in enumerate(CASES)]
    rows += [(None, None, SURROUNDED), (None, "no url", SURROUNDED), (60, "https://h0.example.org/", SURROUNDED)]
    return spark.createDataFrame([(*r, "h", ["p"], 1) for r in rows], "page_id long, url string, html string, host string, paths array<string>, votes long"), rows


def plain_extraction(rows):
    votes = defaultdict(Counter)
    host = lambda u: m[1].lower() if (m := re.match(r"[a-zA-Z][\w+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", u or "")) else ""
    for _, url, source in rows:
        for path, n in extraction.votes_of(source or ""):
            votes[host(url)][path] += n
    best = {h: [p for p, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[: extraction.PATHS]] for h, c in votes.items()}
    return [(i, url, extraction.extract(source or "", best.get(host(url), []))) for i, url, source in rows]


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_main_text_by_consensus(spark, broadcast):
    docs, rows = pages(spark)
    got = [(r.page_id, r.url, r.text) for r in extraction.extract_main(docs.repartition(5), broadcast=broadcast).collect()]
    assert sorted(got, key=repr) == sorted(plain_extraction(rows), key=repr)
    told = {i: t for i, _, t in got}
    assert told[50] == "Short main text of this one page only."
    assert extraction.extract(rows[12][2], []) != told[50]
    assert all(told[60 + k] == want for k, (_, want) in enumerate(CASES) if k)
    assert extraction.extract_main(docs.limit(0), broadcast=broadcast).count() == 0


# importance resampling


def plain_resampling(rows, target, percent, grams, buckets, least):
    def features(text):
        words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(resampling.UPPER, resampling.LOWER))) if w]
        return len(words), [" ".join(words[k : k + n]) for n in range(1, grams + 1) for k in range(len(words) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for text in side for f in features(text)[1]) for side in ([x for _, x in rows], target))
    total, aim = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * float(total + buckets) / ((s[b] + 1) * float(aim + buckets)))) for b in s}
    told = []
    for i, text in rows:
        n, found = features(text)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        told.append((i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in told if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    rank = Counter()
    ranks = defaultdict(list)
    for k, r in enumerate(fit, 1):
        ranks[r].append(k if k <= percent * len(fit) // 100 else None)
    return sorted(((i, f, w, score, ranks[i, n, f, w, score].pop() if n >= least else None) for i, n, f, w, score in told), key=repr)


@pytest.mark.parametrize("grams,buckets,percent", [(1, 10_000, 10), (3, 97, 55), (2, 1, 100), (1, 1000, 0)])
def test_resampling(spark, grams, buckets, percent):
    target = [t for _, t in texts(2)[:9]] + [None, "", "Ka LO 1 é"]
    wanted = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int").repartition(2)
    got = resampling.resample(frame(spark), wanted, percent, grams, buckets)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_resampling(texts(), target, percent, grams, buckets, 20)


def test_resampling_without_rows(spark):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(empty(spark), none).count() == 0
    rows = [(k, "one two three " * 9) for k in range(20)]
    assert sorted(map(tuple, resampling.resample(frame(spark, rows), none, 50).collect()), key=repr) == plain_resampling(rows, [], 50, 1, 10_000, 20)
    with pytest.raises(ValueError):
        resampling.resample(empty(spark), none, buckets=0)


def test_resampling_is_jvm_only(spark):
    wanted = spark.createDataFrame([("a b",)], "text string")
    plan = resampling.resample(frame(spark), wanted)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


# periodic runs


def plain_runs(words, least=12):
    """Every maximal stretch at each distance; of equal stretches the smallest distance is the period."""
    found, known = {}, {}
    ids = np.array([known.setdefault(w, len(known)) for w in words])
    for q in range(1, len(words) // 2 + 1):
        same = np.concatenate([[0], ids[:-q] == ids[q:], [0]]).astype(int)
        for i, k in zip(np.flatnonzero(np.diff(same) == 1).tolist(), np.flatnonzero(np.diff(same) == -1).tolist()):
            if k - i + q >= max(least, 2 * q):
                found.setdefault((i, k - i + q), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_left(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return [w for k, w in enumerate(words) if k not in gone]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=5).flatmap(lambda part: st.integers(1, 9).map(lambda n: part * n)), max_size=8), st.integers(2, 14))
def test_runs_of_any_sequence(parts, least):
    words = [w for part in parts for w in part]
    want = plain_runs(words, least)
    ids = np.array(words, np.int64)
    if len(words) >= 2:
        runs = periodic.runs_of(ids, least)
        assert [tuple(r) for r in runs.tolist()] == want
        assert [words[k] for k in np.flatnonzero(periodic.words_left(len(words), runs))] == plain_left(words, want)
        if want:
            assert periodic.may_repeat(ids.astype(np.uint64) * np.uint64(977), least)


def test_points_are_taken_in_blocks(monkeypatch):
    words = np.array(([1, 2, 3] * 50 + [4, 5] * 40 + [7] * 30 + [1, 2, 3]) * 2, np.int64)
    whole = periodic.runs_of(words)
    monkeypatch.setattr(periodic, "POINTS", 64)
    assert (periodic.runs_of(words) == whole).all() and [tuple(r) for r in whole.tolist()] == plain_runs(words.tolist())


def test_runs_of_documents(spark):
    rows = texts() + [(900, "a " * 40), (901, "x y\tz\n" * 9 + "x"), (902, "p q r s t u v w " * 3), (903, "a b " * 5 + "a"), (904, "a b " * 6), (None, "é è " * 8)]
    got = periodic.periodic_runs(frame(spark, rows)).collect()
    plain = []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = plain_runs(words)
        plain.append((i, len(words), runs, " ".join(plain_left(words, runs))))
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed_text) for r in got), key=repr) == sorted(plain, key=repr)
    assert periodic.periodic_runs(empty(spark)).count() == 0


def test_planted_runs(spark):
    rows = texts() + [(None, "null id"), (10**12, "big id")]
    got = sorted(map(tuple, periodic.with_planted_runs(frame(spark, rows)).collect()), key=repr)
    want = []
    for i, text in rows:
        h = 1 if i is None else zlib.crc32(str(i).encode())
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = " ".join(w[k] if k < a else w[a + (k - a) % p] for k in range(n))
        want.append((i, text))
    assert got == sorted(want, key=repr)
