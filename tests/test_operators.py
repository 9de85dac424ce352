from __future__ import annotations

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import providers
from tessera.functions.text import units
from tessera.operators import admission, analytics, boilerplate, chunking, faq, knowledge, retrieval, sources, waves
from tessera.operators.settings import clamped
from tessera.sources.tables import Conflict, Snapshots, isolated, read, write_exports

T0 = dt.datetime(2024, 1, 10, 12, 0, 0)


def chunks(spark, value, target, overlap):
    base = spark.createDataFrame([(value,)], "t string").select(chunking.packed(chunking.pieces(units("t"), target), target).alias("b"))
    return base.select(chunking.overlapped(F.col("b"), overlap).alias("c")).first().c


def test_chunks(spark):
    assert chunks(spark, "", 50, 0) == [] and chunks(spark, " \n\t ", 50, 0) == []
    assert chunks(spark, "Ala has a cat.", 50, 0) == ["Ala has a cat."]
    assert chunks(spark, "a" * 100, 20, 0) == ["a" * 20] * 5
    parts = chunks(spark, "One two three. Four five six. Seven eight nine. Ten.", 30, 0)
    assert parts == ["One two three. Four five six.", "Seven eight nine. Ten."]
    lapped = chunks(spark, "One two three. Four five six. Seven eight nine. Ten.", 30, 10)
    assert lapped[0] == parts[0] and lapped[1] == "five six. " + parts[1]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab .\n", max_size=60), min_size=1, max_size=4), st.integers(5, 40))
def test_chunks_keep_every_word_and_the_limit(spark, values, target):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, t string")
    for r in rows.select("t", chunking.packed(chunking.pieces(units("t"), target), target).alias("c")).collect():
        assert all(len(c) <= target for c in r.c)
        assert "".join("".join(r.c).split()) == "".join(r.t.split())


def documents(spark, n=12, header="Phone 123 456"):
    rows = [(201 + k, f"{header}\nunique line {'abcdefghijkl'[k]} of its own document") for k in range(n)]
    return spark.createDataFrame(rows, "post_id long, text string")


def test_boilerplate_moves_to_the_sink(spark):
    got = {r.post_id: r for r in boilerplate.without_boilerplate(documents(spark)).collect()}
    assert len(got) == 12 and sum(r.removed for r in got.values()) == 12
    assert sum("Phone" in r.text for r in got.values()) == 1 and "Phone" in got[201].text
    few = boilerplate.without_boilerplate(documents(spark, 4)).collect()
    assert all("Phone" in r.text and r.removed == 0 for r in few)


def test_a_document_of_mostly_boilerplate_is_kept_whole(spark):
    docs = documents(spark, 11).unionByName(spark.createDataFrame([(312, "Phone 99 11\nab")], "post_id long, text string"))
    got = {r.post_id: r for r in boilerplate.without_boilerplate(docs).collect()}
    assert got[312].text == "Phone 99 11\nab" and got[312].removed == 0


def test_pruning_by_an_empty_list_deletes_nothing(spark):
    table = spark.createDataFrame([(1, 5), (2, 6)], "id long, post_id long")
    keep = spark.createDataFrame([(5,)], "post_id long")
    assert [r.id for r in knowledge.prune_orphans(table, keep).collect()] == [1]
    assert knowledge.prune_orphans(table, keep.limit(0)).count() == 2


def test_a_second_run_changes_nothing(spark):
    docs = spark.createDataFrame([(1, "T", "Some text. More text."), (2, "", "Other.")], "post_id long, title string, text string")
    rows = chunking.chunk_documents(docs, "sig")
    assert {r.outcome for r in knowledge.changes(rows, rows).collect()} == {"unchanged"}
    assert {r.outcome for r in knowledge.changes(rows, chunking.chunk_documents(docs, "new")).collect()} == {"indexed"}
    assert {r.outcome for r in knowledge.changes(rows, rows.limit(0)).collect()} == {"cleared"}
    assert all(r.content.startswith("T\n") for r in rows.where("post_id = 1").collect())


def test_cosine_top_k(spark):
    rows = spark.createDataFrame([(1, 1, [3.0, 0.0]), (2, 1, [2.0, 2.0]), (3, 2, [0.0, 5.0]), (4, 2, [1.0, 0.0, 0.0]), (5, 2, None), (6, 3, [0.0, 0.0]), (7, 3, [6.0, 0.0])], "id long, post_id long, embedding array<float>")
    got = [(r.id, round(r.score, 4)) for r in retrieval.top_k(rows, [1.0, 0.0], 5).collect()]
    assert got == [(1, 1.0), (7, 1.0), (2, 0.7071), (3, 0.0), (6, 0.0)]
    assert retrieval.top_k(rows, [0.0, 0.0], 5).count() == 0
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (99, [0.0, 0.0])], "query_id long, embedding array<float>")
    for block, most in ((2, 0), (2048, 0), (2048, 1 << 20)):
        batch = retrieval.top_k_batch(rows, asked, 3, block, most).orderBy("query_id", "rank").collect()
        assert [(r.query_id, r.id, r.rank) for r in batch] == [(1, 7, 1), (1, 2, 2), (1, 3, 3)]


def test_guard(spark):
    hits = spark.createDataFrame([(1, 10, 0.8), (1, 11, 0.4), (2, 12, 0.66), (3, 13, -0.2)], "query_id long, id long, score double")
    got = {r.query_id: r for r in retrieval.guard(hits).collect()}
    assert (got[1].decision, got[1].coverage, got[1].ids) == ("pass", "full", [10])
    assert (got[2].decision, got[2].coverage, got[2].ids) == ("pass", "weak", [12])
    assert (got[3].decision, got[3].score, got[3].ids) == ("refuse", -0.2, [])


def requests(spark, seconds):
    rows = [(k, T0 + dt.timedelta(seconds=s), "ip", "b") for k, s in enumerate(seconds)]
    return spark.createDataFrame(rows, "id long, created_at timestamp_ntz, ip_hash string, bucket string")


def test_limits(spark):
    rows = requests(spark, [0, 1, 2, 3, 3601])
    assert [r.admitted for r in admission.rate_limited(rows, 3).orderBy("id").collect()] == [True, True, True, False, True]
    assert all(r.admitted for r in admission.rate_limited(rows, 0).collect())
    assert [r.id for r in admission.within_budget(rows, 2).orderBy("id").collect()] == [0, 1]
    written = admission.log_once(requests(spark, [0, 100, 3599, 3600, 7100, 7200]), 3600).orderBy("id").collect()
    assert [r.written for r in written] == [True, False, False, True, False, True]


def test_failed_requests_are_refunded(spark):
    rows = requests(spark, [0, 1, 2, 3, 4, 5]).withColumn("failed", F.col("id").isin(0, 3))
    assert [r.admitted for r in admission.rate_limited(rows, 2, failed="failed").orderBy("id").collect()] == [True, True, True, False, False, False]


def test_refusals_and_streaks_equal_a_loop_over_rows(spark):
    import random

    dice = random.Random(5)
    rows = [(k, dice.choice("ab"), T0 + dt.timedelta(seconds=dice.randint(0, 20_000)), dice.random() < 0.2, dice.choice(["ok", "timeout", "timeout", "failed"])) for k in range(400)]
    frame = spark.createDataFrame(rows, "id long, question_hash string, created_at timestamp_ntz, refused boolean, outcome string")
    want, streaks = {}, {}
    for q in "ab":
        last, streak = None, 0
        for k, _, at, refused, outcome in sorted((r for r in rows if r[1] == q), key=lambda r: (r[2], r[0])):
            want[k] = last is not None and at < last + dt.timedelta(seconds=3600)
            last = at if refused else last
            streak = 0 if outcome == "ok" else streak + (outcome == "timeout")
            streaks[k] = streak
    assert {r.id: r.cached_refusal for r in admission.recently_refused(frame).collect()} == want
    fetches = frame.withColumnsRenamed({"question_hash": "queue", "created_at": "at"})
    for block in (None, F.date_trunc("minute", "at"), F.date_trunc("hour", "at")):
        assert {r.id: r.streak for r in admission.timeout_streaks(fetches, block).collect()} == streaks


def test_ranks_equal_ordered_lists(spark):
    import math
    import random

    dice = random.Random(1)
    rows = [("a", float(dice.randint(0, 40_000))) for _ in range(5000)] + [("b", 1.0)] * 7 + [(None, 5.0), (None, 6.0), ("c", None)]
    got = {r.g: tuple(r)[1:] for r in analytics.nearest_rank(spark.createDataFrame(rows, "g string, v double"), "v", [1, 50, 95, 99, 100], ["g"]).collect()}
    for g in ("a", "b", None):
        own = sorted(v for k, v in rows if k == g and v is not None)
        assert got[g] == tuple(own[max(1, math.ceil(p / 100 * len(own))) - 1] for p in (1, 50, 95, 99, 100))
    assert set(got) == {"a", "b", None}


def test_streaks(spark):
    rows = [(k, "q", k, o) for k, o in enumerate(["timeout", "failed", "timeout", "timeout", "ok", "timeout"])]
    got = admission.timeout_streaks(spark.createDataFrame(rows, "id long, queue string, at long, outcome string")).orderBy("id").collect()
    assert [r.streak for r in got] == [1, 1, 2, 3, 0, 1] and [r.pause for r in got].index(True) == 3


def test_retention_takes_age_first(spark):
    rows = spark.createDataFrame([(k, T0 - dt.timedelta(days=10 - k)) for k in range(10)], "id long, created_at timestamp_ntz")
    keep = lambda **k: sorted(r.id for r in analytics.retained(rows, F.lit(T0), **k).collect())
    assert keep() == list(range(10)) and keep(keep_days=3) == [7, 8, 9] and keep(keep_rows=2) == [8, 9] and keep(keep_days=3, keep_rows=5) == [7, 8, 9]


def test_statistics_of_an_empty_log(spark):
    none = spark.createDataFrame([], "id long, created_at timestamp_ntz, status string, source string, score double")
    got = analytics.log_stats(none, F.lit(T0)).first()
    assert (got.total, got.answered, got.avg_score) == (0, 0, 0.0)


@pytest.mark.parametrize(
    "reply, want",
    [
        ('[{"question": "Q", "answer": "A"}]', [("Q", "A")]),
        ('Sure:\n```json\n{"faqs": [{"q": " Q ", "a": 5}]}\n```', [("Q", "5")]),
        ('talk [{"question": "Q", "answer": "A"}, {"question": "q", "answer": "B"}] talk', [("Q", "A")]),
        ('{"x": [{"question": "Q", "answer": ["A"]}]}', []),
        ('{"question": "Q", "answer": "A"}', [("Q", "A")]),
        ('See [draft] first: [ {"question":"Q","answer":"A"} ] bye', [("Q", "A")]),
        ('"a string with [{\\"question\\": 1}]"', []),
        ('[{"question": NaN, "answer": "A"}]', []),
        ("no json at all", []),
        (None, []),
    ],
)
def test_pairs_from_replies(reply, want):
    assert [(p["question"], p["answer"]) for p in faq.parsed_pairs(reply)] == want


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([(1, [("Is 3 < 5 & \"so\"?", "<b>Yes</b>")]), (2, [])], "id long, pairs array<struct<question: string, answer: string>>")
    got = faq.exports(rows).collect()
    assert len(got) == 1
    assert "3 &lt; 5 &amp; &quot;so&quot;?" in got[0].html and "<b>" not in got[0].gutenberg
    assert "\\u003Cb\\u003E" in got[0].json and '"@type":"FAQPage"' in got[0].jsonld and '"widgetType":"accordion"' in got[0].elementor
    write_exports(faq.exports(rows), "html", f"{tmp_path}/html")
    assert read(spark, f"{tmp_path}/html", "text").count() == 6


def test_merging(spark):
    schema = "post_id long, title string, url string, text string"
    a = spark.createDataFrame([(1, " ", "u1", "x\n450 zł"), (0, "t", "u", "gone"), (2, "t2", "", "  ")], schema)
    b = spark.createDataFrame([(1, "title", "u2", "x\n890 zł"), (3, "t3", "u3", "z")], schema)
    got = {r.post_id: r for r in sources.merge_sources([a, b]).collect()}
    assert set(got) == {1, 3} and got[1].text == "x\n450 zł\n890 zł" and (got[1].title, got[1].url) == ("title", "u1")


def test_embedding_in_batches(spark):
    rows = spark.createDataFrame([(k, f"word{k % 3}") for k in range(250)], "id long, text string")
    got = providers.embedded(rows, "text", providers.Offline(8)).collect()
    assert len(got) == 250 and got[0].embedding == next(r.embedding for r in got if r.id == got[0].id + 3)
    with pytest.raises(Exception, match="vectors for"):
        providers.embedded(rows, "text", Short()).collect()


class Short(providers.Offline):
    def embed(self, texts):
        return super().embed(texts)[1:]


def test_provider_errors(spark):
    rows = spark.createDataFrame([("17.4s",), ("600s",), ("soon",)], "h string").select(waves.retry_seconds(F.col("h")).alias("s")).collect()
    assert [r.s for r in rows] == [17, 0, 0]


def test_snapshots(spark, tmp_path):
    table = Snapshots(spark, f"file://{tmp_path}/kb")
    with pytest.raises(LookupError):
        table.current()
    rows = spark.range(5)
    assert table.commit(rows) == 1 and table.commit(knowledge.find(rows, 3)) == 2
    assert table.current().count() == 1 and table.current(1).count() == 5


def test_of_two_writers_one_gets_a_version(spark, tmp_path):
    folder = f"file://{tmp_path}/raced"
    first, second = Snapshots(spark, folder), Snapshots(spark, folder)
    assert first.commit(spark.range(1)) == 1
    assert first.commit(spark.range(2), after=1) == 2
    with pytest.raises(Conflict):
        second.commit(spark.range(3), after=1)
    assert first.current().count() == 2 and first.versions() == [1, 2]
    # a writer that saw version 2 as the newest, and another one after it
    seen = second.versions
    second.versions = lambda: [1]
    assert second.commit(spark.range(4)) == 3
    second.versions = seen
    assert second.current().count() == 4 and second.versions() == [1, 2, 3]


def test_a_failing_source_is_left_out_and_told(spark, tmp_path):
    def broken():
        raise ValueError("gone")

    def late():
        return spark.range(3).select(F.expr("raise_error('no')").cast("string").alias("text"))

    good, report = isolated(spark, {"a": lambda: spark.range(2), "b": broken, "c": late}, f"file://{tmp_path}/sources")
    assert list(good) == ["a"] and good["a"].count() == 2
    assert {(r.source, r.ok, r.docs) for r in report.collect()} == {("a", True, 2), ("b", False, 0), ("c", False, 0)}
    assert all(r.error for r in report.collect() if not r.ok)


def test_settings_stay_within_bounds(spark):
    schema = "rag_threshold double, rag_threshold_hard double, rag_top_k int, rag_thinking_budget int, language string, temperature double"
    rows = [(0.1, 0.9, 99, 5, "fr", 0.149), (1.5, 0.9, 0, 99_999, "en", 7.0), (None, None, None, -5, None, None)]
    got = [tuple(r) for r in clamped(spark.createDataFrame(rows, schema)).collect()]
    assert got == [(0.7, 0.7, 10, 128, None, 0.1), (1.0, 0.9, 1, 24_576, "en", 1.0), (None, None, None, -1, None, None)]


def test_limits_of_null_addresses_times_and_ids(spark):
    at = T0
    rows = [(1, at, None), (2, at, None), (3, at, "a"), (None, at, "a"), (4, None, None), (5, None, None)]
    frame = spark.createDataFrame(rows, "id long, created_at timestamp, ip_hash string")
    got = {(r.id, r.ip_hash, r.created_at is None): r.admitted for r in admission.rate_limited(frame, 1).collect()}
    assert got == {(1, None, False): True, (2, None, False): False, (None, "a", False): True, (3, "a", False): False, (4, None, True): True, (5, None, True): False}


def test_streaks_of_a_null_queue(spark):
    rows = [(1, None, 10, "timeout"), (2, None, 20, "timeout"), (3, None, 30, "timeout"), (4, None, 41, "ok"), (5, None, 42, "timeout"), (6, "q", None, "timeout")]
    frame = spark.createDataFrame(rows, "id long, queue string, at long, outcome string")
    for block in (None, F.floor(F.col("at") / 10)):
        got = {r.id: (r.streak, r.pause) for r in admission.timeout_streaks(frame, block).collect()}
        assert got == {1: (1, False), 2: (2, False), 3: (3, True), 4: (0, False), 5: (1, False), 6: (1, False)}


def test_vectors_without_finite_numbers_are_not_found(spark):
    nan, inf = float("nan"), float("inf")
    chunks = spark.createDataFrame([(1, 1, [nan, 1.0]), (2, 1, [1.0, 0.0]), (3, 1, [inf, 1.0]), (4, 1, [0.5, 0.5]), (5, 1, None)], "id long, post_id long, embedding array<float>")
    want = [(2, 1.0), (4, 0.7071)]
    assert [(r.id, round(r.score, 4)) for r in retrieval.top_k(chunks, [1.0, 0.0], 5).collect()] == want
    asked = spark.createDataFrame([(9, [1.0, 0.0]), (8, [nan, 0.0])], "query_id long, embedding array<float>")
    for most in (1 << 20, 0):
        for k in (5, 1):
            got = retrieval.top_k_batch(chunks, asked, k, most_bytes=most).orderBy("rank").collect()
            assert [(r.query_id, r.id, round(r.score, 4)) for r in got] == [(9, *w) for w in want[:k]]


def test_ranks_with_values_that_are_no_numbers(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", v) for v in (1.0, 2.0, nan, nan)] + [("b", nan)] + [("c", v) for v in (inf, nan, 1.0, None)] + [(None, 3.0)]
    got = {r.g: tuple(r)[1:] for r in analytics.nearest_rank(spark.createDataFrame(rows, "g string, v double"), "v", [1, 50, 60, 99], ["g"]).collect()}
    assert repr(got["a"]) == repr((1.0, 2.0, nan, nan)) and repr(got["b"]) == repr((nan,) * 4) and repr(got["c"]) == repr((1.0, inf, inf, nan)) and got[None] == (3.0,) * 4
    whole = spark.createDataFrame([("a", 1), ("a", 2)], "g string, v long")
    assert [tuple(r) for r in analytics.nearest_rank(whole, "v", [50, 100], ["g"]).collect()] == [("a", 1, 2)]
