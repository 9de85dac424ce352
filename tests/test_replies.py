"""Provider responses, attempts and checks of keys; the value of the site profile."""

from __future__ import annotations

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import replies
from tessera.plans import ask, operate

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def body(finish=None, text=None, block=None, **usage):
    parts = {"content": {"parts": [{"text": text}]}} if text is not None else {}
    return json.dumps({"candidates": [{**parts, **({"finishReason": finish} if finish else {})}], **({"promptFeedback": {"blockReason": block}} if block else {}), "usageMetadata": usage})


@pytest.mark.parametrize("value, want", [
    (body("STOP", "hi", promptTokenCount=3, totalTokenCount=9), ("ok", "hi", "STOP", False, 3, 0, 0, 9)),
    (body("MAX_TOKENS", "cut", thoughtsTokenCount=5, candidatesTokenCount=2), ("ok", "cut", "MAX_TOKENS", True, 0, 5, 2, 0)),
    (body("MAX_TOKENS"), ("truncated", None, "MAX_TOKENS", True, 0, 0, 0, 0)), (body("SAFETY", "x"), ("blocked", None, "SAFETY", False, 0, 0, 0, 0)),
    (body(None, "", None), ("ok", "", "", False, 0, 0, 0, 0)), (body("STOP", "x", "OTHER"), ("blocked", None, "STOP", False, 0, 0, 0, 0)),
    ("{}", ("parse", None, "", False, 0, 0, 0, 0)), ("{broken", ("parse", None, "", False, 0, 0, 0, 0)), (None, ("parse", None, "", False, 0, 0, 0, 0)), ("", ("parse", None, "", False, 0, 0, 0, 0)),
])
def test_what_a_response_says(spark, value, want):
    assert tuple(spark.createDataFrame([(value,)], "b string").select(replies.reply("b").alias("r")).first().r) == want


def test_attempts(spark):
    rows = [
        ([200], [1.0], 1024, 500), ([400, 200], [1.0, 1.0], 1024, 500), ([400, 400, 200], [1.0, 1.0, 1.0], 1024, 500), ([400, 400, 503], [1.0, 1.0, 1.0], 1024, 9000), ([400, 200], [1.0], None, 500),
        ([400, 200], [96.0, 1.0], 1024, 500), ([400, 400, 200], [50.0, 46.0, 1.0], 1024, None), ([429, 200], [1.0], 1024, 500), ([], [], 1024, 500), ([400], None, 1024, 500),
    ]
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id int, statuses array<int>, seconds array<double>, thinking int, max_tokens int")
    got = [(r.sent, r.status, r.thinking_sent, r.tokens_sent) for r in replies.attempts(frame).orderBy("id").collect()]
    assert got == [(1, 200, 1024, 500), (2, 200, 128, 500), (3, 200, -2, 2048), (3, 503, -2, 9000), (1, 400, None, 500), (1, 400, 1024, 500), (2, 400, 128, None), (1, 429, 1024, 500), (1, 0, 1024, 500), (1, 400, 1024, 500)]


def test_checks_of_keys(spark):
    rows = spark.createDataFrame([(200, "x"), (403, "bad key"), (500, " "), (None, None)], "s int, m string")
    assert [tuple(r.v) for r in rows.select(replies.verified(F.col("s"), F.col("m")).alias("v")).collect()] == [(True, ""), (False, "bad key"), (False, "HTTP 500"), (False, "HTTP 0")]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the provided tables aren't here")
def test_the_site_profile_is_the_clean_reply_to_the_sample(spark):
    sample = operate.QUERIES["profile_sample"](spark, SF_DIR).first().sample
    digest = hashlib.md5(f"Name the topic of:\n{sample}".encode()).hexdigest()
    line = '{"faqs": [{"question": "What is %s?", "answer": "It is %s."}]}' % (digest[:6], digest[6:12])
    assert [tuple(r) for r in ask.QUERIES["site_profile"](spark, SF_DIR).collect()] == [(line,)]
