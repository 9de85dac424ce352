"""Pairs from replies: what built-in functions find equals what the plain version finds, or they leave the reply to it."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import faq

PAIR = '{"question": "Q", "answer": "A"}'
#: Replies, and whether built-in functions settle them.
REPLIES = [
    (f"[{PAIR}]", True),
    (f" \n[{PAIR}]\t\r\n", True),
    (f"[{PAIR}]\u00a0", True),
    (f"[{PAIR}] [2]", False),
    (f"[1] [{PAIR}]", False),
    (f"[1], [{PAIR}]", False),
    (f"Sure:\n```json\n[{PAIR}]\n```", True),
    (f"```JSON {PAIR[:-1]}}} ``` and [{PAIR}]", False),
    (f"```\n{{broken}}\n``` but [{PAIR}]", False),
    (f"talk [draft] [ \n{PAIR}, {PAIR.lower()}] talk [1] ]", False),
    (f"talk [draft] [ \n{PAIR}, {PAIR.lower()}] talk", True),
    (f"talk ] [{PAIR}", True),
    ("talk [1, 2] talk", False),
    ('{"faqs": [], "items": [{"q": "Q", "a": "A"}]}', True),
    ('{"faqs": [1, {"q": "Q", "a": "A"}], "pairs": [{"q": "Q2", "a": "A"}]}', True),
    ('{"mine": [{"q": "Q", "a": "A"}]}', False),
    (PAIR, False),
    ('[{"question": null, "q": "Q", "answer": "A"}, {"q": "Q", "answer": null, "a": "A"}, {"q": "Q2", "a": "A"}]', False),
    ('[{"question": null, "answer": "A"}, {"question": "Q", "answer": "A"}]', True),
    ('[{"question": "Q", "a": "A", "id": 1.5, "Q": true, "n": null}, {"question": "Q2"}]', True),
    ('[{"question": "Q", "a": "A", "id": [1]}]', False),
    ('[{"question": "Q", "a": "A", "a b: STRING, q": 1}]', False),
    ('[{"question": "Q", "a": "A", "q: BIGINT, x": 1}]', False),
    ('[{"q": 123456789012345678, "a": 5}, {"a": 7}]', True),
    ('[{"q": true, "a": 5}, {"q": false, "a": 5}]', False),
    ('[{"q": "Q", "a": "A"}, {"q": [1], "a": "A"}, 3, null, [1]]', False),
    ('{"faqs": [{"x": 1}, {"q": "Q", "a": "A"}], "items": [{"q": "Q2", "a": "A"}]}', True),
    ('{"faqs": [{"q": [1], "a": "A"}], "items": [{"q": "Q2", "a": "A"}]}', False),
    ('[{"q": 1.0, "a": "A"}]', False),
    ('[{"q": "Q", "a": 1e5}]', False),
    ('[{"q": 123456789012345678901234567890, "a": "A"}]', False),
    ('[{"q": "Q", "a": "A", "a": "B"}]', False),
    ('[{"q": "\\ud83d\\ude00", "a": "A"}]', False),
    ('[{"q": "\\ud83d", "a": "A"}]', False),
    ('[{"q": "Żółć 😀", "a": "ŻÓŁĆ"}, {"q": "żółĆ 😀", "a": "B"}]', True),
    ('[{"q": " \\u0000\\tQ\\u000b", "a": "\\u00a0"}]', True),
    ('[{"q": NaN, "a": "A"}]', False),
    (f'["{faq.DECODED}", {PAIR}]', False),
    ("null", False),
    (f"null [{PAIR}]", True),
    ("true", True),
    ('"a string"', True),
    ("not json", True),
    ("", True),
    (None, True),
    ("[" * 5000 + "]" * 5000, False),
    (f"[{PAIR}" + "," + ",".join('{"question": "Q%d", "answer": "A"}' % k for k in range(80)) + "]", True),
]


def both(spark, replies):
    rows = spark.createDataFrame(list(enumerate(replies)), "id int, reply string")
    native = {r.id: r.pairs for r in faq.with_pairs(rows, "reply", python=False).collect()}
    whole = {r.id: r.pairs for r in faq.with_pairs(rows, "reply").collect()}
    plain = lambda got: None if got is None else [(p["question"], p["answer"]) for p in got]
    return [(plain(native[k]), plain(whole[k]), plain(faq.parsed_pairs(reply))) for k, reply in enumerate(replies)]


def test_each_reply(spark):
    for (native, whole, want), (reply, settled) in zip(both(spark, [r for r, _ in REPLIES]), REPLIES, strict=True):
        assert whole == want, reply
        assert native == (want if settled else None), reply


def test_random_replies(spark):
    """Fragments of replies in any order: 3,000 of them."""
    rng = random.Random(7)
    parts = [PAIR, '{"q":"x","a":"y"}', "[", "]", "{", "}", ",", "```", "```json", "\n", " ", '"faqs":', '"items":', '"', "1", "null", "talk", '"q":', '"a":', "\\", "Ż"]
    shaped = [f"[{PAIR},", '{"q":"x","a":2}]', '{"data":[', "]}", "```json\n[", "]\n```", f"[{PAIR}]"]
    replies = ["".join(rng.choice(rng.choice([parts, shaped])) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    settled = 0
    for (native, whole, want), reply in zip(both(spark, replies), replies, strict=True):
        assert whole == want, reply
        assert native is None or native == want, reply
        settled += native is not None
    assert settled > 1000


def test_only_unsettled_replies_go_to_python(spark):
    rows = spark.createDataFrame([(f"[{PAIR}]",)], "reply string")
    plan = faq.with_pairs(rows, "reply", python=False)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert "ArrowEvalPython" in faq.with_pairs(rows, "reply")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("count", [1, 3])
def test_count_and_clashing_columns(spark, count):
    reply = json.dumps([{"q": f"Q{k}", "a": "A"} for k in range(5)])
    rows = spark.createDataFrame([(reply, 1), (reply[:-1] + ', {"q": 0.5, "a": "A"}]', 2)], "reply string, reply_native int")
    got = faq.with_pairs(rows, "reply", count=count).collect()
    assert got[0].asDict().keys() == {"reply", "reply_native", "pairs"}
    assert [len(r.pairs) for r in got] == [count, count]


def test_long_and_hostile_replies_take_linear_time(spark):
    """Hundreds of thousands of brackets, pairs or fences in one reply."""
    many = "[" + ",".join('{"q": "Q%d", "a": "A"}' % k for k in range(20000)) + "]"
    hostile = ["[ {" * 100000, "[" * 300000, "] [" * 100000, "``` " * 2000, "{" + "}" * 300000, many]
    rows = spark.createDataFrame([(x,) for x in hostile], "reply string").repartition(4)
    assert sorted(r.n for r in faq.with_pairs(rows, "reply").select(F.size("pairs").alias("n")).collect()) == [0, 0, 0, 0, 0, 50]


def test_no_rows(spark):
    rows = spark.createDataFrame([], "reply string")
    assert faq.with_pairs(rows, "reply").collect() == []


def test_repaired_leaves_half_surrogates_and_deep_nesting():
    assert faq.repaired('["\\ud83d"]') is None and faq.repaired('["\\ud83d\\ude00"]') == ["😀"]
    assert faq.repaired("[" * 200000 + "]" * 200000) is None
    assert all(faq.repaired("".join(x)) is None for x in itertools.product("[{", repeat=4))
