from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions import html, profile, text


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr.alias("r")).first().r


@pytest.mark.parametrize(
    "value, want",
    [
        ("<!-- wp:paragraph --><p>One &amp; two</p><!-- /wp:paragraph -->", "One & two"),
        ("<ul><li>a</li><li>b</li></ul>", "a\nb"),
        ("<table><tr><td>Monday</td><td>7:00</td></tr></table>", "Monday\n7:00"),
        ('[gallery ids="1,2,3"]', ""),
        ("[restrict]hidden [restrict]inner[/restrict] more[/restrict] shown", "more\nshown"),
        ('before [promo title="Offer 450 zł" width="12px"] after', "before\nOffer 450 zł\nafter"),
        ("a b &nbsp; c", "a b c"),
        ("<script>var a = '<p>';</script>text", "text"),
        (None, None),
        ("", ""),
    ],
)
def test_plain_text(spark, value, want):
    assert one(spark, value, html.plain_text("v")) == want


def test_clean_html_drops_containers_and_keeps_the_rest(spark):
    page = (
        '<head><title>t</title></head><nav>menu</nav><main>main<script>x</script><svg>y</svg></main><aside>side</aside>'
        '<div id="comments"><div>secret <div>deep</div></div></div><p class="comments-areas">kept</p><footer>foot</footer><iframe src="x">'
    )
    got = one(spark, page, html.clean_html("v"))
    assert "secret" not in got and "deep" not in got and "menu" in got and "side" in got and "foot" in got and "kept" in got
    assert "main" in got and "x" not in got.split() and "y" not in got.split() and "t" not in got.split("\n")[0].split()
    assert one(spark, '<p>a</p><ol class="x comment-list"><li>b</li>', html.clean_html("v")) == "a"


@pytest.mark.parametrize("value, want", [("ab", False), ("12.5", False), ("https://a.b", False), ("#ffcc00", False), ("12px", False), ("A" * 40, False), ("Offer 450 zł", True), ("  abz ", True)])
def test_useful_values(spark, value, want):
    assert one(spark, value, html.useful("v")) is want


def test_neutralised_text_holds_no_marks(spark):
    value = "### head ＃＃\n---\n[3] (Źródło: x) __NO_ANSW__NO_ANSWER__ER__ rest"
    assert one(spark, value, text.neutralised("v")) == "# # # head # # #\n- - -\n[ 3 ] ( Źródło : x)  rest"


@pytest.mark.parametrize("value", ["__NO_ANSW" * 30 + "__NO_ANSWER__" + "ER__" * 30, "W" * 50 + "__NO_ANSW__NO_ANSWER__ER__", "a__NO_ANSWER__b__NO_ANSWER__NO_ANSWER__", "no mark", "", None])
def test_no_mark_is_left_however_deep(spark, value):
    want = value
    while want and text.NO_ANSWER in want:
        want = want.replace(text.NO_ANSWER, "")
    assert one(spark, value, text.neutralised("v")) == want


def test_heads_and_rulers_in_any_form(spark):
    assert one(spark, "[1] (źródło: x)\n[2](ŹRÓDŁO : y)", text.neutralised("v")) == "[ 1 ] ( Źródło : x)\n[ 2 ] ( Źródło : y)"
    assert one(spark, "a\n***  \n===\n-- -", text.neutralised("v")) == "a\n- - -\n- - -\n-- -"


def test_tokens_are_hmacs(spark):
    import hashlib
    import hmac

    for secret in ("secret", "s" * 100):
        assert one(spark, "crawl é", text.hmac_sha256("v", secret)) == hmac.new(secret.encode(), "crawl é".encode(), hashlib.sha256).hexdigest()
    assert one(spark, "x", text.crawl_token("v", "")) == ""


def test_hashes_ignore_case_and_space(spark):
    rows = spark.createDataFrame([("  What IS  it?\n",), ("what is it?",)], "v string").select(text.question_hash("v").alias("h")).collect()
    assert rows[0].h == rows[1].h
    assert one(spark, "Price 450 zł  in 2024", text.line_key("v")) == "price # zł in #"


def test_lines_and_clamps(spark):
    assert one(spark, " a \n\nb\na\n B", text.deduped_lines("v")) == "a\nb\nB"
    assert one(spark, "word " * 30, text.clamp_words("v")) == ("word " * 30)[:90].strip()
    assert one(spark, "short", text.clamp_words("v")) == "short"


@pytest.mark.parametrize("value, want", [('"A topic."\nand talk', "A topic"), ("UNKNOWN", ""), ("x" * 91, ""), ("a <b> c", ""), ("", ""), ("  two   words ", "two words")])
def test_topics(spark, value, want):
    assert one(spark, value, profile.sanitised_topic("v")) == want


def test_editor_text_is_cut_at_a_space(spark):
    got = one(spark, "<p>" + "word " * 2000 + "</p>", profile.editor_text("v"))
    assert len(got) <= 6000 and got.endswith("word")


def test_removing_the_mark_builds_no_structure(spark):
    mark = text.NO_ANSWER
    assert one(spark, f"#{mark}#", text.neutralised("v")) == "# # #"
    assert one(spark, f"--{mark}-", text.neutralised("v")) == "- - -"
    assert one(spark, f"[1]{mark} (Źródło: x)", text.neutralised("v")) == "[ 1 ] ( Źródło : x)"


def test_removing_marks_takes_linear_time(spark):
    nested = "__NO_ANSW" * 40_000 + "__NO_ANSWER__" + "ER__" * 40_000
    assert one(spark, nested + "W" * 200_000, text.neutralised("v")) == "W" * 200_000
    assert text.without_needle("aXbXXabX", "XX") == "aXbabX" and text.without_needle("aabbab", "ab") == ""
