"""Texts about a site as a whole: its topic and tagline, and an editor's content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .html import unescaped
from .text import TRIM, clamp_words, column, one_space, trim

# The longest topic, taglines that say nothing, characters of an editor's text.
MOST_TOPIC = 90
JUNK = ["just another wordpress site", "kolejna witryna oparta na wordpressie", "jeszcze jedna witryna wordpress", "another wordpress site"]
EDITOR_CHARS = 6000


def sanitised_topic(raw: str | Column) -> Column:
    """A model's first line as a topic, or nothing: blank, unknown, too long, or with marks."""
    line = F.split(trim(raw), r"\R", 2)[0]
    topic = trim(one_space(F.btrim(line, F.lit(TRIM + "\"'`.:"))))
    bad = (topic == "") | F.lower(topic).isin("nieznany", "unknown") | (F.length(topic) > MOST_TOPIC) | topic.contains("<")
    return F.when(bad, "").otherwise(topic)


def tagline(raw: str | Column) -> Column:
    """A site's tagline, unless it is one that comes with the software."""
    plain = trim(one_space(F.lower(F.regexp_replace(trim(raw), r"(?U)[^\p{L}\p{N}\s]", ""))))
    return F.when(plain.isin(JUNK), "").otherwise(clamp_words(trim(raw)))


def editor_text(value: str | Column) -> Column:
    """An editor's HTML as one line of text, cut after at most EDITOR_CHARS at a space."""
    text = F.regexp_replace(column(value), r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?is)<(script|style|noscript|template|svg)(?=[\s>/])[^>]*>.*?</\1\s*>", " ")
    text = trim(one_space(unescaped(F.regexp_replace(text, r"(?s)<[^>]*>", " "))))
    head = F.left(text, F.lit(EDITOR_CHARS))
    return F.when(F.length(text) <= EDITOR_CHARS, text).otherwise(F.regexp_replace(head, r"\s\S*$", ""))
