"""Text functions as column expressions: trimming, white space, units, lines, hashes.

White space in patterns marked Unicode follows Unicode, as the data model asks for; trimming takes the six
characters of TRIM alone.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What trimming takes off.
TRIM = " \t\n\r\0\x0b"
SPACES = r"(?U)\s+"
#: Fixed value: an answer that holds this text says that nothing was found.
NO_ANSWER = "__NO_ANSWER__"


def column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def once(value: Column, body) -> Column:
    """body(value), with value worked out once and not at each place where body uses it."""
    return F.transform(F.array(value), body)[0]


def trim(value: str | Column) -> Column:
    return F.btrim(column(value), F.lit(TRIM))


def one_space(value: str | Column) -> Column:
    return F.regexp_replace(column(value), SPACES, " ")


def question_hash(question: str | Column) -> Column:
    """SHA-256 of the question in lower case with single spaces."""
    return F.sha2(trim(one_space(F.lower(column(question)))), 256)


def hmac_sha256(message: str | Column, secret: str) -> Column:
    """HMAC-SHA256 in hex, of two hashes with the padded secret before."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(k ^ pad for k in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, column(message).cast("binary")), 256))), 256)


def crawl_token(message: str | Column, secret: str) -> Column:
    """What a crawl request proves itself with: the first 32 digits of the HMAC; nothing without a secret."""
    return F.substring(hmac_sha256(message, secret), 1, 32) if secret else F.lit("")


def content_hash(content: str | Column) -> Column:
    return F.sha2(trim(content), 256)


def line_key(line: str | Column) -> Column:
    """A line as it is counted: lower case, single spaces, each number as one #."""
    # a single space stays as it is, which is most of them
    plain = F.regexp_replace(F.lower(column(line)), r"(?U)(?! \S)\s+", " ")
    return trim(F.regexp_replace(plain, r"(?U)\d+", "#"))


def lines(text: str | Column) -> Column:
    """Trimmed lines with content."""
    return F.filter(F.transform(F.split(column(text), "\n", -1), trim), lambda x: x != "")


def deduped_lines(text: str | Column) -> Column:
    """The text's distinct trimmed lines, in the order of their first appearance."""
    return F.array_join(F.array_distinct(lines(text)), "\n")


def normalised(text: str | Column) -> Column:
    """Line ends as LF, runs of blanks as one space, runs of LF as one, trimmed."""
    # a single space stays as it is, which is most of them
    value = F.regexp_replace(F.regexp_replace(column(text), "\r\n?", "\n"), "(?! (?![ \t]))[ \t]+", " ")
    return trim(F.regexp_replace(value, "\n{2,}", "\n"))


def units(text: str | Column) -> Column:
    """Sentences and lines: cut after . ! ? or an ellipsis before white space, and at line feeds."""
    parts = F.split(normalised(text), r"(?U)(?<=[.!?…])\s+|\n+", -1)
    return F.filter(F.transform(parts, trim), lambda x: x != "")


def tokens_estimate(text: str | Column) -> Column:
    return F.ceil(F.length(column(text)) / 4).cast("int")


def clip(text: str | Column, size: int) -> Column:
    return F.substring(column(text), 1, size)


def clamp_words(text: str | Column, size: int = 90) -> Column:
    """A text longer than size is cut there and loses the word that the cut goes through."""
    text = column(text)
    return F.when(F.length(text) > size, trim(F.regexp_replace(F.substring(text, 1, size), r"(?U)\s+\S*$", ""))).otherwise(text)


def without_needle(text: str, needle: str) -> str:
    """Text without the needle, also where taking one out joins another together: each goes as it closes, in one pass."""
    after = [0]  # how much of the needle's beginning stands at the end of the needle's first 1, 2, ... characters
    for c in needle[1:]:
        k = after[-1]
        while k and needle[k] != c:
            k = after[k - 1]
        after.append(k + (needle[k] == c))
    kept, state = [], [0]
    for c in text:
        k = state[-1]
        while k and needle[k] != c:
            k = after[k - 1]
        kept.append(c)
        state.append(k + (needle[k] == c))
        if state[-1] == len(needle):
            del kept[-len(needle) :], state[-len(needle) :]
    return "".join(kept)


def without_fixpoint(text: Column, needle: str) -> Column:
    """Text without the needle, also where taking one out joins another together.

    Three rounds of replacing leave none in all but hostile texts; what is left then goes to Python, where one pass takes
    out all, in time that grows with the text.
    """

    @F.pandas_udf(T.StringType())
    def bare(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: without_needle(t, needle), na_action="ignore")

    for _ in range(3):
        text = F.replace(text, F.lit(needle), F.lit(""))
    return F.coalesce(bare(F.when(text.contains(needle), text)), text)


def hardened(text: str | Column) -> Column:
    """Text without section marks and rulers."""
    # fixed values: what passes for a section mark and for a ruler
    text = F.regexp_replace(column(text), "[#＃]{2,}", "# # #")
    return F.regexp_replace(text, r"(?md)^[-*=]{3,}\s*$", "- - -")


def neutralised(text: str | Column) -> Column:
    """Text in which nothing passes for the structure of a prompt: section marks, rulers, source heads, the no-answer mark."""
    # the mark goes first, so that its removal can't build what is broken up after it; that in turn adds no mark
    text = hardened(without_fixpoint(column(text), NO_ANSWER))
    # fixed value: the head of a source in a prompt
    return F.regexp_replace(text, r"(?iU)\[\s*(\d+)\s*\]\s*\(\s*Źródło\s*:", "[ $1 ] ( Źródło :")


def escaped(text: str | Column) -> Column:
    """Text for HTML: the five characters with a meaning as entities."""
    text = column(text)
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text
