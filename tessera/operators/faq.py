"""Question and answer pairs: tolerant JSON, parsing, normalising, exports."""

from __future__ import annotations

import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clip, column, escaped, hardened, once, trim

# Lengths and number of pairs, keys that wrap a list of pairs.
QUESTION_CHARS, ANSWER_CHARS, MOST_PAIRS = 400, 4000, 50
WRAPPERS = ["faqs", "faq", "items", "questions", "pairs", "data", "results"]
# A fenced block, and how a list of objects begins.
FENCED, LISTED = r"```(?:json)?\s*(.+?)\s*```", r"\[\s*\{"
PAIR_LIST = T.ArrayType(T.StructType([T.StructField("question", T.StringType()), T.StructField("answer", T.StringType())]))

#: What JSON's texts begin and end with, and its other texts; an escape of half a surrogate pair; a mark behind decoded texts.
JSON_ENDS, JSON_SCALAR = ("{}", "[]", '""'), r"^(?:-?[0-9][0-9.eE+-]*|true|false|null)$"
SURROGATE = re.compile(r"\\u[dD][89a-fA-F]")
DECODED = "reply ends here"
#: The schema of a list of flat objects that have one of each two names at most, with strings or whole numbers there.
FLAT = r"^ARRAY<OBJECT<(?!.*\bquestion: .*\bq: |.*\bq: .*\bquestion: |.*\banswer: .*\ba: |.*\ba: .*\banswer: )(?!.*\b(?:question|q|answer|a): (?!STRING\b|BIGINT\b))\w+: [A-Z]+(?:\(\d+,\d+\))?(?:, \w+: [A-Z]+(?:\(\d+,\d+\))?)*>>$"


def repaired(text: str | None):
    """The JSON of a model's reply: as it is, from a fenced block, or from the first bracket (of a list of objects, if
    there is one) to the last; else None. Halves of surrogate pairs and nesting too deep to decode are no JSON."""
    text = text or ""
    tries = [text]
    if fenced := re.search(FENCED, text, re.S | re.I | re.A):
        tries.append(fenced[1].strip(" \t\n\r\0\x0b"))
    listed = re.search(LISTED, text, re.A)
    begin, end = listed.start() if listed else text.find("["), text.rfind("]")
    if 0 <= begin < end:
        tries.append(text[begin : end + 1])
    for some in tries:
        try:
            found = json.loads(some, parse_constant=_no_constant)
            if SURROGATE.search(some):
                json.dumps(found, ensure_ascii=False).encode()
        except (ValueError, RecursionError):
            continue
        if found is not None:
            return found
    return None


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


def _is_pair(item) -> bool:
    return isinstance(item, dict) and ("question" in item or "q" in item)


def pair_items(found) -> list:
    """The list of pairs in decoded JSON: itself, under a known key, under any key, or one pair alone."""
    if isinstance(found, list):
        return found
    if not isinstance(found, dict):
        return []
    for key in [*WRAPPERS, *found]:
        value = found.get(key)
        if isinstance(value, list) and value and _is_pair(value[0]):
            return value
    if _is_pair(found):
        return [found]
    return next((v for v in found.values() if isinstance(v, list)), [])


def _text(value) -> str:
    if isinstance(value, bool):
        return "1" if value else ""
    return str(value).strip(" \t\n\r\0\x0b") if isinstance(value, (str, int, float)) else ""


def parsed_pairs(text: str | None, count: int = MOST_PAIRS) -> list[dict]:
    """Pairs with a question and an answer, each question once (whatever its case), count at most."""
    pairs, seen = [], set()
    for item in pair_items(repaired(text)):
        if isinstance(item, dict):
            q, a = _text(item.get("question", item.get("q"))), _text(item.get("answer", item.get("a")))
            if q and a and q.lower() not in seen and len(pairs) < count:
                seen.add(q.lower())
                pairs.append({"question": q, "answer": a})
    return pairs


@F.pandas_udf(T.StringType())
def json_repaired(texts: pd.Series) -> pd.Series:
    found = texts.map(repaired)
    return found.map(lambda x: None if x is None else json.dumps(x, ensure_ascii=False))


@F.pandas_udf(PAIR_LIST)
def _pairs_by_python(texts: pd.Series, counts: pd.Series) -> pd.Series:
    return pd.Series([parsed_pairs(text, count) for text, count in zip(texts, counts, strict=True)], dtype=object)


def pairs_of(text: str | Column, count: int = MOST_PAIRS) -> Column:
    """parsed_pairs of a reply, by Python in batches."""
    return _pairs_by_python(column(text), F.lit(count))


def _decoded(text: Column) -> Column:
    """The JSON of a whole text as VARIANT; null for JSON's null and for what is none. Spark's parser passes over what
    follows a value, so the text is decoded as the first of two items: it must leave the second one."""
    both = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{DECODED}"]')))
    return once(both, lambda v: F.when(F.try_variant_get(v, "$[1]", "string") == DECODED, F.try_variant_get(v, "$[0]", "variant")))


def _between_brackets(text: Column) -> Column:
    """From the first bracket (of a list of objects, if there is one) to the last; null if there is no such part."""

    def cut(after: Column) -> Column:
        head = F.substring(text, F.lit(1), F.length(text) - F.length(after))
        plain = lambda head: F.when(~after.rlike(LISTED), F.substring(head, F.locate("[", head), F.length(head)))
        begin = lambda parts: F.when(F.size(parts) == 2, F.length(parts[0]) + 1)
        from_list = lambda head: once(once(F.split(head, LISTED, 2), begin), lambda k: F.when(k.isNotNull(), F.substring(head, k, F.length(head))).otherwise(plain(head)))
        return once(head, from_list)

    return F.when(text.contains("]"), once(F.substring_index(text, "]", -1), cut))


def native_pairs(text: str | Column, count: int = MOST_PAIRS) -> Column:
    """parsed_pairs of a reply by built-in functions; null where they can't be sure to find what it finds.

    Sure are: replies of which the first part that could be JSON (all of it, its fenced block, what is between
    brackets) is some, and holds a list of flat objects with strings or whole numbers as questions and answers, bare or
    under a known key; scalars; and replies without such a part. The others are lists under other keys or of other
    items, single pairs, repeated keys, escaped surrogates, fractions as texts and broken JSON.
    """
    ends = lambda t: reduce(Column.__or__, (t.startswith(a) & t.endswith(z) for a, z in JSON_ENDS)) | F.when(F.length(t) < 1000, t.rlike(JSON_SCALAR)).otherwise(t.startswith("-") | t.substr(1, 1).between("0", "9"))
    like_json = lambda part: F.when(once(F.btrim(part, F.lit(" \t\n\r")), ends), part)
    get = lambda v, path: F.try_variant_get(v, path, "variant")
    fields = "array<struct<question: string, q: string, answer: string, a: string>>"

    def part(text: Column) -> Column:
        found = F.coalesce(like_json(text), once(trim(F.regexp_extract(text, f"(?is){FENCED}", 1)), like_json), once(_between_brackets(text), like_json))
        return F.when(~text.contains(DECODED) & ~text.contains("\\ud") & ~text.contains("\\uD"), once(found, lambda c: F.when(c.isNull(), none).otherwise(once(_decoded(c), listed))))

    def listed(found: Column) -> Column:
        known = [F.when(F.coalesce(get(found, f"$.{key}[0].question"), get(found, f"$.{key}[0].q")).isNotNull(), get(found, f"$.{key}")) for key in WRAPPERS]
        kind = lambda k: F.when(k.startswith("ARRAY"), pairs(found, k)).when(k.startswith("OBJECT"), once(F.coalesce(*known), lambda v: pairs(v, F.schema_of_variant(v)))).when(k != "VOID", none)
        return once(F.schema_of_variant(found), kind)

    def pairs(found: Column, kind: Column) -> Column:
        text_of = lambda p, *names: trim(F.coalesce(*(p[name] for name in names), F.lit("")))
        pair = lambda p: F.struct(text_of(p, "question", "q").alias("question"), text_of(p, "answer", "a").alias("answer"))
        told = F.filter(F.transform(F.try_variant_get(found, "$", fields), pair), lambda p: (p["question"] != "") & (p["answer"] != ""))
        return F.when(kind.rlike(FLAT), once(told, distinct))

    def distinct(told: Column) -> Column:
        firsts = lambda keys: F.transform(F.slice(F.array_distinct(keys), 1, count), lambda key: F.get(told, (F.array_position(keys, key) - 1).cast("int")))
        return once(F.transform(told, lambda p: F.lower(p["question"])), firsts)

    none = F.array().cast(PAIR_LIST)
    return once(F.coalesce(column(text).cast("string"), F.lit("")), part)


def with_pairs(rows: DataFrame, text: str, name: str = "pairs", count: int = MOST_PAIRS, python: bool = True) -> DataFrame:
    """rows with the pairs of their replies: those with a question and an answer, each question once, count at most.

    The same as pairs_of, which takes less time; here only replies that native_pairs isn't sure about
    go to Python, and with python=False none does: they get null. A null or empty reply, and one without JSON, has no pairs.
    """
    native = max([*rows.columns, name], key=len) + "_native"  # longer than any name there, so none of them
    found = rows.withColumn(native, native_pairs(text, count))
    if python:
        return found.withColumn(name, F.coalesce(native, pairs_of(F.when(F.col(native).isNull(), F.col(text)), count))).drop(native)
    return found.withColumn(name, F.col(native)).drop(native)


def deduped(pairs: DataFrame, by: list[str], order: str, count: int = MOST_PAIRS) -> DataFrame:
    """pairs with each question of a group once, first by `order`, count at most."""
    first = F.row_number().over(Window.partitionBy(*by, F.lower(trim("question"))).orderBy(order))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return pairs.withColumn("_n", first).where("_n = 1").withColumn("_n", place).where(F.col("_n") <= count).drop("_n")


def normalised_pairs(pairs: str | Column, most: int = MOST_PAIRS) -> Column:
    """An array of pairs trimmed, without blank ones, clipped, most at most."""
    cut = F.transform(column(pairs), lambda p: F.struct(clip(trim(p["question"]), QUESTION_CHARS).alias("question"), clip(trim(p["answer"]), ANSWER_CHARS).alias("answer")))
    return F.slice(F.filter(cut, lambda p: (p["question"] != "") & (p["answer"] != "")), 1, most)


def as_html(pairs: str | Column, css: str = "faq") -> Column:
    one = lambda p: F.concat(F.lit(f'  <details class="{css}__item">\n    <summary class="{css}__q">'), escaped(p["question"]), F.lit(f'</summary>\n    <div class="{css}__a">'), escaped(p["answer"]), F.lit("</div>\n  </details>"))
    return F.array_join(F.concat(F.array(F.lit(f'<div class="{css}">')), F.transform(column(pairs), one), F.array(F.lit("</div>"))), "\n")


def as_gutenberg(pairs: str | Column) -> Column:
    one = lambda p: F.concat(F.lit('<!-- wp:heading {"level":3} -->\n<h3>'), escaped(p["question"]), F.lit("</h3>\n<!-- /wp:heading -->\n\n<!-- wp:paragraph -->\n<p>"), escaped(p["answer"]), F.lit("</p>\n<!-- /wp:paragraph -->"))
    return F.array_join(F.transform(column(pairs), one), "\n\n")


def _safe(text: Column) -> Column:
    """JSON that can stand in HTML."""
    for plain, code in (("<", "\\u003C"), (">", "\\u003E"), ("&", "\\u0026")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def as_json(pairs: str | Column) -> Column:
    return _safe(F.to_json(column(pairs), {"pretty": "true"}))


def as_jsonld(pairs: str | Column, page: Column | None = None, language: Column | None = None) -> Column:
    """A FAQPage; with an address and a language for a published one."""
    question = lambda p: F.struct(F.lit("Question").alias("@type"), p["question"].alias("name"), F.struct(F.lit("Answer").alias("@type"), p["answer"].alias("text")).alias("acceptedAnswer"))
    head = [F.lit("https://schema.org").alias("@context"), F.lit("FAQPage").alias("@type")]
    if page is not None:
        head.append(F.concat(page, F.lit("#faq")).alias("@id"))
    if language is not None:
        head.append(language.alias("inLanguage"))
    return _safe(F.to_json(F.struct(*head, F.transform(column(pairs), question).alias("mainEntity"))))


def element_id(prefix: str, index: Column) -> Column:
    return F.substring(F.md5(F.concat(F.lit(prefix), index.cast("string")).cast("binary")), 1, 7)


def as_elementor(pairs: str | Column, prefix: str = "faq-") -> Column:
    """A version 0.4 template: a section with a column with an accordion."""
    tab = lambda p, i: F.struct(p["question"].alias("tab_title"), p["answer"].alias("tab_content"), element_id(prefix, i + 3).alias("_id"))
    widget = F.struct(element_id(prefix, F.lit(2)).alias("id"), F.lit("widget").alias("elType"), F.lit("accordion").alias("widgetType"), F.struct(F.transform(column(pairs), tab).alias("tabs")).alias("settings"))
    inner = F.struct(element_id(prefix, F.lit(1)).alias("id"), F.lit("column").alias("elType"), F.struct(F.lit(100).alias("_column_size")).alias("settings"), F.array(widget).alias("elements"))
    section = F.struct(element_id(prefix, F.lit(0)).alias("id"), F.lit("section").alias("elType"), F.array(inner).alias("elements"))
    return _safe(F.to_json(F.struct(F.lit("0.4").alias("version"), F.lit("FAQ").alias("title"), F.lit("page").alias("type"), F.array(section).alias("content"))))


def as_text(pairs: str | Column) -> Column:
    return F.array_join(F.transform(column(pairs), lambda p: F.concat_ws("\n", p["question"], p["answer"])), "\n\n")


def exports(rows: DataFrame, pairs: str = "pairs") -> DataFrame:
    """rows with the five formats as columns; rows without pairs have none to export and go."""
    return rows.where(F.size(pairs) > 0).withColumns({"html": as_html(pairs), "gutenberg": as_gutenberg(pairs), "elementor": as_elementor(pairs), "json": as_json(pairs), "jsonld": as_jsonld(pairs)})


def page_schema(name: str, url: str, description: str, language: str) -> Column:
    """A WebApplication node; fields without a value are left out."""
    some = lambda c: F.when(trim(c) != "", trim(c))
    return F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("WebApplication").alias("@type"), some(name).alias("name"), some(url).alias("url"), some(description).alias("description"), some(language).alias("inLanguage")))


def generation_rows(entries: DataFrame) -> DataFrame:
    """Log rows of generations(id, created_at, topic, extra_desc, num_questions, language, user_id, pairs): the pairs as
    JSON, and their number where none is given."""
    pairs = F.coalesce("pairs", F.array().cast(PAIR_LIST))
    return entries.select(
        "id", "created_at", F.coalesce("topic", F.lit("")).alias("topic"), "extra_desc", F.coalesce(F.col("num_questions").cast("int"), F.size(pairs)).alias("num_questions"),
        F.coalesce("language", F.lit("pl")).alias("language"), F.coalesce("user_id", F.lit(0)).cast("long").alias("user_id"), F.to_json(pairs).alias("pairs_json"),
    )


def generation_prompt(topic: str, description: str, count: str, language: str) -> Column:
    """The prompt of a generation: what people wrote can't pass for its structure."""
    ask = F.concat(F.lit("Write "), F.col(count).cast("string"), F.lit(" questions with answers in "), F.col(language), F.lit(" as JSON."))
    return F.concat_ws("\n", ask, F.lit("### TOPIC"), hardened(topic), F.lit("### DESCRIPTION"), hardened(description))


def generator_params(rows: DataFrame, default_count: int = 8, default_language: str = "pl") -> DataFrame:
    """topic, description, count and language within their bounds."""
    count = F.when(F.coalesce("count", F.lit(0)) <= 0, default_count).otherwise(F.greatest(F.lit(5), F.least(F.lit(20), F.col("count"))))
    return rows.withColumns({"topic": clip("topic", 500), "description": clip("description", 8000), "count": count, "language": F.when(F.col("language").isin("pl", "en", "de"), F.col("language")).otherwise(default_language)})
