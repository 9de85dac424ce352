"""Removal of repeated lines or paragraphs, and of the repeated sentences within them.

Each text is cut into units: lines (or paragraphs) and, where those have several, their sentences. Units are
normalised (lower case, runs of ASCII white space as one space, ends trimmed) and hashed; over the whole corpus the
earliest occurrence of each digest stays, ranked by document id and place, and the others go. A passage that begins
and ends inside lines so loses its whole sentences. Where units stood in the original text is kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATOR = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n[ \t]*\n\s*")}
#: Sentences tile a line: anything up to and with a run of end marks.
SENTENCE = re.compile(r"[^.!?。！？]+[.!?。！？]*|[.!?。！？]+")
#: Sentences with fewer words aren't units of their own: alike by chance, not copied.
LEAST_WORDS = 5
UNITS = "doc_id long, text_key binary, place long, digest binary"
SPANS = "array<struct<begin: long, end: long>>"
RESULT = f"doc_id long, n_units long, n_removed long, removed_chars long, removed {SPANS}, kept_text string"


def normal(unit: str) -> bytes:
    return b" ".join(unit.lower().encode("utf-8", "surrogatepass").split())


def spans(text: str, unit: str) -> list[tuple[int, int]]:
    """Begin and end of each line or paragraph in code points; separators belong to none."""
    at, found = 0, []
    for cut in SEPARATOR[unit].finditer(text):
        found.append((at, cut.start()))
        at = cut.end()
    return [*found, (at, len(text))]


def units_of(text: str, unit: str, least_words: int | None) -> Iterator[tuple[int, list[tuple[int, int, bytes]]]]:
    """For each line or paragraph with content its number and units (begin, end, normal form): itself, then its
    sentences of least_words words or more, where it has several sentences."""
    for k, (a, b) in enumerate(spans(text, unit)):
        whole = text[a:b]
        plain = normal(whole)
        if plain:
            own = [(a, b, plain)]
            if least_words is not None:
                pieces = [(a + m.start(), a + m.end(), normal(m.group())) for m in SENTENCE.finditer(whole)]
                if len(pieces) > 1:
                    own += [p for p in pieces if p[2].count(b" ") + 1 >= least_words]
            yield k, own


def text_key(text: str) -> bytes:
    """Tells texts of one id apart."""
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:16]


def unit_digests(batches: Iterator[pa.RecordBatch], unit: str, least_words: int | None) -> Iterator[pa.RecordBatch]:
    """A row for each unit: its place counts the units of its text."""
    for batch in batches:
        ids, keys, places, digests = [], [], [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or ""
            own = [plain for _, units in units_of(text, unit, least_words) for _, _, plain in units]
            ids += [doc_id] * len(own)
            keys += [text_key(text)] * len(own)
            places += range(len(own))
            digests += [hashlib.sha256(plain).digest()[:16] for plain in own]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(places, pa.int64()), pa.array(digests, pa.binary())], names=["doc_id", "text_key", "place", "digest"])


def without(text: str, found: list[tuple[int, int]], lines: list[int], sentences: list[tuple[int, int]]) -> str:
    """The text less the lines, each with the separator after it, the last one with that before it, and less the sentences."""
    gone = set(lines)
    stay = [k for k in range(len(found)) if k not in gone]
    cuts = iter([*sentences, (len(text) + 1, 0)])
    cut, parts = next(cuts), []
    for k in stay:
        begin, end = found[k]
        while cut[0] < end:
            parts.append(text[begin : cut[0]])
            begin, cut = cut[1], next(cuts)
        parts.append(text[begin:end])
        if k != stay[-1]:
            parts.append(text[end : found[k + 1][0]])
        elif not lines or k > lines[-1]:
            parts.append(text[end:])
    return "".join(parts)


def cleaned(batches: Iterator[pa.RecordBatch], unit: str, least_words: int | None) -> Iterator[pa.RecordBatch]:
    types = [pa.int64()] * 4 + [pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.string()]
    names = ["doc_id", "n_units", "n_removed", "removed_chars", "removed", "kept_text"]
    for batch in batches:
        rows = []
        for doc_id, text, firsts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            text, firsts = text.as_py() or "", set(firsts or [])
            place, lines, sentences, gone = 0, [], [], []
            for k, units in units_of(text, unit, least_words):
                repeated = [u[:2] for i, u in enumerate(units) if place + i not in firsts]
                if place not in firsts:
                    lines.append(k)
                    repeated = repeated[:1]
                else:
                    sentences += repeated
                gone += repeated
                place += len(units)
            told = [{"begin": a, "end": b} for a, b in gone]
            rows.append((doc_id, place, len(gone), sum(b - a for a, b in gone), told, without(text, spans(text, unit), lines, sentences)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 6, types)], names=names)


def dedup_units(docs: DataFrame, unit: str = "line", id_col: str = "doc_id", text_col: str = "text", least_words: int | None = LEAST_WORDS) -> DataFrame:
    """One row per row of docs: its units with content, how many went and where they stood (in code points), and the
    text left.

    A line (unit="paragraph": a paragraph) that stands earlier goes whole, with a line end, and counts as one unit
    removed. Of a line that stays those sentences go that stand earlier, there or as lines, if they have least_words
    words or more (None: no sentences). The first occurrence of a unit always stays.

    Units without content stay and count as none. A null text is an empty one and gives an empty text; long texts
    are handled whole. Rows with a null id rank last. Rows that repeat an id and a text count as one occurrence and
    get the same result; rows that share an id only are ranked by the digest of their text. Further columns are
    ignored, whatever their names. No rows give none.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    units = rows.mapInArrow(lambda b: unit_digests(b, unit, least_words), UNITS)
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", "place")
    firsts = units.groupBy("digest").agg(F.min(rank).alias("first"))
    kept = firsts.groupBy(F.col("first.doc_id").alias("kept_id"), F.col("first.text_key").alias("kept_key")).agg(F.collect_list("first.place").alias("firsts"))
    keyed = rows.withColumn("text_key", F.substring(F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)), 1, 16))
    joined = keyed.join(kept, keyed.doc_id.eqNullSafe(kept.kept_id) & (keyed.text_key == kept.kept_key), "left")
    return joined.select("doc_id", "text", "firsts").mapInArrow(lambda b: cleaned(b, unit, least_words), RESULT)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and sentences of all documents that stand earlier removed."""
    found = dedup_units(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    told = F.array_join(F.transform("removed", lambda s: F.concat_ws("-", s["begin"], s["end"])), ",")
    return found.select("doc_id", "n_units", "n_removed", "removed_chars", told.alias("removed_spans"), "kept_text")


#: Expected rows: every line and sentence of the whole table with the first place where its normal form stands.
ORACLE = r"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
u AS (SELECT doc_id, i, a[i] AS line, regexp_extract_all(a[i], '[^.!?。！？]+[.!?。！？]*|[.!?。！？]+') AS p,
        i - 1 + coalesce(list_sum(list_transform(a[1:i - 1], lambda x: length(x))), 0)::BIGINT AS b
      FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM l)),
s AS (SELECT doc_id, i, 0 AS j, line AS piece, b FROM u
      UNION ALL SELECT doc_id, i, j, p[j], b + coalesce(list_sum(list_transform(p[1:j - 1], lambda x: length(x))), 0)::BIGINT FROM (SELECT *, unnest(range(1, len(p) + 1)) AS j FROM u WHERE len(p) > 1)),
n AS (SELECT *, trim(regexp_replace(lower(piece), '[ \t\n\r\x0b\x0c]+', ' ', 'g'), ' ') AS norm FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id, i, j) > 1 AS later FROM n WHERE norm <> '' AND (j = 0 OR len(norm) - len(replace(norm, ' ', '')) >= 4)),
g AS (SELECT k.*, bool_or(later AND j = 0) OVER (PARTITION BY doc_id, i) AS line_gone FROM k),
r AS (SELECT *, later AND (j = 0 OR NOT line_gone) AS gone FROM g),
f AS (SELECT doc_id, i, any_value(line_gone) AS line_gone, list(j) FILTER (gone AND j > 0) AS cut FROM r GROUP BY doc_id, i),
t AS (SELECT u.doc_id, u.i, CASE WHEN cut IS NULL THEN line ELSE array_to_string(list_transform(list_filter(range(1, len(p) + 1), lambda x: NOT list_contains(cut, x)), lambda x: p[x]), '') END AS line
      FROM u LEFT JOIN f USING (doc_id, i) WHERE NOT coalesce(line_gone, false)),
x AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS kept_text FROM t GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n_units, count(*) FILTER (gone) AS n_removed, coalesce(sum(length(piece)) FILTER (gone), 0) AS removed_chars,
        coalesce(string_agg(b || '-' || (b + length(piece)), ',' ORDER BY b, j) FILTER (gone), '') AS removed_spans FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n_units, 0)::BIGINT AS n_units, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed_chars, 0)::BIGINT AS removed_chars,
  coalesce(removed_spans, '') AS removed_spans, coalesce(kept_text, '') AS kept_text
FROM documents LEFT JOIN c USING (doc_id) LEFT JOIN x USING (doc_id)
"""
