"""Removal of repeated multi-line chunks, with DataFrame functions only.

A rolling hash over the hashes of two neighbouring lines ends a chunk wherever it falls on a fixed residue, so
boundaries follow content and an insertion moves only those beside it. Chunks of two or more lines with words
are grouped over the corpus by their bytes (the shuffle hashes them, the grouping compares them); the first
occurrence by document id and position stays and the others go.

Chunks at the edge of a passage hold lines of its neighbours. So that passages go whole, a second chunking takes
each line with words together with the next one (and what is blank between them); these pairs overlap, are grouped by
the SHA-256 of their bytes, and runs of repeated pairs are merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A line hash is below this prime, so that the rolling sum stays far from overflow.
HASHES, STEP = 1_048_573, 31
#: A line with words, and the number from which on places are those of pairs.
WORDED, PAIRS = r"[^\x20\x09-\x0D]", 1 << 30


def bind(value: Column, body) -> Column:
    """body(value), with value computed once for a row and not once for each use in a nested lambda."""
    return F.transform(F.array(value), body)[0]


def chunks(text: Column, divisor: int) -> Column:
    """The text as an array of (chunk, multi, begin, end): joining the chunks with line feeds gives the text again.

    begin and end are a chunk's first and last line, counted from 1.
    """

    def cut(lines: Column) -> Column:
        def from_hashes(hashes: Column) -> Column:
            size = F.size(lines)
            rolling = lambda i: F.element_at(hashes, i) + STEP * F.element_at(hashes, i - 1)
            ends = F.filter(F.sequence(F.lit(1), size), lambda i: (i == size) | F.when(i > 1, F.pmod(F.xxhash64(rolling(i)), F.lit(divisor)) == 0).otherwise(False))
            return bind(ends, from_ends)

        def from_ends(ends: Column) -> Column:
            def one(end: Column, k: Column) -> Column:
                begin = F.when(k == 0, F.lit(1)).otherwise(F.element_at(ends, F.greatest(k, F.lit(1))) + 1)
                return bind(F.slice(lines, begin, end - begin + 1), lambda own: F.struct(F.array_join(own, "\n").alias("chunk"), (F.size(F.filter(own, lambda x: x.rlike(WORDED))) >= 2).alias("multi"), begin.cast("int").alias("begin"), end.cast("int").alias("end")))

            return F.transform(ends, one)

        return bind(F.transform(lines, lambda x: F.pmod(F.xxhash64(x), F.lit(HASHES))), from_hashes)

    return bind(F.split(text, "\n", -1), cut)


def numbers(first: int, size: Column) -> Column:
    """The numbers from first on, so many of them."""
    return F.when(size > 0, F.sequence(F.lit(first), F.greatest(size, F.lit(1)) + (first - 1))).otherwise(F.array().cast("array<int>"))


def worded_lines(lines: Column) -> Column:
    """The places, from 1, of the lines with words."""
    return F.filter(numbers(1, F.size(lines)), lambda i: F.element_at(lines, i).rlike(WORDED))


def pair(lines: Column, worded: Column, k: Column) -> Column:
    """The bytes from the line with words k (from 0) to the next one."""
    return F.array_join(F.slice(lines, worded[k], worded[k + 1] - worded[k] + 1), "\n").cast("binary")


def line_pairs(text: Column) -> Column:
    """(chunk, place) of the pairs of neighbouring lines with words: the digest stands for the bytes."""

    def from_lines(lines: Column) -> Column:
        one = lambda worded: lambda k: F.struct(F.unhex(F.sha2(pair(lines, worded, k), 256)).alias("chunk"), (k + PAIRS).alias("place"))
        return bind(worded_lines(lines), lambda worded: F.transform(numbers(0, F.size(worded) - 1), one(worded)))

    return bind(F.split(text, "\n", -1), from_lines)


def repeated_lines(lines: Column, worded: Column, firsts: Column) -> Column:
    """The places of the lines in pairs that aren't among the firsts. A pair that overlaps its own first one isn't a
    repeat: of four equal lines two stay."""

    def from_repeats(repeats: Column) -> Column:
        like_last = F.filter(repeats, lambda k: F.when(k > 0, pair(lines, worded, k) == pair(lines, worded, F.greatest(k, F.lit(1)) - 1)).otherwise(False))
        overlaps = F.transform(F.array_intersect(F.transform(like_last, lambda k: k - 1), firsts), lambda k: k + 1)
        return F.flatten(F.transform(F.array_except(repeats, overlaps), lambda k: F.sequence(worded[k], worded[k + 1])))

    return bind(F.array_except(numbers(0, F.size(worded) - 1), firsts), from_repeats)


def dedup_line_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = 3, carried: list[str] | None = None, pairs: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_chunks, n_removed, removed_chars and kept_text, and as a struct `carried`
    the columns of docs that are named.

    A null text is an empty one. Chunks with fewer than two lines with words always stay. Rows with a null id
    rank last; rows that repeat an id and a text count as one occurrence and get the same result; rows that
    share an id only are ranked by the digest of their text. Further columns are ignored. No rows give none. Long texts are
    cut whole; a task holds the chunks of one text at a time.

    With pairs, repeated pairs of neighbouring lines go too, so every passage of two or more whole lines with words
    that stands earlier goes whole, wherever chunks end; n_removed then counts the chunks that lose a line. Each line
    stays somewhere. A passage on one line is left to the operators for lines and substrings.
    """
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("text_sha")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), (F.struct(*carried) if carried else F.lit(None)).alias("carried"))
    multi = F.filter(F.transform(chunks(F.col("text"), divisor), lambda c, k: F.struct(c["chunk"].cast("binary").alias("chunk"), k.alias("place"), c["multi"].alias("multi"))), lambda c: c["multi"])
    units = F.transform(multi, lambda c: F.struct(c["chunk"].alias("chunk"), c["place"].alias("place")))
    cut = rows.select("doc_id", digest, F.explode(F.concat(units, line_pairs(F.col("text"))) if pairs else units).alias("c"))
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_sha", "c.place")
    firsts = cut.select(F.col("c.chunk").alias("chunk"), (F.col("c.place") >= PAIRS).alias("pair"), rank.alias("rank")).groupBy("chunk", "pair").agg(F.min("rank").alias("first"))
    kept = firsts.groupBy(F.col("first.doc_id").alias("kept_id"), F.col("first.text_sha").alias("kept_sha")).agg(F.collect_list("first.place").alias("firsts"))
    keyed = rows.withColumn("text_sha", digest)
    joined = keyed.join(kept, keyed.doc_id.eqNullSafe(kept.kept_id) & (keyed.text_sha == kept.kept_sha), "left")
    first = F.coalesce(F.col("firsts"), F.array().cast("array<int>"))

    def left_over(c: Column) -> Column:
        single = F.filter(F.sequence(F.lit(0), F.size(c) - 1), lambda i: ~c[i]["multi"])
        places = F.array_sort(F.concat(single, first))
        return bind(places, lambda p: F.struct(F.size(c).cast("long").alias("n_chunks"), (F.size(c) - F.size(p)).cast("long").alias("n_removed"), F.array_join(F.transform(p, lambda i: c[i]["chunk"]), "\n").alias("kept_text")))

    def lines_left(c: Column) -> Column:
        chunk_firsts, pair_firsts = F.filter(first, lambda p: p < PAIRS), F.transform(F.filter(first, lambda p: p >= PAIRS), lambda p: p - PAIRS)
        single = F.filter(numbers(0, F.size(c)), lambda i: ~c[i]["multi"])
        lost = F.array_except(F.array_except(numbers(0, F.size(c)), single), chunk_firsts)
        by_chunk = F.flatten(F.transform(lost, lambda i: F.sequence(c[i]["begin"], c[i]["end"])))
        chunk_of = F.flatten(F.transform(c, lambda x, k: F.array_repeat(k, x["end"] - x["begin"] + 1)))

        def from_lines(lines: Column) -> Column:
            by_pair = bind(worded_lines(lines), lambda worded: bind(pair_firsts, lambda p: repeated_lines(lines, worded, p)))
            return bind(F.array_distinct(F.concat(by_chunk, by_pair)), lambda gone: bind(chunk_of, lambda of: result(lines, gone, of)))

        def result(lines: Column, gone: Column, of: Column) -> Column:
            stay = F.array_except(numbers(1, F.size(lines)), gone)
            touched = F.array_distinct(F.transform(gone, lambda i: F.element_at(of, i)))
            return F.struct(F.size(c).cast("long").alias("n_chunks"), F.size(touched).cast("long").alias("n_removed"), F.array_join(F.transform(stay, lambda i: F.element_at(lines, i)), "\n").alias("kept_text"))

        return bind(F.split(F.col("text"), "\n", -1), from_lines)

    done = joined.select("doc_id", F.length("text").alias("chars"), bind(chunks(F.col("text"), divisor), lines_left if pairs else left_over).alias("r"), "carried")
    named = ["doc_id", "r.n_chunks", "r.n_removed", (F.col("chars") - F.length("r.kept_text")).cast("long").alias("removed_chars"), "r.kept_text"]
    return done.select(*named, *(["carried"] if carried else []))


def without_repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = None, divisor: int = 3, pairs: bool = False) -> DataFrame:
    """docs, all columns, with the text that is left (chars_col: its length); rows of which nothing is left go.

    Rows whose text was null or empty before stay as they were. Of ties the least id keeps the passage, as in
    dedup_line_chunks; repeated rows stay or go together; no rows give none; long texts are handled whole.
    """
    others = [c for c in docs.columns if c != text_col]
    null = max([*others, ""], key=len) + "_null"  # longer than any name there, so none of them
    kept = dedup_line_chunks(docs, id_col, text_col, divisor, [F.col(c) for c in others] + [F.col(text_col).isNull().alias(null)], pairs)
    kept = kept.where(F.col("kept_text").rlike(WORDED) | (F.col("n_removed") == 0))
    text = F.when(F.col("carried").getField(null), F.lit(None)).otherwise(F.col("kept_text"))
    columns = {c: F.col("carried").getField(c) for c in others} | {text_col: text}
    if chars_col in columns:
        columns[chars_col] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema[chars_col].dataType)).otherwise(columns[chars_col])
    return kept.select(*(columns[c].alias(c) for c in docs.columns))


def op10_line_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated chunks and pairs of lines of all documents removed."""
    return dedup_line_chunks(spark.read.parquet(f"{sf_dir}/documents.parquet"), pairs=True)
