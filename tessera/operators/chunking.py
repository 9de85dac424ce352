"""Texts as overlapping chunks: units packed greedily, long units cut, the tail of a chunk before the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash, once, tokens_estimate, trim, units

TARGET, OVERLAP = 1000, 200


def pieces(unit_list: Column, target: int = TARGET) -> Column:
    """Units no longer than target, longer ones cut at every target characters."""
    cut = lambda u: F.when(F.length(u) <= target, F.array(u)).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.length(u) - 1) / target).cast("int")), lambda k: F.substring(u, k * target + 1, F.lit(target))))
    return F.flatten(F.transform(unit_list, cut))


def packed(piece_list: Column, target: int = TARGET) -> Column:
    """Chunks of at most target characters, each as many pieces as fit, joined by a space; a blank last one goes.

    Where chunks begin is folded from lengths alone, and each chunk is joined once.
    """
    start = F.struct(F.array().cast("array<int>").alias("begins"), F.lit(0).alias("i"), F.lit(0).alias("used"))

    def fold(state: Column, piece: Column) -> Column:
        size, i = F.length(piece), state["i"] + 1
        fits = (state["used"] > 0) & (state["used"] + 1 + size <= target)
        return F.struct(F.when(fits, state["begins"]).otherwise(F.concat(state["begins"], F.array(i))).alias("begins"), i.alias("i"), F.when(fits, state["used"] + 1 + size).otherwise(size).alias("used"))

    def joined(pieces: Column) -> Column:
        def cut(begins: Column) -> Column:
            end = lambda k: F.coalesce(F.get(begins, k + 1), F.size(pieces) + 1)
            return F.transform(begins, lambda begin, k: F.array_join(F.slice(pieces, begin, end(k) - begin), " "))

        chunks = once(F.aggregate(pieces, start, fold, lambda s: s["begins"]), cut)
        return once(chunks, lambda c: F.when(trim(F.get(c, F.size(c) - 1)) == "", F.slice(c, F.lit(1), F.size(c) - 1)).otherwise(c))

    return once(piece_list, joined)


def tail(chunk: Column, size: int) -> Column:
    """The last characters of a chunk from the first word boundary on; all of a shorter one."""
    end = F.right(chunk, F.lit(size))
    space = F.instr(end, " ")
    whole = F.when((space > 0) & (space < F.length(end)), F.substring(end, space + 1, F.lit(size))).otherwise(end)
    return F.when(F.length(chunk) <= size, chunk).otherwise(whole)


def overlapped(chunk_list: Column, size: int = OVERLAP) -> Column:
    """Each chunk after the first with the tail of the one before it in front."""
    if size <= 0:
        return chunk_list
    return F.transform(chunk_list, lambda c, i: F.when(i == 0, c).otherwise(F.concat_ws(" ", tail(F.element_at(chunk_list, F.greatest(i, F.lit(1))), size), c)))


def with_units(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("units", units(text))


def chunk_documents(docs: DataFrame, signature: str = "", target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """Rows (post_id, chunk_index, content, content_hash, tokens) of documents (post_id, title, text)."""
    base = docs.select("post_id", trim("title").alias("title"), packed(pieces(units("text"), target), target).alias("base"))
    rows = base.select("post_id", "title", F.posexplode(overlapped(F.col("base"), overlap)).alias("chunk_index", "piece"))
    content = F.when(F.coalesce("title", F.lit("")) == "", F.col("piece")).otherwise(F.concat_ws("\n", "title", "piece"))
    signed = F.concat_ws("\n", F.lit(signature), content) if signature else content
    return rows.select("post_id", "chunk_index", content.alias("content"), content_hash(signed).alias("content_hash"), tokens_estimate(content).alias("tokens"))
