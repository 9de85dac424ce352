"""Lines that many documents share, moved to one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import line_key, lines, trim
from ..sources.shared import written

#: Documents from which on lines are counted, documents and share that make a line boilerplate, share of a document that protects it.
LEAST_DOCUMENTS, LEAST_FREQUENCY, RATIO, PROTECTED = 5, 3, 0.30, 0.60
#: Shared lines at most: they are told to every task.
MOST_KEYS = 100_000


def text_lines(docs: DataFrame) -> DataFrame:
    """(post_id, place, line, key) of the trimmed lines with content."""
    rows = docs.select("post_id", F.posexplode(F.split("text", "\n", -1)).alias("place", "raw"))
    return rows.select("post_id", "place", trim("raw").alias("line")).where("line <> ''").withColumn("key", line_key("line"))


def document_frequency(docs: DataFrame) -> DataFrame:
    """(key, df): in how many documents each line stands."""
    return text_lines(docs).select("post_id", "key").distinct().groupBy("key").agg(F.count("*").alias("df"))


def boilerplate_keys(docs: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(key, df) of the lines that count as boilerplate: none among fewer than LEAST_DOCUMENTS documents."""
    n = docs.agg(F.count("*").alias("n")).scalar()
    enough = (n >= LEAST_DOCUMENTS) & (F.col("df") >= F.greatest(F.lit(LEAST_FREQUENCY), F.ceil(F.lit(ratio) * n))) & (F.col("df") / n >= F.lit(ratio))
    return document_frequency(docs).where(enough)


def shared_keys(keyed: DataFrame, n: int, ratio: float = RATIO) -> list[str]:
    """The keys that are boilerplate among n documents keyed(keys). A key stands in a share of `ratio` of the documents, so
    there are 1 / ratio keys at most for each line of an average document, however many documents there are; this is checked."""
    if n < LEAST_DOCUMENTS:
        return []
    counted = keyed.select(F.explode(F.array_distinct("keys")).alias("key")).groupBy("key").agg(F.count("*").alias("df"))
    enough = (F.col("df") >= F.greatest(F.lit(LEAST_FREQUENCY), F.ceil(F.lit(ratio) * n))) & (F.col("df") / n >= F.lit(ratio))
    keys = [r["key"] for r in counted.where(enough).select("key").limit(MOST_KEYS + 1).collect()]
    if len(keys) > MOST_KEYS:
        raise ValueError(f"more than {MOST_KEYS} lines stand in a share of {ratio} of the documents; take a higher ratio")
    return sorted(keys)


def marked(keyed: DataFrame, keys: list[str]) -> DataFrame:
    """keyed(post_id, text, keys) with `lines`, an array of (place, line, key, shared), and `whole`: too much would go, so
    all stays. Lines are marked inside their document's row; no text is shuffled."""
    shared = lambda key: key.isin(keys) if keys else F.lit(False)
    told = F.transform(F.arrays_zip(lines("text").alias("line"), F.col("keys").alias("key")), lambda x, k: F.struct(k.alias("place"), x["line"].alias("line"), x["key"].alias("key"), shared(x["key"]).alias("shared")))

    def both(own: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("some"), F.lit(0).cast("long").alias("every"))
        add = lambda s, x: F.struct((s["some"] + F.when(x["shared"], F.length(x["line"])).otherwise(0)).alias("some"), (s["every"] + F.length(x["line"])).alias("every"))
        whole = F.aggregate(own, start, add, lambda s: F.coalesce(F.try_divide(s["some"], s["every"]) >= F.lit(PROTECTED), F.lit(False)))
        return F.struct(own.alias("lines"), whole.alias("whole"))

    # out of a generator, as a plain projection would be worked out again in every filter above it
    return keyed.select("post_id", "text", F.inline(F.transform(F.array(told), both)))


def without_boilerplate(docs: DataFrame, ratio: float = RATIO, sink: int | None = None) -> DataFrame:
    """(post_id, text, removed): documents, a row each, less shared lines, `removed` of them; each shared line's first form
    goes to the sink (the smallest id by default) unless it still has the line. Documents left blank go; those without
    a removal keep their text as it was, and so do those of which PROTECTED or more would go.

    The keys of all lines, whose patterns are the costly part, are worked out once and written beside their texts; the
    shared ones, few and checked, are found by counting in place; a last pass rewrites each document by itself. The lines
    for the sink, one for each shared key, come together in its row only.
    """
    keyed = written(docs.select("post_id", "text", F.coalesce(F.transform(lines("text"), line_key), F.array().cast("array<string>")).alias("keys")), "line-keys")
    n, least = keyed.agg(F.count("*"), F.min("post_id")).first()
    target = sink if sink is not None else least
    keys = shared_keys(keyed, n, ratio)
    told = marked(keyed, keys)
    kept_lines = F.transform(F.filter("lines", lambda x: ~x["shared"]), lambda x: x["line"])
    removed = F.when(F.col("whole"), 0).otherwise(F.size("lines") - F.size(kept_lines)).cast("long")
    text = F.when(removed > 0, F.array_join(kept_lines, "\n")).otherwise(F.col("text"))
    cleaned = told.select("post_id", F.inline(F.array(F.struct(text.alias("text"), removed.alias("removed")))))
    if keys:
        at = F.struct("post_id", "x.place")
        gone = told.where("NOT whole").select("post_id", F.explode(F.filter("lines", lambda x: x["shared"])).alias("x"))
        firsts = gone.groupBy(F.col("x.key").alias("key")).agg(F.min_by("x.line", at).alias("line"), F.min(at).alias("at"))
        # a protected sink still has its shared lines; any other has lost them
        still = told.where((F.col("post_id") == target) & F.col("whole")).select(F.explode("lines").alias("x")).select(F.col("x.key").alias("key"))
        poured = firsts.join(still, "key", "left_anti").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("poured"))
        mine = F.col("post_id").eqNullSafe(F.lit(target))
        own = cleaned.where(mine).join(F.broadcast(poured), F.lit(True), "left")
        blank = F.coalesce(trim("text"), F.lit("")) == ""
        full = F.when(F.coalesce("poured", F.lit("")) == "", F.col("text")).when(blank, F.col("poured")).otherwise(F.concat_ws("\n", "text", "poured"))
        cleaned = cleaned.where(~mine).unionByName(own.select("post_id", full.alias("text"), "removed"))
    return cleaned.where(trim("text") != "")
