"""Benchmark passages in documents, by SimHash of item-sized windows.

Windows of each benchmark item's number of words are hashed to 256-bit SimHash fingerprints. A multi-index over
blocks of two bits finds every item whose fingerprint is within the radius: if at most r bits differ, at most r
of the 128 blocks do, so 128 - r blocks vote for the item at least, where an unrelated one has 32 votes. Votes of many
windows are one matrix product. The weighted Jaccard similarity of the full shingle multisets decides.
A window can only be similar to an item if they share a shingle, so windows without any shingle of an item of
their size are passed over before they are fingerprinted; this loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .shingles import PLACES, WIDE, U, mixed, windows, word_hashes

BITS = 256
#: A pair at similarity 0.75 differs in 44 bits on average, with a deviation of 6; unrelated ones in 128.
RADIUS = 76
#: Items and bytes of benchmark text that a pass over the documents takes with it at most, about; more make more passes.
MOST_ITEMS, MOST_BYTES = 20_000, 32 << 20
#: Blocks of a fingerprint, and the values that one can have.
BLOCKS = 128
VALUES = 1 << (BITS // BLOCKS)
#: Windows fingerprinted at once; votes counted at once.
SOME, MOST_VOTES = 2048, 1 << 21
PAIRS = "doc_id long, item_id long, similarity double, begin long, end long"


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """The shingle at each place of a text, as windows of `size` words have them: for fewer than 5, one a window."""
    if size >= WIDE:
        return windows(words) if len(words) >= WIDE else np.zeros(0, U)
    n = len(words) - size + 1
    if n < 1 or not size:
        return np.zeros(0, U)
    return mixed(sum(words[k : k + n] * PLACES[k] for k in range(size)) + U(size))


def bit_votes(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each shingle (shingles x BITS)."""
    wide = np.stack([mixed(shingles + U(k * 0x9E3779B97F4A7C15 % 2**64)) for k in range(BITS // 64)], axis=1)
    return np.unpackbits(wide.astype("<u8").view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def fingerprints(shingles: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Bits (windows x BITS) of the windows of `width` shingles at the starts."""
    low = int(starts[0])
    sums = np.zeros((int(starts[-1]) + width - low + 1, BITS), np.int32)
    np.cumsum(bit_votes(shingles[low : int(starts[-1]) + width]), axis=0, dtype=np.int32, out=sums[1:])
    return sums[starts - low + width] - sums[starts - low] > 0


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the lesser counts of each shingle over the sum of the greater ones."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(at[: len(a)], minlength=len(names)), np.bincount(at[len(a) :], minlength=len(names))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


def block_table(bits: np.ndarray) -> np.ndarray:
    """For each fingerprint a 1 at the value of each of its blocks (fingerprints x BLOCKS * VALUES)."""
    values = bits.reshape(len(bits), BLOCKS, -1) @ (1 << np.arange(BITS // BLOCKS))
    table = np.zeros((len(bits), BLOCKS, VALUES), np.float32)
    np.put_along_axis(table, values[:, :, None], 1, axis=2)
    return table.reshape(len(bits), -1)


@dataclass
class Sized:
    """The items of one size in words: ids, shingles, fingerprints, and the multi-index over their blocks."""

    size: int
    ids: list[int | None]
    shingles: list[np.ndarray]

    def __post_init__(self):
        self.known = np.unique(np.concatenate(self.shingles))
        self.bits = np.stack([fingerprints(s, np.zeros(1, int), len(s))[0] for s in self.shingles])
        self.index = block_table(self.bits)

    def near(self, bits: np.ndarray) -> Iterator[tuple[int, int]]:
        """(window, item) for each pair within the radius: only pairs that enough blocks vote for are compared."""
        some = max(1, MOST_VOTES // len(self.ids))
        for begin in range(0, len(bits), some):
            part = bits[begin : begin + some]
            w, k = np.nonzero(block_table(part) @ self.index.T >= BLOCKS - RADIUS)
            close = (part[w] != self.bits[k]).sum(1) <= RADIUS
            yield from zip((w[close] + begin).tolist(), k[close].tolist())


class Benchmark:
    """The items of one pass, by size, and a filter of their shingles' low bits."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        by_size: dict[int, tuple[list, list]] = {}
        for item, text in items:
            words = word_hashes((text or "").encode("utf-8", "surrogatepass"))[0]
            if len(words):
                ids, shingles = by_size.setdefault(len(words), ([], []))
                ids.append(item)
                shingles.append(grams(words, len(words)))
        self.sizes = [Sized(n, *v) for n, v in sorted(by_size.items())]
        self.held = np.zeros(1 << 20, bool)
        self.owner: dict[int, list[Sized]] = {}
        for s in self.sizes:
            if s.size >= WIDE:
                self.held[(s.known & U((1 << 20) - 1)).astype(np.int64)] = True
                for g in s.known:
                    self.owner.setdefault(int(g), []).append(s)

    def starts(self, shingles: np.ndarray, sized: Sized, hits: np.ndarray, width: int) -> np.ndarray:
        """Places where a window of `width` shingles holds one of the hits."""
        last = len(shingles) - width
        marks = np.zeros(len(shingles) + 1, np.int32)
        np.add.at(marks, np.maximum(hits - width + 1, 0), 1)
        np.add.at(marks, np.minimum(hits, last) + 1, -1)
        return np.flatnonzero(np.cumsum(marks)[: last + 1] > 0)

    def find(self, text: bytes, percent: int) -> list[tuple[int | None, float, int, int]]:
        """(item, similarity, begin and end byte) of the best and then first window of each item that is similar enough."""
        words, begins, ends = word_hashes(text)
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        whole = grams(words, WIDE)
        at = np.flatnonzero(self.held[(whole & U((1 << 20) - 1)).astype(np.int64)])
        hit_sizes: dict[int, tuple[Sized, list[int]]] = {}
        for p in at:
            for s in self.owner.get(int(whole[p]), ()):
                hit_sizes.setdefault(s.size, (s, []))[1].append(int(p))
        for s in self.sizes:
            if s.size < WIDE:
                own = grams(words, s.size)
                found = np.flatnonzero(np.isin(own, s.known))
                if len(found):
                    hit_sizes[s.size] = (s, found.tolist())
        for size, (s, places) in sorted(hit_sizes.items()):
            shingles = whole if size >= WIDE else grams(words, size)
            width = min(len(s.shingles[0]), len(shingles))
            starts = self.starts(shingles, s, np.array(places), width)
            for begin in range(0, len(starts), SOME):
                some = starts[begin : begin + SOME]
                for run in np.split(some, np.flatnonzero(np.diff(some) > 4 * width) + 1):
                    for w, k in s.near(fingerprints(shingles, run, width)):
                        start = int(run[w])
                        value = weighted_similarity(shingles[start : start + width], s.shingles[k])
                        if 100 * value >= percent and value > best.get((size, k), (0.0,))[0]:
                            last = min(start + size, len(words)) - 1
                            best[size, k] = (value, int(begins[start]), int(ends[last]))
        names = {s.size: s.ids for s in self.sizes}
        return [(names[size][k], *v) for (size, k), v in best.items()]


def passes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int | None, str | None]]]:
    """The benchmark's items in groups of a bounded size."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text"))
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    groups = max(1, -(-size["n"] // MOST_ITEMS), -(-size["b"] // MOST_BYTES))
    for k in range(groups):
        some = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(groups)) == k)
        yield [(r["item"], r["text"]) for r in some.collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row per document and item with a window of at least percent similarity: doc_id, item_id, similarity, and
    the first best window's begin and end in code points.

    Words are cut at ASCII white space and A-Z lower-cased. Null or empty texts and items match nothing; items
    under five words match only as they stand. Long texts are searched whole, so many windows at a time. Null ids
    pass through; repeated rows give repeated pairs, and of equally similar windows the first is told; further
    columns are ignored, whatever their names. No documents or no items give no pairs.
    """

    def worker(items):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Benchmark(items)
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                    for item, value, begin, end in known.find(raw, percent):
                        first = len(raw[:begin].decode("utf-8", "surrogatepass"))
                        rows.append((doc_id, item, value, first, first + len(raw[begin:end].decode("utf-8", "surrogatepass"))))
                types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, types)], names=[c.split()[0] for c in PAIRS.split(", ")])

        return work

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary"))
    found = None
    for items in passes(benchmark):
        some = rows.mapInArrow(worker(items), PAIRS)
        found = some if found is None else found.unionByName(some)
    return found


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", percent: int = 75) -> DataFrame:
    """The rows of docs, all columns as they are, whose text has no window that similar to an item.

    Null and empty texts stay; repeated rows stay or go together; without items all rows stay; no rows give none. Every window
    of a text is looked at, however long it is.
    """

    def worker(items, at):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Benchmark(items)
            for batch in batches:
                texts = pc.cast(batch.column(at), pa.binary())
                yield batch.filter(pa.array([not (t.is_valid and known.find(t.as_buffer().to_pybytes(), percent)) for t in texts], pa.bool_()))

        return work

    for items in passes(benchmark):
        docs = docs.mapInArrow(worker(items, docs.columns.index(text_col)), docs.schema)
    return docs


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best window of each document and item that are alike, over whole tables."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("similarity", 9).alias("similarity"), "begin", "end")


#: Expected pairs: every item-sized window of each document that shares a shingle with an item (all items have five
#: words or more); and where the first best window stands.
ORACLE = r"""
WITH w AS (SELECT doc_id, text, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, text, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS a, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+') AS spaced FROM w),
g AS (SELECT doc_id, i, array_to_string(a[i:i + 4], ' ') AS g FROM (SELECT doc_id, a, unnest(range(1, len(a) - 3)) AS i FROM d)),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM benchmark),
q AS (SELECT item_id, len(a) AS m, array_to_string(a[i:i + 4], ' ') AS g FROM (SELECT item_id, a, unnest(range(1, len(a) - 3)) AS i FROM b)),
k AS (SELECT item_id, m, g, count(*) AS c FROM q GROUP BY ALL),
pairs AS (SELECT DISTINCT doc_id, item_id, m FROM g JOIN k USING (g)),
z AS (SELECT p.doc_id, p.item_id, p.m, len(a) AS n, least(p.m, len(a)) - 4 AS width FROM pairs p JOIN d USING (doc_id)),
starts AS (SELECT doc_id, item_id, m, n, width, unnest(range(1, n - 4 - width + 2)) AS s FROM z),
c AS (SELECT x.doc_id, x.item_id, s, g.g, count(*) AS c FROM starts x JOIN g ON g.doc_id = x.doc_id AND g.i BETWEEN s AND s + width - 1 GROUP BY ALL),
v AS (SELECT c.doc_id, c.item_id, s, sum(least(c.c, coalesce(k.c, 0))) AS shared FROM c LEFT JOIN k ON k.item_id = c.item_id AND k.g = c.g GROUP BY ALL),
r AS (SELECT v.doc_id, v.item_id, s, n, m, shared / (width + m - 4 - shared) AS sim FROM v JOIN z USING (doc_id, item_id)),
best AS (SELECT doc_id, item_id, max(sim) AS sim, arg_max(s, (sim, -s)) AS s, any_value(n) AS n, any_value(m) AS m FROM r WHERE sim >= 0.75::DOUBLE GROUP BY doc_id, item_id)
SELECT doc_id, item_id, round(sim, 9) AS similarity,
  (length(array_to_string(spaced[1:s], '')) - length(a[s]))::BIGINT AS begin, length(array_to_string(spaced[1:least(s + m - 1, n)], ''))::BIGINT AS "end"
FROM best JOIN d USING (doc_id)
"""
