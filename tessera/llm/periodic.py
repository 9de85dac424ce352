"""Periodic runs of words: stretches that repeat themselves with some period, found on a harmonic grid.

For each period p the grid has the points jp. A run of period p and of two periods or more covers two neighbouring
points, so the longest common extensions of (jp, (j + 1)p), forward and backward, give its ends. Extensions are range
minima over the common prefixes of a suffix array, and over those of the reversed words for the backward ones. The grid
of n words has n ln n points. Each text is one task's row: nothing is shuffled.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .resampling import CRC, CRC_BYTES, CRC_TABLE

LEAST = 12
#: Grid points that are asked for at a time; bounds memory, not the result.
POINTS = 1 << 18
RUNS = "runs array<struct<start: long, length: long, period: long>>"


class Extensions:
    """Longest common extensions to the right, of any two positions of a sequence of word numbers."""

    def __init__(self, words: np.ndarray):
        n = self.n = len(words)
        levels = [words.astype(np.int64)]
        while True:  # ranks of the first 1, 2, 4 ... words of each suffix, until they differ
            width = 1 << (len(levels) - 1)
            second = np.zeros(n, np.int64)
            second[: max(n - width, 0)] = levels[-1][width:] + 1
            key = levels[-1] * (n + 2) + second
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
            if rank[order[-1]] == n - 1:
                break
            levels.append(rank)
        self.rank = rank
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(max(n - 1, 0), np.int32)
        for k in range(len(levels) - 1, -1, -1):  # common prefixes of neighbours in the suffix array
            level = np.append(levels.pop(), -1)
            same = (level[a] == level[b]) & (a < n) & (b < n)
            step = same.astype(np.int64) << k
            a, b, common = a + step, b + step, common + step.astype(np.int32)
        self.minima = [common]
        while 2 << (len(self.minima) - 1) <= len(common):
            half, last = 1 << (len(self.minima) - 1), self.minima[-1]
            self.minima.append(np.minimum(last[:-half], last[half:]))

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For i < j <= n; 0 where j is the end."""
        inside = j < self.n
        first, second = self.rank[np.where(inside, i, 0)], self.rank[np.where(inside, j, 1)]
        low, high = np.minimum(first, second), np.maximum(first, second)
        level = np.frexp(high - low)[1] - 1
        found = np.empty(len(i), np.int64)
        for k in np.unique(level):
            at = level == k
            found[at] = np.minimum(self.minima[k][low[at]], self.minima[k][high[at] - (1 << int(k))])
        return np.where(inside, found, 0)


def may_repeat(hashed: np.ndarray, least: int = LEAST) -> bool:
    """False only where no run can be: a quick look before the suffix arrays are made.

    A run of length l >= max(least, 2q) has l - q - w + 1 positions whose next w words come again at most q words later.
    So with the distances to the next place of the same w words in order, some k-th one is under k + w.
    """
    w = max(1, min(6, least // 2))
    n = len(hashed) - w + 1
    if n < 2:
        return False
    key = np.zeros(n, np.uint64)
    for k in range(w):
        key = key * np.uint64(0x9E3779B97F4A7C15) + (hashed[k : k + n] ^ (hashed[k : k + n] >> np.uint64(29)))
    plain = np.sort(key)
    if not (plain[1:] == plain[:-1]).any():
        return False
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    ahead = np.sort((order[1:] - order[:-1])[same])
    return bool((ahead <= np.arange(1, len(ahead) + 1) + w - 1).any())


def runs_of(words: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(start, length, period) of every run of at least max(least, 2 * period) words, by start, then period."""
    n, found = len(words), []
    ahead, back = Extensions(words), Extensions(words[::-1])
    periods = np.arange(1, n // 2 + 1)
    points = np.cumsum((n - 1) // periods)
    begin = 0
    while begin < len(periods):
        done = points[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(points, done + POINTS, "right")))
        some = periods[begin:end]
        count = (n - 1) // some
        p = np.repeat(some, count)
        i = (np.arange(len(p)) - np.repeat(np.cumsum(count) - count, count)) * p
        near = (words[i] == words[i + p]) | (words[i - 1] == words[i + p - 1])  # else both extensions are 0
        i, p = i[near], p[near]
        b, f = back.of(n - i - p, n - i), ahead.of(i, i + p)
        long = (b + f >= p) & (b + f + p >= least)
        found.append(np.stack([i - b, f + b + p, p], axis=1)[long])
        begin = end
    rows = np.concatenate([np.empty((0, 3), np.int64), *found])
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    if len(rows) > 1:  # several grid points tell of the same stretch, with its period and its multiples: the smallest stays
        rows = rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def words_left(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each of n words stays: no run contains it after that run's first period."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, runs[:, 0] + runs[:, 2], 1)
    np.add.at(marks, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(marks[:n]) == 0


def numbered(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = defaultdict(itertools.count().__next__)
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, runs, collapsed_text) of every row: its runs by start, then period, and the words outside of all
    repeats, joined by one space.

    A run is a stretch of words with the smallest period q, of max(least, 2q) words or more, that can't be extended
    either way; words are what ASCII white space separates. Null and empty texts have no words, no runs and an empty
    collapsed text; texts shorter than `least` words have no runs. Long texts are searched whole, in about 400 bytes a word.
    Runs that overlap are all told. Null and repeated ids pass through, a row each; no rows give none; further columns are
    ignored, whatever their names.
    """
    none = np.empty((0, 3), np.int64)

    def one(text: bytes) -> tuple[int, np.ndarray, bytes]:
        words = text.split()
        if len(words) < least or not may_repeat(np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64), least):
            return len(words), none, b" ".join(words)
        runs = runs_of(numbered(words), least)
        return len(words), runs, b" ".join(words[k] for k in np.flatnonzero(words_left(len(words), runs)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in batch.column(1)]
            every = np.concatenate([none, *(r[1] for r in rows)])
            struct = pa.StructArray.from_arrays([pa.array(every[:, k]) for k in range(3)], names=["start", "length", "period"])
            ends = np.cumsum([0, *(len(r[1]) for r in rows)])
            runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)
            columns = [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), runs, pa.array([r[2] for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed_text"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary"))
    found = picked.mapInArrow(work, f"doc_id long, n_words long, {RUNS}, collapsed_text binary")
    return found.withColumn("collapsed_text", F.col("collapsed_text").cast("string"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of docs, a tenth of them, by the hash h of their ids, made periodic from some word on: word i >= a becomes
    word a + (i - a) % p, where a = g % n, p = 1 + floor((n - a) / (3 + g % 8)), g = floor(h / 10). Null ids and texts stay."""
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    words = hashed.withColumn("w", F.when(F.col("h") % 10 == 0, F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))).withColumn("n", F.expr("nullif(greatest(size(w), 0), 0)"))
    where = words.withColumns({"a": F.expr("int((h div 10) % n)"), "k": F.expr("int(3 + (h div 10) % 8)")}).withColumn("p", F.expr("int(1 + (n - a) div k)"))
    made = F.array_join(F.expr("transform(w, (x, i) -> if(i < a, x, w[a + (i - a) % p]))"), " ")
    return where.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents after a tenth of them were made periodic: the longest, and digests of all runs and of what is left."""
    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("less"))))
    told = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"))
    return rows.select(
        "doc_id", "n_runs", (-F.col("b.before")).alias("start"), F.col("b.length").alias("length"), (-F.col("b.less")).alias("period"),
        F.expr("1000 * b.length div -b.less").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


#: Expected rows: pairs of equal six words at each distance, their islands are the runs, of equal stretches the smallest
#: distance is the period. A run of period q has at least six equal words at the distance q.
ORACLE = rf"""
WITH crc AS ({CRC_TABLE}),
t AS (SELECT row_number() OVER () AS r, doc_id, encode(doc_id::VARCHAR) AS b, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
y AS (SELECT *, {CRC_BYTES} AS bytes FROM t),
h AS (SELECT r, doc_id, w, len(w) AS n, {CRC} AS h FROM y, crc),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
d AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w FROM p),
u AS (SELECT r, n, unnest(range(n)) AS i, w FROM d),
g AS (SELECT r, n, i, array_to_string(w[i + 1:i + 6], ' ') AS gram FROM u WHERE i + 6 <= n),
e AS (SELECT x.r, x.i, z.i - x.i AS q FROM g x JOIN g z ON x.r = z.r AND x.gram = z.gram AND x.i < z.i AND 2 * (z.i - x.i) <= x.n),
k AS (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM e),
m AS (SELECT r, min(i) AS s, count(*) + 5 + q AS l, q FROM k GROUP BY r, q, island HAVING count(*) + 5 + q >= greatest(12, 2 * q)),
runs AS (SELECT r, s, l, min(q) AS q FROM m GROUP BY r, s, l),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM runs),
left_over AS (SELECT u.r, string_agg(u.w[u.i + 1], ' ' ORDER BY u.i) AS kept FROM u ANTI JOIN gone USING (r, i) GROUP BY u.r),
told AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS told, first(struct_pack(s := s, l := l, q := q) ORDER BY l DESC, s, q) AS b FROM runs GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.s::BIGINT AS start, b.l::BIGINT AS length, b.q::BIGINT AS period, (1000 * b.l // b.q)::BIGINT AS exponent_milli,
  sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN told USING (r) LEFT JOIN left_over USING (r)
"""
