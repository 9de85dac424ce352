"""Removal of byte strings that repeat across documents, by difference-cover sampling of suffixes.

The suffixes at positions whose remainder lies in a difference cover modulo 21 are sampled: of any two equal
50-byte strings some pair of sampled suffixes lies at the same offset under 21, and agrees in 30 bytes at least.
The samples' 30-byte prefixes are sorted in ranges of their hash and named by equality; a name that only one
sample bears finds no other string. The suffixes left (those with a shared name at an offset under 21)
are merged the same way: sorted in ranges, adjacent 50-byte prefixes compared, and of each class the smallest
document id found. A full ranking of all suffixes isn't needed for prefixes of a fixed length, so the recursion
on names ends at this depth.

Texts are dealt into blocks of bounded size, like ones mostly to the same block, where what they share is counted
once; exact copies of a text are one text of its smallest document. What goes between blocks and ranges are sorted, packed arrays of hashes (64 bits decide equality).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import all_salts, salt_of, written
from .shingles import BASE, WIDE, U, mixed, powers, windows, word_hashes

LENGTH = 50
#: A perfect difference cover: every remainder modulo 21 is a difference of two of these.
MODULUS, COVER = 21, np.array([0, 1, 6, 8, 18])
PREFIX = LENGTH - MODULUS + 1
BLOCK_BYTES = 8 << 20
SALTS = 16
NO_ID = 2**63 - 1
BYTE = np.random.default_rng(41).integers(1, 2**63, 256, dtype=np.uint64)
_BACK = pow(BASE, -1, 2**64)
#: Positions of a text that are hashed at once.
PART = 1 << 20
PACKED = "block int, range int, first binary, second binary, ids binary"
FIELDS = ["block", "range", "first", "second", "ids"]


def prefix_hashes(text: bytes, starts: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the `width` bytes at each start (ascending)."""
    codes = np.frombuffer(text, np.uint8)
    out = np.empty(len(starts), U)
    for low in range(0, len(text), PART):
        a, b = np.searchsorted(starts, [low, low + PART])
        if a < b:
            own = codes[low : low + PART + width]
            total = np.zeros(len(own) + 1, U)
            np.cumsum(BYTE[own] * powers(BASE, len(own)), out=total[1:])
            at = starts[a:b] - low
            out[a:b] = mixed((total[at + width] - total[at]) * powers(_BACK, len(own))[at])
    return out


def packed(values: np.ndarray) -> bytes:
    """Ascending numbers as their differences, byte planes compressed."""
    if not len(values):
        return b""
    steps = np.diff(values, prepend=U(0)).astype("<u8")
    planes = steps.view(np.uint8).reshape(-1, 8).T
    used = max(1, int(planes.any(axis=1).nonzero()[0].max(initial=0)) + 1)
    return bytes([used]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes[:used]).tobytes())


def unpacked(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, U)
    used = raw[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(used, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, :used] = planes.T
    return np.cumsum(wide.view("<u8").ravel(), dtype=U)


def small(values: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unsmall(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def ranged(values: np.ndarray, ranges: int, top: int) -> np.ndarray:
    """Where each of `ranges` ranges of numbers under 2**top begins in the ascending values, and their end."""
    limits = np.arange(ranges, dtype=np.uint64) * U((1 << top) // max(ranges, 2))  # of one range the limit is 0
    return np.append(np.searchsorted(values, limits), len(values))


def rows_of(rows: list[tuple]) -> pa.Table:
    types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, types)], names=FIELDS)


class Block:
    """The distinct texts of a block in the order of their smallest ids, one after another in one array of bytes."""

    def __init__(self, table: pa.Table):
        ids: dict[bytes, int] = {}
        texts: dict[bytes, bytes] = {}
        unpacker = zstandard.ZstdDecompressor()
        for sha, doc_id, text in zip(*(table.column(c).to_pylist() for c in ("sha", "doc_id", "text"))):
            ids[sha] = min(ids.get(sha, NO_ID), doc_id)
            if text is not None and sha not in texts:
                texts[sha] = unpacker.decompress(text)
        order = sorted(texts, key=lambda s: (ids[s], s))
        self.shas, self.ids = order, np.array([ids[s] for s in order], np.int64)
        self.sizes = np.array([len(texts[s]) for s in order], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.data = b"".join(texts[s] for s in order)

    def text(self, k: int) -> bytes:
        return self.data[self.begins[k] : self.begins[k] + self.sizes[k]]

    def sampled(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the sampled suffixes begin that have a whole prefix in their text, and the text of each."""
        periods = -(-self.sizes // MODULUS)
        of = np.repeat(np.arange(len(self.sizes), dtype=np.int32), periods)
        within = (np.arange(len(of)) - np.repeat(np.cumsum(periods) - periods, periods)) * MODULUS
        inside = (within[:, None] + COVER <= (self.sizes[of] - PREFIX)[:, None]).ravel()
        at = ((self.begins[of] + within)[:, None] + COVER).ravel()
        return at[inside], np.repeat(of, len(COVER))[inside]

    def samples(self, shift: int) -> np.ndarray:
        """Sampled prefixes' hashes, ascending; one that several samples of the block have stands here twice."""
        names = np.sort(prefix_hashes(self.data, self.sampled()[0], PREFIX) >> U(shift))
        same = np.concatenate([[False], names[1:] == names[:-1]])[: len(names)]
        third = np.concatenate([[False, False], same[2:] & same[1:-1]])[: len(names)]
        return names[~third]

    def suffixes(self, shared: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of the 50-byte prefix, text and place of each suffix with a sample under MODULUS further on that has a shared name."""
        at, of = self.sampled()
        if not len(shared) or not len(at):
            return np.zeros(0, U), np.zeros(0, np.int32), np.zeros(0, np.int64)
        names = prefix_hashes(self.data, at, PREFIX) >> U(shift)
        held = shared[np.minimum(np.searchsorted(shared, names), len(shared) - 1)] == names
        at, of = at[held], of[held]
        marks = np.bincount(np.maximum(at - MODULUS + 1, self.begins[of]), minlength=len(self.data) + 1)
        marks -= np.bincount(at + 1, minlength=len(self.data) + 1)
        places = np.flatnonzero(np.cumsum(marks, out=marks) > 0)
        texts = (np.searchsorted(self.begins, places, side="right") - 1).astype(np.int32)
        whole = places <= (self.begins + self.sizes - LENGTH)[texts]
        places, texts = places[whole], texts[whole]
        return prefix_hashes(self.data, places, LENGTH), texts, places


def grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values, ascending, where each begins in the order, and an order that sorts the values."""
    order = np.argsort(values)
    ranked = values[order]
    begins = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])[: len(values)])
    return ranked[begins], begins, order


def classes(hashes: np.ndarray, texts: np.ndarray, each: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """The distinct hashes, the first text (of the smallest id) that has each, and with `each` every suffix's class."""
    names, begins, order = grouped(hashes)
    if not len(names) or not each:
        return names, np.minimum.reduceat(texts[order], begins) if len(names) else texts, begins if each else None
    of = np.empty(len(hashes), np.int64)
    of[order] = np.repeat(np.arange(len(names)), np.diff(begins, append=len(hashes)))
    return names, np.minimum.reduceat(texts[order], begins), of  # texts ascend by their ids


def shared_names(table: pa.Table) -> pa.Table:
    """Of a range's packed samples, for each block those that occur twice or more over all blocks."""
    blocks, own = table.column("block").to_pylist(), [unpacked(r) for r in table.column("first").to_pylist()]
    every = np.sort(np.concatenate(own))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    place = table.column("range")[0].as_py()
    return rows_of([(b, place, packed(np.intersect1d(np.unique(x), twice, assume_unique=True)), None, None) for b, x in zip(blocks, own)])


def later_suffixes(table: pa.Table) -> pa.Table:
    """Of a range's packed classes, for each block a bit for each: whether a text of a smaller id has it too."""
    blocks = table.column("block").to_pylist()
    own = [unpacked(r) for r in table.column("first").to_pylist()]
    ids = [unpacked(i).view(np.int64)[unsmall(t)] for t, i in zip(table.column("second").to_pylist(), table.column("ids").to_pylist())]
    names, whose = np.concatenate(own), np.concatenate(ids)
    order = np.lexsort((whose, names))
    names, sorted_ids = names[order], whose[order]
    begin = np.concatenate([[True], names[1:] != names[:-1]])
    least = sorted_ids[begin][np.cumsum(begin) - 1]
    later = np.empty(len(names), bool)
    later[order] = sorted_ids > least
    cuts = np.cumsum([0, *map(len, own)])
    place = table.column("range")[0].as_py()
    return rows_of([(b, place, None, np.packbits(later[i:j]).tobytes(), None) for b, i, j in zip(blocks, cuts[:-1], cuts[1:])])


def union_of(table: pa.Table) -> np.ndarray:
    """All names in a block's rows of shared names, ascending as ranges are."""
    rows = sorted((r, x) for r, x in zip(table.column("range").to_pylist(), table.column("first").to_pylist()) if x)
    return np.concatenate([unpacked(x) for _, x in rows]) if rows else np.zeros(0, U)


RESULT = "sha binary, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin: long, end: long>>"


def cut_spans(text: bytes, starts: np.ndarray) -> tuple[list[dict], bytes]:
    """The maximal runs of bytes that strings at the starts cover, and the bytes left."""
    marks = np.zeros(len(text) + 1, np.int32)
    marks[starts] += 1
    np.add.at(marks, starts + LENGTH, -1)
    gone = np.cumsum(marks[:-1]) > 0
    edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    spans = [{"begin": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]
    return spans, np.frombuffer(text, np.uint8)[~gone].tobytes()


def in_blocks(ranges: int, shift: int) -> tuple[Callable, Callable, Callable]:
    """The three things done to a block: pack its samples; pack its suffixes' classes; cut its texts."""
    top = 64 - shift

    def samples(table: pa.Table) -> pa.Table:
        block, own = table.column("block")[0].as_py(), Block(table).samples(shift)
        at = ranged(own, ranges, top)
        return rows_of([(block, k, packed(own[i:j]), None, None) for k, (i, j) in enumerate(zip(at[:-1], at[1:])) if i < j])

    def suffixes(table: pa.Table, names: pa.Table) -> pa.Table:
        if not table.num_rows:
            return rows_of([])
        own = Block(table)
        hashes, texts, _ = own.suffixes(union_of(names), shift)
        distinct, first, _ = classes(hashes, texts, False)
        at, rows = ranged(distinct, ranges, 64), []
        block = table.column("block")[0].as_py()
        for k in np.flatnonzero(np.diff(at)).tolist():
            whose, of = np.unique(first[at[k] : at[k + 1]], return_inverse=True)
            rows.append((block, k, packed(distinct[at[k] : at[k + 1]]), small(of), packed(own.ids[whose].view(U))))
        return rows_of(rows)

    def cut(table: pa.Table, told: pa.Table) -> pa.Table:
        rows = []
        if table.num_rows:
            own = Block(table)
            hashes, texts, places = own.suffixes(union_of(told), shift)
            distinct, first, of = classes(hashes, texts, True)
            at = ranged(distinct, ranges, 64)
            later = np.zeros(len(distinct), bool)
            for k, bits in zip(told.column("range").to_pylist(), told.column("second").to_pylist()):
                if bits is not None:
                    later[at[k] : at[k + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(at[k + 1] - at[k])).astype(bool)
            # a class goes from every text but that of the smallest id; in the block the first text may have it
            hit = later[of] | (own.ids[texts] > own.ids[first[of]]) if len(of) else np.zeros(0, bool)
            places, texts = places[hit], texts[hit]
            limits = np.searchsorted(texts, np.arange(len(own.sizes) + 1))
            for k in np.flatnonzero(np.diff(limits)).tolist():
                starts = places[limits[k] : limits[k + 1]] - own.begins[k]
                if len(starts):
                    spans, kept = cut_spans(own.text(k), starts)
                    rows.append((own.shas[k], sum(s["end"] - s["begin"] for s in spans), len(spans), hashlib.sha256(kept).hexdigest(), spans))
        types = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))]
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, types)], names=["sha", "n_removed", "n_spans", "kept_sha256", "spans"])

    return samples, suffixes, cut


def likenesses(raws: list[bytes]) -> np.ndarray:
    """For each text a number that like texts mostly share: the least hash of its shingles, or of its words if it has
    fewer than five; the texts are hashed together."""
    least = np.full(len(raws), U(2**63 - 1))
    begins = np.cumsum([0, *(len(r) + 1 for r in raws)])[:-1]
    words, at, _ = word_hashes(b"\n".join(raws))
    if len(words):
        of = np.searchsorted(begins, at, side="right") - 1
        values, several = words.copy(), np.bincount(of, minlength=len(raws))[of] >= WIDE
        values[several] = U(2**64 - 1)
        if len(words) >= WIDE:
            whole = of[WIDE - 1 :] == of[: 1 - WIDE]
            values[: 1 - WIDE][whole] = windows(words)[whole]
        firsts = np.flatnonzero(np.diff(of, prepend=-1))
        least[of[firsts]] = np.minimum.reduceat(values, firsts) >> U(1)
    return least.view(np.int64)


def batched(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    """Where they begin, and the texts of some rows after another, of PART bytes or a little more together."""
    some, size, first = [], 0, 0
    for k, text in enumerate(batch.column(column)):
        some.append(text.as_buffer().to_pybytes() if text.is_valid else b"")
        size += len(some[-1])
        if size >= PART:
            yield first, some
            some, size, first = [], 0, k + 1
    if some:
        yield first, some


def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, raws in batched(batch, 1):
            columns = [pa.array([len(r) for r in raws], pa.int64()), pa.array([hashlib.sha256(r).digest() for r in raws], pa.binary()), pa.array(likenesses(raws))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(raws)), *columns], names=["doc_id", "n_bytes", "sha", "like"])


def distinct_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of texts of LENGTH bytes or more each distinct one once a task, compressed; of its other rows those with smaller ids, without it."""
    least: dict[bytes, int] = {}
    packer = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for first, raws in batched(batch, 1):
            rows = []
            for k, (raw, like) in enumerate(zip(raws, likenesses(raws).tolist()), first):
                if len(raw) < LENGTH:
                    continue
                sha, doc_id = hashlib.sha256(raw).digest(), NO_ID if ids[k] is None else ids[k]
                if doc_id < least.get(sha, NO_ID + 1):
                    rows.append((sha, doc_id, like, None if sha in least else packer.compress(raw)))
                    least[sha] = doc_id
            types = (pa.binary(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 4, types)], names=["sha", "doc_id", "like", "text"])


def in_block(texts: DataFrame, told: DataFrame, blocks: int, block_bytes: int) -> DataFrame:
    """texts with `block`. Texts of one likeness go to one block; a likeness that would overfill a block is dealt to
    several by the texts' digests. Such likenesses are few beside the texts and joined by salted keys."""
    distinct = told.where(F.col("n_bytes") >= LENGTH).groupBy("sha").agg(F.first("like").alias("like"), F.first("n_bytes").alias("n"))
    heavy = distinct.groupBy("like").agg(F.sum("n").alias("n")).where(F.col("n") > block_bytes // 4)
    heavy = written(heavy.select("like", F.ceil(4 * F.col("n") / block_bytes).alias("parts")), "likenesses").withColumn("salt", all_salts(SALTS))
    dealt = texts.withColumn("salt", salt_of("sha", SALTS)).join(heavy, ["like", "salt"], "left")
    part = F.pmod(F.xxhash64("sha"), F.coalesce("parts", F.lit(1)))
    return dealt.select(F.pmod(F.xxhash64("like", part), F.lit(blocks)).cast("int").alias("block"), "sha", "doc_id", "text")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the spans removed (in bytes).

    A byte goes if a 50-byte string over it also starts in a document with a smaller id. A null or empty text
    has no bytes. A row with a null id counts as larger than all others. Rows of one id don't affect each other
    unless they hold equal texts, and then get the same result. Further columns are ignored, whatever their names. No
    rows give none. A task holds a block of texts, block_bytes (BLOCK_BYTES) or one longer text, and a range of hashes
    of the size of a block's. Rows between blocks and ranges are at most as many as the hashes in them: where blocks
    are so many that these rows become small, larger blocks keep their number down.
    """
    block_bytes = block_bytes or BLOCK_BYTES
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    told = written(rows.mapInArrow(described, "doc_id long, n_bytes long, sha binary, like long"), "texts")
    total = told.agg(F.sum("n_bytes")).first()[0] or 0
    ranges = max(1, math.ceil(total / block_bytes))
    shift = max(0, 64 - 12 - max(20, math.ceil(math.log2(total + 1))))
    samples, suffixes, cut = in_blocks(ranges, shift)
    texts = in_block(rows.mapInArrow(distinct_texts, "sha binary, doc_id long, like long, text binary"), told, ranges, block_bytes)
    names = texts.groupBy("block").applyInArrow(samples, PACKED).groupBy("range").applyInArrow(shared_names, PACKED)
    found = texts.groupBy("block").cogroup(names.groupBy("block")).applyInArrow(suffixes, PACKED).groupBy("range").applyInArrow(later_suffixes, PACKED)
    done = written(texts.groupBy("block").cogroup(names.unionByName(found).groupBy("block")).applyInArrow(cut, RESULT), "spans")
    least = told.groupBy("sha").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("least"))
    of_text = least.join(done, "sha", "left").withColumn("salt", all_salts(SALTS))
    joined = told.withColumn("salt", salt_of("doc_id", SALTS)).join(of_text, ["sha", "salt"])
    whole = (F.coalesce("doc_id", F.lit(NO_ID)) > F.col("least")) & (F.col("n_bytes") >= LENGTH)
    none = F.array().cast("array<struct<begin: bigint, end: bigint>>")
    return joined.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
        F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("n_bytes").alias("end")))).otherwise(F.coalesce("spans", none)).alias("spans"),
    )


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents removed that long strings of earlier ones cover."""
    found = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    told = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["begin"], s["end"])), ",")
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", told.alias("removed_spans"))


#: Expected rows, over the hex digits of the texts: every 50-byte string with the least document it starts in.
ORACLE = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
p AS (SELECT doc_id, i, substr(x, 2 * i + 1, 2) AS byte, CASE WHEN i + 50 <= n THEN md5(substr(x, 2 * i + 1, 100)) END AS g FROM (SELECT doc_id, x, n, unnest(range(0, n)) AS i FROM h)),
s AS (SELECT doc_id, i, byte, g IS NOT NULL AND min(doc_id) OVER (PARTITION BY g) < doc_id AS hit FROM p),
b AS (SELECT doc_id, i, byte, coalesce(max(CASE WHEN hit THEN i END) OVER (PARTITION BY doc_id ORDER BY i) > i - 50, false) AS gone FROM s),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER w, false) AS first, gone AND NOT coalesce(lead(gone) OVER w, false) AS last FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
t AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (first) AS n_spans, coalesce(string_agg(byte, '' ORDER BY i) FILTER (NOT gone), '') AS kept,
  list(i ORDER BY i) FILTER (first) AS f, list(i + 1 ORDER BY i) FILTER (last) AS l FROM e GROUP BY doc_id)
SELECT h.doc_id, h.n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256,
  coalesce(array_to_string(list_transform(range(1, len(f) + 1), lambda k: f[k] || '-' || l[k]), ','), '') AS removed_spans
FROM h LEFT JOIN t USING (doc_id)
"""
