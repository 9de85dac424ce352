"""Near-duplicate documents by one-permutation MinHash.

Every document's shingle set is hashed once and its hash range cut into bins; the least hash of each bin is the
signature, and an empty bin takes the value of a bin that its own random probes reach first (optimal
densification). Bands of the signature are bucket keys. In each bucket the earliest document is the centre of a
star of candidate edges, so a bucket of m documents gives m - 1 pairs. Each candidate is confirmed on full sets.

Bands can miss a pair, most often one of small sets. So sets of up to SMALL shingles have further buckets, their
rarest shingles: of any two such sets that are similar enough, the prefixes in the order of rarity share one.

Stars alone could miss a link between two documents that are both unlike their centre. So buckets whose members
are still in several components after the stars are settled exactly: the documents outside the largest component are
dealt in blocks of bounded size and held against blocks of all, with full sets inside tasks, which give links and no
pairs. Members of the largest component aren't held against each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import all_salts, salt_of, written
from .components import components
from .shingles import U, mixed, set_digest, shingle_set, similar

#: 32 bands of 4 bins: a pair at 0.75 shares no bucket with a probability of 5e-6.
BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
SALTS = 8
#: Sets of up to so many shingles are also joined by their rarest ones; what makes a shingle a bucket key.
SMALL, SHINGLE_KEY = 128, "shingle"
#: Stands for no id in orders and joins.
NO_ID = 2**63 - 1
#: Members of a star in one piece of its verification; shingles and documents in a block of an unsettled group.
STAR_PART, BLOCK_SHINGLES, BLOCK_DOCUMENTS = 64, 1 << 19, 256
_BOUNDS = np.array([(k << 64) // BINS for k in range(BINS)], np.uint64)
_PROBES = np.random.default_rng(11).integers(0, BINS, (BINS, 512))


def signature(own: np.ndarray) -> np.ndarray:
    """The densified signature of a set that isn't empty (ascending hashes)."""
    at = np.searchsorted(own, _BOUNDS)
    full = at < np.append(at[1:], len(own))
    values = np.where(full, own[np.minimum(at, len(own) - 1)], U(0))
    empty = np.flatnonzero(~full)
    if len(empty):
        probes = _PROBES[empty]
        hit = full[probes]
        source = np.where(hit.any(1), probes[np.arange(len(empty)), hit.argmax(1)], np.flatnonzero(full)[mixed(empty.astype(U)) % U(full.sum())])
        values[empty] = values[source]
    return values


def band_keys(own: np.ndarray) -> np.ndarray:
    rows = signature(own).reshape(BANDS, ROWS)
    keys = np.arange(BANDS, dtype=U)
    for k in range(ROWS):
        keys = mixed(keys * U(0x9E3779B97F4A7C15) + rows[:, k])
    return keys.view(np.int64)


def node_of(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t.as_buffer().to_pybytes() if t.is_valid else None) for t in batch.column(1)]
        digests = [set_digest(s) if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array([d and node_of(d) for d in digests], pa.int64()),
                pa.array([band_keys(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
                pa.array([s.view(np.int64) if 0 < len(s) <= SMALL else None for s in sets], pa.list_(pa.int64())),
                batch.column(2),
            ],
            names=["doc_id", "n_shingles", "digest", "node", "bands", "small", "text_key"],
        )


def set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t.as_buffer().to_pybytes()) for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array([node_of(set_digest(s)) for s in sets], pa.int64()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["node", "own"])


def as_set(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u8")


def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, set of a, set of b) those with enough in common. Rows of a centre mostly come together."""
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = as_set(x.as_buffer()), as_set(y.as_buffer())
            keep.append(bool(similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
        yield pa.RecordBatch.from_arrays([pa.array([v for v, k in zip(a, keep) if k], pa.int64()), pa.array([v for v, k in zip(b, keep) if k], pa.int64())], names=["a", "b"])


def block_links(frame: pd.DataFrame) -> pd.DataFrame:
    """Links between the documents of two blocks that are in different components: for each document of the
    first block one with each component of the second at most, as more would join nothing further."""
    left, right = frame[frame["side"] == 0], frame[frame["side"] == 1]
    none = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    if not len(left) or not len(right):
        return none
    sets = [[as_set(r) for r in part["own"]] for part in (left, right)]
    shared = np.intersect1d(np.unique(np.concatenate(sets[0])), np.unique(np.concatenate(sets[1])), assume_unique=True)
    common = np.zeros((len(left), len(right)), np.float32)
    for begin in range(0, len(shared), 8192):
        some = shared[begin : begin + 8192]
        tables = []
        for part in sets:
            held = np.zeros((len(part), len(some)), np.float32)
            for k, own in enumerate(part):
                at = np.searchsorted(some, own[np.searchsorted(own, some[0]) : np.searchsorted(own, some[-1], side="right")])
                inside = own[np.searchsorted(own, some[0]) : np.searchsorted(own, some[-1], side="right")]
                good = some[np.minimum(at, len(some) - 1)] == inside
                held[k, at[good]] = 1
            tables.append(held)
        common += tables[0] @ tables[1].T
    sizes = [np.array([len(s) for s in part]) for part in sets]
    comps = [part["component"].to_numpy() for part in (left, right)]
    linked = similar(common.astype(np.int64), sizes[0][:, None], sizes[1][None, :]) & (comps[0][:, None] != comps[1][None, :])
    x, y = np.nonzero(linked)
    if not len(x):
        return none
    found = pd.DataFrame({"a": left["node"].to_numpy()[x], "b": right["node"].to_numpy()[y], "c": comps[1][y]})
    return found.drop_duplicates(["a", "c"])[["a", "b"]]


def star_edges(members: DataFrame) -> DataFrame:
    """Distinct (a, b): the centre of a bucket and a member whose sizes allow the similarity."""
    fits = (F.col("node") != F.col("centre")) & (100 * F.least("n", "centre_n") >= 75 * F.greatest("n", "centre_n"))
    return members.where(fits).select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()


def rare_keys(nodes: DataFrame) -> DataFrame:
    """(node, key): for each set of up to SMALL shingles, those of its prefix in the order of rarity that another one has.

    Sets x and y with a similarity of 0.75 have 3/4 of the shingles of either in common, so the |x| - ceil(3|x|/4) + 1
    rarest of x and the like of y share one. Shingles of one set alone come first in that order and find nothing.
    """
    held = nodes.where("small IS NOT NULL").select("node", "n", F.explode("small").alias("s"))
    counts = held.groupBy("s").agg(F.count("*").alias("df")).where("df > 1").withColumn("salt", all_salts(SALTS))
    shared = held.withColumn("salt", salt_of("node", SALTS)).join(counts, ["s", "salt"])
    own = shared.groupBy("node").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "s"))).alias("own"))
    prefix = F.col("n") - F.ceil(F.col("n") * 3 / 4) + 1
    keys = F.slice("own", F.lit(1), F.greatest(F.lit(0), prefix - (F.col("n") - F.size("own"))).cast("int"))
    return own.select("node", F.explode(keys).alias("k")).select("node", F.xxhash64(F.lit(SHINGLE_KEY), "k.s").alias("key"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (least id of the documents reachable by links), kept, and
    text_key, the MD5 of its text.

    Links are of at least 0.75 Jaccard similarity of 5-word shingle sets. A null or empty text has no shingles
    and is linked with nothing; long texts count whole. Rows with a null id take part, but name no component: a
    component without any id has a null component_id, and there all are kept. Rows of one id count as documents of
    their own; those with the same set are in one component, and kept follows the id. Further columns are ignored,
    whatever their names. No rows give none.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    keyed = rows.withColumn("text_key", F.unhex(F.md5(F.coalesce("text", F.lit(b"")))))
    told = written(keyed.mapInArrow(sketches, "doc_id long, n_shingles long, digest binary, node long, bands array<long>, small array<long>, text_key binary"), "sketches")
    # equal sets stand for each other: one node for a set, with its least id
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "bands", "small")).alias("first")
    nodes = written(told.where("n_shingles > 0").groupBy("digest", "node", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("id"), first).select("digest", "node", "n", "id", "first.bands", "first.small"), "nodes")
    order = F.coalesce("id", F.lit(NO_ID)).alias("id")
    banded = nodes.select("node", order, F.col("n").cast("int").alias("n"), F.explode("bands").alias("key"))
    small = nodes.where("small IS NOT NULL").select("node", order, F.col("n").cast("int").alias("n")).join(rare_keys(nodes), "node").select(banded.columns)
    banded = banded.unionByName(small)
    stars = banded.groupBy("key").agg(F.min(F.struct("id", "node", "n")).alias("c"), F.count("*").alias("m")).where("m > 1")
    stars = stars.select("key", F.col("c.node").alias("centre"), F.col("c.n").alias("centre_n"), all_salts(SALTS).alias("salt"))
    members = written(banded.withColumn("salt", salt_of("node", SALTS)).join(stars, ["key", "salt"]).select("key", "node", "n", "centre", "centre_n"), "members")
    edges = written(star_edges(members), "candidates")
    # full sets of the documents in buckets of two or more
    needed = members.select("node").distinct().join(nodes.select("node", order), "node")
    named = rows.where("text IS NOT NULL").withColumn("id", F.coalesce("doc_id", F.lit(NO_ID)))
    texts = named.join(needed.select("id").distinct(), "id", "left_semi")
    sets = written(texts.select("text").mapInArrow(set_rows, "node long, own binary").groupBy("node").agg(F.min("own").alias("own")), "sets")
    degrees = edges.groupBy("a").agg(F.ceil(F.count("*") / STAR_PART).cast("int").alias("parts"))
    dealt = edges.withColumn("salt", salt_of("b", SALTS)).join(degrees.withColumn("salt", all_salts(SALTS)), ["a", "salt"]).withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    centres = degrees.join(sets, F.col("a") == F.col("node")).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("own").alias("own_a"))
    pairs = dealt.select("a", "b", "part").join(sets.select(F.col("node").alias("b"), F.col("own").alias("own_b")), "b").join(centres, ["a", "part"])
    links = written(pairs.select("a", "b", "own_a", "own_b").mapInArrow(confirmed, "a long, b long"), "links")
    found = written(components(links), "components")
    more = written(settle(members, found, sets), "links")
    found = components(links.unionByName(more))
    named = nodes.join(found, "node", "left").select("digest", "id", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    classes = named.withColumn("salt", salt_of("digest", SALTS)).join(least.withColumn("salt", all_salts(SALTS)), ["component", "salt"])
    classes = classes.select("digest", "component_id", all_salts(SALTS).alias("salt"))
    # the salt comes from the row's id, and from nothing where it has none
    out = told.select("doc_id", "n_shingles", "digest", "text_key", salt_of("doc_id", SALTS).alias("salt")).join(classes, ["digest", "salt"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_key")


def settle(members: DataFrame, found: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between documents of a bucket that the stars left in different components."""
    of_node = found.select("node", F.col("component").alias("c"))
    whose = members.join(of_node, "node", "left").select("key", "node", "n", "centre", F.coalesce("c", "node").alias("component"))
    whose = written(whose, "whose")
    open_keys = whose.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max(F.when(F.col("node") == F.col("centre"), F.col("component"))).alias("g")).where("low <> high")
    opened = whose.withColumn("salt", salt_of("node", SALTS)).join(open_keys.select("key", "g", all_salts(SALTS).alias("salt")), ["key", "salt"])
    group = written(opened.select("g", "node", "n", "component").distinct(), "unsettled")
    # pairs inside the component with most members are linked already: only those outside it are held against all
    largest = group.groupBy("g", "component").agg(F.count("*").alias("m")).groupBy("g").agg(F.max_by("component", F.struct("m", "component")).alias("main"))
    apart = F.col("component") != F.col("main")
    blocks = lambda some: F.greatest(F.ceil(F.sum(F.when(some, F.col("n"))) / BLOCK_SHINGLES), F.ceil(F.count(F.when(some, 1)) / BLOCK_DOCUMENTS)).cast("int")
    salted = group.withColumn("salt", salt_of("node", SALTS))
    with_main = salted.join(largest.withColumn("salt", all_salts(SALTS)), ["g", "salt"])
    sizes = with_main.groupBy("g").agg(blocks(F.lit(True)).alias("every"), blocks(apart).alias("few"))
    placed = with_main.join(sizes.withColumn("salt", all_salts(SALTS)), ["g", "salt"]).select("g", "node", "component", apart.alias("apart"), "every", "few", F.xxhash64("node").alias("h"))
    place = lambda count: F.pmod(F.col("h"), F.col(count)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    left = placed.where("apart").select("g", "node", "component", place("few").alias("i"), each("every").alias("j"), F.lit(0).alias("side"))
    right = placed.select("g", "node", "component", each("few").alias("i"), place("every").alias("j"), F.lit(1).alias("side"))
    return left.unionByName(right).join(sets, "node").groupBy("g", "i", "j").applyInPandas(block_links, "a long, b long")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, that are kept: a row goes for its own text's component. A row
    without an id stays, and so does one without text or words. Of repeated rows all stay or go. Long texts count by their
    full sets; no rows give none."""
    dropped = near_duplicates(docs, id_col, text_col).where(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_dropped_id"), F.col("text_key").alias("_dropped_key")).distinct()
    key = F.unhex(F.md5(F.coalesce(docs[text_col].cast("string").cast("binary"), F.lit(b""))))
    return docs.join(dropped, (docs[id_col].cast("long") == dropped["_dropped_id"]) & (key == dropped["_dropped_key"]), "left_anti")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near duplicates of all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_key")


#: Expected rows: all pairs of documents with a shingle in common, their similarity, and what links reach.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(a[i:i + 4], ' ')) AS g FROM (SELECT doc_id, a, unnest(range(1, greatest(len(a) - 4, least(len(a), 1)) + 1)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
k AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)
"""
