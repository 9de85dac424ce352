"""Placement of rows on shards by a permutation-filled lookup table, with DataFrame functions only.

Each shard prefers the slots of a prime-sized table in an order of its own (an offset and a step, both hashed
from its name); shards take turns claiming the next free slot of their order until the table is full. A row's
key is hashed to a slot, and the broadcast table tells its shard. The table has a fixed number of slots, so its
size doesn't depend on the rows, and adding or losing a shard moves few slots beside that shard's share.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537
#: A table of more slots than this isn't broadcast.
MOST_SLOTS = 5_000_011


def number(name: str, use: str) -> int:
    return int.from_bytes(hashlib.md5(f"{use}:{name}".encode()).digest()[:8], "big")


def filled(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The index of the shard that claims each slot; slots must be a prime above the number of shards."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need names of their own")
    if not len(shards) < slots <= MOST_SLOTS or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime above the number of shards, and of a size to broadcast")
    at = [number(s, "offset") % slots for s in shards]
    step = [number(s, "step") % (slots - 1) + 1 for s in shards]
    owner, free = [-1] * slots, slots
    while free:
        for k in range(min(len(shards), slots)):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            owner[at[k]] = k
            free -= 1
            if not free:
                break
    return owner


def slot_of(key: Column, slots: int) -> Column:
    """A key's slot: the first 60 bits of its MD5, so that any other engine finds the same. Null counts as empty."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def assign_shards(rows: DataFrame, key_col: str, shards: list[str], slots: int = SLOTS, slot_name: str = "slot", shard_name: str = "shard", spread_col: str | None = None) -> DataFrame:
    """rows, all columns, with the slot and the shard of each; columns of rows that have these names already are
    replaced, also where they are the key.

    Rows with a null key share the slot of the empty key. Rows with equal keys share a shard; with spread_col, those
    that are equal in it too, so that a key with much of the rows is spread by another column. Repeated rows share a
    shard; long rows count as others. An empty frame stays empty.
    """
    owners = ",".join(map(str, filled(shards, slots)))
    names = F.array(*map(F.lit, shards))
    placed = rows.sparkSession.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias(slot_name, "owner"))
    placed = placed.select(slot_name, F.element_at(names, F.col("owner").cast("int") + 1).alias(shard_name))
    key = rows[key_col]
    if spread_col is not None:
        key = F.concat_ws("\x1f", F.coalesce(key.cast("string"), F.lit("")), F.coalesce(rows[spread_col].cast("string"), F.lit("")))
    keyed = rows.select(*(rows[c] for c in rows.columns if c not in (slot_name, shard_name)), slot_of(key, slots).alias(slot_name))
    return keyed.join(F.broadcast(placed), slot_name)


SHARDS = [f"shard-{k:03d}" for k in range(64)]


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, whose whole row is carried."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    placed = assign_shards(docs, "doc_id", SHARDS)
    return placed.select("doc_id", "slot", "shard", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))


def oracle() -> str:
    owners = ",".join(map(str, filled(SHARDS)))
    return f"""
SELECT doc_id, slot::INTEGER AS slot, 'shard-' || lpad(owner[slot + 1]::VARCHAR, 3, '0') AS shard, n_bytes
FROM (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT % {SLOTS} AS slot FROM documents),
  (SELECT [{owners}] AS owner)
"""


ORACLE = oracle()
