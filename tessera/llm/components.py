"""Connected components of an edge table by alternating large and small stars, on Spark tables alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import all_salts, new_folder, remove, salt_of, written

SALTS = 8


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's least neighbour takes over its larger (or, for a small star, its smaller) neighbours."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    near = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else down
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    salted = near.withColumn("s", salt_of("v", SALTS)).join(least.withColumn("s", all_salts(SALTS)), ["u", "s"])
    if large:
        out = salted.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        # a node whose neighbours are all smaller still belongs to its least one
        out = out.unionByName(least.where("m < u").select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        out = salted.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges(a, b), longs; the component is its least node.

    Self-loops and nulls are left out; no edges give no rows. Ends when the table of edges no longer changes,
    when each is a star around its least node.
    """
    spark = edges.sparkSession
    folder, mark = new_folder(spark, "edges"), None
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", folder)
    while True:
        seen = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if (seen["n"], seen["x"]) == mark or seen["n"] == 0:
            break
        mark = (seen["n"], seen["x"])
        before, folder = folder, new_folder(spark, "edges")
        now = written(_star(_star(now, True), False), "edges", folder)
        remove(spark, before)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
