"""Numbers in an order over all rows, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

BITS = 33  # of monotonically_increasing_id: the position in the partition


def numbered(rows: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """rows with their number from 0 in the order given: positions in range-sorted partitions plus the rows before them.

    The sorted rows are written to the shared folder, so that a lost executor can't sort them anew in other ranges. Only
    the partitions' sizes, a row each, meet in one place.
    """
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id()), "ranges")
    part = F.shiftrightunsigned("__place", BITS)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n")).agg(F.collect_list(F.struct("__part", "__n")).alias("parts"))
    before = F.transform("parts", lambda p: F.struct(p["__part"].alias("__part"), F.aggregate(F.filter("parts", lambda q: q["__part"] < p["__part"]), F.lit(0).cast("long"), lambda a, q: a + q["__n"]).alias("__before")))
    offsets = sizes.select(F.explode(before).alias("o")).select("o.*")
    met = placed.withColumn("__part", part).join(F.broadcast(offsets), "__part", "left")
    return met.select(*rows.columns, (F.col("__before") + F.col("__place").bitwiseAND((1 << BITS) - 1)).alias(name))
