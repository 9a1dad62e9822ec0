"""Places of rows in a total order, without putting the table into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.session import settle

PART_BITS = 33  #: monotonically_increasing_id holds the row of a partition in its lowest 33 bits


def numbered(rows: DataFrame, *keys: str, name: str = "place") -> DataFrame:
    """``rows`` with their place, from 0, in the ascending order of ``keys`` (nulls first; ties in any order).

    Rows are cut into ranges, sorted within them and written once with their row of the range; rows of
    earlier ranges are added from counts, of which there is one a range.
    """
    placed = settle(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", PART_BITS)
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", before).drop("_n")
    placed = placed.withColumn("_part", part).join(offsets, "_part")
    return placed.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << PART_BITS) - 1)).drop("_part", "_at", "_before")


def levels(rows: DataFrame, value: Column, count: int, name: str) -> DataFrame:
    """``rows`` with the level, 0 to count - 1, of a value among its distinct values: order is kept (nulls first)."""
    valued = rows.withColumn("_value", value)
    distinct = valued.select("_value").distinct()
    total = max(1, distinct.count())
    ranked = numbered(distinct, "_value").select(F.col("_value").alias("_v"), F.floor(F.col("place") * count / total).cast("int").alias(name))
    return valued.join(ranked, F.col("_value").eqNullSafe(F.col("_v"))).drop("_value", "_v")


def unused(df: DataFrame, name: str) -> str:
    """``name``, longer by underscores until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
