"""Ordered work per key without putting an unbounded key into one task.

A series ordered by a DATE column with a unique (key, date) cannot hold more rows than the
calendar has days, so an ordinary ``partitionBy(key)`` window is bounded whatever the data size.
A series ordered by anything else (ticks, intraday bars) has no such bound and one key may hold
a third of all rows. Those are numbered in two levels, cut into slices of fixed row count, and
each slice carries the few rows before and after it that its frames look at. Both ways give the
same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barweave.session import settle

SLICE_ROWS = 65_536


def calendar_bounded(df: DataFrame, order: str) -> bool:
    return isinstance(df.schema[order].dataType, T.DateType)


def row_index(df: DataFrame, key: Sequence[str], order: str, name: str = "rn") -> DataFrame:
    """1-based row number per key.

    Beyond the calendar bound the rows are cut into ranges of (key, order), written once with the
    number of their range, and numbered inside it; the rows of earlier ranges of the key are added
    from counts. A range holds its share of all rows however few keys or hours they fall into.
    """
    key = list(key)
    if calendar_bounded(df, order):
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(order)).cast("long"))
    # the number of a range depends on sampled bounds, so it is fixed by writing it
    ranged = settle(df.repartitionByRange(*key, order).withColumn("_range", F.spark_partition_id()))
    before = (
        ranged.groupBy(*key, "_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(
            "_before",
            F.coalesce(
                F.sum("_n").over(
                    Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .drop("_n")
    )
    within = Window.partitionBy(*key, "_range").orderBy(order)
    return (
        ranged.join(before, [*key, "_range"])
        .withColumn(name, F.col("_before") + F.row_number().over(within))
        .drop("_range", "_before")
    )


def over_rows(
    df: DataFrame,
    key: Sequence[str],
    order: str,
    build: Callable[[DataFrame, list[str]], DataFrame],
    back: int,
    ahead: int = 0,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Apply ``build(df, partition_columns)``, which adds columns from row frames that reach at
    most ``back`` rows back and ``ahead`` rows forward in total."""
    key = list(key)
    if calendar_bounded(df, order):
        return build(df, key)
    rows = row_index(df, key, order, "_rn").withColumn("_p", F.col("_rn") - 1)
    first = F.floor(F.greatest(F.col("_p") - ahead, F.lit(0)) / slice_rows)
    last = F.floor((F.col("_p") + back) / slice_rows)
    spread = rows.withColumn("_slice", F.explode(F.sequence(first, last)))
    out = build(spread, [*key, "_slice"])
    return out.filter(F.col("_slice") == F.floor(F.col("_p") / slice_rows)).drop("_slice", "_rn", "_p")


def running(
    df: DataFrame,
    key: Sequence[str],
    order: str,
    values: dict[str, Column],
    agg: Callable[[Column], Column],
    join: Callable[[Column, Column], Column],
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Cumulative ``agg(value)`` from the first row of the key to the current one, for each name in ``values``.

    ``join(before, here)`` merges the result of all earlier slices (NULL for the first) with the
    result inside the slice. All values share one numbering and one sort.
    """
    key = list(key)
    cum = (Window.unboundedPreceding, Window.currentRow)
    if calendar_bounded(df, order):
        w = Window.partitionBy(*key).orderBy(order).rowsBetween(*cum)
        return df.withColumns({name: agg(v).over(w) for name, v in values.items()})
    w = Window.partitionBy(*key, "_slice").orderBy(order).rowsBetween(*cum)
    rows = (
        row_index(df, key, order, "_rn")
        .withColumn("_slice", F.floor((F.col("_rn") - 1) / slice_rows))
        .withColumns({f"_here_{name}": agg(v).over(w) for name, v in values.items()})
    )
    # the result of a slice is the one at its last row, so it does not depend on how rows meet
    earlier = Window.partitionBy(*key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        rows.groupBy(*key, "_slice")
        .agg(*[F.max_by(f"_here_{name}", "_rn").alias(f"_a_{name}") for name in values])
        .select(*key, "_slice", *[agg(F.col(f"_a_{name}")).over(earlier).alias(f"_before_{name}") for name in values])
    )
    return (
        rows.join(carried, [*key, "_slice"])
        .withColumns({name: join(F.col(f"_before_{name}"), F.col(f"_here_{name}")) for name in values})
        .drop("_rn", "_slice", *[f"{part}_{name}" for name in values for part in ("_here", "_before")])
    )
