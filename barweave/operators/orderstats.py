"""Exact order statistics per key from counts that merge, whatever the size of a key.

A round counts the values of each key in equal slots of an interval, keeps the slot that holds the wanted rank
and goes on inside it. Counts are added before the shuffle, so a task sends at most ``SLOTS`` rows for each key
and rank however many rows one key has. An interval is always spanned by two values of its own, so every round
parts them, and the search ends when one value is left.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.session import settle

SLOTS = 2048


def _slot(v: Column, lo: Column, hi: Column) -> Column:
    share = (v / 2 - lo / 2) / (hi / 2 - lo / 2)  # halves, so that no difference overflows
    inside = F.floor(F.nanvl(share, F.lit(0.5)) * SLOTS)
    # the ends have slots of their own, which keeps an interval from staying as it is
    return F.when(v <= lo, 0).when(v >= hi, SLOTS + 1).otherwise(F.least(F.greatest(inside + 1, F.lit(1)), F.lit(SLOTS)))


def order_statistics(rows: DataFrame, key: Sequence[str], value: Column, ranks: Callable[[Column], Sequence[Column]]) -> DataFrame:
    """(key, n, ranked): the values of the given ranks (from 1) of each key as an array, by ``ranks(n)`` of its row count.

    Nulls and NaN have no rank. A key without values gives no row.
    """
    key = list(key)
    own = key or ["_k"]
    held = (rows if key else rows.withColumn("_k", F.lit(0))).select(*own, value.cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    whole = held.groupBy(*own).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    wanted = F.array(*[r.cast("long") for r in ranks(F.col("n"))])
    state = settle(whole.select(*own, "n", F.posexplode(wanted).alias("_i", "_rank"), F.lit(0).cast("long").alias("_below"), "_lo", "_hi"))
    while True:
        open_ = state.filter("_lo < _hi")
        if open_.isEmpty():
            break
        inside = held.join(open_, own).filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        counted = inside.groupBy(*own, "n", "_i", "_rank", "_below", _slot(F.col("_v"), F.col("_lo"), F.col("_hi")).alias("_slot")).agg(
            F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
        )
        upto = F.col("_below") + F.sum("_c").over(Window.partitionBy(*own, "_i").orderBy("_slot"))  # at most SLOTS + 2 rows
        here = counted.withColumn("_upto", upto).filter((F.col("_upto") - F.col("_c") < F.col("_rank")) & (F.col("_rank") <= F.col("_upto")))
        state = settle(state.filter("_lo >= _hi").unionByName(here.select(*own, "n", "_i", "_rank", (F.col("_upto") - F.col("_c")).alias("_below"), "_lo", "_hi")))
    out = state.groupBy(*own, "n").agg(F.sort_array(F.collect_list(F.struct("_i", F.col("_lo").alias("v")))).alias("_r"))
    return out.select(*key, "n", F.transform("_r", lambda s: s["v"]).alias("ranked"))


def percentiles(rows: DataFrame, key: Sequence[str], value: Column, shares: Sequence[float]) -> DataFrame:
    """(key, n, percentiles): interpolated between the two order statistics around share * (n - 1)."""
    at = lambda n, p: (n - 1) * F.lit(p)
    found = order_statistics(rows, key, value, lambda n: [r for p in shares for r in (F.floor(at(n, p)) + 1, F.ceil(at(n, p)) + 1)])

    def between(k: int, p: float) -> Column:
        low, high, part = F.col("ranked")[2 * k], F.col("ranked")[2 * k + 1], at(F.col("n"), p) - F.floor(at(F.col("n"), p))
        return F.when(low == high, low).otherwise((1 - part) * low + part * high)

    return found.select(*key, "n", F.array(*[between(k, p) for k, p in enumerate(shares)]).alias("percentiles"))
