"""Per-symbol summaries: metrics, bar records and descriptive attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barweave.operators.metrics import performance_metrics
from barweave.operators.quality import drop_incomplete_bars
from barweave.operators.returns import simple_returns
from barweave.operators.series import calendar_bounded
from barweave.schemas import BAR_COLUMNS

# Defaults of unknown attributes.
ATTRIBUTES = {"sector": "N/A", "industry": "N/A", "market_cap": 0, "currency": "USD", "exchange": "N/A"}


def asset_summary(bars: DataFrame, benchmark: DataFrame | None = None, key: str = "symbol", order: str = "dt", records: bool = True) -> DataFrame:
    """One row per symbol: number of returns, metrics and the complete bars as an array in date order.

    The array holds one record per calendar day; series ordered by anything else get no records.
    """
    usable = drop_incomplete_bars(bars)
    returns = simple_returns(usable, key=(key,), order=order).select(key, order, "ret")
    points = returns.groupBy(key).agg(F.count(F.lit(1)).alias("data_points"))
    out = performance_metrics(returns, (key,), order=order, benchmark=benchmark).join(points, key)
    if not records or not calendar_bounded(bars, order):
        return out
    record = F.struct(order, *[c for c in BAR_COLUMNS if c != "volume"], F.col("volume").cast("long").alias("volume"))
    prices = usable.groupBy(key).agg(F.sort_array(F.collect_list(record)).alias("prices"))
    return out.join(prices, key)


def symbol_lookup(symbols: DataFrame, attributes: DataFrame, key: str = "symbol") -> DataFrame:
    """Attributes of each symbol with defaults: the long name, else the short one, else N/A."""
    found = symbols.select(key).join(attributes, key, "left")
    have = set(attributes.columns)
    names = [F.col(c) for c in ("long_name", "short_name") if c in have]
    rest = [F.coalesce(*([F.col(c)] if c in have else []), F.lit(v)).alias(c) for c, v in ATTRIBUTES.items()]
    return found.select(key, F.coalesce(*names, F.lit("N/A")).alias("name"), *rest)
