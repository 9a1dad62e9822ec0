"""Returns, curves, date filters, panels and alignment of return series."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.functions.exprs import ratio
from barweave.operators.series import over_rows, running
from barweave.session import settle


def simple_returns(
    bars: DataFrame, price: str = "adj_close", key: Sequence[str] = ("symbol",), order: str = "dt", drop_first: bool = True
) -> DataFrame:
    """Adds ``ret`` = p / previous p - 1."""

    def build(df: DataFrame, part: list[str]) -> DataFrame:
        o = Window.partitionBy(*part).orderBy(order)
        return df.withColumn("ret", ratio(F.col(price), F.lag(price).over(o)) - 1)

    out = over_rows(bars, key, order, build, back=1)
    return out.filter(F.col("ret").isNotNull()) if drop_first else out


def log_returns(
    bars: DataFrame, price: str = "adj_close", key: Sequence[str] = ("symbol",), order: str = "dt", drop_first: bool = True
) -> DataFrame:
    """Adds ``log_ret`` = ln(p / previous p)."""

    def build(df: DataFrame, part: list[str]) -> DataFrame:
        o = Window.partitionBy(*part).orderBy(order)
        return df.withColumn("log_ret", F.ln(ratio(F.col(price), F.lag(price).over(o))))

    out = over_rows(bars, key, order, build, back=1)
    return out.filter(F.col("log_ret").isNotNull()) if drop_first else out


def equity_curve(returns: DataFrame, key: Sequence[str] = ("symbol",), order: str = "dt", ret: str = "ret", **kw) -> DataFrame:
    """Adds ``equity``, the running product of 1 + r."""
    return running(
        returns,
        key,
        order,
        {"equity": 1.0 + F.col(ret)},
        F.product,
        lambda before, here: F.coalesce(before, F.lit(1.0)) * here,
        **kw,
    )


def drawdown_curve(returns: DataFrame, key: Sequence[str] = ("symbol",), order: str = "dt", ret: str = "ret", **kw) -> DataFrame:
    """Adds ``equity`` and ``drawdown``; the peak starts at the first compounded value, not at 1."""
    curve = equity_curve(returns, key, order, ret, **kw)
    peak = running(curve, key, order, {"_peak": F.col("equity")}, F.max, lambda b, h: F.greatest(b, h), **kw)
    return peak.withColumn("drawdown", ratio(F.col("equity"), F.col("_peak")) - 1).drop("_peak")


# ---- date filters and panels ----------------------------------------------------------------


def date_range_filter(df: DataFrame, start: str | Column, end: str | Column, order: str = "dt") -> DataFrame:
    start = F.to_date(F.lit(start)) if isinstance(start, str) else start
    end = F.to_date(F.lit(end)) if isinstance(end, str) else end
    return df.filter(F.col(order).between(start, end))


# Period names and the interval each stands for.
PERIOD_PATTERN = re.compile(r"^(\d+)(d|mo|y)$")
PERIOD_UNITS = {"d": "DAY", "mo": "MONTH", "y": "YEAR"}


def period_interval(period: str) -> Column:
    m = PERIOD_PATTERN.match(period)
    if not m:
        raise ValueError(f"unknown period {period!r}")
    return F.expr(f"INTERVAL {int(m.group(1))} {PERIOD_UNITS[m.group(2)]}")


def lookback_filter(df: DataFrame, period: str, order: str = "dt") -> DataFrame:
    """Rows after (last date - period); the last date is one scalar subquery."""
    last = df.select(F.max(order)).scalar()
    return df.filter(F.col(order) > last - period_interval(period))


def drop_all_null_dates(df: DataFrame, value: str = "adj_close") -> DataFrame:
    """In long form a date without any price is a date without rows."""
    return df.filter(F.col(value).isNotNull())


def complete_dates_only(df: DataFrame, item: str = "symbol", order: str = "dt", value: str = "adj_close", items: Column | None = None) -> DataFrame:
    """Rows of dates on which every item has a value. Items and dates are counted by aggregation,
    and the dates come back through a semi join. ``items`` is the number of items where it is known."""
    have = df.filter(F.col(value).isNotNull())
    if items is None:
        items = have.select(F.count_distinct(item)).scalar()
    days = have.groupBy(order).agg(F.count_distinct(item).alias("_n")).filter(F.col("_n") == items).select(order)
    return have.join(days, order, "left_semi")


def filled_panel(bars: DataFrame, price: str = "adj_close", item: str = "symbol", order: str = "dt") -> DataFrame:
    """(symbol, dt, price) on the common calendar: a price holds until the next bar of its symbol,
    and dates before every symbol has started are dropped.

    Each bar is expanded over the days to the next one, then reduced to calendar days, so the work
    grows with the gaps and not with symbols x dates. The bars are written once: calendar, last
    date, number of symbols and rows all come from them.
    """
    have = settle(bars.filter(F.col(price).isNotNull()).select(item, order, F.col(price).alias("price")))
    calendar = have.select(order).distinct()
    last = have.select(F.max(order)).scalar()
    o = Window.partitionBy(item).orderBy(order)
    held = have.withColumn("_until", F.coalesce(F.date_sub(F.lead(order).over(o), 1), last))
    days = held.select(item, F.explode(F.sequence(order, "_until")).alias(order), "price")
    items = have.select(F.count_distinct(item)).scalar()
    return complete_dates_only(days.join(calendar, order, "left_semi"), item, order, "price", items)


def rebuild_panel(bars: DataFrame, symbols: Sequence[str], price: str = "adj_close", how: str = "any") -> DataFrame:
    """Wide date x symbol prices from per-symbol bars; ``how`` = any (complete dates) or all.

    The symbol list is given, so the pivot needs no pass to find its columns."""
    return bars.groupBy("dt").pivot("symbol", list(symbols)).agg(F.first(price)).na.drop(how, subset=list(symbols))


def melt_panel(panel: DataFrame, order: str = "dt", value: str = "adj_close", item: str = "symbol") -> DataFrame:
    cols = [c for c in panel.columns if c != order]
    return panel.unpivot(order, cols, item, value)


# ---- alignment ------------------------------------------------------------------------------


def align_inner(left: DataFrame, right: DataFrame, on: str = "dt") -> DataFrame:
    return left.join(right, on, "inner")


def align_left_benchmark(bars: DataFrame, benchmark: DataFrame, on: str = "dt") -> DataFrame:
    return bars.join(benchmark, on, "left")


def align_outer(left: DataFrame, right: DataFrame, on: str = "dt") -> DataFrame:
    return left.join(right, on, "full")


def asof_last(
    left: DataFrame, right: DataFrame, on: str, value: str, default: str | None = None, key: Sequence[str] = ()
) -> DataFrame:
    """For each left row the last right value at or before it.

    The value is looked up once per distinct (key, date) of the left side and joined back by
    equality, so that many rows of one date do not meet in one window. Dates and values of a key
    form one stream per calendar month; what a month starts with is a running last over months.
    """
    part = list(key)
    none = F.lit(None).cast(right.schema[value].dataType)
    asked = left.select(*part, on).distinct().select(*part, on, none.alias("_v"), F.lit(1).alias("_side"))
    known = right.groupBy(*part, on).agg(F.max(value).alias("_v")).select(*part, on, "_v", F.lit(0).alias("_side"))
    stream = asked.unionByName(known).withColumn("_month", F.trunc(on, "month"))
    months = (
        stream.groupBy(*part, "_month")
        .agg(F.max_by("_v", F.when(F.col("_side") == 0, F.col(on))).alias("_m"))
        .withColumn(
            "_carry",
            F.last("_m", ignorenulls=True).over(
                Window.partitionBy(*part).orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
        .drop("_m")
    )
    w = Window.partitionBy(*part, "_month").orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = (
        stream.withColumn("_here", F.last("_v", ignorenulls=True).over(w))
        .filter(F.col("_side") == 1)
        .join(months, [*part, "_month"])
        .select(*part, on, F.coalesce("_here", "_carry").alias(value))
    )
    got = F.coalesce(F.col(value), F.lit(default)) if default is not None else F.col(value)
    return left.join(found, [*part, on], "left").withColumn(value, got)


def portfolio_returns(returns: DataFrame, weights: DataFrame, key: Sequence[str] = ("portfolio_id",), order: str = "dt",
                      item: str = "symbol", ret: str = "ret") -> DataFrame:
    """Sum of w * r per portfolio and date; a symbol without weight or return adds nothing."""
    return (
        returns.select(item, order, ret)
        .join(weights.select(*key, item, "w"), item)
        .groupBy(*key, order)
        .agg(F.coalesce(F.sum(F.col("w") * F.col(ret)), F.lit(0.0)).alias("ret"))
    )


def latest_row(df: DataFrame, key: Sequence[str] = ("symbol",), order: str = "dt") -> DataFrame:
    """Last row per key as an aggregate, so that a long series is reduced before the shuffle. Every
    column follows the same comparisons of ``order``, so all come from one row."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(*[F.max_by(c, order).alias(c) for c in rest])
