"""Cleaning, validation and normalisation of bars. Key (symbol, dt); NULL is missing, never NaN."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.functions.exprs import annualised, ratio
from barweave.operators.series import calendar_bounded, running
from barweave.schemas import BAR_COLUMNS, PRICE_COLUMNS

# Messages and limits of the validation and quality reports.
EXTREME_RETURN = 0.5
GAP_SHARE = 0.95
MAX_MISSING_SHARE = 0.05
MIN_SPAN_DAYS = 30
NO_DATA = "No data available"
REC_MISSING = "Consider investigating missing data patterns"
REC_VOLATILE = "High volatility detected - ensure risk metrics account for this"
REC_SHORT = "Limited data history - may affect optimization reliability"


# ---- cleaning -------------------------------------------------------------------------------


def dedup_bars(
    bars: DataFrame, key: Sequence[str] = ("symbol", "dt"), first_by: str | None = None, by_values: bool = False
) -> DataFrame:
    """One row per key. An aggregate, not a window: copies are merged before the shuffle, so a
    key repeated any number of times is no hot task.

    ``by_values`` instead merges equal bars of different dates of a symbol, keeping the earliest.
    """
    key = list(key)
    if by_values:
        order = key[-1]
        values = [c for c in bars.columns if c != order and c != first_by]
        return bars.groupBy(*values).agg(F.min(order).alias(order)).select(*[c for c in bars.columns if c != first_by])
    rest = [c for c in bars.columns if c not in key and c != first_by]
    if first_by:
        # column by column, so that numbers are hashed and need no sort; every column follows the
        # same comparisons of ``first_by`` and therefore comes from the same row
        return bars.groupBy(*key).agg(*[F.min_by(c, first_by).alias(c) for c in rest])
    return bars.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_row")).select(*key, "_row.*")


def fix_negative_low(bars: DataFrame) -> DataFrame:
    """A negative low becomes the close if that is positive, else the open; then its absolute value."""
    stand_in = F.when(F.col("close") > 0, F.col("close")).otherwise(F.col("open"))
    return bars.withColumn("low", F.when(F.col("low") < 0, F.abs(stand_in)).otherwise(F.col("low")))


def fix_negative_prices(bars: DataFrame, cols: Sequence[str] = ("open", "high", "close", "adj_close")) -> DataFrame:
    return bars.withColumns({c: F.abs(F.col(c)) for c in cols})


def drop_empty_rows(bars: DataFrame, cols: Sequence[str] = BAR_COLUMNS) -> DataFrame:
    return bars.na.drop("all", subset=list(cols))


def drop_incomplete_bars(bars: DataFrame, cols: Sequence[str] = BAR_COLUMNS) -> DataFrame:
    return bars.na.drop("any", subset=list(cols))


def fill_forward_backward(
    bars: DataFrame, key: Sequence[str] = ("symbol",), order: str = "dt", cols: Sequence[str] = BAR_COLUMNS, **kw
) -> DataFrame:
    """Last earlier value, else first later value, per column. ``kw`` goes to `running`."""
    key = list(key)
    if calendar_bounded(bars, order):
        o = Window.partitionBy(*key).orderBy(order)
        past = o.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # what the forward fill leaves NULL precedes the first value of the key, so the backward
        # fill is that one value; a frame "current row to the end" would cost rows squared
        whole = o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return bars.withColumns(
            {
                c: F.coalesce(F.last(c, ignorenulls=True).over(past), F.first(c, ignorenulls=True).over(whole))
                for c in cols
            }
        )
    # Unbounded series: running last value slice by slice; what is still NULL precedes the first
    # value of the key, so the backward fill is that one value.
    firsts = bars.groupBy(*key).agg(
        *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_first_{c}") for c in cols]
    )
    out = running(
        bars, key, order, {f"_ff_{c}": F.col(c) for c in cols}, lambda x: F.last(x, ignorenulls=True), lambda b, h: F.coalesce(h, b), **kw
    )
    return (
        out.join(firsts, key, "left")
        .withColumns({c: F.coalesce(F.col(f"_ff_{c}"), F.col(f"_first_{c}")) for c in cols})
        .select(*bars.columns)
    )


def sort_bars(bars: DataFrame, key: Sequence[str] = ("symbol",), order: str = "dt", total: bool = True) -> DataFrame:
    cols = [*key, order]
    return bars.orderBy(*cols) if total else bars.repartition(*key).sortWithinPartitions(*cols)


def clean_bars(bars: DataFrame, key: Sequence[str] = ("symbol",), order: str = "dt", first_by: str | None = None) -> DataFrame:
    """De-duplicate, repair signs, fill per symbol in date order, drop rows that are still empty."""
    once = dedup_bars(bars, [*key, order], first_by)
    signed = fix_negative_prices(fix_negative_low(once))
    cols = [c for c in BAR_COLUMNS if c in bars.columns]
    return drop_empty_rows(fill_forward_backward(signed, key, order, cols), cols)


# ---- normalisation --------------------------------------------------------------------------


def _with_stats(bars: DataFrame, key: Sequence[str], order: str, stats: dict[str, Column]) -> DataFrame:
    """Adds statistics of the whole key. A calendar-bounded key takes them from a window on the
    partitioning its rows already have; an unbounded one is aggregated, then joined back."""
    if calendar_bounded(bars, order):
        w = Window.partitionBy(*key)
        return bars.withColumns({n: c.over(w) for n, c in stats.items()})
    return bars.join(bars.groupBy(*key).agg(*[c.alias(n) for n, c in stats.items()]), list(key))


def normalize_minmax(
    bars: DataFrame, key: Sequence[str] = ("symbol",), order: str = "dt", cols: Sequence[str] = BAR_COLUMNS
) -> DataFrame:
    stats = {f"_{n}_{c}": f(c) for c in cols for n, f in (("lo", F.min), ("hi", F.max))}
    width = {c: F.col(f"_hi_{c}") - F.col(f"_lo_{c}") for c in cols}
    return (
        _with_stats(bars, key, order, stats)
        .withColumns(
            {c: F.when(width[c] != 0, (F.col(c) - F.col(f"_lo_{c}")) / width[c]).otherwise(F.col(c)) for c in cols}
        )
        .select(*bars.columns)
    )


def normalize_zscore(
    bars: DataFrame, key: Sequence[str] = ("symbol",), order: str = "dt", cols: Sequence[str] = BAR_COLUMNS
) -> DataFrame:
    stats = {f"_{n}_{c}": f(c) for c in cols for n, f in (("m", F.avg), ("s", F.stddev_samp))}
    return (
        _with_stats(bars, key, order, stats)
        .withColumns(
            {
                c: F.when(F.col(f"_s_{c}") != 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(F.col(c))
                for c in cols
            }
        )
        .select(*bars.columns)
    )


def normalize_base(
    bars: DataFrame, key: Sequence[str] = ("symbol",), order: str = "dt", cols: Sequence[str] = PRICE_COLUMNS
) -> DataFrame:
    """Return since the first bar of the key; a first price of 0 leaves the column as it is."""
    stats = {f"_b_{c}": F.min_by(c, F.col(order)) for c in cols}
    return (
        _with_stats(bars, key, order, stats)
        .withColumns(
            {c: F.when(F.col(f"_b_{c}") != 0, F.col(c) / F.col(f"_b_{c}") - 1).otherwise(F.col(c)) for c in cols}
        )
        .select(*bars.columns)
    )


NORMALIZERS = {"minmax": normalize_minmax, "zscore": normalize_zscore, "returns": normalize_base}


# ---- validation -----------------------------------------------------------------------------


def missing_columns(bars: DataFrame, required: Sequence[str]) -> list[str]:
    return [c for c in required if c not in bars.columns]


def weekday_count(first: Column, last: Column) -> Column:
    """Monday-to-Friday days in [first, last], by arithmetic."""
    days = F.datediff(last, first) + 1
    rest = days % 7
    in_rest = F.size(
        F.filter(
            F.sequence(F.lit(0), F.lit(6)),
            lambda k: (k < rest) & ((F.weekday(first) + k) % 7 < 5),
        )
    )
    return (F.floor(days / 7) * 5 + in_rest).cast("long")


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def count_negative_prices(bars: DataFrame, key: Sequence[str] = ("symbol",)) -> DataFrame:
    return bars.groupBy(*key).agg(*[count_if(F.col(c) < 0).alias(f"negative_{c}") for c in PRICE_COLUMNS])


def count_nonpositive_adj_close(bars: DataFrame, key: Sequence[str] = ("symbol",)) -> DataFrame:
    return bars.groupBy(*key).agg(count_if(F.col("adj_close") <= 0).alias("nonpositive_adj_close"))


def count_high_below_low(bars: DataFrame, key: Sequence[str] = ("symbol",)) -> DataFrame:
    return bars.groupBy(*key).agg(count_if(F.col("high") < F.col("low")).alias("high_below_low"))


def business_day_gaps(bars: DataFrame, key: Sequence[str] = ("symbol",), order: str = "dt") -> DataFrame:
    counted = bars.groupBy(*key).agg(
        F.count(F.lit(1)).alias("rows"), weekday_count(F.min(order), F.max(order)).alias("expected_days")
    )
    return counted.withColumn("has_gaps", _gap(F.col("rows"), F.col("expected_days")))


def _gap(rows: Column, expected: Column) -> Column:
    return (rows > 1) & (expected > 0) & (rows < expected * GAP_SHARE)


def count_extreme_returns(returns: DataFrame, key: Sequence[str] = ("symbol",), ret: str = "ret") -> DataFrame:
    return returns.groupBy(*key).agg(count_if(F.abs(F.col(ret)) > EXTREME_RETURN).alias("extreme_returns"))


def _texts(*pairs: tuple[Column, Column]) -> Column:
    return F.filter(F.array(*[F.when(c, t) for c, t in pairs]), lambda x: x.isNotNull())


def validate_bars(bars: DataFrame, key: str = "symbol", order: str = "dt", universe: DataFrame | None = None) -> DataFrame:
    """One report row per symbol from a single aggregation; ``bars`` may carry a ``ret`` column.

    Symbols of ``universe`` without bars are reported as having no data.
    """
    lost = missing_columns(bars, ["adj_close", "volume"])
    prices = [c for c in PRICE_COLUMNS if c in bars.columns]
    has = set(bars.columns)
    none = F.lit(0).cast("long")
    agg = bars.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_rows"),
        weekday_count(F.min(order), F.max(order)).alias("_expected"),
        *[count_if(F.col(c) < 0).alias(f"_neg_{c}") for c in prices],
        (count_if(F.col("adj_close") <= 0) if "adj_close" in has else none).alias("_zero"),
        (count_if(F.col("high") < F.col("low")) if {"high", "low", "open", "close"} <= has else none).alias("_hl"),
        (count_if(F.abs(F.col("ret")) > EXTREME_RETURN) if "ret" in has else none).alias("_ext"),
    )
    if universe is not None:
        agg = universe.select(key).distinct().join(agg, key, "left").na.fill(0)

    def some(col: str, text: str) -> tuple[Column, Column]:
        return F.col(col) > 0, F.concat(F.lit("Found "), F.col(col).cast("string"), F.lit(text))

    issues = _texts(
        (F.col("total_rows") == 0, F.lit(NO_DATA)),
        (F.lit(bool(lost)), F.lit("Missing required columns: " + ", ".join(lost))),
        some("_zero", " zero/negative Adj Close prices"),
        some("_hl", " rows where High < Low"),
    )
    gap_text = F.concat(
        F.lit("Potential data gaps: "), F.col("total_rows").cast("string"), F.lit("/"), F.col("_expected").cast("string"),
        F.lit(" trading days"),
    )
    warnings = _texts(
        *[some(f"_neg_{c}", f" negative {c} prices") for c in prices],
        (_gap(F.col("total_rows"), F.col("_expected")), gap_text),
        some("_ext", " extreme returns (>50%)"),
    )
    return agg.select(key, "total_rows", issues.alias("issues"), warnings.alias("warnings")).select(
        key, "total_rows", (F.size("issues") == 0).alias("is_valid"), "issues", "warnings"
    )


def validate_datasets(stored: DataFrame, key: Sequence[str], order: str = "dt", expected: DataFrame | None = None) -> DataFrame:
    """Checks of stored datasets: empty, missing columns, share of NULL cells, span of days."""
    key = list(key)
    have = [c for c in BAR_COLUMNS if c in stored.columns]
    lost = missing_columns(stored, BAR_COLUMNS)
    nulls = sum((count_if(F.col(c).isNull()) for c in have[1:]), count_if(F.col(have[0]).isNull()))
    agg = stored.groupBy(*key).agg(
        F.count(F.lit(1)).alias("rows"),
        nulls.alias("null_cells"),
        F.datediff(F.max(order), F.min(order)).cast("long").alias("span_days"),
    )
    if expected is not None:
        agg = expected.select(*key).distinct().join(agg, key, "left").na.fill(0)
    share = ratio(F.col("null_cells"), F.col("rows") * len(have))
    issues = _texts(
        (F.col("rows") == 0, F.lit("Empty dataset")),
        (F.lit(bool(lost)), F.lit("Missing columns: " + ", ".join(lost))),
        (share > MAX_MISSING_SHARE, F.lit("High missing data")),
        ((F.col("rows") > 1) & (F.col("span_days") < MIN_SPAN_DAYS), F.lit("Limited date range")),
    )
    return agg.withColumn("missing_share", F.coalesce(share, F.lit(0.0))).withColumn("issues", issues).withColumn(
        "is_valid", F.size("issues") == 0
    )


def date_range_consistency(stored: DataFrame, period: str = "period", symbol: str = "symbol", order: str = "dt") -> DataFrame:
    ranges = stored.groupBy(period, symbol).agg(F.min(order).alias("start"), F.max(order).alias("end"))
    return ranges.groupBy(period).agg(
        F.count(F.lit(1)).alias("symbols"),
        F.count_distinct(F.struct("start", "end")).alias("distinct_ranges"),
        (F.count_distinct(F.struct("start", "end")) == 1).alias("consistent"),
    )


def quality_report(bars: DataFrame, key: str = "symbol", order: str = "dt", cols: Sequence[str] | None = None) -> DataFrame:
    """Nested report per symbol over ``cols`` (bars plus ``ret`` when present)."""
    cols = list(cols or [c for c in [*BAR_COLUMNS, "ret"] if c in bars.columns])
    vol = annualised(F.stddev_samp("ret")) if "ret" in bars.columns else F.lit(None).cast("double")
    agg = bars.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(order).alias("first"),
        F.max(order).alias("last"),
        F.min("adj_close").alias("lo"),
        F.max("adj_close").alias("hi"),
        vol.alias("vol"),
        *[count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in cols],
    )
    nulls = sum((F.col(f"_null_{c}") for c in cols[1:]), F.col(f"_null_{cols[0]}"))
    cells = F.col("n") * len(cols)
    complete = ratio(cells - nulls, cells)
    pairs = [x for c in cols for x in (F.lit(c), F.col(f"_null_{c}"))]
    rec = _texts(
        (complete < 0.9, F.lit(REC_MISSING)),
        (F.col("vol") > 0.5, F.lit(REC_VOLATILE)),
        (F.col("n") < 252, F.lit(REC_SHORT)),
    )
    span = F.greatest(F.lit(1), F.datediff("last", "first"))
    return agg.select(
        key,
        F.struct(
            F.col("n").alias("total_rows"),
            F.struct(F.col("first").alias("start"), F.col("last").alias("end")).alias("date_range"),
            F.create_map(*pairs).alias("missing_values"),
        ).alias("data_summary"),
        F.struct(
            complete.alias("completeness"),
            F.col("vol").alias("volatility_annualized"),
            (F.col("n") / span).alias("data_density"),
            F.struct(F.col("lo").alias("min"), F.col("hi").alias("max")).alias("price_range"),
        ).alias("quality_metrics"),
        rec.alias("recommendations"),
    )


def quality_summary(report: DataFrame, key: str = "symbol") -> DataFrame:
    return report.select(
        key,
        F.col("data_summary.total_rows").alias("total_rows"),
        F.col("quality_metrics.completeness").alias("completeness"),
        F.col("quality_metrics.volatility_annualized").alias("volatility"),
    ).orderBy(key)


def expected_datasets(symbols: DataFrame, periods: Sequence[str], symbol: str = "symbol") -> DataFrame:
    """One row per symbol and period that should be stored."""
    return symbols.select(symbol, F.explode(F.array(*[F.lit(p) for p in periods])).alias("period"))


def coverage_vs_universe(expected: DataFrame, stored: DataFrame, key: Sequence[str] = ("symbol", "period")) -> DataFrame:
    return expected.join(stored.select(*key).distinct(), list(key), "left_anti")


def load_summary(expected: DataFrame, stored: DataFrame, key: Sequence[str] = ("symbol", "period"), by: str = "period") -> DataFrame:
    """Expected and stored datasets and the share of successes per period."""
    got = stored.select(*key).distinct().withColumn("_got", F.lit(1))
    return (
        expected.join(got, list(key), "left")
        .groupBy(by)
        .agg(
            F.count(F.lit(1)).alias("expected"),
            F.count("_got").alias("succeeded"),
            F.avg(F.coalesce("_got", F.lit(0))).alias("success_rate"),
        )
    )


# Period names in common use; those not allowed are restricted.
COMMON_PERIODS = ["1d", "5d", "1mo", "3mo", "6mo", "1y", "2y", "3y", "5y", "10y", "ytd", "max"]


def policy_violations(names: DataFrame, symbols: DataFrame, allowed: Sequence[str], name: str = "name", symbol: str = "symbol") -> DataFrame:
    """(violation, name) for file stems with a restricted period, report files and unknown symbols;
    symbols that start with ^ are exempt."""
    banned = [p for p in COMMON_PERIODS if p not in allowed]
    parts = F.split(F.col(name), "_")
    tagged = names.withColumn("_symbol", F.when(F.size(parts) >= 2, parts[0]))
    known = symbols.select(F.col(symbol).alias("_symbol")).distinct().withColumn("_known", F.lit(True))
    flags = tagged.join(known, "_symbol", "left").select(
        name,
        F.explode(
            _texts(
                (F.col(name).rlike("_(" + "|".join(banned) + ")_"), F.lit("restricted_periods")),
                (F.col(name).endswith("_report"), F.lit("report_files")),
                (
                    F.col("_symbol").isNotNull() & F.col("_known").isNull() & ~F.col("_symbol").startswith("^"),
                    F.lit("unknown_symbols"),
                ),
            )
        ).alias("violation"),
    )
    return flags.select("violation", name)
