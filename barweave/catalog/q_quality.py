"""Cleaning, validation and normalisation queries over the faulty bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from barweave.catalog.oracle import cte, d, r, with_ctes
from barweave.catalog.registry import query
from barweave.operators import quality as Q
from barweave.operators.returns import simple_returns
from barweave.schemas import BAR_COLUMNS, PRICE_COLUMNS
from barweave.plans.processing import process_bars
from barweave.sources import derived as D

BARS_OUT = ", ".join(["symbol", d(), *[r(c) for c in BAR_COLUMNS]])
KEEP = ["symbol", "dt", *BAR_COLUMNS]


def dirty(spark, sf):
    return D.faulty(D.bars(spark, sf))


def cleaned(spark, sf):
    return Q.clean_bars(dirty(spark, sf).drop("rn"), first_by="src")


def cleaned_with_returns(spark, sf):
    return simple_returns(cleaned(spark, sf), drop_first=False)


_fixed = {
    "open": "ABS(open)",
    "high": "ABS(high)",
    "low": "CASE WHEN low < 0 THEN ABS(CASE WHEN close > 0 THEN close ELSE open END) ELSE low END",
    "close": "ABS(close)",
    "adj_close": "ABS(adj_close)",
    "volume": "volume",
}
_fill = ", ".join(
    f"COALESCE(LAST_VALUE({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),"
    f" FIRST_VALUE({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}"
    for c in BAR_COLUMNS
)
_any = " OR ".join(f"{c} IS NOT NULL" for c in BAR_COLUMNS)
_all = " AND ".join(f"{c} IS NOT NULL" for c in BAR_COLUMNS)


def clean_ctes(prefix: str, source: str) -> None:
    cte(f"{prefix}once", (source,), f"SELECT * EXCLUDE (src) FROM {source} WHERE src = 0")
    cte(f"{prefix}signed", (f"{prefix}once",), "SELECT symbol, dt, " + ", ".join(f"{e} AS {c}" for c, e in _fixed.items()) + f" FROM {prefix}once")
    cte(f"{prefix}clean", (f"{prefix}signed",), f"SELECT * FROM (SELECT symbol, dt, {_fill} FROM {prefix}signed) WHERE {_any}")
    cte(
        f"{prefix}clean_ret",
        (f"{prefix}clean",),
        f"SELECT *, adj_close / NULLIF(LAG(adj_close) OVER (PARTITION BY symbol ORDER BY dt), 0) - 1 AS ret FROM {prefix}clean",
    )


clean_ctes("", "dirty")
# two symbols with faults, three without
cte(
    "mixed",
    ("bars", "dirty"),
    "SELECT * FROM dirty WHERE symbol IN ('ASIA', 'EUROPE') UNION ALL SELECT *, 0 AS src FROM bars WHERE symbol NOT IN ('ASIA', 'EUROPE')",
)
clean_ctes("mixed_", "mixed")


@query("dedup_bars", with_ctes(["once"], f"SELECT {BARS_OUT} FROM once"))
def _(spark, sf):
    return Q.dedup_bars(dirty(spark, sf), first_by="src").select(*KEEP)


@query(
    "dedup_bars_by_value",
    with_ctes(["once"], f"SELECT symbol, {d('MIN(dt)', 'dt')}, {', '.join(r(c) for c in BAR_COLUMNS)} FROM once GROUP BY symbol, {', '.join(BAR_COLUMNS)}"),
)
def _(spark, sf):
    return Q.dedup_bars(dirty(spark, sf).drop("rn"), first_by="src", by_values=True).select(*KEEP)


@query(
    "fix_negative_low",
    with_ctes(["once"], f"SELECT symbol, {d()}, {r(_fixed['low'], 'low')} FROM once"),
)
def _(spark, sf):
    return Q.fix_negative_low(Q.dedup_bars(dirty(spark, sf), first_by="src")).select("symbol", "dt", "low")


@query("fix_negative_prices", with_ctes(["signed"], f"SELECT {BARS_OUT} FROM signed"))
def _(spark, sf):
    return Q.fix_negative_prices(Q.fix_negative_low(Q.dedup_bars(dirty(spark, sf), first_by="src"))).select(*KEEP)


@query("drop_empty_rows", with_ctes(["dirty"], f"SELECT {BARS_OUT}, src FROM dirty WHERE {_any}"))
def _(spark, sf):
    return Q.drop_empty_rows(dirty(spark, sf)).select(*KEEP, F.col("src").cast("int"))


@query("drop_incomplete_bars", with_ctes(["dirty"], f"SELECT {BARS_OUT} FROM dirty WHERE {_all}"))
def _(spark, sf):
    return Q.drop_incomplete_bars(dirty(spark, sf)).select(*KEEP)


@query("fill_forward_backward", with_ctes(["signed"], f"SELECT {BARS_OUT} FROM (SELECT symbol, dt, {_fill} FROM signed)"))
def _(spark, sf):
    signed = Q.fix_negative_prices(Q.fix_negative_low(Q.dedup_bars(dirty(spark, sf).drop("rn"), first_by="src")))
    return Q.fill_forward_backward(signed).select(*KEEP)


@query("sort_bars", with_ctes(["bars"], f"SELECT {BARS_OUT} FROM bars ORDER BY symbol, dt"))
def _(spark, sf):
    return Q.sort_bars(D.bars(spark, sf).select(*KEEP))


@query("clean_bars", with_ctes(["clean"], f"SELECT {BARS_OUT} FROM clean"))
def _(spark, sf):
    return cleaned(spark, sf).select(*KEEP)


# ---- validation -----------------------------------------------------------------------------


@query(
    "check_required_columns",
    with_ctes(
        ["bars"],
        "SELECT symbol, COUNT(*) AS total_rows, 'high; low' AS missing_all_six, '' AS missing_service FROM bars GROUP BY symbol",
    ),
)
def _(spark, sf):
    part = D.bars(spark, sf).select("symbol", "dt", "open", "close", "adj_close", "volume")
    return part.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.lit("; ".join(Q.missing_columns(part, BAR_COLUMNS))).alias("missing_all_six"),
        F.lit("; ".join(Q.missing_columns(part, ["adj_close", "volume"]))).alias("missing_service"),
    )


@query(
    "count_negative_prices",
    with_ctes(
        ["dirty"],
        "SELECT symbol, " + ", ".join(f"COUNT(*) FILTER (WHERE {c} < 0) AS negative_{c}" for c in PRICE_COLUMNS) + " FROM dirty GROUP BY symbol",
    ),
)
def _(spark, sf):
    return Q.count_negative_prices(dirty(spark, sf))


@query(
    "count_nonpositive_adj_close",
    with_ctes(["dirty"], "SELECT symbol, COUNT(*) FILTER (WHERE adj_close <= 0) AS nonpositive_adj_close FROM dirty GROUP BY symbol"),
)
def _(spark, sf):
    return Q.count_nonpositive_adj_close(dirty(spark, sf))


@query(
    "count_high_below_low",
    with_ctes(["dirty"], "SELECT symbol, COUNT(*) FILTER (WHERE high < low) AS high_below_low FROM dirty GROUP BY symbol"),
)
def _(spark, sf):
    return Q.count_high_below_low(dirty(spark, sf))


cte(
    "spans_clean",
    ("clean_ret",),
    """SELECT s.symbol, COUNT(x) AS expected_days FROM (SELECT symbol, MIN(dt) a, MAX(dt) b FROM clean_ret GROUP BY symbol) s,
       generate_series(s.a, s.b, INTERVAL 1 DAY) g(x) WHERE isodow(x) < 6 GROUP BY s.symbol""",
)


@query(
    "business_day_gaps",
    with_ctes(
        ["once"],
        """SELECT s.symbol, s.n AS rows, COUNT(x) AS expected_days, s.n > 1 AND s.n < 0.95e0 * COUNT(x) AS has_gaps
        FROM (SELECT symbol, COUNT(*) n, MIN(dt) a, MAX(dt) b FROM once GROUP BY symbol) s,
        generate_series(s.a, s.b, INTERVAL 1 DAY) g(x) WHERE isodow(x) < 6 GROUP BY s.symbol, s.n""",
    ),
)
def _(spark, sf):
    return Q.business_day_gaps(Q.dedup_bars(dirty(spark, sf), first_by="src"))


@query(
    "count_extreme_returns",
    with_ctes(["clean_ret"], "SELECT symbol, COUNT(*) FILTER (WHERE ABS(ret) > 0.5) AS extreme_returns FROM clean_ret GROUP BY symbol"),
)
def _(spark, sf):
    return Q.count_extreme_returns(cleaned_with_returns(spark, sf))


_neg_text = ", ".join(
    f"CASE WHEN COUNT(*) FILTER (WHERE {c} < 0) > 0 THEN 'Found ' || COUNT(*) FILTER (WHERE {c} < 0) || ' negative {c} prices' END"
    for c in PRICE_COLUMNS
)
cte(
    "report",
    ("clean_ret",),
    f"""SELECT symbol, COUNT(*) AS total_rows, CONCAT_WS('; ',
      CASE WHEN COUNT(*) FILTER (WHERE adj_close <= 0) > 0 THEN 'Found ' || COUNT(*) FILTER (WHERE adj_close <= 0) || ' zero/negative Adj Close prices' END,
      CASE WHEN COUNT(*) FILTER (WHERE high < low) > 0 THEN 'Found ' || COUNT(*) FILTER (WHERE high < low) || ' rows where High < Low' END) AS issues,
      CONCAT_WS('; ', {_neg_text}, NULL) AS negs,
      CASE WHEN COUNT(*) FILTER (WHERE ABS(ret) > 0.5) > 0 THEN 'Found ' || COUNT(*) FILTER (WHERE ABS(ret) > 0.5) || ' extreme returns (>50%)' END AS ext
      FROM clean_ret GROUP BY symbol""",
)
cte(
    "validation",
    ("report", "spans_clean"),
    """SELECT symbol, total_rows, issues = '' AS is_valid, issues, CONCAT_WS('; ', NULLIF(negs, ''),
      CASE WHEN total_rows > 1 AND total_rows < 0.95e0 * expected_days
        THEN 'Potential data gaps: ' || total_rows || '/' || expected_days || ' trading days' END, ext) AS warnings
      FROM report JOIN spans_clean USING (symbol)""",
)
WORLD = "(SELECT r_name AS symbol FROM region UNION SELECT 'ATLANTIS')"


@query(
    "validate_bars",
    with_ctes(
        ["validation"],
        f"""SELECT symbol, COALESCE(total_rows, 0) AS total_rows, COALESCE(is_valid, FALSE) AS is_valid,
        COALESCE(issues, 'No data available') AS issues, COALESCE(warnings, '') AS warnings FROM {WORLD} LEFT JOIN validation USING (symbol)""",
    ),
)
def _(spark, sf):
    return Q.validate_bars(cleaned_with_returns(spark, sf), universe=universe(spark, sf))


def universe(spark, sf):
    """Regions and one symbol that has no data."""
    names = D.table(spark, sf, "region").select(F.col("r_name").alias("symbol"))
    return names.unionByName(spark.range(1).select(F.lit("ATLANTIS").alias("symbol")))


@query(
    "validate_bars_raw",
    with_ctes(
        ["dirty"],
        f"""SELECT symbol, COUNT(*) AS total_rows, CONCAT_WS('; ',
      CASE WHEN COUNT(*) FILTER (WHERE adj_close <= 0) > 0 THEN 'Found ' || COUNT(*) FILTER (WHERE adj_close <= 0) || ' zero/negative Adj Close prices' END,
      CASE WHEN COUNT(*) FILTER (WHERE high < low) > 0 THEN 'Found ' || COUNT(*) FILTER (WHERE high < low) || ' rows where High < Low' END) AS issues,
      COUNT(*) FILTER (WHERE adj_close <= 0) + COUNT(*) FILTER (WHERE high < low) = 0 AS is_valid FROM dirty GROUP BY symbol""",
    ),
)
def _(spark, sf):
    return Q.validate_bars(dirty(spark, sf)).select("symbol", "total_rows", "issues", "is_valid")


_nulls = " + ".join(f"COUNT(*) FILTER (WHERE {c} IS NULL)" for c in BAR_COLUMNS)


cte("stored", ("dirty",), "SELECT *, '5y' AS period FROM dirty UNION ALL SELECT *, '1mo' AS period FROM dirty WHERE rn <= 25")


def stored(spark, sf):
    """The same bars stored for two periods, the short one holding the first month of rows."""
    both, one = F.array(F.lit("5y"), F.lit("1mo")), F.array(F.lit("5y"))
    return dirty(spark, sf).withColumn("period", F.explode(F.when(F.col("rn") <= 25, both).otherwise(one)))


@query(
    "validate_datasets",
    with_ctes(
        ["stored"],
        f"""SELECT symbol, period, rows, null_cells, span_days, {r('missing_share')}, CONCAT_WS('; ',
         CASE WHEN missing_share > 0.05e0 THEN 'High missing data' END,
         CASE WHEN rows > 1 AND span_days < 30 THEN 'Limited date range' END) AS issues,
         NOT (missing_share > 0.05e0 OR (rows > 1 AND span_days < 30)) AS is_valid
         FROM (SELECT symbol, period, COUNT(*) AS rows, {_nulls} AS null_cells, CAST(MAX(dt) - MIN(dt) AS BIGINT) AS span_days,
           ({_nulls}) / (COUNT(*) * 6e0) AS missing_share FROM stored GROUP BY symbol, period)""",
    ),
)
def _(spark, sf):
    return Q.validate_datasets(stored(spark, sf), ["symbol", "period"])


def expected_sets(spark, sf):
    return Q.expected_datasets(universe(spark, sf), PERIODS)


PERIODS = ["5y", "10y"]


@query(
    "coverage_vs_universe",
    with_ctes(
        ["stored"],
        f"""SELECT symbol, period FROM {WORLD}, (VALUES ('5y'), ('10y')) p(period)
        EXCEPT SELECT symbol, period FROM stored""",
    ),
)
def _(spark, sf):
    return Q.coverage_vs_universe(expected_sets(spark, sf), stored(spark, sf))


@query(
    "load_summary",
    with_ctes(
        ["stored"],
        f"""SELECT e.period, COUNT(*) AS expected, COUNT(s.symbol) AS succeeded, {r('COUNT(s.symbol) * 1e0 / COUNT(*)', 'success_rate')}
        FROM (SELECT symbol, period FROM {WORLD}, (VALUES ('5y'), ('10y')) p(period)) e
        LEFT JOIN (SELECT DISTINCT symbol, period FROM stored) s ON e.symbol = s.symbol AND e.period = s.period GROUP BY e.period""",
    ),
)
def _(spark, sf):
    return Q.load_summary(expected_sets(spark, sf), stored(spark, sf))


# names of stored files: each dataset as processed, its report, and raw files named after nations
_files = """SELECT DISTINCT symbol || '_' || period || '_processed' AS name FROM stored
 UNION ALL SELECT DISTINCT symbol || '_5y_report' FROM stored
 UNION ALL SELECT n_name || '_5y_raw' FROM nation UNION ALL SELECT '^' || n_name || '_5y_raw' FROM nation"""


def file_names(spark, sf):
    sets = stored(spark, sf).select("symbol", "period").distinct()
    nation = D.table(spark, sf, "nation")
    return (
        sets.select(F.concat_ws("_", "symbol", "period", F.lit("processed")).alias("name"))
        .unionByName(sets.select("symbol").distinct().select(F.concat("symbol", F.lit("_5y_report")).alias("name")))
        .unionByName(nation.select(F.concat("n_name", F.lit("_5y_raw")).alias("name")))
        .unionByName(nation.select(F.concat(F.lit("^"), "n_name", F.lit("_5y_raw")).alias("name")))
    )


@query(
    "policy_violations",
    with_ctes(
        ["stored"],
        f"""SELECT 'restricted_periods' AS violation, name FROM ({_files}) WHERE name LIKE '%\\_1mo\\_%' ESCAPE '\\'
        UNION ALL SELECT 'report_files', name FROM ({_files}) WHERE name LIKE '%\\_report' ESCAPE '\\'
        UNION ALL SELECT 'unknown_symbols', name FROM ({_files}) WHERE name LIKE '%\\_%' ESCAPE '\\' AND NOT name LIKE '^%'
          AND SPLIT_PART(name, '_', 1) NOT IN (SELECT r_name FROM region)""",
    ),
)
def _(spark, sf):
    return Q.policy_violations(file_names(spark, sf), universe(spark, sf), PERIODS)


@query(
    "date_range_consistency",
    with_ctes(
        ["stored"],
        """SELECT period, COUNT(*) AS symbols, COUNT(DISTINCT (a, b)) AS distinct_ranges, COUNT(DISTINCT (a, b)) = 1 AS consistent
        FROM (SELECT period, symbol, MIN(dt) a, MAX(dt) b FROM stored GROUP BY period, symbol) GROUP BY period""",
    ),
)
def _(spark, sf):
    return Q.date_range_consistency(stored(spark, sf))


cte(
    "once_ret",
    ("once",),
    "SELECT *, adj_close / NULLIF(LAG(adj_close) OVER (PARTITION BY symbol ORDER BY dt), 0) - 1 AS ret FROM once",
)
_rep_cols = [*BAR_COLUMNS, "ret"]
_rep_nulls = " + ".join(f"COUNT(*) FILTER (WHERE {c} IS NULL)" for c in _rep_cols)
cte(
    "quality",
    ("once_ret",),
    f"""SELECT symbol, COUNT(*) AS total_rows, MIN(dt) AS a, MAX(dt) AS b,
    {', '.join(f'COUNT(*) FILTER (WHERE {c} IS NULL) AS missing_{c}' for c in _rep_cols)},
    1e0 - ({_rep_nulls}) / (COUNT(*) * 7e0) AS completeness, STDDEV_SAMP(ret) * SQRT(252e0) AS volatility,
    COUNT(*) / GREATEST(1e0, MAX(dt) - MIN(dt)) AS data_density, MIN(adj_close) AS min_price, MAX(adj_close) AS max_price
    FROM once_ret GROUP BY symbol""",
)


def reported(spark, sf):
    once = Q.dedup_bars(dirty(spark, sf).drop("rn"), first_by="src")
    return Q.quality_report(simple_returns(once, drop_first=False))


@query(
    "quality_report",
    with_ctes(
        ["quality"],
        f"""SELECT symbol, total_rows, {d('a', 'start_date')}, {d('b', 'end_date')}, {', '.join(f'missing_{c}' for c in _rep_cols)},
        {r('completeness')}, {r('volatility')}, {r('data_density')}, {r('min_price')}, {r('max_price')},
        CONCAT_WS('; ', CASE WHEN completeness < 0.9 THEN '{Q.REC_MISSING}' END, CASE WHEN volatility > 0.5 THEN '{Q.REC_VOLATILE}' END,
          CASE WHEN total_rows < 252 THEN '{Q.REC_SHORT}' END) AS recommendations FROM quality""",
    ),
)
def _(spark, sf):
    s, m = "data_summary", "quality_metrics"
    return reported(spark, sf).select(
        "symbol",
        f"{s}.total_rows",
        F.col(f"{s}.date_range.start").alias("start_date"),
        F.col(f"{s}.date_range.end").alias("end_date"),
        *[F.col(f"{s}.missing_values")[c].alias(f"missing_{c}") for c in _rep_cols],
        f"{m}.completeness",
        F.col(f"{m}.volatility_annualized").alias("volatility"),
        f"{m}.data_density",
        F.col(f"{m}.price_range.min").alias("min_price"),
        F.col(f"{m}.price_range.max").alias("max_price"),
        "recommendations",
    )


@query(
    "quality_summary",
    with_ctes(["quality"], f"SELECT symbol, total_rows, {r('completeness')}, {r('volatility')} FROM quality ORDER BY symbol"),
)
def _(spark, sf):
    return Q.quality_summary(reported(spark, sf))


def mixed(spark, sf):
    bars = D.bars(spark, sf)
    bad = F.col("symbol").isin("ASIA", "EUROPE")
    return D.faulty(bars).filter(bad).unionByName(bars.filter(~bad).withColumn("src", F.lit(0)))


_minmax = ", ".join(
    r(f"CASE WHEN MAX({c}) OVER s <> MIN({c}) OVER s THEN ({c} - MIN({c}) OVER s) / (MAX({c}) OVER s - MIN({c}) OVER s) ELSE {c} END", c)
    for c in BAR_COLUMNS
)


@query(
    "process_bars",
    with_ctes(
        ["mixed_clean_ret"],
        f"""SELECT symbol, {d()}, {_minmax} FROM mixed_clean_ret
        WHERE symbol NOT IN (SELECT symbol FROM mixed_clean_ret WHERE adj_close <= 0 OR high < low) WINDOW s AS (PARTITION BY symbol)""",
    ),
)
def _(spark, sf):
    return process_bars(mixed(spark, sf).drop("rn"), "minmax", first_by="src").data.select(*KEEP)


@query(
    "process_bars_failures",
    with_ctes(
        ["mixed_clean_ret"],
        """SELECT symbol, COUNT(*) FILTER (WHERE adj_close <= 0 OR high < low) = 0 AS success, COUNT(*) AS total_rows
        FROM mixed_clean_ret GROUP BY symbol""",
    ),
)
def _(spark, sf):
    return process_bars(mixed(spark, sf).drop("rn"), "minmax", first_by="src").outcome.select("symbol", "success", "total_rows")


# ---- normalisation --------------------------------------------------------------------------


@query("normalize_minmax", with_ctes(["clean"], f"SELECT symbol, {d()}, {_minmax} FROM clean WINDOW s AS (PARTITION BY symbol)"))
def _(spark, sf):
    return Q.normalize_minmax(cleaned(spark, sf)).select(*KEEP)


_z = ", ".join(
    r(f"CASE WHEN STDDEV_SAMP({c}) OVER s <> 0 THEN ({c} - AVG({c}) OVER s) / STDDEV_SAMP({c}) OVER s ELSE {c} END", c) for c in BAR_COLUMNS
)


@query("normalize_zscore", with_ctes(["clean"], f"SELECT symbol, {d()}, {_z} FROM clean WINDOW s AS (PARTITION BY symbol)"))
def _(spark, sf):
    return Q.normalize_zscore(cleaned(spark, sf)).select(*KEEP)


_base = ", ".join(
    r(f"CASE WHEN FIRST_VALUE({c}) OVER s <> 0 THEN {c} / FIRST_VALUE({c}) OVER s - 1 ELSE {c} END", c) for c in PRICE_COLUMNS
)


@query(
    "normalize_base",
    with_ctes(["clean"], f"SELECT symbol, {d()}, {_base}, {r('volume')} FROM clean WINDOW s AS (PARTITION BY symbol ORDER BY dt)"),
)
def _(spark, sf):
    return Q.normalize_base(cleaned(spark, sf)).select(*KEEP)
