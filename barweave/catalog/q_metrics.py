"""Metric queries grouped by symbol."""

from __future__ import annotations

from pyspark.sql import functions as F

from barweave.catalog.oracle import cte, d, r, with_ctes
from barweave.catalog.q_returns import CUM, W, bench, rets
from barweave.catalog.q_quality import dirty
from barweave.catalog.registry import query
from barweave.operators import metrics as M
from barweave.operators import quality as Q
from barweave.operators.returns import portfolio_returns, simple_returns
from barweave.plans.summary import asset_summary, symbol_lookup
from barweave.sources import derived as D


def metrics_sql(source: str, key: str, bench_join: str = "") -> str:
    """All metrics of (key, dt, ret) with an optional benchmark join that adds bench_ret."""
    b = "bench_ret" if bench_join else "CAST(NULL AS DOUBLE)"
    return f"""SELECT *,
      CASE WHEN av = 0 OR av IS NULL THEN 0e0 ELSE (ar - 0.02e0) / av END AS sharpe,
      CASE WHEN neg = 0 THEN (CASE WHEN av = 0 OR av IS NULL THEN 0e0 ELSE (ar - 0.02e0) / av END)
           WHEN down > 0 THEN (ar - 0.02e0) / down ELSE 0e0 END AS sortino,
      CASE WHEN mdd = 0 THEN 0e0 ELSE ar / ABS(mdd) END AS calmar,
      pa - (0.02e0 + beta * (ba - 0.02e0)) AS alpha
      FROM (SELECT *, POW(1 + tr, 252e0 / n) - 1 AS ar, POW(gp, 252e0 / m) - 1 AS pa, POW(gb, 252e0 / m) - 1 AS ba FROM (
      SELECT {key}, COUNT(*) AS n, PRODUCT(1 + ret) - 1 AS tr, STDDEV_SAMP(ret) * SQRT(252e0) AS av, MIN(dd) AS mdd,
        MAX(ret) AS best, MIN(ret) AS worst, AVG(CASE WHEN ret > 0 THEN 1e0 ELSE 0e0 END) AS wins, AVG(CASE WHEN ret < 0 THEN 1e0 ELSE 0e0 END) AS losses,
        COUNT(*) FILTER (WHERE ret < 0) AS neg, STDDEV_SAMP(ret) FILTER (WHERE ret < 0) * SQRT(252e0) AS down,
        COUNT({b}) AS m, PRODUCT(1 + ret) FILTER (WHERE {b} IS NOT NULL) AS gp, PRODUCT(1 + {b}) AS gb,
        COALESCE(COVAR_SAMP(ret, {b}) / NULLIF(VAR_POP({b}), 0), 0) AS beta,
        COALESCE(AVG(ret - {b}) * 252 / NULLIF(STDDEV_SAMP(ret - {b}) * SQRT(252e0), 0), 0) AS ir
      FROM (SELECT x.*, eq / MAX(eq) OVER (PARTITION BY {key} ORDER BY dt {CUM}) - 1 AS dd FROM
        (SELECT {key}, dt, ret, PRODUCT(1 + ret) OVER (PARTITION BY {key} ORDER BY dt {CUM}) AS eq FROM {source}) x) y {bench_join}
      GROUP BY {key}))"""


PERF = [
    r("tr", "total_return"), r("ar", "annual_return"), r("av", "annual_volatility"), r("sharpe", "sharpe_ratio"), r("mdd", "max_drawdown"),
    r("best", "best_day"), r("worst", "worst_day"), r("wins", "win_rate"),
]
MORE = [r("sortino", "sortino_ratio"), r("calmar", "calmar_ratio"), r("losses", "loss_rate")]
REL = [r("beta"), r("alpha"), r("ir", "information_ratio")]
BJ = "LEFT JOIN mkt_ret USING (dt)"
cte("met", ("ret",), metrics_sql("ret", "symbol"))
cte("met_b", ("ret", "mkt_ret"), metrics_sql("ret", "symbol", BJ))


def tick_rets(spark, sf):
    return simple_returns(D.ticks(spark, sf), order="ts").withColumn("ret", F.col("ret") / 1000).filter("ret is not null")


def _sel(*cols: str, src: str = "met") -> str:
    return with_ctes([src], f"SELECT symbol, {', '.join(cols)} FROM {src}")


@query("performance_metrics", _sel(*PERF))
def _(spark, sf):
    return M.performance_metrics(rets(spark, sf))


@query("performance_metrics_vs_benchmark", _sel(*PERF, *REL, src="met_b"))
def _(spark, sf):
    return M.performance_metrics(rets(spark, sf), benchmark=bench(spark, sf))


@query("comprehensive_metrics", _sel(*PERF, *MORE, *REL, src="met_b"))
def _(spark, sf):
    return M.comprehensive_metrics(rets(spark, sf), benchmark=bench(spark, sf))


@query("total_return", _sel(PERF[0]))
def _(spark, sf):
    return M.total_return(rets(spark, sf))


@query("annual_return", _sel(PERF[1]))
def _(spark, sf):
    return M.annual_return_by(rets(spark, sf))


@query("annual_volatility", _sel(PERF[2]))
def _(spark, sf):
    return M.annual_volatility(rets(spark, sf))


@query("sharpe_ratio", _sel(PERF[3]))
def _(spark, sf):
    return M.performance_metrics(rets(spark, sf)).select("symbol", "sharpe_ratio")


@query("max_drawdown", _sel(PERF[4]))
def _(spark, sf):
    return M.max_drawdown(rets(spark, sf))


_TICK_CURVE = f"""SELECT symbol, ret, eq / MAX(eq) OVER (PARTITION BY symbol ORDER BY ts {CUM}) - 1 AS dd FROM
  (SELECT symbol, ts, ret / 1000 AS ret, PRODUCT(1 + ret / 1000) OVER (PARTITION BY symbol ORDER BY ts {CUM}) AS eq FROM tick_ret)"""


@query("max_drawdown_ticks", with_ctes(["tick_ret"], f"SELECT symbol, {r('MIN(dd)', 'max_drawdown')} FROM ({_TICK_CURVE}) GROUP BY symbol"))
def _(spark, sf):
    """Ticks have no calendar bound: ranges are walked once and their states merge, without a curve."""
    return M.max_drawdown(tick_rets(spark, sf), order="ts")


@query(
    "comprehensive_metrics_ticks",
    with_ctes(
        ["tick_ret"],
        f"""SELECT symbol, {r('PRODUCT(1 + ret) - 1', 'total_return')}, {r('STDDEV_SAMP(ret) * SQRT(252e0)', 'annual_volatility')}, {r('MIN(dd)', 'max_drawdown')},
        {r('MAX(ret)', 'best_day')}, {r('AVG(CASE WHEN ret > 0 THEN 1e0 ELSE 0e0 END)', 'win_rate')} FROM ({_TICK_CURVE}) GROUP BY symbol""",
    ),
)
def _(spark, sf):
    m = M.comprehensive_metrics(tick_rets(spark, sf), order="ts")
    return m.select("symbol", "total_return", "annual_volatility", "max_drawdown", "best_day", "win_rate")


@query("day_stats", _sel(*PERF[5:], MORE[2]))
def _(spark, sf):
    return M.day_stats(rets(spark, sf))


@query("sortino_ratio", _sel(MORE[0]))
def _(spark, sf):
    return M.comprehensive_metrics(rets(spark, sf)).select("symbol", "sortino_ratio")


@query("calmar_ratio", _sel(MORE[1]))
def _(spark, sf):
    return M.comprehensive_metrics(rets(spark, sf)).select("symbol", "calmar_ratio")


for _name, _col in (("beta", REL[0]), ("alpha", REL[1]), ("information_ratio", REL[2])):

    @query(_name, _sel(_col, src="met_b"))
    def _(spark, sf, _name=_name):
        return M.relative_metrics(rets(spark, sf), bench(spark, sf)).select("symbol", _name)


@query("returns_describe", with_ctes(["ret"], f"SELECT symbol, {r('AVG(ret)', 'mean')}, {r('STDDEV_SAMP(ret)', 'std')} FROM ret GROUP BY symbol"))
def _(spark, sf):
    return M.returns_describe(rets(spark, sf))


@query("mean_returns", with_ctes(["ret"], f"SELECT symbol, {r('AVG(ret) * 252', 'mu')} FROM ret GROUP BY symbol"))
def _(spark, sf):
    return M.mean_returns(rets(spark, sf))


ROLL = "(PARTITION BY symbol ORDER BY dt ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)"


@query(
    "rolling_sharpe",
    with_ctes(
        ["ret"],
        f"""SELECT symbol, {d()}, {r(f'CASE WHEN COUNT(ret) OVER {ROLL} = 252 THEN COALESCE((AVG(ret) OVER {ROLL} * 252 - 0.02e0) / NULLIF(STDDEV_SAMP(ret) OVER {ROLL} * SQRT(252e0), 0), 0) END', 'rolling_sharpe')} FROM ret""",
    ),
)
def _(spark, sf):
    return M.rolling_sharpe(rets(spark, sf)).select("symbol", "dt", "rolling_sharpe")


# forecasts: half of the previous return stands for a model's prediction
cte("pred", ("ret",), f"SELECT * FROM (SELECT symbol, dt, ret AS y, 0.5e0 * LAG(ret) OVER {W} AS yhat FROM ret) WHERE yhat IS NOT NULL")


def predictions(spark, sf):
    from pyspark.sql import Window

    o = Window.partitionBy("symbol").orderBy("dt")
    return rets(spark, sf).select("symbol", "dt", F.col("ret").alias("y"), (0.5 * F.lag("ret").over(o)).alias("yhat")).filter("yhat is not null")


@query(
    "regression_scores",
    with_ctes(
        ["pred"],
        f"""SELECT symbol, COUNT(*) AS n, {r('AVG((y - yhat) * (y - yhat))', 'mse', )}, {r('SQRT(AVG((y - yhat) * (y - yhat)))', 'rmse')},
        {r('1 - SUM((y - yhat) * (y - yhat)) / (VAR_POP(y) * COUNT(y))', 'r2')}, {r('AVG(ABS(y - yhat))', 'mae')},
        {r('AVG(CASE WHEN SIGN(y) = SIGN(yhat) THEN 1e0 ELSE 0e0 END)', 'directional_accuracy')} FROM pred GROUP BY symbol""",
    ),
)
def _(spark, sf):
    return M.regression_scores(predictions(spark, sf))


# portfolios: equal weight, one concentrated, one without ASIA, one that does not sum to 1
PORTFOLIOS_SQL = """SELECT 'equal' AS portfolio_id, r_name AS symbol, 0.2e0 AS w FROM region
 UNION ALL SELECT 'concentrated', r_name, CASE WHEN r_name = 'AFRICA' THEN 0.6e0 ELSE 0.1e0 END FROM region
 UNION ALL SELECT 'no_asia', r_name, 0.25e0 FROM region WHERE r_name <> 'ASIA'
 UNION ALL SELECT 'short_sum', r_name, 0.15e0 FROM region"""
cte("ports", (), PORTFOLIOS_SQL)
cte("port_ret", ("ports", "ret"), "SELECT portfolio_id, dt, SUM(w * ret) AS ret FROM ret JOIN ports USING (symbol) GROUP BY portfolio_id, dt")


def portfolios(spark, sf):
    s = F.col("symbol")
    weights = F.map_filter(
        F.create_map(
            F.lit("equal"), F.lit(0.2),
            F.lit("concentrated"), F.when(s == "AFRICA", 0.6).otherwise(0.1),
            F.lit("no_asia"), F.when(s != "ASIA", 0.25),
            F.lit("short_sum"), F.lit(0.15),
        ),
        lambda k, v: v.isNotNull(),
    )
    names = D.table(spark, sf, "region").select(F.col("r_name").alias("symbol"))
    return names.select("symbol", F.explode(weights).alias("portfolio_id", "w"))


def port_rets(spark, sf):
    return portfolio_returns(rets(spark, sf), portfolios(spark, sf))


@query("portfolio_returns", with_ctes(["port_ret"], f"SELECT portfolio_id, {d()}, {r('ret')} FROM port_ret"))
def _(spark, sf):
    return port_rets(spark, sf)


cte("met_p", ("port_ret", "mkt_ret"), metrics_sql("port_ret", "portfolio_id", BJ))


@query("portfolio_metrics", with_ctes(["met_p"], f"SELECT portfolio_id, {', '.join([*PERF, *MORE, *REL])} FROM met_p"))
def _(spark, sf):
    return M.comprehensive_metrics(port_rets(spark, sf), ("portfolio_id",), benchmark=bench(spark, sf))


cte("brand_met", ("brand_ret",), metrics_sql("brand_ret", "symbol"))


@query("brand_metrics", with_ctes(["brand_met"], f"SELECT symbol, {', '.join([*PERF, *MORE])} FROM brand_met"))
def _(spark, sf):
    return M.comprehensive_metrics(simple_returns(D.brand_bars(spark, sf)))


# ---- summaries -------------------------------------------------------------------------------

_whole = " AND ".join(f"{c} IS NOT NULL" for c in ("open", "high", "low", "close", "adj_close", "volume"))
cte("usable", ("once",), f"SELECT * FROM once WHERE {_whole}")
cte("usable_ret", ("usable",), f"SELECT * FROM (SELECT symbol, dt, adj_close / NULLIF(LAG(adj_close) OVER {W}, 0) - 1 AS ret FROM usable) WHERE ret IS NOT NULL")
cte("met_u", ("usable_ret", "mkt_ret"), metrics_sql("usable_ret", "symbol", BJ))


@query(
    "asset_summary",
    with_ctes(
        ["met_u", "usable"],
        f"""SELECT symbol, n AS data_points, {', '.join([*PERF, *REL])}, records FROM met_u JOIN
        (SELECT symbol, STRING_AGG(CAST(dt AS VARCHAR) || '=' || CAST(CAST(volume AS BIGINT) AS VARCHAR), '; ' ORDER BY dt) AS records FROM usable GROUP BY symbol) USING (symbol)""",
    ),
)
def _(spark, sf):
    out = asset_summary(Q.dedup_bars(dirty(spark, sf).drop("rn"), first_by="src"), bench(spark, sf))
    text = F.transform("prices", lambda p: F.concat(p["dt"].cast("string"), F.lit("="), p["volume"].cast("string")))
    return out.withColumn("records", text).drop("prices")


# nations stand for symbols; those of two regions have no attributes, one has a short name only
@query(
    "symbol_lookup",
    """SELECT n_name AS symbol, CASE WHEN r_name IN ('ASIA', 'EUROPE') THEN 'N/A' WHEN n_nationkey % 3 = 0 THEN LOWER(n_name) ELSE n_name || ' of ' || r_name END AS name,
      CASE WHEN r_name IN ('ASIA', 'EUROPE') THEN 'N/A' ELSE r_name END AS sector, 'N/A' AS industry,
      CASE WHEN r_name IN ('ASIA', 'EUROPE') THEN 0 ELSE n_nationkey * 1000 END AS market_cap, 'USD' AS currency, 'N/A' AS exchange
    FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def _(spark, sf):
    nation, region = D.table(spark, sf, "nation"), D.table(spark, sf, "region")
    both = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    attributes = both.filter(~F.col("r_name").isin("ASIA", "EUROPE")).select(
        F.col("n_name").alias("symbol"),
        F.when(F.col("n_nationkey") % 3 != 0, F.concat("n_name", F.lit(" of "), "r_name")).alias("long_name"),
        F.lower("n_name").alias("short_name"),
        F.col("r_name").alias("sector"),
        (F.col("n_nationkey") * 1000).alias("market_cap"),
    )
    return symbol_lookup(nation.select(F.col("n_name").alias("symbol")), attributes)
