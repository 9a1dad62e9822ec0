"""Feature queries: each family alone, then the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from barweave.catalog.oracle import cte, d, r, with_ctes
from barweave.catalog.q_returns import W, bench
from barweave.catalog.registry import query
from barweave.operators import features as X
from barweave.operators.returns import align_left_benchmark, simple_returns
from barweave.sources import derived as D


def fw(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY dt ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(fn: str, col: str, n: int, extra: str = "") -> str:
    return f"(CASE WHEN COUNT({col}) OVER {fw(n)} = {n} THEN {fn}({col}{extra}) OVER {fw(n)} END)"


def lag(col: str, k: int) -> str:
    return f"LAG({col}, {k}) OVER {W}"


def pair(fn: str, n: int) -> str:
    return f"(CASE WHEN COUNT(log_returns * bench_ret) OVER {fw(n)} = {n} THEN {fn}(log_returns, bench_ret) OVER {fw(n)} END)"


first = {
    **{n: f"p / {lag('p', k)} - 1" for n, k in X.MOMENTUM.items()},
    **{f"price_to_ma_{n}": f"p / {full('AVG', 'p', n)}" for n in X.PRICE_TO_MA},
    **{f"return_stability_{n}d": f"{full('AVG', 'log_returns', n)} / ({full('STDDEV_SAMP', 'log_returns', n)} + 1e-8)" for n in X.STABILITY},
    **{f"volatility_{n}d": f"{full('STDDEV_SAMP', 'log_returns', n)} * SQRT(252e0)" for n in X.VOLATILITY},
    **{f"volume_ma_{n}": full("AVG", "volume", n) for n in X.VOLUME_MA},
    **{f"ma_{n}": full("AVG", "p", n) for n in (21, 63)},
    "drawdown_from_high": f"p / {full('MAX', 'p', 252)} - 1",
    **{f"win_rate_{n}d": f"CASE WHEN COUNT(*) OVER {fw(n)} = {n} THEN AVG(CASE WHEN price_change > 0 THEN 1e0 ELSE 0e0 END) OVER {fw(n)} END" for n in X.WIN_RATE},
    "target": f"LEAD(price_change) OVER {W}",
    "hl_range": "(high - low) / (p + 1e-8)",
    **{f"market_corr_{n}d": pair("CORR", n) for n in X.MARKET},
    **{f"beta_{n}d": f"{pair('COVAR_SAMP', n)} / ({full('VAR_SAMP', 'bench_ret', n)} + 1e-8)" for n in X.MARKET},
}
second = {
    "vol_regime": "volatility_21d / (volatility_252d + 1e-8)",
    "volume_regime": "volume_ma_21 / (volume_ma_63 + 1e-8)",
    **{n: lag(c, k) for n, (c, k) in X.PRICE_LAGS.items()},
    "vol_mom_21d": "volatility_21d * momentum_21d",
    "vol_mom_63d": "volatility_63d * momentum_3m",
    "hl_range_ma_21": full("AVG", "hl_range", 21),
    "hl_volatility": full("STDDEV_SAMP", "hl_range", 21),
    "momentum_accel_21d": f"momentum_21d - {lag('momentum_21d', 21)}",
    "momentum_accel_63d": f"momentum_3m - {lag('momentum_3m', 63)}",
    "ma_cross_21_63": "ma_21 / ma_63 - 1",
    "vol_spike": f"CAST(COALESCE(ROUND(volatility_21d, 9) > ROUND({full('QUANTILE_CONT', 'volatility_252d', 63, ', 0.75')}, 9), FALSE) AS BIGINT)",
    "trend_strength": "ABS(momentum_3m) / (volatility_63d + 1e-8)",
    "volume_surge": "CAST(COALESCE(volume_ma_21 > volume_ma_63 * 1.5e0, FALSE) AS BIGINT)",
    "beta_stability": "ABS(beta_63d - beta_126d)",
}
third = {
    "volume_price_change_lag1": f"{lag('volume_regime', 1)} * {lag('price_change', 1)}",
    "volume_momentum_21d": "volume_regime * momentum_21d",
}


def stage(cols: dict[str, str], source: str) -> str:
    return "SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in cols.items()) + f" FROM {source}"


cte(
    "f0",
    ("bars", "mkt_ret"),
    f"""SELECT symbol, dt, adj_close AS p, high, low, volume, bench_ret, adj_close / {lag('adj_close', 1)} - 1 AS price_change,
    LN(adj_close / {lag('adj_close', 1)}) AS log_returns FROM bars LEFT JOIN mkt_ret USING (dt)""",
)
cte("f1", ("f0",), stage(first, "f0"))
cte("f2", ("f1",), stage(second, "f1"))
cte("f3", ("f2",), stage(third, "f2"))
INTS = {"vol_spike", "volume_surge"}


def out(cols: list[str]) -> str:
    return ", ".join(c if c in INTS else r(c) for c in cols)


def family(key: str, cols: list[str]) -> None:
    market = any(c in X.MARKET_COLUMNS for c in cols)

    @query(key, with_ctes(["f3"], f"SELECT symbol, {d()}, {out(cols)} FROM f3"))
    def _(spark, sf):
        bars = D.bars(spark, sf)
        if market:
            bars = align_left_benchmark(bars, bench(spark, sf))
        return X.add_features(bars, bench="bench_ret" if market else None, only=cols)


FAMILIES = {
    "momentum": list(X.MOMENTUM),
    "price_to_ma": [f"price_to_ma_{n}" for n in X.PRICE_TO_MA],
    "return_stability": [f"return_stability_{n}d" for n in X.STABILITY],
    "realized_volatility": [f"volatility_{n}d" for n in X.VOLATILITY],
    "vol_regime": ["vol_regime"],
    "volume_regime": ["volume_ma_21", "volume_ma_63", "volume_regime"],
    "rolling_market_corr": [f"market_corr_{n}d" for n in X.MARKET],
    "rolling_beta": ["beta_63d", "beta_126d", "beta_stability"],
    "lagged_features": list(X.PRICE_LAGS),
    "interaction_features": ["vol_mom_21d", "vol_mom_63d", "volume_price_change_lag1", "volume_momentum_21d"],
    "high_low_range": ["hl_range", "hl_range_ma_21", "hl_volatility"],
    "momentum_acceleration": ["momentum_accel_21d", "momentum_accel_63d"],
    "ma_cross": ["ma_21", "ma_63", "ma_cross_21_63"],
    "vol_spike": ["vol_spike"],
    "trend_strength": ["trend_strength"],
    "volume_surge": ["volume_surge"],
    "drawdown_from_high": ["drawdown_from_high"],
    "rolling_win_rate": [f"win_rate_{n}d" for n in X.WIN_RATE],
    "next_day_target": ["target"],
}
for _k, _c in FAMILIES.items():
    family(_k, _c)

_base = [*X.FEATURE_COLUMNS, "target"]
_market = [*X.FEATURE_COLUMNS, *X.MARKET_COLUMNS, "target"]


def _whole(cols: list[str]) -> str:
    keep = " AND ".join(f"{c} IS NOT NULL" for c in ["price_change", "log_returns", *cols])
    return with_ctes(["f3"], f"SELECT symbol, {d()}, {out(cols)} FROM f3 WHERE {keep}")


@query("feature_table", _whole(_base))
def _(spark, sf):
    return X.feature_table(D.bars(spark, sf)).select("symbol", "dt", *_base)


@query("feature_table_market", _whole(_market))
def _(spark, sf):
    bars = align_left_benchmark(D.bars(spark, sf), bench(spark, sf))
    return X.feature_table(bars, bench="bench_ret").select("symbol", "dt", *_market)


@query(
    "momentum_ticks",
    with_ctes(
        ["ticks"],
        f"""SELECT symbol, CAST(ts AS VARCHAR) AS ts, {', '.join(r(e.replace('ORDER BY dt', 'ORDER BY ts').replace('p /', 'adj_close /').replace('LAG(p,', 'LAG(adj_close,'), n) for n, e in first.items() if n in X.MOMENTUM)} FROM ticks""",
    ),
)
def _(spark, sf):
    # no calendar bound: sliced windows with overlapping edges
    ticks = D.ticks(spark, sf).withColumns({"high": F.col("adj_close"), "low": F.col("adj_close"), "volume": F.lit(1.0)})
    return X.add_features(ticks, order="ts", only=list(X.MOMENTUM))


R60, R20 = ("(ORDER BY dt ROWS BETWEEN %d PRECEDING AND CURRENT ROW)" % (n - 1) for n in (60, 20))
cte(
    "rf1",
    ("mkt_ret",),
    f"""SELECT dt, bench_ret, CASE WHEN COUNT(bench_ret) OVER {R60} = 60 THEN SUM(bench_ret) OVER {R60} END AS rolling_return,
      CASE WHEN COUNT(bench_ret) OVER {R20} = 20 THEN STDDEV_SAMP(bench_ret) OVER {R20} * SQRT(252e0) END AS realized_vol FROM mkt_ret""",
)
cte(
    "rf",
    ("rf1",),
    f"""SELECT * FROM (SELECT *, CASE WHEN COUNT(realized_vol) OVER {R20} = 20 THEN STDDEV_SAMP(realized_vol) OVER {R20} END AS vix_proxy FROM rf1)
       WHERE rolling_return IS NOT NULL AND vix_proxy IS NOT NULL""",
)


@query("regime_features", with_ctes(["rf"], f"SELECT {d()}, {r('rolling_return')}, {r('realized_vol')}, {r('vix_proxy')} FROM rf"))
def _(spark, sf):
    return regime_inputs(spark, sf).select("dt", "rolling_return", "realized_vol", "vix_proxy")


def regime_inputs(spark, sf):
    return X.regime_features(simple_returns(D.market(spark, sf)).select("symbol", "dt", "ret"), key=("symbol",))


_RC = ["rolling_return", "realized_vol", "vix_proxy"]


@query(
    "row_zscore_scale",
    with_ctes(
        ["rf"],
        f"""SELECT {d()}, {', '.join(r(f'({c} - (SELECT AVG({c}) FROM fit)) / (SELECT STDDEV_POP({c}) FROM fit)', c) for c in _RC)} FROM rf""",
        fit="SELECT * FROM rf WHERE dt < DATE '1998-01-01'",
    ),
)
def _(spark, sf):
    rows = regime_inputs(spark, sf).select("dt", *_RC)
    return X.scale_by_fit(rows, rows.filter("dt < date'1998-01-01'"), _RC)
