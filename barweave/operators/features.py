"""Rolling features of bars and the model input table.

Every rolling value is NULL until its frame is full. All columns of one stage share one partition
and order, so a feature table costs one shuffle and one sort; lags of rolling values form later
stages on the same sort.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barweave.functions.exprs import annualised, full_frame, ratio
from barweave.operators.series import over_rows
from barweave.schemas import TRADING_DAYS

EPS = 1e-8
# Names and lengths of the features.
MOMENTUM = {"momentum_12m": 252, "momentum_6m": 126, "momentum_3m": 63, "momentum_1m": 21,
            "momentum_5d": 5, "momentum_10d": 10, "momentum_21d": 21}
PRICE_TO_MA = [252, 126, 63]
STABILITY = [63, 126]
VOLATILITY = [21, 63, 252]
VOLUME_MA = [21, 63]
MARKET = [63, 126]
WIN_RATE = [21, 63]
PRICE_LAGS = {"momentum_5d_lag5": ("momentum_5d", 5), "momentum_10d_lag10": ("momentum_10d", 10),
              "momentum_21d_lag21": ("momentum_21d", 21), "volatility_21d_lag5": ("volatility_21d", 5),
              "volatility_21d_lag10": ("volatility_21d", 10), "volatility_21d_lag21": ("volatility_21d", 21)}
LOOK_BACK = 400  # longest chain: 63 rows of a 252-row volatility of returns

FEATURE_COLUMNS = [
    *MOMENTUM, *[f"price_to_ma_{n}" for n in PRICE_TO_MA], *[f"return_stability_{n}d" for n in STABILITY],
    *[f"volatility_{n}d" for n in VOLATILITY], "vol_regime", *[f"volume_ma_{n}" for n in VOLUME_MA], "volume_regime",
    *PRICE_LAGS, "vol_mom_21d", "vol_mom_63d", "volume_price_change_lag1", "volume_momentum_21d",
    "hl_range", "hl_range_ma_21", "hl_volatility", "momentum_accel_21d", "momentum_accel_63d",
    "ma_21", "ma_63", "ma_cross_21_63", "vol_spike", "trend_strength", "volume_surge", "drawdown_from_high",
    *[f"win_rate_{n}d" for n in WIN_RATE],
]
MARKET_COLUMNS = [*[f"market_corr_{n}d" for n in MARKET], *[f"beta_{n}d" for n in MARKET], "beta_stability"]
# Columns a model does not see: intermediate averages for both sets, weak ones for the smaller set.
NOT_INPUT = ["ma_21", "ma_63"]
WEAK = [*PRICE_LAGS, "vol_mom_21d", "vol_mom_63d", "volume_momentum_21d", "momentum_accel_21d", "momentum_accel_63d"]


class _Frames:
    def __init__(self, part: Sequence[str], order: str) -> None:
        self.o: WindowSpec = Window.partitionBy(*part).orderBy(order)

    def last(self, n: int) -> WindowSpec:
        return self.o.rowsBetween(-(n - 1), 0)

    def mean(self, c: str, n: int) -> Column:
        return full_frame(F.avg(c), F.col(c), self.last(n), n)

    def std(self, c: str, n: int) -> Column:
        return full_frame(F.stddev_samp(c), F.col(c), self.last(n), n)

    def lag(self, c: str, k: int) -> Column:
        return F.lag(c, k).over(self.o)


def _returns(df: DataFrame, f: _Frames, price: str) -> DataFrame:
    p = ratio(F.col(price), f.lag(price, 1))
    return df.withColumns({"price_change": p - 1, "log_returns": F.ln(p)})


def _momentum(f: _Frames, price: str) -> dict[str, Column]:
    return {n: ratio(F.col(price), f.lag(price, k)) - 1 for n, k in MOMENTUM.items()}


def _price_to_ma(f: _Frames, price: str) -> dict[str, Column]:
    return {f"price_to_ma_{n}": ratio(F.col(price), f.mean(price, n)) for n in PRICE_TO_MA}


def _stability(f: _Frames) -> dict[str, Column]:
    return {f"return_stability_{n}d": f.mean("log_returns", n) / (f.std("log_returns", n) + EPS) for n in STABILITY}


def _volatility(f: _Frames) -> dict[str, Column]:
    return {f"volatility_{n}d": annualised(f.std("log_returns", n)) for n in VOLATILITY}


def _volume(f: _Frames) -> dict[str, Column]:
    return {f"volume_ma_{n}": f.mean("volume", n) for n in VOLUME_MA}


def _moving(f: _Frames, price: str) -> dict[str, Column]:
    return {f"ma_{n}": f.mean(price, n) for n in (21, 63)}


def _high(f: _Frames, price: str, n: int = 252) -> dict[str, Column]:
    return {"drawdown_from_high": ratio(F.col(price), full_frame(F.max(price), F.col(price), f.last(n), n)) - 1}


def _win_rate(f: _Frames) -> dict[str, Column]:
    up = F.coalesce(F.col("price_change") > 0, F.lit(False)).cast("double")
    return {f"win_rate_{n}d": full_frame(F.avg(up), F.lit(1), f.last(n), n) for n in WIN_RATE}


def _target(f: _Frames) -> dict[str, Column]:
    return {"target": F.lead("price_change", 1).over(f.o)}


def _beta(f: _Frames, n: int, bench: str) -> Column:
    w, pair = f.last(n), F.col("log_returns") * F.col(bench)
    cov = full_frame(F.covar_samp("log_returns", bench), pair, w, n)
    return cov / (full_frame(F.var_samp(bench), F.col(bench), w, n) + EPS)


def _market(f: _Frames, bench: str) -> dict[str, Column]:
    pair = F.col("log_returns") * F.col(bench)
    return {
        **{f"market_corr_{n}d": full_frame(F.corr("log_returns", bench), pair, f.last(n), n) for n in MARKET},
        **{f"beta_{n}d": _beta(f, n, bench) for n in MARKET},
    }


_SECOND = {
    "vol_regime": lambda f: F.col("volatility_21d") / (F.col("volatility_252d") + EPS),
    "volume_regime": lambda f: F.col("volume_ma_21") / (F.col("volume_ma_63") + EPS),
    **{n: (lambda f, c=c, k=k: f.lag(c, k)) for n, (c, k) in PRICE_LAGS.items()},
    "vol_mom_21d": lambda f: F.col("volatility_21d") * F.col("momentum_21d"),
    "vol_mom_63d": lambda f: F.col("volatility_63d") * F.col("momentum_3m"),
    "hl_range_ma_21": lambda f: f.mean("hl_range", 21),
    "hl_volatility": lambda f: f.std("hl_range", 21),
    "momentum_accel_21d": lambda f: F.col("momentum_21d") - f.lag("momentum_21d", 21),
    "momentum_accel_63d": lambda f: F.col("momentum_3m") - f.lag("momentum_3m", 63),
    "ma_cross_21_63": lambda f: ratio(F.col("ma_21"), F.col("ma_63")) - 1,
    # both sides are rounded so that engines that sum in another order agree on near-equal values
    "vol_spike": lambda f: F.coalesce(
        F.round("volatility_21d", 9)
        > F.round(
            full_frame(F.percentile("volatility_252d", F.lit(0.75)), F.col("volatility_252d"), f.last(63), 63), 9
        ),
        F.lit(False),
    ).cast("long"),
    "trend_strength": lambda f: F.abs("momentum_3m") / (F.col("volatility_63d") + EPS),
    "volume_surge": lambda f: F.coalesce(F.col("volume_ma_21") > F.col("volume_ma_63") * 1.5, F.lit(False)).cast("long"),
}
_THIRD = {
    "volume_price_change_lag1": lambda f: f.lag("volume_regime", 1) * f.lag("price_change", 1),
    "volume_momentum_21d": lambda f: F.col("volume_regime") * F.col("momentum_21d"),
}


def _stage(df: DataFrame, f: _Frames, cols: dict) -> DataFrame:
    return df.withColumns({n: c(f) for n, c in cols.items()})


def add_features(
    bars: DataFrame,
    key: Sequence[str] = ("symbol",),
    order: str = "dt",
    price: str = "adj_close",
    bench: str | None = None,
    only: Sequence[str] | None = None,
) -> DataFrame:
    """All feature columns next to the bars; ``only`` keeps the named ones and Catalyst drops the rest.

    ``bench`` names a benchmark return column already on the bars.
    """

    def build(df: DataFrame, part: list[str]) -> DataFrame:
        f = _Frames(part, order)
        out = _returns(df, f, price)
        first = {
            **_momentum(f, price), **_price_to_ma(f, price), **_stability(f), **_volatility(f), **_volume(f),
            **_moving(f, price), **_high(f, price), **_win_rate(f), **_target(f),
            "hl_range": (F.col("high") - F.col("low")) / (F.col(price) + EPS),
        }
        if bench:
            first |= _market(f, bench)
        out = _stage(_stage(out.withColumns(first), f, _SECOND), f, _THIRD)
        if bench:
            out = out.withColumn("beta_stability", F.abs(F.col("beta_63d") - F.col("beta_126d")))
        return out

    out = over_rows(bars, key, order, build, back=LOOK_BACK, ahead=1)
    return out.select(*key, order, *only) if only else out


def feature_table(bars: DataFrame, key: Sequence[str] = ("symbol",), order: str = "dt", price: str = "adj_close",
                  bench: str | None = None) -> DataFrame:
    """Feature rows without any NULL: the warm-up and the last row of each key are gone."""
    cols = [*FEATURE_COLUMNS, *(MARKET_COLUMNS if bench else []), "target"]
    full = add_features(bars, key, order, price, bench, only=["price_change", "log_returns", *cols])
    return full.na.drop("any")


def input_columns(model: str = "gbt", bench: bool = False) -> list[str]:
    """Feature columns a model sees: 41 for boosted trees, 30 for the forest; 5 more with a benchmark."""
    cols = [c for c in FEATURE_COLUMNS if c not in NOT_INPUT]
    if model == "rf":
        cols = [c for c in cols if c not in WEAK]
    return cols + (MARKET_COLUMNS if bench else [])


def regime_features(returns: DataFrame, key: Sequence[str] = (), order: str = "dt", ret: str = "ret",
                    return_window: int = 60, vol_window: int = 20) -> DataFrame:
    """Rolling sum of returns, annualised volatility and the volatility of that volatility."""

    def build(df: DataFrame, part: list[str]) -> DataFrame:
        f = _Frames(part, order)
        one = df.withColumns(
            {
                "rolling_return": full_frame(F.sum(ret), F.col(ret), f.last(return_window), return_window),
                "realized_vol": f.std(ret, vol_window) * math.sqrt(TRADING_DAYS),
            }
        )
        return one.withColumn("vix_proxy", f.std("realized_vol", vol_window))

    cols = ["rolling_return", "realized_vol", "vix_proxy"]
    return over_rows(returns, key, order, build, back=return_window + vol_window).na.drop("any", subset=cols)


def scale_by_fit(df: DataFrame, fit: DataFrame, cols: Sequence[str], key: Sequence[str] = ()) -> DataFrame:
    """(x - mean) / population deviation with the statistics of ``fit``; a deviation of 0 counts as 1."""
    stats = fit.groupBy(*key).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols]
    )
    # without a key the statistics are exactly one row
    joined = df.join(stats, list(key)) if key else df.join(F.broadcast(stats), F.lit(True))
    return joined.withColumns(
        {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) for c in cols}
    ).select(*df.columns)
