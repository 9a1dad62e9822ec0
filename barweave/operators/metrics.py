"""Performance and risk metrics per key, and comparisons of strategies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.functions.exprs import annual_return, annualised, ratio_or_zero, sharpe
from barweave.operators.returns import drawdown_curve
from barweave.operators.segments import worst_falls
from barweave.operators.series import calendar_bounded, over_rows
from barweave.schemas import RISK_FREE, TRADING_DAYS


def _total(ret: str) -> Column:
    return F.product(1.0 + F.col(ret)) - 1.0


def total_return(returns: DataFrame, key: Sequence[str] = ("symbol",), ret: str = "ret") -> DataFrame:
    return returns.groupBy(*key).agg(_total(ret).alias("total_return"))


def annual_return_by(returns: DataFrame, key: Sequence[str] = ("symbol",), ret: str = "ret", days: int = TRADING_DAYS) -> DataFrame:
    return returns.groupBy(*key).agg(annual_return(_total(ret), F.count(ret), days).alias("annual_return"))


def annual_volatility(returns: DataFrame, key: Sequence[str] = ("symbol",), ret: str = "ret", days: int = TRADING_DAYS) -> DataFrame:
    return returns.groupBy(*key).agg(annualised(F.stddev_samp(ret), days).alias("annual_volatility"))


def max_drawdown(returns: DataFrame, key: Sequence[str] = ("symbol",), order: str = "dt", ret: str = "ret") -> DataFrame:
    """Largest fall below the peak so far. Beyond the calendar bound no curve is made: pieces of a series merge."""
    if calendar_bounded(returns, order):
        return drawdown_curve(returns, key, order, ret).groupBy(*key).agg(F.min("drawdown").alias("max_drawdown"))
    return worst_falls(returns, key, order, ret)


def day_stats(returns: DataFrame, key: Sequence[str] = ("symbol",), ret: str = "ret") -> DataFrame:
    return returns.groupBy(*key).agg(*_day_stats(ret))


def _day_stats(ret: str) -> list[Column]:
    r = F.col(ret)
    return [
        F.max(ret).alias("best_day"),
        F.min(ret).alias("worst_day"),
        F.avg((r > 0).cast("double")).alias("win_rate"),
        F.avg((r < 0).cast("double")).alias("loss_rate"),
    ]


BASIC = ["total_return", "annual_return", "annual_volatility", "sharpe_ratio", "max_drawdown", "best_day", "worst_day", "win_rate"]
RELATIVE = ["beta", "alpha", "information_ratio"]
EXTRA = ["sortino_ratio", "calmar_ratio", "loss_rate"]


def comprehensive_metrics(
    returns: DataFrame,
    key: Sequence[str] = ("symbol",),
    order: str = "dt",
    ret: str = "ret",
    rf: float = RISK_FREE,
    days: int = TRADING_DAYS,
    benchmark: DataFrame | None = None,
) -> DataFrame:
    """All metrics in one row per key: one ordered pass for the drawdown, one aggregation. Beyond the calendar bound
    the drawdown comes from merged pieces of the series and is joined to the aggregation.

    ``benchmark`` has (order, bench_ret); relative metrics use the dates both have.
    """
    key = list(key)
    bounded = calendar_bounded(returns, order)
    rows = drawdown_curve(returns, key, order, ret) if bounded else returns
    r = F.col(ret)
    aggs = [
        F.count(ret).alias("_n"),
        _total(ret).alias("total_return"),
        annualised(F.stddev_samp(ret), days).alias("annual_volatility"),
        *([F.min("drawdown").alias("max_drawdown")] if bounded else []),
        *_day_stats(ret),
        F.count(F.when(r < 0, 1)).alias("_neg"),
        annualised(F.stddev_samp(F.when(r < 0, r)), days).alias("_down"),
    ]
    if benchmark is not None:
        rows = rows.join(benchmark.select(order, "bench_ret"), order, "left")
        b = F.col("bench_ret")
        both = F.when(b.isNotNull(), r)
        aggs += [
            F.count(both).alias("_m"),
            F.product(1.0 + both).alias("_gp"),
            F.product(1.0 + b).alias("_gb"),
            F.covar_samp(both, b).alias("_cov"),
            F.var_pop(b).alias("_var"),
            F.avg(r - b).alias("_ad"),
            F.stddev_samp(r - b).alias("_sd"),
        ]
    m = rows.groupBy(*key).agg(*aggs)
    if not bounded:
        m = m.join(worst_falls(returns, key, order, ret), key, "left") if key else m.crossJoin(F.broadcast(worst_falls(returns, key, order, ret)))  # one row
    m = m.withColumn("annual_return", annual_return(F.col("total_return"), F.col("_n"), days))
    m = m.withColumn("sharpe_ratio", sharpe(F.col("annual_return"), F.col("annual_volatility"), rf))
    m = m.withColumns(
        {
            "sortino_ratio": F.when(
                F.col("_neg") > 0,
                F.when(F.col("_down") > 0, (F.col("annual_return") - rf) / F.col("_down")).otherwise(F.lit(0.0)),
            ).otherwise(F.col("sharpe_ratio")),
            "calmar_ratio": ratio_or_zero(F.col("annual_return"), F.abs("max_drawdown")),
        }
    )
    cols = [*key, *BASIC, *EXTRA]
    if benchmark is not None:
        ok = F.col("_m") >= 2
        beta = ratio_or_zero(F.col("_cov"), F.col("_var"))
        ap = annual_return(F.col("_gp") - 1, F.col("_m"), days)
        ab = annual_return(F.col("_gb") - 1, F.col("_m"), days)
        m = m.withColumn("beta", F.when(ok, beta))
        m = m.withColumns(
            {
                "alpha": F.when(ok, ap - (rf + F.col("beta") * (ab - rf))),
                "information_ratio": F.when(ok, ratio_or_zero(F.col("_ad") * days, annualised(F.col("_sd"), days))),
            }
        )
        cols += RELATIVE
    return m.select(*cols)


def performance_metrics(returns: DataFrame, key: Sequence[str] = ("symbol",), **kw) -> DataFrame:
    m = comprehensive_metrics(returns, key, **kw)
    return m.drop(*EXTRA)


def relative_metrics(returns: DataFrame, benchmark: DataFrame, key: Sequence[str] = ("symbol",), order: str = "dt",
                     ret: str = "ret", rf: float = RISK_FREE, days: int = TRADING_DAYS) -> DataFrame:
    """Beta, alpha and information ratio on the dates shared with the benchmark; fewer than two
    shared dates give no row. Beta keeps its mixed degrees of freedom: sample covariance over
    population variance."""
    r, b = F.col(ret), F.col("bench_ret")
    m = (
        returns.join(benchmark.select(order, "bench_ret"), order)
        .groupBy(*key)
        .agg(
            F.count(F.lit(1)).alias("_m"),
            annual_return(_total(ret), F.count(F.lit(1)), days).alias("_ap"),
            annual_return(_total("bench_ret"), F.count(F.lit(1)), days).alias("_ab"),
            ratio_or_zero(F.covar_samp(r, b), F.var_pop(b)).alias("beta"),
            ratio_or_zero(F.avg(r - b) * days, annualised(F.stddev_samp(r - b), days)).alias("information_ratio"),
        )
        .filter(F.col("_m") >= 2)
    )
    return m.select(
        *key, "beta", (F.col("_ap") - (rf + F.col("beta") * (F.col("_ab") - rf))).alias("alpha"), "information_ratio"
    )


def returns_describe(returns: DataFrame, key: Sequence[str] = ("symbol",), ret: str = "ret") -> DataFrame:
    return returns.groupBy(*key).agg(F.avg(ret).alias("mean"), F.stddev_samp(ret).alias("std"))


def mean_returns(returns: DataFrame, key: Sequence[str] = ("symbol",), ret: str = "ret", days: int = TRADING_DAYS) -> DataFrame:
    return returns.groupBy(*key).agg((F.avg(ret) * days).alias("mu"))


def excess_returns(returns: DataFrame, a: str, b: str, key: str = "strategy", order: str = "dt", ret: str = "ret") -> DataFrame:
    """Returns of a minus returns of b on shared dates. One aggregation by date, no self-join."""
    return (
        returns.filter(F.col(key).isin(a, b))
        .groupBy(order)
        .agg(F.max(F.when(F.col(key) == a, F.col(ret))).alias("_a"), F.max(F.when(F.col(key) == b, F.col(ret))).alias("_b"))
        .filter(F.col("_a").isNotNull() & F.col("_b").isNotNull())
        .select(F.lit(f"{a}-{b}").alias(key), order, (F.col("_a") - F.col("_b")).alias(ret))
    )


def strategy_rankings(metrics: DataFrame, key: str = "strategy") -> DataFrame:
    """Place of every strategy by four metrics (the drawdown by size, small first) and the order as text."""
    scores = metrics.select(
        key,
        F.expr(
            "stack(4, 'sharpe_ratio', -sharpe_ratio, 'sortino_ratio', -sortino_ratio,"
            " 'annual_return', -annual_return, 'max_drawdown', abs(max_drawdown)) as (metric, _score)"
        ),
    ).withColumn("_score", F.round("_score", 9))
    w = Window.partitionBy("metric").orderBy("_score", key)
    placed = scores.withColumn("place", F.row_number().over(w))
    # one row per strategy and metric: the number of strategies bounds each group
    text = placed.groupBy("metric").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", key))), lambda s: s[key]), " > ").alias("ranking")
    )
    return placed.select("metric", key, "place").join(text, "metric")


def turnover_impact(scores: DataFrame, base: str, other: str, cols: Sequence[str], key: str = "strategy") -> DataFrame:
    """Value of ``other`` minus value of ``base`` for each column, one row."""
    rows = scores.filter(F.col(key).isin(base, other))
    pick = {c: (F.max(F.when(F.col(key) == base, F.col(c))), F.max(F.when(F.col(key) == other, F.col(c)))) for c in cols}
    return rows.agg(*[(o - b).alias(f"delta_{c}") for c, (b, o) in pick.items()])


def sharpe_improvement(a: Column, b: Column) -> Column:
    return F.try_divide(a - b, F.abs(b)) * 100


def rolling_sharpe(returns: DataFrame, key: Sequence[str] = ("symbol",), order: str = "dt", ret: str = "ret", n: int = 252,
                   rf: float = RISK_FREE, days: int = TRADING_DAYS) -> DataFrame:
    def build(df: DataFrame, part: list[str]) -> DataFrame:
        w = Window.partitionBy(*part).orderBy(order).rowsBetween(-(n - 1), 0)
        value = sharpe(F.avg(ret).over(w) * days, annualised(F.stddev_samp(ret).over(w), days), rf)
        return df.withColumn("rolling_sharpe", F.when(F.count(ret).over(w) == n, value))

    return over_rows(returns, key, order, build, back=n - 1)


def regression_scores(predictions: DataFrame, key: Sequence[str] = ("symbol",), y: str = "y", yhat: str = "yhat") -> DataFrame:
    err = F.col(y) - F.col(yhat)
    hit = F.signum(F.col(y)) == F.signum(F.col(yhat))
    return predictions.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(err * err).alias("mse"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        (1 - F.try_divide(F.sum(err * err), F.var_pop(y) * F.count(y))).alias("r2"),
        F.avg(F.abs(err)).alias("mae"),
        F.avg(hit.cast("double")).alias("directional_accuracy"),
    )


def method_ranking(metrics: DataFrame, key: str = "method") -> DataFrame:
    """Places by Sharpe ratio and by drawdown; one row per method, so the methods share a task."""
    m = metrics.select(key, F.round("sharpe_ratio", 9).alias("_s"), F.round("max_drawdown", 9).alias("_d")).withColumn("_one", F.lit(1))
    one = Window.partitionBy("_one")
    return m.select(
        key, F.rank().over(one.orderBy(F.desc("_s"))).alias("by_sharpe"), F.rank().over(one.orderBy(F.desc("_d"))).alias("by_drawdown")
    )
