"""Market regimes: labels, smoothing, statistics, transitions and weights per regime."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.operators import allocation as A
from barweave.operators.features import scale_by_fit
from barweave.operators.orderstats import percentiles
from barweave.operators.series import over_rows
from barweave.plans.walkforward import window_problems
from barweave.schemas import TRADING_DAYS
from barweave.session import settle

# Names of the regimes and columns of the regime features.
REGIMES = ["Bull", "Bear", "Sideways"]
FEATURES = ["rolling_return", "realized_vol", "vix_proxy"]
BULL_AVERSION = 2.0


def regime_rule_labels(features: DataFrame, key: Sequence[str] = (), value: str = "rolling_return", out: str = "regime") -> DataFrame:
    """Lowest third of ``value`` is Bear, highest third Bull. The thresholds are exact order statistics of each key,
    found by counting, so a key may have any number of rows. A row without a value is Sideways."""
    key = list(key)
    x = F.round(value, 9)
    third = lambda k: F.round(F.col("percentiles")[k], 9)
    cuts = percentiles(features, key, x, [1 / 3, 2 / 3]).select(*key, third(0).alias("_lo"), third(1).alias("_hi"))
    # without a key the thresholds are exactly one row
    rows = features.join(cuts, key, "left") if key else features.join(F.broadcast(cuts), F.lit(True), "left")
    label = F.when(x <= F.col("_lo"), "Bear").when(x > F.col("_hi"), "Bull").otherwise("Sideways")
    return rows.withColumn(out, label).drop("_lo", "_hi")


def regime_labels(states: DataFrame, key: Sequence[str] = (), state: str = "state", value: str = "rolling_return", out: str = "regime") -> DataFrame:
    """Names given states by their mean of ``value``: lowest Bear, highest Bull, all others Sideways."""
    key = list(key)
    means = states.groupBy(*key, state).agg(F.round(F.avg(value), 12).alias("_mean"))
    ends = means.groupBy(*(key or [F.lit(0).alias("_k")])).agg(
        F.min(F.struct("_mean", state)).alias("_lo"), F.max(F.struct("_mean", state)).alias("_hi")
    )
    named = means.join(ends, key) if key else means.join(F.broadcast(ends.drop("_k")), F.lit(True))
    names = named.select(
        *key, state,
        F.when(F.col(f"_lo.{state}") == F.col(state), "Bear").when(F.col(f"_hi.{state}") == F.col(state), "Bull").otherwise("Sideways").alias(out),
    )
    # a state is one row of a handful, so the names are broadcast
    return states.join(F.broadcast(names) if not key else names, [*key, state])


def regime_smoothing(labels: DataFrame, n: int = 5, key: Sequence[str] = (), order: str = "dt", label: str = "regime", out: str = "smoothed") -> DataFrame:
    """Most frequent label of the last n rows; a tie goes to the label seen last."""

    def build(df: DataFrame, part: list[str]) -> DataFrame:
        o = Window.partitionBy(*part).orderBy(order)
        w = o.rowsBetween(-(n - 1), 0)
        votes = [
            F.struct(
                F.count(F.when(F.col(label) == name, 1)).over(w).alias("votes"),
                F.max(F.when(F.col(label) == name, F.col(order))).over(w).alias("seen"),
                F.lit(name).alias("name"),
            )
            for name in REGIMES
        ]
        return df.withColumn(out, F.array_max(F.array(*votes))["name"])

    return over_rows(labels, key, order, build, back=n - 1)


def regime_clusters(features: DataFrame, cols: Sequence[str] = FEATURES, k: int = 3, seed: int = 42) -> DataFrame:
    """Gaussian states with full covariance on scaled features, fitted over all rows at once.

    A mixture has no memory of the previous state; :func:`regime_smoothing` stands in for it.
    """
    cols = list(cols)
    scaled = scale_by_fit(features, features, cols).select(*[F.col(c).alias(f"_z_{c}") for c in cols], F.struct(*features.columns).alias("_row"))
    vectors = VectorAssembler(inputCols=[f"_z_{c}" for c in cols], outputCol="_x").transform(scaled).select("_row", "_x")
    raw = vectors.select(F.col("_x"), "_row")
    model = GaussianMixture(k=k, seed=seed, featuresCol="_x", predictionCol="state", probabilityCol="_p").fit(raw)
    out = model.transform(raw)
    return out.select("_row.*", F.col("state").cast("long").alias("state"), F.array_max(vector_to_array("_p")).alias("confidence"))


# ---- reports --------------------------------------------------------------------------------


def regime_statistics(labels: DataFrame, returns: DataFrame, key: Sequence[str] = (), order: str = "dt", label: str = "regime",
                      ret: str = "ret", days: int = TRADING_DAYS) -> DataFrame:
    """Count, share of time, annual mean, volatility and their ratio (no risk-free rate) per regime."""
    key = list(key)
    mean, vol = F.avg(ret) * days, F.stddev_samp(ret) * math.sqrt(days)
    per = labels.select(*key, order, label).join(returns.select(*key, order, ret), [*key, order]).groupBy(*key, label).agg(
        F.count(F.lit(1)).alias("count"), mean.alias("mean_return"), vol.alias("volatility"), (mean / (vol + 1e-8)).alias("sharpe")
    )
    return _share(per, key, "count", "pct_time")


def regime_distribution(labels: DataFrame, key: Sequence[str] = (), label: str = "regime") -> DataFrame:
    return _share(labels.groupBy(*key, label).agg(F.count(F.lit(1)).alias("days")), list(key), "days", "pct")


def _share(counts: DataFrame, key: list[str], count: str, out: str) -> DataFrame:
    # three regimes per key
    total = F.sum(count).over(Window.partitionBy(*key) if key else Window.partitionBy(F.lit(0)))
    return counts.withColumn(out, F.col(count) / total * 100)


def regime_transitions(labels: DataFrame, key: Sequence[str] = (), order: str = "dt", label: str = "regime") -> DataFrame:
    """Share of next regimes per current regime; a regime that is never left has zeros."""
    key = list(key)

    def build(df: DataFrame, part: list[str]) -> DataFrame:
        return df.withColumn("_next", F.lead(label).over(Window.partitionBy(*part).orderBy(order)))

    steps = over_rows(labels, key, order, build, back=0, ahead=1)
    counts = steps.groupBy(*key, F.col(label).alias("current")).agg(*[F.count(F.when(F.col("_next") == x, 1)).alias(x) for x in REGIMES])
    names = F.explode(F.array(*[F.lit(x) for x in REGIMES])).alias("current")
    frame = labels.select(*key).distinct().select(*key, names) if key else labels.sparkSession.range(1).select(names)
    total = sum((F.col(x) for x in REGIMES[1:]), F.col(REGIMES[0]))
    return frame.join(counts, [*key, "current"], "left").select(
        *key, "current", *[F.coalesce(F.try_divide(F.col(x), total), F.lit(0.0)).alias(x) for x in REGIMES]
    )


# ---- weights per regime ---------------------------------------------------------------------


def regime_weights(train: DataFrame, regimes: DataFrame, cap: float, confidence: float = 0.95, risk_model: str = "sample",
                   grid: int | None = None, step: int = 10) -> DataFrame:
    """(window_id, symbol, w, regime): equilibrium returns in Bull, least CVaR in Bear, inverse
    volatility otherwise. Each window is solved by its own method only.

    ``regimes`` has (window_id, regime), one row per window.
    """
    key = ["window_id"]
    routed = settle(train.join(regimes.select(*key, "regime"), key))

    def of(cond: Column) -> DataFrame:
        return routed.filter(cond).drop("regime")

    bull, bear = F.col("regime") == "Bull", F.col("regime") == "Bear"
    parts = [
        A.mv_best(window_problems(of(bull), risk_model, implied=BULL_AVERSION), key, grid, step, cap=cap).drop("status"),
        A.min_cvar(A.scenarios(of(bear), key), key, grid, step, confidence, cap).drop("status"),
        A.inverse_vol_weights(of(~bull & ~bear), key, cap=cap),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).join(regimes.select(*key, "regime"), key)
