"""Walk-forward evaluation: windows, weights per window, test returns net of cost, scorecards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barweave.operators import allocation as A
from barweave.operators.allocation import effective_holdings
from barweave.operators.covariance import COVARIANCES
from barweave.operators.metrics import comprehensive_metrics, mean_returns
from barweave.session import settle

# Costs and limits of a walk-forward run.
BPS = 7.5
ENTROPY = 0.03
CONFIDENCE = 0.90
MAX_TURNOVER = 0.30


def walk_forward_windows(calendar: DataFrame, key: Sequence[str] = (), order: str = "dt", train_days: int = 252,
                         test_days: int = 63, mode: str = "rolling") -> DataFrame:
    """(key, window_id, train_start, train_end, test_end) on trading days, lengths in calendar days.

    The next window starts the day after the last test day; ``expanding`` keeps the first start
    for training. The steps run over the sorted dates of one calendar inside its row.
    """
    key = list(key)
    cal = (
        calendar.groupBy(*(key or [F.lit(0).alias("_k")]))
        .agg(F.sort_array(F.collect_set(order)).alias("_cal"))
        .withColumns({"_first": F.array_min("_cal"), "_last": F.array_max("_cal")})
    )

    def trading_day(limit):
        return F.array_max(F.filter("_cal", lambda x: x <= limit))

    def step(state, i):
        start = state["start"]
        te, xe = F.date_add(start, train_days), F.date_add(start, train_days + test_days)
        done = F.struct(
            F.size(state["out"]).alias("window_id"),
            (F.col("_first") if mode == "expanding" else start).alias("train_start"),
            trading_day(te).alias("train_end"),
            trading_day(xe).alias("test_end"),
        )
        return F.when(
            xe <= F.col("_last"),
            F.struct(F.date_add(done["test_end"], 1).alias("start"), F.array_append(state["out"], done).alias("out")),
        ).otherwise(state)

    empty = F.expr("CAST(array() AS ARRAY<STRUCT<window_id: INT, train_start: DATE, train_end: DATE, test_end: DATE>>)")
    init = F.struct(F.col("_first").alias("start"), empty.alias("out"))
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.datediff("_last", "_first")))
    out = cal.select(*key, F.explode(F.aggregate(steps, init, step, lambda s: s["out"])).alias("_w"))
    return out.select(*key, F.col("_w.window_id").cast("long").alias("window_id"), "_w.train_start", "_w.train_end", "_w.test_end")


def split_rows(panel: DataFrame, windows: DataFrame, order: str = "dt") -> DataFrame:
    """Each row once per window that covers it, with role train or test.

    Windows are laid out as days, which turns the range condition into an equality on the date.
    """
    days = windows.select(
        "window_id", "train_end", F.explode(F.sequence("train_start", "test_end")).alias(order)
    ).select("window_id", order, F.when(F.col(order) <= F.col("train_end"), "train").otherwise("test").alias("role"))
    return panel.join(days, order)


def segment_returns(rows: DataFrame, price: str = "price", item: str = "symbol", order: str = "dt") -> DataFrame:
    """Returns inside each train or test segment; the first day of a segment has none."""
    o = Window.partitionBy("window_id", "role", item).orderBy(order)
    return rows.withColumn("ret", F.try_divide(F.col(price), F.lag(price).over(o)) - 1).filter(F.col("ret").isNotNull())


def window_cov(train: DataFrame, risk_model: str = "ledoit_wolf") -> DataFrame:
    return COVARIANCES[risk_model](train, group=["window_id"]).select("window_id", "i", "j", "cov")


def window_problems(train: DataFrame, risk_model: str = "ledoit_wolf", implied: float | None = None, cov: DataFrame | None = None) -> DataFrame:
    """One allocation problem per window; ``implied`` takes equilibrium returns at that risk aversion."""
    key = ["window_id"]
    cov = window_cov(train, risk_model) if cov is None else cov
    mu = mean_returns(train, ("window_id", "symbol")) if implied is None else A.implied_returns(cov, key, implied)
    return A.problems(mu, cov, key)


def strategy_weights(train: DataFrame, cap: float, signals: DataFrame | None = None, risk_model: str = "ledoit_wolf",
                     entropy: float = ENTROPY, confidence: float = CONFIDENCE, max_turnover: float = MAX_TURNOVER, grid: int | None = None, step: int = 10) -> DataFrame:
    """(strategy, window_id, symbol, w) of every strategy; names carry the cap that was used.

    ``signals`` (window_id, symbol, signal) add the forecast overlay on the capped weights. ``grid`` asks for
    weights in steps, see :func:`allocation.mv_best`.
    """
    key = ["window_id"]
    tag = f"_capped_{round(cap * 100)}"
    cov = settle(window_cov(train, risk_model))
    rows = settle(window_problems(train, cov=cov))
    pooled = window_problems(train, cov=cov, implied=2.5)
    best = {
        "mean_variance": A.mv_best(rows, key, grid, step, entropy=entropy),
        f"mean_variance{tag}": A.mv_best(rows, key, grid, step, cap=cap, entropy=entropy),
        "mean_variance_turnover_constrained": A.mv_chain(rows, [], grid, step, cap=cap, entropy=entropy, max_turnover=max_turnover),
        f"cvar{tag}": A.min_cvar(A.scenarios(train, key), key, grid, step, confidence, cap),
        f"black_litterman{tag}": A.mv_best(pooled, key, grid, step, cap=cap),
        "equal_weight": A.equal_weight(train, key),
    }
    if signals is not None:
        base = best[f"mean_variance{tag}"]
        z = A.signal_zscore(signals, base.select("window_id", "symbol"), key)
        best["ml_overlay"] = A.tilt_weights(base, z, key, cap=cap)
    parts = [w.select(F.lit(name).alias("strategy"), "window_id", "symbol", "w") for name, w in best.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def weights_delta(weights: DataFrame, key: Sequence[str] = ("strategy",), item: str = "symbol") -> DataFrame:
    """(key, window_id, item, w, prev, is_first): each weight next to that of the previous window.

    Every weight is emitted for its own window and as the previous one of the next; one aggregation
    pairs them, symbols missing on a side count as 0.
    """
    key = list(key)
    none = F.lit(None).cast("double")
    now = weights.select(*key, "window_id", item, F.col("w").alias("w"), none.alias("prev"))
    before = weights.select(*key, (F.col("window_id") + 1).alias("window_id"), item, none.alias("w"), F.col("w").alias("prev"))
    w = Window.partitionBy(*key, "window_id")
    return (
        now.unionByName(before)
        .groupBy(*key, "window_id", item)
        .agg(F.sum("w").alias("w"), F.sum("prev").alias("prev"))
        .withColumns({"_now": F.count("w").over(w), "_prev": F.count("prev").over(w)})
        .filter(F.col("_now") > 0)
        .select(
            *key, "window_id", item, F.coalesce("w", F.lit(0.0)).alias("w"), F.coalesce("prev", F.lit(0.0)).alias("prev"),
            F.col("w").isNotNull().alias("_in_new"), F.col("prev").isNotNull().alias("_in_old"), (F.col("_prev") == 0).alias("is_first"),
        )
    )


def half_l1_turnover(weights: DataFrame, key: Sequence[str] = ("strategy",), item: str = "symbol") -> DataFrame:
    """Half the absolute change over the symbols held before; the first window has none."""
    d = weights_delta(weights, key, item).filter(~F.col("is_first") & F.col("_in_old"))
    return d.groupBy(*key, "window_id").agg((F.sum(F.abs(F.col("w") - F.col("prev"))) / 2).alias("turnover"))


def l1_turnover(weights: DataFrame, key: Sequence[str] = ("strategy",), item: str = "symbol") -> DataFrame:
    """Absolute change over the symbols held now."""
    d = weights_delta(weights, key, item).filter(~F.col("is_first") & F.col("_in_new"))
    return d.groupBy(*key, "window_id").agg(F.sum(F.abs(F.col("w") - F.col("prev"))).alias("turnover"))


def total_turnover(turnover: DataFrame, key: Sequence[str] = ("strategy",)) -> DataFrame:
    return turnover.groupBy(*key).agg(F.sum("turnover").alias("total_turnover"))


def transaction_costs(turnover: DataFrame, bps: float = BPS) -> DataFrame:
    return turnover.withColumn("cost", F.col("turnover") * bps / 10000)


def net_test_returns(test: DataFrame, weights: DataFrame, costs: DataFrame, key: Sequence[str] = ("strategy",),
                     item: str = "symbol", order: str = "dt") -> DataFrame:
    """Portfolio returns of each test segment, the cost taken from its first row.

    The first row is found by an aggregate over the segments, not by ordering the returns.
    """
    key = list(key)
    own = [*key, "window_id"]
    gross = (
        test.join(weights.select(*own, item, "w"), ["window_id", item])
        .groupBy(*own, order)
        .agg(F.sum(F.col("w") * F.col("ret")).alias("ret"))
    )
    first = test.groupBy("window_id").agg(F.min(order).alias("_first"))
    return (
        gross.join(first, "window_id")
        .join(costs.select(*own, "cost"), own, "left")
        .select(
            *own, order,
            (F.col("ret") - F.when(F.col(order) == F.col("_first"), F.coalesce("cost", F.lit(0.0))).otherwise(F.lit(0.0))).alias("ret"),
        )
    )


def benchmark_in_tests(benchmark: DataFrame, windows: DataFrame, order: str = "dt") -> DataFrame:
    return split_rows(benchmark, windows, order).filter("role = 'test'")


def cost_sensitivity(test: DataFrame, weights: DataFrame, turnover: DataFrame, bps: Sequence[float], key: Sequence[str] = ("strategy",)) -> DataFrame:
    """Net returns of the same weights at several cost levels, keyed by (key, bps)."""
    levels = turnover.select("*", F.explode(F.array(*[F.lit(float(b)) for b in bps])).alias("bps")).withColumn(
        "cost", F.col("turnover") * F.col("bps") / 10000
    )
    spread = weights.select("*", F.explode(F.array(*[F.lit(float(b)) for b in bps])).alias("bps"))
    return net_test_returns(test, spread, levels, [*key, "bps"])


def strategy_scorecard(test: DataFrame, weights: DataFrame, benchmark: DataFrame | None = None, bps: float = BPS,
                       key: Sequence[str] = ("strategy",)) -> DataFrame:
    """Metrics, effective holdings, total cost and turnover per strategy, benchmark metrics for all."""
    key = list(key)
    turnover = half_l1_turnover(weights, key)
    costs = transaction_costs(turnover, bps)
    net = net_test_returns(test, weights, costs, key)
    enh = effective_holdings(weights, [*key, "window_id"]).groupBy(*key).agg(
        F.avg("enh").alias("avg_enh"), F.min("enh").alias("min_enh"), F.max("enh").alias("max_enh")
    )
    paid = costs.groupBy(*key).agg(F.sum("turnover").alias("total_turnover"), F.sum("cost").alias("total_cost"))
    return (
        comprehensive_metrics(net, key, benchmark=benchmark)
        .join(enh, key)
        .join(paid, key, "left")
        .na.fill(0.0, ["total_turnover", "total_cost"])
    )


def headline_strategy(scores: DataFrame, preferred: Sequence[str], key: str = "strategy") -> DataFrame:
    """The row reported as ``optimized``: the first of ``preferred`` that was evaluated."""
    rank = F.array_position(F.array(*[F.lit(p) for p in preferred]), F.col(key))
    best = scores.filter(rank > 0).agg(F.min_by(F.struct(*scores.columns), rank).alias("_s")).select("_s.*")
    return best.withColumn(key, F.lit("optimized"))


# ---- rebalancing on row counts --------------------------------------------------------------


def rebalance_rows(returns: DataFrame, train_rows: int = 252, every: int = 63, order: str = "dt") -> DataFrame:
    """(window_id, dt, role, is_rebalance) by row number of the dates: window k trains on the
    ``train_rows`` dates before date number train_rows + k * every and holds for ``every`` dates.

    Each date lists its windows by arithmetic. The dates are one calendar.
    """
    n = F.row_number().over(Window.partitionBy("_one").orderBy(order)) - 1
    x = F.col("_x")
    dates = returns.select(order).distinct().withColumn("_one", F.lit(1)).withColumn("_x", n)
    last = F.max("_x").over(Window.partitionBy("_one"))
    dates = dates.withColumn("_kmax", F.floor((last - train_rows) / every))
    lo = F.greatest(F.lit(0), F.floor((x - train_rows) / every) + 1)
    hi = F.least(F.floor(x / every), F.col("_kmax"))
    train = F.when(lo <= hi, F.transform(F.sequence(lo, hi), lambda k: F.struct(k.alias("window_id"), F.lit("train").alias("role"))))
    test_k = F.floor((x - train_rows) / every)
    test = F.when(x >= train_rows, F.array(F.struct(test_k.alias("window_id"), F.lit("test").alias("role"))))
    empty = F.expr("CAST(array() AS ARRAY<STRUCT<window_id: BIGINT, role: STRING>>)")
    both = F.concat(F.coalesce(train, empty), F.coalesce(test, empty))
    out = dates.select(order, "_x", F.explode(both).alias("_w")).select(order, "_x", "_w.window_id", "_w.role")
    return out.select(
        "window_id", order, "role",
        ((F.col("role") == "test") & (F.col("_x") == train_rows + F.col("window_id") * every)).alias("is_rebalance"),
    )


def gross_returns(returns: DataFrame, schedule: DataFrame, weights: DataFrame, order: str = "dt", item: str = "symbol") -> DataFrame:
    """Sum of w * r on the holding dates of each window."""
    held = returns.join(schedule.filter("role = 'test'").select("window_id", order), order)
    return (
        held.join(weights.select("window_id", item, "w"), ["window_id", item])
        .groupBy("window_id", order)
        .agg(F.sum(F.col("w") * F.col("ret")).alias("ret"))
    )
