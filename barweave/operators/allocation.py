"""Portfolio weights for many problems at once.

A problem is one row: key columns, the sorted symbols, their expected returns and the flat
covariance, all arrays of the size of its universe. Weights on a simplex grid are generated inside
the row by a chain of generators, so no problem is joined to a table of candidates.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.operators.optimum import chained, frontier_tasks, optimum
from barweave.operators.orderstats import order_statistics
from barweave.operators.tail import least_cvar
from barweave.schemas import RISK_FREE, TRADING_DAYS

GRID_MAX_ASSETS = 8
RISK_AVERSION = 0.5
ENTROPY_EPS = 1e-8
VOL_EPS = 1e-8
TOL = 1e-9


# ---- closed forms ---------------------------------------------------------------------------


def equal_weight(universe: DataFrame, key: Sequence[str], item: str = "symbol") -> DataFrame:
    """1 / N per key; a key is one portfolio, so its window holds N rows."""
    w = Window.partitionBy(*key)
    return universe.select(*key, item).distinct().withColumn("w", 1.0 / F.count(F.lit(1)).over(w))


def inverse_vol_weights(returns: DataFrame, key: Sequence[str], item: str = "symbol", ret: str = "ret",
                        cap: float | None = None, days: int = TRADING_DAYS) -> DataFrame:
    """1 / volatility, normalised; capped once and normalised again, so the cap can be exceeded."""
    w = Window.partitionBy(*key)
    vols = returns.groupBy(*key, item).agg((1.0 / (F.stddev_samp(ret) * math.sqrt(days) + VOL_EPS)).alias("_inv"))
    raw = vols.withColumn("w", F.col("_inv") / F.sum("_inv").over(w))
    if cap is not None:
        raw = raw.withColumn("w", F.least("w", F.lit(cap))).withColumn("w", F.col("w") / F.sum("w").over(w))
    return raw.select(*key, item, "w")


def implied_returns(cov: DataFrame, key: Sequence[str], delta: float = 2.5, market: DataFrame | None = None,
                    item: str = "symbol") -> DataFrame:
    """Equilibrium returns delta * Sigma w of the market weights (normalised), equal when none are given."""
    key = list(key)
    if market is None:
        w = equal_weight(cov.select(*key, F.col("j").alias(item)), key, item)
    else:
        w = market.select(*key, item, (F.col("w") / F.sum("w").over(Window.partitionBy(*key))).alias("w"))
    return (
        cov.join(w.withColumnRenamed(item, "j"), [*key, "j"])
        .groupBy(*key, F.col("i").alias(item))
        .agg((delta * F.sum(F.col("cov") * F.col("w"))).alias("mu"))
    )


def align_weights(weights: DataFrame, universe: DataFrame, key: Sequence[str] = ("portfolio_id",), item: str = "symbol") -> DataFrame:
    """Weights on the symbols of ``universe`` (key, item): missing is 0, then normalised; a total that
    is not positive gives equal weights."""
    key = list(key)
    w = Window.partitionBy(*key)
    return (
        universe.select(*key, item)
        .join(weights.select(*key, item, "w"), [*key, item], "left")
        .withColumn("w", F.coalesce("w", F.lit(0.0)))
        .withColumn("_sum", F.sum("w").over(w))
        .withColumn("w", F.when(F.col("_sum") > 0, F.col("w") / F.col("_sum")).otherwise(1.0 / F.count(F.lit(1)).over(w)))
        .drop("_sum")
    )


def validate_weights(weights: DataFrame, expected: DataFrame, key: Sequence[str] = ("portfolio_id",), item: str = "symbol",
                     tolerance: float = 0.01) -> DataFrame:
    """Same symbols (in upper case) as expected, and a sum of 1 within the tolerance."""
    key = list(key)
    a = weights.select(*key, F.upper(item).alias("_s"), "w", F.lit(1).alias("_a"), F.lit(0).alias("_b"))
    b = expected.select(*key, F.upper(item).alias("_s"), F.lit(None).cast("double").alias("w"), F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    # both lists in one aggregation instead of an outer join
    per = a.unionByName(b).groupBy(*key, "_s").agg(F.sum("w").alias("w"), F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    total = per.groupBy(*key).agg(
        (F.count(F.when(F.col("_a") != F.col("_b"), 1)) == 0).alias("same_symbols"), F.sum("w").alias("total")
    )
    ok = F.coalesce(F.abs(F.col("total") - 1) <= tolerance, F.lit(False))
    return total.select(*key, "same_symbols", "total", (F.col("same_symbols") & ok).alias("is_valid"))


def signal_zscore(signals: DataFrame, universe: DataFrame, key: Sequence[str], item: str = "symbol", clip: float = 2.0) -> DataFrame:
    """Cross-section z of the signals of a key: a missing signal is 0, a spread of 0 gives 0, clipped."""
    key = list(key)
    w = Window.partitionBy(*key)
    return (
        universe.select(*key, item)
        .join(signals.select(*key, item, "signal"), [*key, item], "left")
        .withColumn("signal", F.coalesce("signal", F.lit(0.0)))
        .withColumns({"_m": F.avg("signal").over(w), "_s": F.stddev_pop("signal").over(w)})
        .withColumn(
            "z",
            F.when(F.round("_s", 15) > 0, F.greatest(F.lit(-clip), F.least(F.lit(clip), (F.col("signal") - F.col("_m")) / F.col("_s")))).otherwise(
                F.lit(0.0)
            ),
        )
        .select(*key, item, "z")
    )


def tilt_weights(weights: DataFrame, z: DataFrame, key: Sequence[str], item: str = "symbol", alpha: float = 0.2,
                 cap: float | None = 0.2, weakest: float = 0.10) -> DataFrame:
    """w * exp(alpha * min(1, strength) * z) with strength = mean |z|; weaker signals leave the weights.
    Normalised, capped once and normalised again."""
    key = list(key)
    w = Window.partitionBy(*key)
    strength = F.avg(F.abs("z")).over(w)
    out = (
        weights.select(*key, item, "w")
        .join(z, [*key, item], "left")
        .withColumn("z", F.coalesce("z", F.lit(0.0)))
        .withColumn("_strength", strength)
        .withColumn(
            "_t",
            F.when(F.col("_strength") < weakest, F.col("w")).otherwise(
                F.col("w") * F.exp(alpha * F.least(F.lit(1.0), "_strength") * F.col("z"))
            ),
        )
        .withColumn("_t", F.try_divide(F.col("_t"), F.sum("_t").over(w)))
    )
    if cap is not None:
        out = out.withColumn("_t", F.least("_t", F.lit(cap))).withColumn("_t", F.try_divide(F.col("_t"), F.sum("_t").over(w)))
    return out.select(*key, item, F.coalesce("_t", "w").alias("w"))


# ---- problems and the simplex grid ----------------------------------------------------------


def problems(mu: DataFrame, cov: DataFrame, key: Sequence[str], item: str = "symbol") -> DataFrame:
    """One row per key with ``symbols``, ``mu`` and the row-major ``cov``."""
    key = list(key)
    m = mu.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(item, "mu"))).alias("_m"))
    c = cov.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("i", "j", "cov"))).alias("_c"))
    return m.join(c, key).select(
        *key,
        F.transform("_m", lambda s: s[item]).alias("symbols"),
        F.transform("_m", lambda s: s["mu"]).alias("mu"),
        F.transform("_c", lambda s: s["cov"]).alias("cov"),
    )


def scenarios(returns: DataFrame, key: Sequence[str], item: str = "symbol", on: str = "dt", ret: str = "ret") -> DataFrame:
    """One row per key with ``symbols`` and the returns of every complete date as an array of arrays.

    Dates on which a symbol of the key has no return are left out. A key is a training span, whose
    calendar bounds the number of dates.
    """
    key = list(key)
    known = returns.filter(F.col(ret).isNotNull())
    width = known.groupBy(*key).agg(F.count_distinct(item).alias("_n"))
    days = known.groupBy(*key, on).agg(F.sort_array(F.collect_list(F.struct(item, ret))).alias("_r")).join(width, key).filter(F.size("_r") == F.col("_n"))
    return days.groupBy(*key).agg(
        F.first(F.transform("_r", lambda s: s[item])).alias("symbols"),
        F.transform(F.sort_array(F.collect_list(F.struct(on, "_r"))), lambda d: F.transform(d["_r"], lambda s: s[ret])).alias("scenarios"),
    )


def candidate_grid(rows: DataFrame, key: Sequence[str], assets: int, step: int = 10) -> DataFrame:
    """Every long-only weight vector in steps of 1/step, as ``w`` next to each row.

    After the first weight is chosen the rows are spread by (key, weight), so that a few problems
    still use many tasks.
    """
    if assets > GRID_MAX_ASSETS:
        raise ValueError(f"the grid is for at most {GRID_MAX_ASSETS} assets, got {assets}")
    fits = F.size("symbols") == assets
    if "cov" in rows.columns:
        fits = fits & (F.size("cov") == assets * assets)
    wrong = F.raise_error(F.concat(F.lit(f"the grid is for {assets} assets with all covariances, a row has "), F.to_json(F.struct("symbols"))))
    out = rows.withColumn("_left", F.when(fits, F.lit(step)).otherwise(wrong.cast("int")))
    for k in range(assets - 1):
        out = out.withColumn(f"_u{k}", F.explode(F.sequence(F.lit(0), F.col("_left")))).withColumn(
            "_left", F.col("_left") - F.col(f"_u{k}")
        )
        if k == 0 and assets > 2:
            out = out.repartition(*key, "_u0")
    units = [F.col(f"_u{k}") for k in range(assets - 1)] + [F.col("_left")]
    return out.withColumn("w", F.array(*[u / F.lit(step) for u in units])).drop("_left", *[f"_u{k}" for k in range(assets - 1)])


def _dot(a: Column, b: Column, n: int) -> Column:
    return sum((a[k] * b[k] for k in range(1, n)), a[0] * b[0])


def _quad(w: Column, cov: Column, n: int) -> Column:
    terms = [w[i] * w[j] * cov[i * n + j] * (1.0 if i == j else 2.0) for i in range(n) for j in range(i, n)]
    return sum(terms[1:], terms[0])


def _each(w: Column, n: int, f) -> Column:
    return sum((f(w[k], k) for k in range(1, n)), f(w[0], 0))


def with_moments(cands: DataFrame, assets: int, rf: float = RISK_FREE) -> DataFrame:
    """Adds ret, var, vol and sharpe of ``w``."""
    return (
        cands.withColumns({"ret": _dot(F.col("w"), F.col("mu"), assets), "var": _quad(F.col("w"), F.col("cov"), assets)})
        .withColumn("vol", F.sqrt(F.greatest("var", F.lit(0.0))))
        .withColumn("sharpe", (F.col("ret") - rf) / F.greatest("vol", F.lit(1e-8)))
    )


def _feasible(w: Column, assets: int, cap: Column | None, prev: Column | None, max_turnover: Column | None) -> Column:
    ok = F.lit(True)
    if cap is not None:
        ok = ok & (cap.isNull() | (F.greatest(*[w[k] for k in range(assets)]) <= cap + TOL))
    if prev is not None and max_turnover is not None:
        ok = ok & (_each(w, assets, lambda x, k: F.abs(x - prev[k])) <= max_turnover + TOL)
    return ok


def _with_fallback(rows: DataFrame, best: DataFrame, key: list[str], item: str = "symbol") -> DataFrame:
    """Long weights; a problem without a feasible candidate gets equal weights and says so."""
    joined = rows.select(*key, "symbols").join(best, key, "left")
    n = F.size("symbols")
    w = F.coalesce("w", F.transform("symbols", lambda s: F.lit(1.0) / n))
    status = F.when(F.col("w").isNull(), F.lit("infeasible")).otherwise(F.lit("optimal"))
    return joined.select(
        *key, status.alias("status"), F.explode(F.arrays_zip("symbols", w.alias("w"))).alias("_z")
    ).select(*key, F.col("_z.symbols").alias(item), F.col("_z.w").alias("w"), "status")


def _long(solved: DataFrame, key: list[str], item: str, *more: str) -> DataFrame:
    """A row for each weight of solved problems."""
    out = solved.select(*key, *more, F.explode(F.arrays_zip("symbols", "w")).alias("_z"))
    return out.select(*key, F.col("_z.symbols").alias(item), F.col("_z.w").alias("w"), *more)


def mv_best(rows: DataFrame, key: Sequence[str], grid: int | None = None, step: int = 10, cap: float | None = None,
            entropy: float = 0.0, turnover_penalty: float = 0.0, max_turnover: float | None = None,
            target: float | None = None, item: str = "symbol") -> DataFrame:
    """Best weights by mu'w - w'Sigma w / 2 plus entropy minus the squared change from ``prev``;
    with a target return the least variance that reaches it. ``rows`` are problems, with a ``prev``
    array when turnover matters. One law for any number of assets and any cap, see :mod:`optimum`.

    ``grid`` asks for the best of the weights in steps of 1 / step instead, for universes of that many assets
    (at most GRID_MAX_ASSETS): an exact check. Ties go to the largest weights in symbol order."""
    if grid is None:
        asked = {"cap": cap, "entropy": entropy, "turnover_penalty": turnover_penalty, "max_turnover": max_turnover, "target": target}
        tasks = rows.withColumns({name: F.lit(v).cast("double") for name, v in asked.items() if v})
        return _long(optimum(tasks, key), list(key), item, "status")
    assets = grid
    key = list(key)
    w = F.col("w")
    prev = F.col("prev") if "prev" in rows.columns else None
    c = with_moments(candidate_grid(rows, key, assets, step), assets)
    c = c.filter(_feasible(w, assets, F.lit(cap).cast("double"), prev, None if max_turnover is None else F.lit(max_turnover)))
    if target is not None:
        score = -F.col("var")
        c = c.filter(F.col("ret") >= target - TOL)
    else:
        score = F.col("ret") - RISK_AVERSION * F.col("var")
        if entropy > 0:
            score = score - entropy * _each(w, assets, lambda x, k: (x + ENTROPY_EPS) * F.ln(x + ENTROPY_EPS))
        if turnover_penalty > 0 and prev is not None:
            score = score - turnover_penalty * _each(w, assets, lambda x, k: (x - prev[k]) * (x - prev[k]))
    best = c.groupBy(*key).agg(F.max(F.struct(F.round(score, 12).alias("score"), w)).alias("_b")).select(*key, F.col("_b.w").alias("w"))
    return _with_fallback(rows, best, key, item)


def _simplex(assets: int, step: int) -> Column:
    """The simplex grid as one array of weight arrays."""

    def grow(left: Column, chosen: list[Column], k: int) -> Column:
        if k == assets - 1:
            return F.array(F.array(*[u / F.lit(step) for u in [*chosen, left]]))
        return F.flatten(F.transform(F.sequence(F.lit(0), left), lambda u: grow(left - u, [*chosen, u], k + 1)))

    return grow(F.lit(step), [], 0)


def mv_chain(rows: DataFrame, key: Sequence[str], grid: int | None = None, step: int = 10, order: str = "window_id", cap: float | None = None,
             entropy: float = 0.0, max_turnover: float = 0.3, item: str = "symbol") -> DataFrame:
    """Weights window after window, each within ``max_turnover`` (absolute change) of the one before.

    A window needs the choice of the previous one, so the windows of a key are folded inside one
    row; keys run in parallel. The row holds the moments of the windows of one calendar (and the grid where
    that is asked for, as in :func:`mv_best`).
    """
    if grid is None:
        return chained(rows, key, order, cap, entropy, max_turnover, item)
    assets = grid
    key = list(key)
    own = key or ["_k"]
    base = rows if key else rows.withColumn("_k", F.lit(0))
    chain = base.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct(order, "symbols", "mu", "cov"))).alias("_ps"))
    cap_col = F.lit(cap).cast("double")
    chain = chain.withColumn("_grid", F.filter(_simplex(assets, step), lambda w: _feasible(w, assets, cap_col, None, None)))

    def choose(state: Column, p: Column) -> Column:
        prev, held = state["prev"], state["held"]

        def near(w: Column) -> Column:
            moved = _each(w, assets, lambda x, k: F.abs(x - F.coalesce(F.try_element_at(held, p["symbols"][k]), F.lit(0.0))))
            return prev.isNull() | (moved <= max_turnover + TOL)

        def scored(w: Column) -> Column:
            score = _dot(w, p["mu"], assets) - RISK_AVERSION * _quad(w, p["cov"], assets)
            if entropy > 0:
                score = score - entropy * _each(w, assets, lambda x, k: (x + ENTROPY_EPS) * F.ln(x + ENTROPY_EPS))
            return F.struct(F.round(score, 12).alias("score"), w.alias("w"))

        best = F.array_max(F.transform(F.filter("_grid", near), scored))["w"]
        w = F.coalesce(best, F.array_repeat(F.lit(1.0 / assets), assets))
        status = F.when(best.isNull(), F.lit("infeasible")).otherwise(F.lit("optimal"))
        # weights are computed once and carried in an array of one element
        return F.transform(
            F.array(F.struct(w.alias("w"), status.alias("status"))),
            lambda c: F.struct(
                c["w"].alias("prev"),
                F.map_from_arrays(p["symbols"], c["w"]).alias("held"),
                F.array_append(
                    state["out"], F.struct(p[order].alias(order), p["symbols"].alias("symbols"), c["w"].alias("w"), c["status"].alias("status"))
                ).alias("out"),
            ),
        )[0]

    kinds = {order: rows.schema[order].dataType.simpleString(), "symbols": rows.schema["symbols"].dataType.simpleString()}
    none = f"CAST(array() AS ARRAY<STRUCT<{order}: {kinds[order]}, symbols: {kinds['symbols']}, w: ARRAY<DOUBLE>, status: STRING>>)"
    start = F.struct(
        F.lit(None).cast("array<double>").alias("prev"), F.lit(None).cast("map<string,double>").alias("held"), F.expr(none).alias("out")
    )
    done = chain.select(*own, F.explode(F.aggregate("_ps", start, choose, lambda st: st["out"])).alias("_o"))
    long = done.select(*own, F.col(f"_o.{order}").alias(order), F.explode(F.arrays_zip("_o.symbols", "_o.w")).alias("_z"), F.col("_o.status").alias("status"))
    return long.select(*key, order, F.col("_z.symbols").alias(item), F.col("_z.w").alias("w"), "status")


def _cvar(sorted_losses: Column, confidence: float) -> Column:
    n = F.size(sorted_losses)
    at = F.greatest(F.lit(1), F.ceil(F.round(n * confidence, 9)).cast("int"))
    t = F.element_at(sorted_losses, at)
    beyond = F.slice(sorted_losses, at, n - at + 1)
    return t + F.aggregate(beyond, F.lit(0.0), lambda a, x: a + (x - t)) / ((1 - confidence) * n)


def min_cvar(rows: DataFrame, key: Sequence[str], grid: int | None = None, step: int = 10, confidence: float = 0.90,
             cap: float | None = None, item: str = "symbol") -> DataFrame:
    """Weights of least CVaR, for any number of assets, or the best of a grid where that is asked for.
    ``rows`` come from :func:`scenarios`."""
    if grid is None:
        return least_cvar(rows, key, confidence, cap, item).drop("gap")
    assets = grid
    key = list(key)
    w = F.col("w")
    c = candidate_grid(rows, key, assets, step).filter(_feasible(w, assets, F.lit(cap).cast("double"), None, None))
    losses = F.sort_array(F.transform("scenarios", lambda s: -_dot(w, s, assets)))
    c = c.withColumn("_losses", losses).withColumn("cvar", _cvar(F.col("_losses"), confidence))
    best = c.groupBy(*key).agg(F.max(F.struct(F.round(-F.col("cvar"), 12).alias("score"), w)).alias("_b")).select(
        *key, F.col("_b.w").alias("w")
    )
    return _with_fallback(rows, best, key, item)


def cvar_of_portfolio(returns: DataFrame, key: Sequence[str] = ("portfolio_id",), ret: str = "ret", confidence: float = 0.90) -> DataFrame:
    """VaR (an order statistic) and CVaR of each portfolio's losses. ``confidence`` is the level, not the tail.

    One portfolio may hold any number of returns: its losses are counted, never gathered."""
    key = list(key)
    loss = returns.select(*key, (-F.col(ret)).alias("_loss")).filter(F.col("_loss").isNotNull())
    level = order_statistics(loss, key, F.col("_loss"), lambda n: [F.greatest(F.lit(1), F.ceil(F.round(n * confidence, 9)))])
    return (
        loss.join(level.select(*key, F.col("ranked")[0].alias("var")), key)
        .groupBy(*key, "var")
        .agg((F.sum(F.greatest(F.col("_loss") - F.col("var"), F.lit(0.0))) / ((1 - confidence) * F.count(F.lit(1)))).alias("_x"))
        .select(*key, "var", (F.col("var") + F.col("_x")).alias("cvar"))
    )


def efficient_frontier(rows: DataFrame, key: Sequence[str], grid: int | None = None, step: int = 10, points: int = 10, rf: float = RISK_FREE) -> DataFrame:
    """Least variance that reaches each of ``points`` equally spaced target returns, for any number of assets,
    with ``status``, the duality ``gap`` and the return's multiplier ``lambda``.

    With ``grid`` the best of the weights in steps of 1 / step: a candidate names the targets it reaches by
    arithmetic, so targets and candidates are not joined.
    """
    key = list(key)
    if grid is None:
        out = optimum(frontier_tasks(rows, points), [*key, "point"], rf)
        return out.select(*key, "point", "target", "ret", "vol", "sharpe", "symbols", "w", "lambda", "gap", "status")
    assets = grid
    lo, hi = F.array_min("mu"), F.array_max("mu")
    gap = (hi - lo) / (points - 1)
    c = with_moments(candidate_grid(rows, key, assets, step), assets, rf).withColumns({"_lo": lo, "_gap": gap})
    reach = F.when(F.col("_gap") > 0, F.floor((F.col("ret") - F.col("_lo") + TOL) / F.col("_gap"))).otherwise(F.lit(points - 1))
    reach = F.least(reach, F.lit(points - 1)).cast("int")
    best = (
        c.filter(reach >= 0)
        .withColumn("point", F.explode(F.sequence(F.lit(0), reach)))
        .groupBy(*key, "point")
        .agg(F.max(F.struct(F.round(-F.col("var"), 14).alias("s"), "w", "ret", "vol")).alias("_b"), F.first("_lo").alias("_lo"), F.first("_gap").alias("_gap"))
    )
    ret, vol = F.col("_b.ret"), F.col("_b.vol")
    return best.select(
        *key,
        "point",
        (F.col("_lo") + F.col("point") * F.col("_gap")).alias("target"),
        ret.alias("ret"),
        vol.alias("vol"),
        F.when(vol > 0, (ret - rf) / vol).otherwise(F.lit(0.0)).alias("sharpe"),
        F.col("_b.w").alias("w"),
    )


# ---- tables of weights ----------------------------------------------------------------------


def top_holdings(weights: DataFrame, key: Sequence[str], item: str = "symbol", n: int = 5) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(F.round("w", 9)), item))
    return weights.select(*key, item, "w", place.alias("place")).filter(F.col("place") <= n)


def effective_holdings(weights: DataFrame, key: Sequence[str]) -> DataFrame:
    """exp of the entropy of the positive weights."""
    w = F.col("w")
    return weights.groupBy(*key).agg(
        F.coalesce(F.exp(-F.sum(F.when(w > 0, w * F.ln(w + 1e-12)))), F.lit(0.0)).alias("enh")
    )


def param_grid(**values: Sequence) -> list[Column]:
    """Columns that expand one row into every combination of the given parameter values."""
    return [F.explode(F.array(*[F.lit(v) for v in vs])).alias(name) for name, vs in values.items()]


def expand_grid(df: DataFrame, **values: Sequence) -> DataFrame:
    for col in param_grid(**values):
        df = df.select("*", col)
    return df


def leaderboard(candidates: DataFrame, assets: int, cap: float | None = None, n: int = 12) -> DataFrame:
    """The n candidates of highest Sharpe ratio, then return, within an optional cap."""
    ok = _feasible(F.col("w"), assets, F.lit(cap).cast("double"), None, None)
    return candidates.filter(ok).orderBy(F.desc(F.round("sharpe", 9)), F.desc(F.round("ret", 9)), "window_id", F.desc("w")).limit(n)
