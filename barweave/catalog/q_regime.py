"""Regime labels on the pooled market and weights that follow them."""

from __future__ import annotations

from pyspark.sql import functions as F

from barweave.catalog.oracle import cte, d, r, with_ctes
from barweave.catalog.oracle_grid import (
    N, best_ctes, candidate_ctes, cap_once, capped, cvar_ctes, inverse_vol_cte, mu_cte, sample_cov_cte,
)
from barweave.catalog.q_allocation import CAP
from barweave.catalog.q_features import regime_inputs
from barweave.catalog.q_metrics import PERF, metrics_sql
from barweave.catalog.q_returns import bench, panel_rets
from barweave.catalog.registry import query
from barweave.operators import metrics as M
from barweave.operators import regime as G
from barweave.operators.returns import asof_last
from barweave.plans import walkforward as B
from barweave.session import settle

cte(
    "reg",
    ("rf",),
    """SELECT *, CASE WHEN x <= ROUND(lo, 9) THEN 'Bear' WHEN x > ROUND(hi, 9) THEN 'Bull' ELSE 'Sideways' END AS regime FROM
    (SELECT *, ROUND(rolling_return, 9) AS x FROM rf), (SELECT QUANTILE_CONT(ROUND(rolling_return, 9), 1e0 / 3) AS lo, QUANTILE_CONT(ROUND(rolling_return, 9), 2e0 / 3) AS hi FROM rf)""",
)


def labels(spark, sf):
    return G.regime_rule_labels(regime_inputs(spark, sf)).select("dt", "ret", "rolling_return", "regime")


@query("regime_rule_labels", with_ctes(["reg"], f"SELECT {d()}, {r('rolling_return')}, regime FROM reg"))
def _(spark, sf):
    return labels(spark, sf).select("dt", "rolling_return", "regime")


# states of the calendar quarter stand for given states
@query(
    "regime_labels",
    with_ctes(
        ["rf"],
        f"""SELECT {d()}, state, CASE WHEN state = (SELECT state FROM m ORDER BY a, state LIMIT 1) THEN 'Bear'
        WHEN state = (SELECT state FROM m ORDER BY a DESC, state DESC LIMIT 1) THEN 'Bull' ELSE 'Sideways' END AS regime FROM st""",
        st="SELECT dt, rolling_return, CAST(QUARTER(dt) AS BIGINT) AS state FROM rf",
        m="SELECT state, ROUND(AVG(rolling_return), 12) AS a FROM st GROUP BY state",
    ),
)
def _(spark, sf):
    states = regime_inputs(spark, sf).withColumn("state", F.quarter("dt").cast("long"))
    return G.regime_labels(states).select("dt", "state", "regime")


_last5 = "(ORDER BY dt ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
_votes = ", ".join(f"{{'v': COUNT(*) FILTER (WHERE regime = '{x}') OVER {_last5}, 's': COALESCE(MAX(CASE WHEN regime = '{x}' THEN dt END) OVER {_last5}, DATE '0001-01-01'), 'n': '{x}'}}" for x in G.REGIMES)


@query("regime_smoothing", with_ctes(["reg"], f"SELECT {d()}, regime, LIST_MAX([{_votes}]).n AS smoothed FROM reg"))
def _(spark, sf):
    return G.regime_smoothing(labels(spark, sf), 5).select("dt", "regime", "smoothed")


@query(
    "regime_statistics",
    with_ctes(
        ["reg"],
        f"""SELECT regime, count, {r('count * 1e2 / SUM(count) OVER ()', 'pct_time')}, {r('m', 'mean_return')}, {r('v', 'volatility')}, {r('m / (v + 1e-8)', 'sharpe')} FROM
        (SELECT regime, COUNT(*) AS count, AVG(bench_ret) * 252 AS m, STDDEV_SAMP(bench_ret) * SQRT(252e0) AS v FROM reg GROUP BY regime)""",
    ),
)
def _(spark, sf):
    rows = labels(spark, sf)
    return G.regime_statistics(rows, bench(spark, sf).withColumnRenamed("bench_ret", "ret"))


@query("regime_distribution", with_ctes(["reg"], f"SELECT regime, COUNT(*) AS days, {r('COUNT(*) * 1e2 / (SELECT COUNT(*) FROM reg)', 'pct')} FROM reg GROUP BY regime"))
def _(spark, sf):
    return G.regime_distribution(labels(spark, sf))


_share = ", ".join(r(f"COALESCE(AVG(CASE WHEN nxt = '{x}' THEN 1e0 ELSE 0e0 END) FILTER (WHERE nxt IS NOT NULL), 0e0)", f'"{x}"') for x in G.REGIMES)


@query("regime_transitions", with_ctes(["reg"], f"SELECT regime AS current, {_share} FROM (SELECT regime, LEAD(regime) OVER (ORDER BY dt) AS nxt FROM reg) GROUP BY regime"))
def _(spark, sf):
    return G.regime_transitions(labels(spark, sf))


# ---- rebalancing on row counts ---------------------------------------------------------------

cte("adates", ("panel_ret",), "SELECT dt, ROW_NUMBER() OVER (ORDER BY dt) - 1 AS x FROM (SELECT DISTINCT dt FROM panel_ret)")
cte(
    "asched",
    ("adates",),
    """SELECT CAST(k AS BIGINT) AS window_id, dt, CASE WHEN x < 252 + k * 63 THEN 'train' ELSE 'test' END AS role, x = 252 + k * 63 AS is_rebalance
    FROM adates, range(100000) t(k) WHERE k <= ((SELECT MAX(x) FROM adates) - 252) // 63 AND x >= k * 63 AND x < 252 + (k + 1) * 63""",
)
# for the as-of query alone: labels of every fifth day only, so that most dates look back for the last one
cte("reg5", ("reg",), "SELECT dt, regime FROM reg WHERE (dt - DATE '1990-01-01') % 5 = 0")
for _name, _src in (("awin", "reg"), ("awin5", "reg5")):
    cte(
        _name,
        ("asched", _src),
        f"SELECT s.window_id, s.dt, COALESCE((SELECT MAX_BY(g.regime, g.dt) FROM {_src} g WHERE g.dt <= s.dt), 'Sideways') AS regime FROM asched s WHERE s.is_rebalance",
    )
cte("atrain", ("asched", "panel_ret"), "SELECT window_id, symbol, dt, ret FROM panel_ret JOIN asched USING (dt) WHERE role = 'train'")
mu_cte("a_", "atrain")
sample_cov_cte("a_", "atrain")
candidate_ctes("a_", "a_wmu", delta=2.0)
best_ctes("a_bull", "a_cand_bl", capped(CAP), "ret - 0.5e0 * var", "a_wmu")
cvar_ctes("a_bear", "atrain", 0.95, CAP, "a_wmu")
inverse_vol_cte("a_inv_raw", "atrain")
cte("a_side", ("a_inv_raw",), cap_once("a_inv_raw", CAP))
cte(
    "aw",
    ("awin", "a_bull", "a_bear", "a_side"),
    " UNION ALL ".join(
        f"SELECT window_id, symbol, w, regime FROM {src} JOIN awin USING (window_id) WHERE regime = '{name}'"
        for name, src in (("Bull", "a_bull"), ("Bear", "a_bear"), ("Sideways", "a_side"))
    ),
)
cte("agross", ("aw", "asched", "panel_ret"), """SELECT 'regime_adaptive' AS strategy, window_id, dt, SUM(w * ret) AS ret FROM panel_ret JOIN asched USING (dt) JOIN aw USING (window_id, symbol)
  WHERE role = 'test' GROUP BY window_id, dt""")


def known_labels(spark, sf):
    return settle(labels(spark, sf).filter(F.datediff("dt", F.lit("1990-01-01")) % 5 == 0).select("dt", "regime"))


@query("asof_regime", with_ctes(["awin5"], f"SELECT window_id, {d()}, regime FROM awin5"))
def _(spark, sf):
    # a few dates, written once: they are looked up and joined back
    schedule = settle(B.rebalance_rows(panel_rets(spark, sf)).filter("is_rebalance").select("window_id", "dt"))
    return asof_last(schedule, known_labels(spark, sf), "dt", "regime", default="Sideways")


def adaptive(spark, sf):
    """Returns, schedule and weights, each written once."""
    returns = settle(panel_rets(spark, sf))
    schedule = settle(B.rebalance_rows(returns))
    at = settle(schedule.filter("is_rebalance").select("window_id", "dt"))
    regimes = settle(asof_last(at, labels(spark, sf).select("dt", "regime"), "dt", "regime", default="Sideways"))
    train = returns.join(schedule.filter("role = 'train'").select("window_id", "dt"), "dt")
    return returns, schedule, settle(G.regime_weights(train, regimes, CAP, grid=N))


@query("regime_adaptive_weights", with_ctes(["aw"], f"SELECT window_id, symbol, {r('w')}, regime FROM aw"))
def _(spark, sf):
    return adaptive(spark, sf)[2]


@query("regime_adaptive_returns", with_ctes(["agross"], f"SELECT window_id, {d()}, {r('ret')} FROM agross"))
def _(spark, sf):
    returns, schedule, weights = adaptive(spark, sf)
    return B.gross_returns(returns, schedule, weights)


cte("met_a", ("agross",), metrics_sql("agross", "strategy"))
cte("a_to", ("aw",), "SELECT AVG(t) AS avg_turnover FROM (SELECT a.window_id, SUM(ABS(a.w - b.w)) AS t FROM aw a JOIN aw b ON a.symbol = b.symbol AND a.window_id = b.window_id + 1 GROUP BY a.window_id)")


@query("regime_adaptive_metrics", with_ctes(["met_a", "a_to"], f"SELECT strategy, {', '.join(PERF)}, {r('avg_turnover')} FROM met_a, a_to"))
def _(spark, sf):
    returns, schedule, weights = adaptive(spark, sf)
    one = F.lit("regime_adaptive").alias("strategy")
    m = M.performance_metrics(B.gross_returns(returns, schedule, weights).select(one, "dt", "ret"), ("strategy",))
    moved = B.l1_turnover(weights.select(one, "window_id", "symbol", "w")).groupBy("strategy").agg(F.avg("turnover").alias("avg_turnover"))
    return m.join(moved, "strategy")


@query("regime_clusters")
def _(spark, sf):
    """Gaussian states named by their mean return."""
    states = settle(G.regime_clusters(regime_inputs(spark, sf)))
    return G.regime_labels(states).select("dt", "state", "confidence", "rolling_return", "regime")
