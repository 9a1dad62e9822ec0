"""Walk-forward evaluation of all strategies over the windows of the panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from barweave.catalog.oracle import cte, d, r, with_ctes
from barweave.catalog.oracle_grid import (
    DESC, ENT, N, UNPIVOT, WS, best_ctes, candidate_ctes, cap_once, capped, cvar_ctes, shrunk_cov_cte,
)
from barweave.catalog.q_allocation import CAP, full_signals, split
from barweave.catalog.q_metrics import MORE, PERF, REL, metrics_sql
from barweave.catalog.q_returns import bench, panel, rets
from barweave.catalog.registry import query
from barweave.operators import covariance as C
from barweave.operators import metrics as M
from barweave.operators import returns as R
from barweave.plans import walkforward as B
from barweave.session import settle

# ---- windows --------------------------------------------------------------------------------


@query("walk_forward_windows", with_ctes(["win"], f"SELECT CAST(n AS BIGINT) AS window_id, {d('st', 'train_start')}, {d('te', 'train_end')}, {d('xe', 'test_end')} FROM win"))
def _(spark, sf):
    return B.walk_forward_windows(panel(spark, sf).select("dt"))


@query(
    "walk_forward_windows_expanding",
    with_ctes(["win"], f"SELECT CAST(n AS BIGINT) AS window_id, {d('(SELECT MIN(dt) FROM pcal)', 'train_start')}, {d('te', 'train_end')}, {d('xe', 'test_end')} FROM win"),
)
def _(spark, sf):
    return B.walk_forward_windows(panel(spark, sf).select("dt"), mode="expanding")


@query("train_test_split_rows", with_ctes(["wrows"], f"SELECT window_id, symbol, {d()}, {r('price')}, role FROM wrows"))
def _(spark, sf):
    rows = panel(spark, sf)
    return B.split_rows(rows, B.walk_forward_windows(rows.select("dt"))).select("window_id", "symbol", "dt", "price", "role")


cte("bwin", ("mkt_ret", "win"), "SELECT CAST(n AS BIGINT) AS window_id, dt, bench_ret, CASE WHEN dt <= te THEN 'train' ELSE 'test' END AS role FROM mkt_ret JOIN win ON dt BETWEEN st AND xe")


@query("window_range_join", with_ctes(["bwin"], f"SELECT window_id, {d()}, {r('bench_ret')}, role FROM bwin"))
def _(spark, sf):
    return B.split_rows(bench(spark, sf), B.walk_forward_windows(panel(spark, sf).select("dt"))).select("window_id", "dt", "bench_ret", "role")


@query("benchmark_walk_forward", with_ctes(["bwin"], f"SELECT window_id, {d()}, {r('bench_ret')} FROM bwin WHERE role = 'test'"))
def _(spark, sf):
    return B.benchmark_in_tests(bench(spark, sf), B.walk_forward_windows(panel(spark, sf).select("dt"))).select("window_id", "dt", "bench_ret")


# ---- weights of every strategy ---------------------------------------------------------------

shrunk_cov_cte("s_", "train")
candidate_ctes("s_", "wmu")
_score = f"ret - 0.5e0 * var - 0.03e0 * ({ENT})"
best_ctes("s_mv", "s_cand", "TRUE", _score)
best_ctes("s_cap", "s_cand", capped(CAP), _score)
best_ctes("s_bl", "s_cand_bl", capped(CAP), "ret - 0.5e0 * var")
_moved = " + ".join(f"ABS(c.w{k} - p.w{k})" for k in range(N))
_cw = ", ".join(f"c.w{k}" for k in range(N))
cte("s_scored", ("s_cand",), f"SELECT window_id, {WS}, ROUND({_score}, 12) AS score FROM s_cand WHERE {capped(CAP)}")
cte(
    "s_chain",
    ("s_scored",),
    f"""SELECT window_id, {WS} FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY score DESC, {DESC}) AS place FROM s_scored WHERE window_id = 0) WHERE place = 1
    UNION ALL
    SELECT window_id, {WS} FROM (SELECT c.window_id, {_cw}, ROW_NUMBER() OVER (ORDER BY c.score DESC, {', '.join(f'c.w{k} DESC' for k in range(N))}) AS place
      FROM s_scored c JOIN s_chain p ON c.window_id = p.window_id + 1 WHERE {_moved} <= 0.3e0 + 1e-9) WHERE place = 1""",
)
cte(
    "s_tilt_raw",
    ("full_zs", "s_cap"),
    """SELECT window_id, symbol, CASE WHEN g < 0.1e0 THEN w ELSE w * EXP(0.2e0 * LEAST(1e0, g) * z) END AS w FROM
    (SELECT m.window_id, m.symbol, m.w, z, AVG(ABS(z)) OVER (PARTITION BY m.window_id) AS g FROM s_cap m JOIN full_zs ON m.window_id = full_zs.window_id AND m.symbol = full_zs.symbol)""",
)
cte("s_tilt_norm", ("s_tilt_raw",), "SELECT window_id, symbol, w / SUM(w) OVER (PARTITION BY window_id) AS w FROM s_tilt_raw")
cte("s_tilt", ("s_tilt_norm",), cap_once("s_tilt_norm", CAP))
STRATEGIES = {
    "mean_variance": "s_mv", "mean_variance_capped_30": "s_cap", "cvar_capped_30": "cvar", "black_litterman_capped_30": "s_bl",
    "equal_weight": "equal", "ml_overlay": "s_tilt",
}
cte(
    "strat",
    (*STRATEGIES.values(), "s_chain"),
    " UNION ALL ".join(f"SELECT '{name}' AS strategy, window_id, symbol, w FROM {src}" for name, src in STRATEGIES.items())
    + f" UNION ALL SELECT 'mean_variance_turnover_constrained', * FROM ({UNPIVOT.format(src='s_chain')})",
)


def weights_of(train):
    return B.strategy_weights(train, CAP, full_signals(train), grid=N)


def evaluated(spark, sf):
    """Train and test returns and the weights of all strategies, written once."""
    train, test = split(spark, sf)
    return train, test, settle(weights_of(train))


@query("strategy_weights", with_ctes(["strat"], f"SELECT strategy, window_id, symbol, {r('w')} FROM strat"))
def _(spark, sf):
    return weights_of(split(spark, sf)[0])


cte(
    "delta",
    ("strat",),
    """SELECT COALESCE(a.strategy, b.strategy) AS strategy, COALESCE(a.window_id, b.window_id + 1) AS window_id, COALESCE(a.symbol, b.symbol) AS symbol,
      COALESCE(a.w, 0e0) AS w, COALESCE(b.w, 0e0) AS prev, a.w IS NOT NULL AS in_new, b.w IS NOT NULL AS in_old
    FROM strat a FULL JOIN strat b ON a.strategy = b.strategy AND a.window_id = b.window_id + 1 AND a.symbol = b.symbol
    WHERE COALESCE(a.window_id, b.window_id + 1) <= (SELECT MAX(window_id) FROM strat)""",
)
cte("half_to", ("delta",), "SELECT strategy, window_id, SUM(ABS(w - prev)) / 2 AS turnover FROM delta WHERE window_id > 0 AND in_old GROUP BY strategy, window_id")
cte("full_to", ("delta",), "SELECT strategy, window_id, SUM(ABS(w - prev)) AS turnover FROM delta WHERE window_id > 0 AND in_new GROUP BY strategy, window_id")


@query("weights_delta", with_ctes(["delta"], f"SELECT strategy, window_id, symbol, {r('w')}, {r('prev')} FROM delta"))
def _(spark, sf):
    return B.weights_delta(evaluated(spark, sf)[2]).select("strategy", "window_id", "symbol", "w", "prev")


@query("half_l1_turnover", with_ctes(["half_to"], f"SELECT strategy, window_id, {r('turnover')} FROM half_to"))
def _(spark, sf):
    return B.half_l1_turnover(evaluated(spark, sf)[2])


@query("l1_turnover", with_ctes(["full_to"], f"SELECT strategy, {r('AVG(turnover)', 'avg_turnover')} FROM full_to GROUP BY strategy"))
def _(spark, sf):
    return B.l1_turnover(evaluated(spark, sf)[2]).groupBy("strategy").agg(F.avg("turnover").alias("avg_turnover"))


@query("transaction_costs", with_ctes(["half_to"], f"SELECT strategy, window_id, {r('turnover')}, {r('turnover * 7.5e0 / 10000', 'cost', 9)} FROM half_to"), digits=9)
def _(spark, sf):
    return B.transaction_costs(B.half_l1_turnover(evaluated(spark, sf)[2])).withColumn("turnover", F.round("turnover", 6))


@query("total_turnover", with_ctes(["half_to"], f"SELECT strategy, {r('SUM(turnover)', 'total_turnover')} FROM half_to GROUP BY strategy"))
def _(spark, sf):
    return B.total_turnover(B.half_l1_turnover(evaluated(spark, sf)[2]))


# ---- test returns ----------------------------------------------------------------------------

cte(
    "gross",
    ("test", "strat"),
    "SELECT strategy, window_id, dt, SUM(w * ret) AS ret FROM test JOIN strat USING (window_id, symbol) GROUP BY strategy, window_id, dt",
)


def net_cte(name: str, bps: str) -> None:
    cte(
        name,
        ("gross", "half_to"),
        f"""SELECT g.strategy, g.window_id, g.dt, g.ret - CASE WHEN g.dt = MIN(g.dt) OVER (PARTITION BY g.strategy, g.window_id)
          THEN COALESCE(h.turnover, 0e0) * {bps} / 10000 ELSE 0e0 END AS ret
        FROM gross g LEFT JOIN half_to h ON g.strategy = h.strategy AND g.window_id = h.window_id""",
    )


net_cte("net", "7.5e0")


def net_of(test, weights):
    return B.net_test_returns(test, weights, B.transaction_costs(B.half_l1_turnover(weights)))


@query("net_test_returns", with_ctes(["net"], f"SELECT strategy, window_id, {d()}, {r('ret')} FROM net"))
def _(spark, sf):
    _, test, weights = evaluated(spark, sf)
    return net_of(test, weights)


@query(
    "union_results",
    with_ctes(["net", "bwin"], f"SELECT strategy, {d()}, {r('ret')} FROM net UNION ALL SELECT 'benchmark', {d()}, {r('bench_ret', 'ret')} FROM bwin WHERE role = 'test'"),
)
def _(spark, sf):
    _, test, weights = evaluated(spark, sf)
    marks = B.benchmark_in_tests(bench(spark, sf), B.walk_forward_windows(panel(spark, sf).select("dt")))
    return net_of(test, weights).select("strategy", "dt", "ret").unionByName(
        marks.select(F.lit("benchmark").alias("strategy"), "dt", F.col("bench_ret").alias("ret"))
    )


cte("met_s", ("net", "mkt_ret"), metrics_sql("net", "strategy", "LEFT JOIN mkt_ret USING (dt)"))
cte(
    "score",
    ("met_s", "strat", "half_to"),
    """SELECT * FROM met_s JOIN
      (SELECT strategy, AVG(enh) AS avg_enh, MIN(enh) AS min_enh, MAX(enh) AS max_enh FROM
        (SELECT strategy, window_id, COALESCE(EXP(-SUM(CASE WHEN w > 0 THEN w * LN(w + 1e-12) END)), 0e0) AS enh FROM strat GROUP BY strategy, window_id)
        GROUP BY strategy) USING (strategy)
      LEFT JOIN (SELECT strategy, SUM(turnover) AS tt FROM half_to GROUP BY strategy) USING (strategy)""",
)
_cost = r("COALESCE(tt, 0e0) * 7.5e0 / 10000", "total_cost")
SCORE = [*PERF, *MORE, *REL, *[r(c) for c in ("avg_enh", "min_enh", "max_enh")], r("COALESCE(tt, 0e0)", "total_turnover"), _cost]


def scores(spark, sf):
    _, test, weights = evaluated(spark, sf)
    return B.strategy_scorecard(test, weights, bench(spark, sf))


@query("strategy_scorecard", with_ctes(["score"], f"SELECT strategy, {', '.join(SCORE)} FROM score"))
def _(spark, sf):
    return scores(spark, sf)


@query("headline_strategy", with_ctes(["score"], f"SELECT 'optimized' AS strategy, {', '.join(SCORE)} FROM score WHERE strategy = 'mean_variance_capped_30'"))
def _(spark, sf):
    return B.headline_strategy(scores(spark, sf), ["mean_variance_capped_30", "mean_variance", "equal_weight"])


@query(
    "strategy_rankings",
    with_ctes(
        ["score"],
        """SELECT metric, strategy, place, STRING_AGG(strategy, ' > ' ORDER BY place) OVER (PARTITION BY metric) AS ranking FROM
        (SELECT metric, strategy, ROW_NUMBER() OVER (PARTITION BY metric ORDER BY s, strategy) AS place FROM
          (SELECT 'sharpe_ratio' AS metric, strategy, ROUND(-sharpe, 9) AS s FROM score UNION ALL SELECT 'sortino_ratio', strategy, ROUND(-sortino, 9) FROM score
           UNION ALL SELECT 'annual_return', strategy, ROUND(-ar, 9) FROM score UNION ALL SELECT 'max_drawdown', strategy, ROUND(ABS(mdd), 9) FROM score))""",
    ),
)
def _(spark, sf):
    return M.strategy_rankings(scores(spark, sf))


_pairs = [(r(f"MAX({c}) FILTER (WHERE strategy = 'mean_variance_turnover_constrained') - MAX({c}) FILTER (WHERE strategy = 'mean_variance')", f"delta_{n}")) for c, n in (
    ("ar", "annual_return"), ("av", "annual_volatility"), ("sharpe", "sharpe_ratio"), ("mdd", "max_drawdown"), ("sortino", "sortino_ratio"), ("wins", "win_rate"),
    ("tt", "total_turnover"), ("tt * 7.5e0 / 10000", "total_cost"), ("(ar - tt * 7.5e0 / 10000)", "net_return"))]


@query("turnover_impact", with_ctes(["score"], f"SELECT {', '.join(_pairs)} FROM score"))
def _(spark, sf):
    s = scores(spark, sf).withColumn("net_return", F.col("annual_return") - F.col("total_cost"))
    cols = ["annual_return", "annual_volatility", "sharpe_ratio", "max_drawdown", "sortino_ratio", "win_rate", "total_turnover", "total_cost", "net_return"]
    return M.turnover_impact(s, "mean_variance", "mean_variance_turnover_constrained", cols)


cte(
    "excess",
    ("net",),
    """SELECT 'excess' AS strategy, a.dt, a.ret - b.ret AS ret FROM net a JOIN net b ON a.dt = b.dt
    WHERE a.strategy = 'mean_variance_capped_30' AND b.strategy = 'equal_weight'""",
)
cte("met_x", ("excess",), metrics_sql("excess", "strategy"))


@query("excess_return_metrics", with_ctes(["met_x"], f"SELECT 'mean_variance_capped_30-equal_weight' AS strategy, {', '.join(PERF)} FROM met_x"))
def _(spark, sf):
    _, test, weights = evaluated(spark, sf)
    return M.performance_metrics(M.excess_returns(net_of(test, weights), "mean_variance_capped_30", "equal_weight"), ("strategy",))


@query(
    "walk_forward_correlation",
    with_ctes(["net"], f"SELECT a.strategy AS i, b.strategy AS j, {r('CORR(a.ret, b.ret)', 'corr')} FROM net a JOIN net b ON a.dt = b.dt GROUP BY a.strategy, b.strategy"),
)
def _(spark, sf):
    _, test, weights = evaluated(spark, sf)
    return C.correlation_matrix(net_of(test, weights), item="strategy")


net_cte("net1", "1e0")
net_cte("net20", "20e0")
cte("net_bps", ("net", "net1", "net20"), "SELECT *, 7.5e0 AS bps FROM net UNION ALL SELECT *, 1e0 FROM net1 UNION ALL SELECT *, 20e0 FROM net20")


@query(
    "cost_sensitivity",
    with_ctes(["net_bps"], f"SELECT strategy, bps, COUNT(*) AS n, {r('PRODUCT(1 + ret) - 1', 'total_return')} FROM net_bps GROUP BY strategy, bps"),
)
def _(spark, sf):
    _, test, weights = evaluated(spark, sf)
    net = B.cost_sensitivity(test, weights, B.half_l1_turnover(weights), [1.0, 7.5, 20.0])
    return net.groupBy("strategy", "bps").agg(F.count(F.lit(1)).alias("n"), (F.product(1 + F.col("ret")) - 1).alias("total_return"))


@query(
    "sharpe_improvement",
    with_ctes(
        ["score"],
        f"""SELECT strategy, {r('(sharpe - eq) / NULLIF(ABS(eq), 0) * 100', 'improvement', 4)} FROM score,
        (SELECT sharpe AS eq FROM score WHERE strategy = 'equal_weight')""",
    ),
    digits=4,
)
def _(spark, sf):
    # metrics rows are few: one per strategy
    s = scores(spark, sf).select("strategy", "sharpe_ratio")
    even = s.filter("strategy = 'equal_weight'").select("sharpe_ratio").scalar()
    return s.select("strategy", M.sharpe_improvement(F.col("sharpe_ratio"), even).alias("improvement"))
