"""Weights per walk-forward window, candidate grids and moments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barweave.catalog.oracle import cte, d, r, with_ctes
from barweave.catalog.oracle_grid import (
    DESC, ENT, L1, L2, N, NAMES, WS, best_ctes, candidate_ctes, cap_once, capped, cvar_ctes, exchange_cte, inverse_vol_cte, mu_cte, sample_cov_cte,
)
from barweave.catalog.q_metrics import port_rets, portfolios
from barweave.catalog.q_returns import panel
from barweave.catalog.registry import query
from barweave.operators import allocation as A
from barweave.operators import covariance as C
from barweave.operators import metrics as M
from barweave.operators import returns as R
from barweave.operators import optimum as S
from barweave.plans import walkforward as B
from barweave.session import settle
from barweave.sources import derived as D

CAP = 0.3
KEY = ("window_id",)

# ---- windows --------------------------------------------------------------------------------

cte("pcal", ("panel",), "SELECT DISTINCT dt FROM panel")
cte(
    "win",
    ("pcal",),
    """SELECT 0 AS n, s.m0 AS st, (SELECT MAX(c.dt) FROM pcal c WHERE c.dt <= s.m0 + 252) AS te, (SELECT MAX(c.dt) FROM pcal c WHERE c.dt <= s.m0 + 315) AS xe
   FROM (SELECT MIN(dt) m0, MAX(dt) m1 FROM pcal) s WHERE s.m0 + 315 <= s.m1
   UNION ALL
   SELECT n + 1, xe + 1, (SELECT MAX(c.dt) FROM pcal c WHERE c.dt <= win.xe + 253), (SELECT MAX(c.dt) FROM pcal c WHERE c.dt <= win.xe + 316)
   FROM win WHERE win.xe + 316 <= (SELECT MAX(dt) FROM pcal)""",
)
cte("wrows", ("panel", "win"), "SELECT CAST(n AS BIGINT) AS window_id, symbol, dt, price, CASE WHEN dt <= te THEN 'train' ELSE 'test' END AS role FROM panel JOIN win ON dt BETWEEN st AND xe")
cte("wret", ("wrows",), """SELECT * FROM (SELECT window_id, role, symbol, dt, price / LAG(price) OVER (PARTITION BY window_id, role, symbol ORDER BY dt) - 1 AS ret FROM wrows)
  WHERE ret IS NOT NULL""")
cte("train", ("wret",), "SELECT * FROM wret WHERE role = 'train'")
cte("test", ("wret",), "SELECT * FROM wret WHERE role = 'test'")


def windows(spark, sf):
    return B.walk_forward_windows(panel(spark, sf).select("dt"))


def segments(spark, sf):
    rows = panel(spark, sf)
    return B.segment_returns(B.split_rows(rows, B.walk_forward_windows(rows.select("dt"))))


def split(spark, sf):
    """Train and test returns of every window, written once."""
    seg = settle(segments(spark, sf).select("window_id", "role", "symbol", "dt", "ret"))
    return seg.filter("role = 'train'").drop("role"), seg.filter("role = 'test'").drop("role")


def moments(train):
    return M.mean_returns(train, ("window_id", "symbol")), C.cov_sample(train, group=KEY)


# ---- the same moments and candidates in SQL -------------------------------------------------

mu_cte("", "train")
sample_cov_cte("", "train")
candidate_ctes("", "wmu")
best_ctes("mv", "cand", "TRUE", "ret - 0.5e0 * var")
best_ctes("mv_cap", "cand", capped(CAP), "ret - 0.5e0 * var")
best_ctes("mv_cap18", "cand", capped(0.18), "ret - 0.5e0 * var")
best_ctes("mv_ent", "cand", capped(CAP), f"ret - 0.5e0 * var - 0.05e0 * ({ENT})")
best_ctes("mv_to", "cand", f"{capped(CAP)} AND {L1} <= 0.3e0 + 1e-9", f"ret - 0.5e0 * var - 0.1e0 * ({L2})")
best_ctes("mv_target", "cand", "ret >= 0.02e0 - 1e-9", "-var")
best_ctes("bl", "cand_bl", capped(CAP), "ret - 0.5e0 * var")
cvar_ctes("cvar", "train", 0.9, CAP)
inverse_vol_cte("invvol_raw", "train")
cte("invvol", ("invvol_raw",), cap_once("invvol_raw", 0.2))
cte("equal", ("wmu",), "SELECT window_id, symbol, 0.2e0 AS w FROM wmu")
# signals: half of the last training return; ASIA has none, window 0 has equal ones
cte(
    "signals",
    ("train",),
    "SELECT window_id, symbol, CASE WHEN window_id = 0 THEN 0.001e0 ELSE 0.5e0 * ret END AS signal FROM train WHERE symbol <> 'ASIA' OR window_id = 0 QUALIFY ROW_NUMBER() OVER (PARTITION BY window_id, symbol ORDER BY dt DESC) = 1",
)
# for the strategies: the last training return of every symbol
cte("full_signals", ("train",), "SELECT window_id, symbol, ret AS signal FROM train QUALIFY ROW_NUMBER() OVER (PARTITION BY window_id, symbol ORDER BY dt DESC) = 1")
for _zs, _source in (("zs", "signals"), ("full_zs", "full_signals")):
    cte(
        _zs,
        (_source, "wmu"),
        f"""SELECT window_id, symbol, CASE WHEN ROUND(sd, 15) > 0 THEN GREATEST(-2e0, LEAST(2e0, (s - m) / sd)) ELSE 0e0 END AS z FROM
        (SELECT window_id, symbol, s, AVG(s) OVER (PARTITION BY window_id) AS m, STDDEV_POP(s) OVER (PARTITION BY window_id) AS sd FROM
        (SELECT w.window_id, w.symbol, COALESCE(g.signal, 0e0) AS s FROM wmu w LEFT JOIN {_source} g ON w.window_id = g.window_id AND w.symbol = g.symbol))""",
    )
cte(
    "tilt_raw",
    ("zs", "mv_cap"),
    """SELECT window_id, symbol, CASE WHEN g < 0.1e0 THEN w ELSE w * EXP(0.2e0 * LEAST(1e0, g) * z) END AS w FROM
    (SELECT m.window_id, m.symbol, m.w, z, AVG(ABS(z)) OVER (PARTITION BY m.window_id) AS g FROM mv_cap m JOIN zs ON m.window_id = zs.window_id AND m.symbol = zs.symbol)""",
)
cte("tilt_norm", ("tilt_raw",), "SELECT window_id, symbol, w / SUM(w) OVER (PARTITION BY window_id) AS w FROM tilt_raw")
cte("tilt", ("tilt_norm",), cap_once("tilt_norm", CAP))


def signals(train):
    from barweave.operators.returns import latest_row

    last = latest_row(train.filter("symbol <> 'ASIA' or window_id = 0"), ("window_id", "symbol"))
    return last.select("window_id", "symbol", F.when(F.col("window_id") == 0, 0.001).otherwise(0.5 * F.col("ret")).alias("signal"))


def full_signals(train):
    """The last training return of every symbol."""
    return R.latest_row(train, ("window_id", "symbol")).select("window_id", "symbol", F.col("ret").alias("signal"))


def tilted(train, base, cap=CAP):
    z = A.signal_zscore(signals(train), base.select("window_id", "symbol"), KEY)
    return A.tilt_weights(base, z, KEY, cap=cap)


# ---- queries --------------------------------------------------------------------------------


def weights_query(key: str, name: str, fn, status: bool = True) -> None:
    cols = ", status" if status else ""

    @query(key, with_ctes([name], f"SELECT window_id, symbol, {r('w')}{cols} FROM {name}"))
    def _(spark, sf):
        return fn(split(spark, sf)[0])


def _problems(train):
    return A.problems(*moments(train), KEY)


def _bl(train, delta=2.5):
    cov = C.cov_sample(train, group=KEY)
    return A.problems(A.implied_returns(cov, KEY, delta), cov, KEY)


def with_even_prev(rows):
    return rows.withColumn("prev", F.transform("symbols", lambda s: F.lit(1.0) / F.size("symbols")))


weights_query("equal_weight", "equal", lambda t: A.equal_weight(t, KEY), status=False)
weights_query("inverse_vol_weights", "invvol", lambda t: A.inverse_vol_weights(t, KEY, cap=0.2), status=False)
weights_query("mv_best", "mv", lambda t: A.mv_best(_problems(t), KEY, N))
weights_query("mv_best_capped", "mv_cap", lambda t: A.mv_best(_problems(t), KEY, N, cap=CAP))
weights_query("mv_best_entropy", "mv_ent", lambda t: A.mv_best(_problems(t), KEY, N, cap=CAP, entropy=0.05))
weights_query(
    "mv_best_turnover_limited", "mv_to",
    lambda t: A.mv_best(with_even_prev(_problems(t)), KEY, N, cap=CAP, turnover_penalty=0.1, max_turnover=0.3),
)
weights_query("mv_best_target_return", "mv_target", lambda t: A.mv_best(_problems(t), KEY, N, target=0.02))
weights_query("infeasible_fallback", "mv_cap18", lambda t: A.mv_best(_problems(t), KEY, N, cap=0.18))
weights_query("black_litterman_best", "bl", lambda t: A.mv_best(_bl(t), KEY, N, cap=CAP))
weights_query("min_cvar", "cvar", lambda t: A.min_cvar(A.scenarios(t, KEY), KEY, N, confidence=0.9, cap=CAP))
weights_query("ml_tilt_weights", "tilt", lambda t: tilted(t, A.mv_best(_problems(t), KEY, N, cap=CAP)), status=False)


@query("ml_signal_zscore", with_ctes(["zs"], f"SELECT window_id, symbol, {r('z')} FROM zs"))
def _(spark, sf):
    train, _ = split(spark, sf)
    return A.signal_zscore(signals(train), train.select("window_id", "symbol").distinct(), KEY)


@query(
    "bl_implied_returns",
    with_ctes(["prob_bl"], " UNION ALL ".join(f"SELECT window_id, {s} AS symbol, {r(f'm{k}', 'mu')} FROM prob_bl" for k, s in enumerate(NAMES))),
)
def _(spark, sf):
    train, _ = split(spark, sf)
    return A.implied_returns(C.cov_sample(train, group=KEY), KEY)


@query(
    "candidate_grid",
    with_ctes(["cand"], f"SELECT window_id, {', '.join(r(f'w{k}') for k in range(N))}, {r('ret')}, {r('SQRT(GREATEST(var, 0))', 'vol')} FROM cand"),
)
def _(spark, sf):
    train, _ = split(spark, sf)
    c = A.with_moments(A.candidate_grid(_problems(train), KEY, N), N)
    return c.select("window_id", *[F.col("w")[k].alias(f"w{k}") for k in range(N)], "ret", "vol")


@query(
    "efficient_frontier",
    with_ctes(
        ["cand", "prob"],
        f"""SELECT window_id, point, {r('target')}, {r('ret')}, {r('vol')}, {r('CASE WHEN vol > 0 THEN (ret - 0.02e0) / vol ELSE 0e0 END', 'sharpe')}, {', '.join(r(f'w{k}') for k in range(N))} FROM
        (SELECT window_id, CAST(k AS BIGINT) AS point, lo + k * gap AS target, ret, var, SQRT(GREATEST(var, 0)) AS vol, {WS} FROM cand JOIN
          (SELECT window_id AS wid, lo, (hi - lo) / 9 AS gap, UNNEST(range(10)) AS k FROM
            (SELECT window_id, LEAST(m0, m1, m2, m3, m4) AS lo, GREATEST(m0, m1, m2, m3, m4) AS hi FROM prob)) ON wid = window_id AND ret - lo + 1e-9 >= k * gap
         QUALIFY ROW_NUMBER() OVER (PARTITION BY window_id, k ORDER BY ROUND(-var, 14) DESC, {DESC}) = 1)""",
    ),
)
def _(spark, sf):
    train, _ = split(spark, sf)
    f = A.efficient_frontier(_problems(train), KEY, N)
    return f.select("window_id", "point", "target", "ret", "vol", "sharpe", *[F.col("w")[k].alias(f"w{k}") for k in range(N)])


@query(
    "cvar_of_portfolio",
    with_ctes(
        ["port_ret"],
        f"""SELECT portfolio_id, {r('t', 'var')}, {r('t + SUM(GREATEST(-ret - t, 0)) / ((1 - 0.9e0) * COUNT(*))', 'cvar')} FROM
        (SELECT *, QUANTILE_DISC(-ret, 0.9) OVER (PARTITION BY portfolio_id) AS t FROM port_ret) GROUP BY portfolio_id, t""",
    ),
)
def _(spark, sf):
    return A.cvar_of_portfolio(port_rets(spark, sf), confidence=0.9)


@query("effective_holdings", with_ctes(["mv_ent"], f"SELECT window_id, {r('EXP(-SUM(CASE WHEN w > 0 THEN w * LN(w + 1e-12) END))', 'enh')} FROM mv_ent GROUP BY window_id"))
def _(spark, sf):
    return A.effective_holdings(A.mv_best(_problems(split(spark, sf)[0]), KEY, N, cap=CAP, entropy=0.05), KEY)


@query(
    "top_holdings",
    with_ctes(["invvol_raw"], f"SELECT window_id, symbol, {r('w')}, ROW_NUMBER() OVER (PARTITION BY window_id ORDER BY ROUND(w, 9) DESC, symbol) AS place FROM invvol_raw QUALIFY place <= 5"),
)
def _(spark, sf):
    return A.top_holdings(A.inverse_vol_weights(split(spark, sf)[0], KEY), KEY, n=5)


_ALL = "(SELECT portfolio_id, r_name AS symbol FROM (SELECT DISTINCT portfolio_id FROM ports), region)"


def full_universe(spark, sf):
    ports = portfolios(spark, sf)
    names = D.table(spark, sf, "region").agg(F.sort_array(F.collect_set("r_name")).alias("_s"))
    ids = ports.select("portfolio_id").distinct()
    return ids.select("portfolio_id", F.explode(names.scalar()).alias("symbol"))


@query(
    "align_weights",
    with_ctes(["ports"], f"SELECT portfolio_id, symbol, {r('COALESCE(w, 0) / SUM(w) OVER (PARTITION BY portfolio_id)', 'w')} FROM {_ALL} LEFT JOIN ports USING (portfolio_id, symbol)"),
)
def _(spark, sf):
    return A.align_weights(portfolios(spark, sf), full_universe(spark, sf))


@query(
    "validate_weights",
    with_ctes(
        ["ports"],
        """SELECT portfolio_id, COUNT(*) = 5 AS same_symbols, ROUND(SUM(w), 6) + 0.0 AS total, COUNT(*) = 5 AND ABS(SUM(w) - 1) <= 0.01 AS is_valid FROM ports GROUP BY portfolio_id""",
    ),
)
def _(spark, sf):
    return A.validate_weights(portfolios(spark, sf), full_universe(spark, sf))


# The parameter grid of the risk models, caps and entropy levels.
CAPS = [None, 0.40, 0.35, 0.30, 0.25, 0.20]
ENTROPIES = [0.0, 0.01, 0.02, 0.03]


@query(
    "param_grid",
    with_ctes(["win"], """SELECT CAST(n AS BIGINT) AS window_id, risk_model, cap, entropy FROM win, (VALUES ('sample'), ('ledoit_wolf'), ('oas')) a(risk_model),
      (VALUES (CAST(NULL AS DOUBLE)), (0.4e0), (0.35e0), (0.3e0), (0.25e0), (0.2e0)) b(cap), (VALUES (0e0), (0.01e0), (0.02e0), (0.03e0)) c(entropy)"""),
)
def _(spark, sf):
    return A.expand_grid(windows(spark, sf).select("window_id"), risk_model=["sample", "ledoit_wolf", "oas"], cap=CAPS, entropy=ENTROPIES)


# portfolios of the whole history compared by method
@query(
    "method_comparison",
    with_ctes(
        ["met_p", "ports"],
        f"""SELECT portfolio_id, {r('ar', 'annual_return')}, {r('av', 'annual_volatility')}, {r('sharpe', 'sharpe_ratio')}, {r('mdd', 'max_drawdown')}, {r('wins', 'win_rate')},
        top_holding, {r('top_weight')} FROM met_p JOIN (SELECT portfolio_id, symbol AS top_holding, w AS top_weight FROM ports
          QUALIFY ROW_NUMBER() OVER (PARTITION BY portfolio_id ORDER BY w DESC, symbol) = 1) USING (portfolio_id)""",
    ),
)
def _(spark, sf):
    ports = portfolios(spark, sf)
    top = A.top_holdings(ports, ("portfolio_id",), n=1).select("portfolio_id", F.col("symbol").alias("top_holding"), F.col("w").alias("top_weight"))
    m = M.performance_metrics(port_rets(spark, sf), ("portfolio_id",))
    return m.select("portfolio_id", "annual_return", "annual_volatility", "sharpe_ratio", "max_drawdown", "win_rate").join(top, "portfolio_id")


@query(
    "method_ranking",
    with_ctes(
        ["met_p"],
        """SELECT portfolio_id, RANK() OVER (ORDER BY ROUND(sharpe, 9) DESC) AS by_sharpe, RANK() OVER (ORDER BY ROUND(mdd, 9) DESC) AS by_drawdown FROM met_p""",
    ),
)
def _(spark, sf):
    return M.method_ranking(M.performance_metrics(port_rets(spark, sf), ("portfolio_id",)), "portfolio_id")


_board = "GREATEST(" + WS + ") <= 0.5e0 + 1e-9"
_sh = "(ret - 0.02e0) / GREATEST(SQRT(GREATEST(var, 0)), 1e-8)"


@query(
    "grid_leaderboard",
    with_ctes(
        ["cand"],
        f"""SELECT window_id, {', '.join(r(f'w{k}') for k in range(N))}, {r('ret')}, {r(_sh, 'sharpe')} FROM cand WHERE {_board}
        ORDER BY ROUND({_sh}, 9) DESC, ROUND(ret, 9) DESC, window_id, {DESC} LIMIT 12""",
    ),
)
def _(spark, sf):
    train, _ = split(spark, sf)
    c = A.with_moments(A.candidate_grid(_problems(train), KEY, N), N)
    return A.leaderboard(c, cap=0.5, assets=N).select("window_id", *[F.col("w")[k].alias(f"w{k}") for k in range(N)], "ret", "sharpe")


# ---- continuous weights for many tasks -------------------------------------------------------

def sweep_tasks(train):
    """Every window under every risk model, cap and entropy level."""
    parts = [B.window_problems(train, m).withColumn("risk_model", F.lit(m)) for m in C.COVARIANCES]
    rows = settle(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    return A.expand_grid(rows, cap=CAPS, entropy=ENTROPIES)


@query("param_grid_metrics")
def _(spark, sf):
    out = S.optimum(sweep_tasks(split(spark, sf)[0]), ["window_id", "risk_model"])
    return out.select("window_id", "risk_model", "cap", "entropy", "sharpe", "vol", "ret", "gap", "status")


@query("portfolio_sweep")
def _(spark, sf):
    """Weights of plain, capped, turnover-limited, equilibrium and frontier tasks of every window."""
    train, _ = split(spark, sf)
    rows = settle(with_even_prev(_problems(train)))
    num = lambda v: F.lit(v).cast("double")
    task = lambda df, name, cap, limit, target: df.select(
        F.lit(name).alias("method"), "window_id", "symbols", "mu", "cov", "prev", num(cap).alias("cap"), num(limit).alias("max_turnover"), target.alias("target")
    )
    none = num(None)
    frontier = S.frontier_tasks(rows).withColumn("method", F.concat(F.lit("frontier_"), F.col("point")))
    tasks = [
        task(rows, "mean_variance", None, None, none),
        task(rows, "mean_variance_capped", CAP, None, none),
        task(rows, "turnover_limited", CAP, 0.3, none),
        task(with_even_prev(_bl(train)), "black_litterman", CAP, None, none),
        task(rows, "infeasible", 0.18, None, none),
        frontier.select("method", "window_id", "symbols", "mu", "cov", "prev", none.alias("cap"), none.alias("max_turnover"), "target"),
    ]
    union = tasks[0]
    for t in tasks[1:]:
        union = union.unionByName(t)
    out = S.optimum(union, ["method", "window_id"])
    return out.select("method", "window_id", "status", "ret", "vol", "sharpe", F.explode(F.arrays_zip("symbols", "w")).alias("_z")).select(
        "method", "window_id", "status", "ret", "vol", "sharpe", F.col("_z.symbols").alias("symbol"), F.col("_z.w").alias("w")
    )


# ---- continuous weights, as facts that SQL can state -----------------------------------------


def _facts(weights, cap):
    w = F.col("w")
    return weights.groupBy("window_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(w), 6).alias("total"), (F.max(w) <= cap + 1e-9).alias("within_cap"), (F.min(w) >= 0).alias("long_only")
    )


cte("brand_win", ("brand_ret", "win"), "SELECT CAST(n AS BIGINT) AS window_id, symbol, dt, ret FROM brand_ret JOIN win ON dt BETWEEN st AND te")


mu_cte("b_", "brand_win")
sample_cov_cte("b_", "brand_win")
cte(
    "b_prob",
    ("b_wmu", "b_wcov"),
    """SELECT window_id, symbols, mu, cov FROM (SELECT window_id, list(symbol ORDER BY symbol) AS symbols, list(mu ORDER BY symbol) AS mu FROM b_wmu GROUP BY window_id)
    JOIN (SELECT window_id, list(cov ORDER BY i, j) AS cov FROM b_wcov GROUP BY window_id) USING (window_id)""",
)
exchange_cte("b_best", "b_prob", 1, 0.18)
exchange_cte("b_least", "b_prob", 0, 1)


def brand_train(spark, sf):
    returns = R.simple_returns(D.brand_bars(spark, sf)).select("symbol", "dt", "ret")
    return settle(B.split_rows(returns, windows(spark, sf)).filter("role = 'train'").drop("role"))


@query(
    "strategy_weights_brands",
    with_ctes(["brand_win"], "SELECT window_id, COUNT(DISTINCT symbol) AS n, 1e0 AS total, TRUE AS within_cap, TRUE AS long_only FROM brand_win GROUP BY window_id"),
)
def _(spark, sf):
    """A capped universe of 25 brands: more assets than the grid takes, and a cap between its steps."""
    rows = A.problems(*moments(brand_train(spark, sf)), KEY)
    return _facts(A.mv_best(rows, KEY, cap=0.18, entropy=0.03), 0.18)


@query(
    "turnover_chain_brands",
    with_ctes(["brand_win"], """SELECT window_id, n, CASE WHEN prior IS NULL OR prior = names THEN TRUE END AS within_limit FROM (SELECT *, LAG(names) OVER (ORDER BY window_id) AS prior FROM
      (SELECT window_id, COUNT(DISTINCT symbol) AS n, LIST_SORT(LIST(DISTINCT symbol)) AS names FROM brand_win GROUP BY window_id))"""),
)
def _(spark, sf):
    """Windows of 25 brands, each within the turnover limit of the one before where both hold the same brands."""
    rows = A.problems(*moments(brand_train(spark, sf)), KEY)
    held = settle(A.mv_chain(rows, [], cap=0.18, entropy=0.03, max_turnover=0.3)).groupBy("window_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("symbol", "w")))).alias("now"))
    before = F.lag("now").over(Window.orderBy("window_id"))  # one row a window
    moved = F.aggregate(F.map_entries("now"), F.lit(0.0), lambda a, e: a + F.abs(e["value"] - F.try_element_at(F.col("before"), e["key"])))
    same = F.map_keys("now") == F.map_keys("before")
    return held.withColumn("before", before).select(
        "window_id", F.size("now").cast("long").alias("n"), F.when(F.col("before").isNull(), True).when(same, moved <= 0.3 + 1e-6).alias("within_limit")
    )


@query("mv_target_turnover", with_ctes(["win"], "SELECT CAST(n AS BIGINT) AS window_id, 'optimal' AS status, 1e0 AS total, TRUE AS reaches_target, TRUE AS within_limit FROM win"))
def _(spark, sf):
    """Least risk with a least return and a largest change from even weights at once."""
    rows = settle(with_even_prev(_problems(split(spark, sf)[0])))
    mean = F.aggregate("mu", F.lit(0.0), lambda a, x: a + x) / F.size("mu")
    tasks = rows.withColumns({"target": mean + 0.25 * (F.array_max("mu") - mean), "max_turnover": F.lit(0.5)})
    out = S.optimum(tasks, KEY).join(rows.select("window_id", "prev"), list(KEY))
    moved = F.aggregate(F.zip_with("w", "prev", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, x: a + x)
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x)
    return out.select(
        "window_id", "status", F.round(total, 6).alias("total"), (F.col("ret") >= F.col("target") - 1e-6).alias("reaches_target"), (moved <= 0.5 + 1e-6).alias("within_limit")
    )


@query(
    "scenarios_incomplete",
    with_ctes(
        ["train"],
        """SELECT window_id, MAX(n) AS n_symbols, COUNT(*) AS n_dates FROM (SELECT window_id, dt, COUNT(*) AS k FROM train WHERE NOT (symbol = 'ASIA' AND EXTRACT(DAY FROM dt) % 3 = 0) GROUP BY ALL)
        JOIN (SELECT window_id, COUNT(DISTINCT symbol) AS n FROM train GROUP BY window_id) USING (window_id) WHERE k = n GROUP BY window_id""",
    ),
)
def _(spark, sf):
    """Dates on which a symbol has no return give no scenario."""
    train = split(spark, sf)[0].filter("not (symbol = 'ASIA' and day(dt) % 3 = 0)")
    return A.scenarios(train, KEY).select("window_id", F.size("symbols").alias("n_symbols"), F.size("scenarios").alias("n_dates"))


@query(
    "mv_best_brands",
    with_ctes(["b_best", "b_prob"], f"SELECT window_id, UNNEST(symbols) AS symbol, 'optimal' AS status, {r('UNNEST(w)', 'w', 5)} FROM b_best JOIN b_prob USING (window_id)"),
    digits=5,
)
def _(spark, sf):
    """The best capped weights of 25 brands; the SQL finds them by its own search."""
    rows = A.problems(*moments(brand_train(spark, sf)), KEY)
    return A.mv_best(rows, KEY, cap=0.18).select("window_id", "symbol", "status", "w")


def duality_gaps(weights, mu, cov):
    """(window_id, point, gap, ret, vol) from long weights (window_id, point, symbol, w, lambda, target), by joins: what
    the largest slope gains over the slopes of the weights, and the multiplier times the return beyond the target."""
    at = ["window_id", "point"]
    risk = weights.select(*at, F.col("symbol").alias("j"), F.col("w").alias("wj")).join(cov.select("window_id", "i", "j", "cov"), ["window_id", "j"])
    slope = risk.groupBy(*at, F.col("i").alias("symbol")).agg(F.sum(F.col("cov") * F.col("wj")).alias("g"))
    per = weights.join(slope, [*at, "symbol"]).join(mu.select("window_id", "symbol", "mu"), ["window_id", "symbol"])
    b = F.col("lambda") * F.col("mu") - F.col("g")
    beyond = F.first("lambda") * (F.sum(F.col("w") * F.col("mu")) - F.first("target"))
    return per.groupBy(*at).agg(
        (F.max(b) - F.sum(b * F.col("w")) + beyond).alias("gap"), F.sum(F.col("w") * F.col("mu")).alias("ret"), F.sqrt(F.sum(F.col("w") * F.col("g"))).alias("vol")
    )


_corner = "list_position(mu, list_max(mu))"


@query(
    "efficient_frontier_brands",
    with_ctes(
        ["b_least", "b_prob"],
        f"""SELECT window_id, CAST(k AS BIGINT) AS point, 'optimal' AS status, {r('lo + k * (hi - lo) / 9', 'target')}, TRUE AS within_gap, TRUE AS reaches, TRUE AS rises,
        {r('CASE k WHEN 0 THEN SQRT(least_var) WHEN 9 THEN SQRT(last_var) END', 'end_vol')} FROM
        (SELECT window_id, list_min(mu) AS lo, list_max(mu) AS hi, cov[({_corner} - 1) * len(mu) + {_corner}] AS last_var,
          list_sum(list_transform(range(len(mu) * len(mu)), lambda q: w[q // len(mu) + 1] * w[q % len(mu) + 1] * cov[q + 1])) AS least_var, UNNEST(range(10)) AS k
         FROM b_prob JOIN b_least USING (window_id))""",
    ),
)
def _(spark, sf):
    """Ten least-risk portfolios of 25 brands per window. Gap, return and risk are recomputed from the weights by joins;
    the SQL knows the targets, the least risk of all and the risk of the asset of largest return."""
    mu, cov = (settle(x) for x in moments(brand_train(spark, sf)))
    made = settle(A.efficient_frontier(A.problems(mu, cov, KEY), KEY))
    long = made.select("window_id", "point", "target", "lambda", F.explode(F.arrays_zip("symbols", "w")).alias("_z")).select(
        "window_id", "point", "target", "lambda", F.col("_z.symbols").alias("symbol"), F.col("_z.w").alias("w")
    )
    facts = made.select("window_id", "point", "target", "status").join(duality_gaps(long, mu, cov), ["window_id", "point"])
    rises = F.col("vol") >= F.coalesce(F.lag("vol").over(Window.partitionBy("window_id").orderBy("point")), F.lit(0.0)) - 1e-9  # ten rows a window
    return facts.select(
        "window_id", "point", "status", "target", (F.abs("gap") <= 1e-4).alias("within_gap"), (F.col("ret") >= F.col("target") - 1e-7).alias("reaches"), rises.alias("rises"),
        F.when(F.col("point").isin(0, 9), F.col("vol")).alias("end_vol"),
    )
