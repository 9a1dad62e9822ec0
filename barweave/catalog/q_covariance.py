"""Covariance, correlation and portfolio moments."""

from __future__ import annotations

from barweave.catalog.oracle import cte, r, with_ctes
from barweave.catalog.q_metrics import port_rets, portfolios
from barweave.catalog.q_quality import dirty
from barweave.catalog.q_returns import panel_rets
from barweave.catalog.registry import query
from barweave.operators import covariance as C
from barweave.operators import metrics as M
from barweave.operators import quality as Q
from barweave.operators.returns import simple_returns
from barweave.sources import derived as D


def _pairs(source: str, expr: str, key: str = "symbol") -> str:
    return f"SELECT a.{key} AS i, b.{key} AS j, {expr} FROM {source} a JOIN {source} b ON a.dt = b.dt GROUP BY a.{key}, b.{key}"


cte(
    "once_pos",
    ("once",),
    """SELECT * FROM (SELECT symbol, dt, adj_close / LAG(adj_close) OVER (PARTITION BY symbol ORDER BY dt) - 1 AS ret
    FROM once WHERE adj_close > 0) WHERE ret IS NOT NULL""",
)


@query("correlation_matrix", with_ctes(["once_pos"], _pairs("once_pos", r("CORR(a.ret, b.ret)", "corr"))))
def _(spark, sf):
    once = Q.dedup_bars(dirty(spark, sf), first_by="src").filter("adj_close > 0")
    return C.correlation_matrix(simple_returns(once).select("symbol", "dt", "ret"))


@query("brand_correlation", with_ctes(["brand_ret"], _pairs("brand_ret", r("CORR(a.ret, b.ret)", "corr"))))
def _(spark, sf):
    return C.correlation_matrix(simple_returns(D.brand_bars(spark, sf)).select("symbol", "dt", "ret"))


@query("strategy_correlation", with_ctes(["port_ret"], _pairs("port_ret", r("CORR(a.ret, b.ret)", "corr"), "portfolio_id")))
def _(spark, sf):
    return C.correlation_matrix(port_rets(spark, sf), item="portfolio_id")


cte("mu", ("panel_ret",), "SELECT symbol, AVG(ret) * 252 AS mu FROM panel_ret GROUP BY symbol")
cte("cov", ("panel_ret",), _pairs("panel_ret", "COVAR_SAMP(a.ret, b.ret) * 252 AS cov"))


@query("cov_sample", with_ctes(["cov"], f"SELECT i, j, {r('cov')} FROM cov"))
def _(spark, sf):
    return C.cov_sample(panel_rets(spark, sf))


def shrink_ctes(prefix: str, source: str) -> None:
    cte(f"{prefix}pop", (source,), _pairs(source, "COVAR_POP(a.ret, b.ret) AS s, COUNT(*) AS t"))
    cte(
        f"{prefix}st",
        (f"{prefix}pop",),
        f"""SELECT SUM(CASE WHEN i = j THEN s END) AS tr, COUNT(*) FILTER (WHERE i = j) * 1e0 AS p, SUM(s * s) AS ss, MAX(t) * 1e0 AS t,
        SUM(CASE WHEN i = j THEN s END) / COUNT(*) FILTER (WHERE i = j) AS m FROM {prefix}pop""",
    )
    cte(
        f"{prefix}qq",
        (source,),
        f"""SELECT SUM(q * q) AS qq FROM (SELECT dt, SUM(x * x) AS q FROM
        (SELECT dt, ret - AVG(ret) OVER (PARTITION BY symbol) AS x FROM {source}) GROUP BY dt)""",
    )
    cte(
        f"{prefix}lw",
        (f"{prefix}st", f"{prefix}qq"),
        f"""SELECT m, CASE WHEN delta > 0 THEN LEAST(beta, delta) / delta ELSE 0e0 END AS a FROM
        (SELECT m, (ss - 2 * m * tr + p * m * m) / p AS delta, (qq / t - ss) / (p * t) AS beta FROM {prefix}st, {prefix}qq)""",
    )
    cte(
        f"{prefix}oas",
        (f"{prefix}st",),
        f"""SELECT m, CASE WHEN den = 0 THEN 1e0 ELSE LEAST(1e0, num / den) END AS a FROM
        (SELECT m, ss / (p * p) + m * m AS num, (t + 1) * (ss / (p * p) - m * m / p) AS den FROM {prefix}st)""",
    )


shrink_ctes("", "panel_ret")


def _shrunk(kind: str) -> str:
    value = r("((1 - a) * s + CASE WHEN i = j THEN a * m ELSE 0e0 END) * 252", "cov")
    return with_ctes(["pop", kind], f"SELECT i, j, {value}, {r('a', 'shrinkage')} FROM pop, {kind}")


@query("cov_ledoit_wolf", _shrunk("lw"))
def _(spark, sf):
    return C.cov_ledoit_wolf(panel_rets(spark, sf))


@query("cov_oas", _shrunk("oas"))
def _(spark, sf):
    return C.cov_oas(panel_rets(spark, sf))


cte("gappy_ret", ("panel_ret",), "SELECT * FROM panel_ret WHERE NOT (symbol = 'ASIA' AND EXTRACT(DAY FROM dt) % 3 = 0)")
cte("gappy_full", ("gappy_ret",), "SELECT * FROM gappy_ret WHERE dt IN (SELECT dt FROM gappy_ret GROUP BY dt HAVING COUNT(*) = (SELECT COUNT(DISTINCT symbol) FROM gappy_ret))")
shrink_ctes("g_", "gappy_full")


@query(
    "cov_ledoit_wolf_incomplete",
    with_ctes(["g_pop", "g_lw"], f"SELECT i, j, {r('((1 - a) * s + CASE WHEN i = j THEN a * m ELSE 0e0 END) * 252', 'cov')}, {r('a', 'shrinkage')} FROM g_pop, g_lw"),
)
def _(spark, sf):
    """A panel with missing values: only dates on which every symbol has a return count."""
    return C.cov_ledoit_wolf(panel_rets(spark, sf).filter("not (symbol = 'ASIA' and day(dt) % 3 = 0)"))


@query(
    "portfolio_moments",
    with_ctes(
        ["mu", "cov", "ports"],
        f"""SELECT portfolio_id, {r('er', 'expected_return')}, {r('SQRT(GREATEST(v, 0))', 'expected_volatility')},
        {r('(er - 0.02e0) / GREATEST(SQRT(GREATEST(v, 0)), 1e-8)', 'sharpe_ratio')} FROM
        (SELECT portfolio_id, SUM(w * mu) AS er FROM ports JOIN mu USING (symbol) GROUP BY portfolio_id) JOIN
        (SELECT a.portfolio_id, SUM(a.w * cov * b.w) AS v FROM ports a JOIN cov ON a.symbol = i JOIN ports b ON b.symbol = j AND a.portfolio_id = b.portfolio_id
         GROUP BY a.portfolio_id) USING (portfolio_id)""",
    ),
)
def _(spark, sf):
    ret = panel_rets(spark, sf)
    return C.portfolio_moments(portfolios(spark, sf), M.mean_returns(ret), C.cov_sample(ret))
