"""SQL of moments, candidate grids and grid winners per window, for any table of training returns
(window_id, symbol, dt, ret) over the five regions."""

from __future__ import annotations

from barweave.catalog.oracle import cte

REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
N = len(REGIONS)
NAMES = [f"'{x}'" for x in REGIONS]
WS = ", ".join(f"w{k}" for k in range(N))
DESC = ", ".join(f"w{k} DESC" for k in range(N))
RET = " + ".join(f"w{k} * m{k}" for k in range(N))
VAR = " + ".join(f"w{x} * w{y} * c{x}{y}" for x in range(N) for y in range(N))
ENT = " + ".join(f"(w{k} + 1e-8) * LN(w{k} + 1e-8)" for k in range(N))
L1 = " + ".join(f"ABS(w{k} - 0.2e0)" for k in range(N))
L2 = " + ".join(f"(w{k} - 0.2e0) * (w{k} - 0.2e0)" for k in range(N))
UNPIVOT = "UNION ALL".join(f" SELECT window_id, {s} AS symbol, w{k} AS w FROM {{src}} " for k, s in enumerate(NAMES))
_LOSS = " + ".join(f"w{k} * r{k}" for k in range(N))

cte(
    "grid",
    (),
    """SELECT a / 10e0 AS w0, b / 10e0 AS w1, c / 10e0 AS w2, e / 10e0 AS w3, (10 - a - b - c - e) / 10e0 AS w4
    FROM range(11) t0(a), range(11) t1(b), range(11) t2(c), range(11) t3(e) WHERE a + b + c + e <= 10""",
)


def capped(cap: float) -> str:
    return f"GREATEST({WS}) <= {cap} + 1e-9"


def mu_cte(p: str, train: str) -> None:
    cte(f"{p}wmu", (train,), f"SELECT window_id, symbol, AVG(ret) * 252 AS mu FROM {train} GROUP BY window_id, symbol")


def sample_cov_cte(p: str, train: str) -> None:
    cte(
        f"{p}wcov",
        (train,),
        f"""SELECT a.window_id, a.symbol AS i, b.symbol AS j, COVAR_SAMP(a.ret, b.ret) * 252 AS cov FROM {train} a JOIN {train} b
        ON a.window_id = b.window_id AND a.dt = b.dt GROUP BY a.window_id, a.symbol, b.symbol""",
    )


def shrunk_cov_cte(p: str, train: str) -> None:
    """Ledoit-Wolf covariance per window."""
    cte(
        f"{p}wpop",
        (train,),
        f"""SELECT a.window_id, a.symbol AS i, b.symbol AS j, COVAR_POP(a.ret, b.ret) AS s, COUNT(*) * 1e0 AS t FROM {train} a JOIN {train} b
        ON a.window_id = b.window_id AND a.dt = b.dt GROUP BY a.window_id, a.symbol, b.symbol""",
    )
    cte(
        f"{p}wqq",
        (train,),
        f"""SELECT window_id, SUM(q * q) AS qq FROM (SELECT window_id, dt, SUM(x * x) AS q FROM
        (SELECT window_id, dt, ret - AVG(ret) OVER (PARTITION BY window_id, symbol) AS x FROM {train}) GROUP BY window_id, dt) GROUP BY window_id""",
    )
    cte(
        f"{p}wlw",
        (f"{p}wpop", f"{p}wqq"),
        f"""SELECT window_id, m, CASE WHEN delta > 0 THEN LEAST(beta, delta) / delta ELSE 0e0 END AS a FROM
        (SELECT window_id, m, (ss - 2 * m * tr + 5 * m * m) / 5 AS delta, (qq / t - ss) / (5 * t) AS beta FROM
          (SELECT window_id, SUM(CASE WHEN i = j THEN s END) AS tr, SUM(CASE WHEN i = j THEN s END) / 5 AS m, SUM(s * s) AS ss, MAX(t) AS t
           FROM {p}wpop GROUP BY window_id) JOIN {p}wqq USING (window_id))""",
    )
    cte(
        f"{p}wcov",
        (f"{p}wpop", f"{p}wlw"),
        f"SELECT window_id, i, j, ((1 - a) * s + CASE WHEN i = j THEN a * m ELSE 0e0 END) * 252 AS cov FROM {p}wpop JOIN {p}wlw USING (window_id)",
    )


def candidate_ctes(p: str, mu: str, delta: float = 2.5) -> None:
    """``{p}prob`` (wide moments), ``{p}cand`` and the same with implied returns, ``{p}cand_bl``."""
    m = ", ".join(f"MAX(CASE WHEN symbol = {s} THEN mu END) AS m{k}" for k, s in enumerate(NAMES))
    c = ", ".join(f"MAX(CASE WHEN i = {a} AND j = {b} THEN cov END) AS c{x}{y}" for x, a in enumerate(NAMES) for y, b in enumerate(NAMES))
    cte(
        f"{p}prob",
        (mu, f"{p}wcov"),
        f"SELECT * FROM (SELECT window_id, {m} FROM {mu} GROUP BY window_id) JOIN (SELECT window_id, {c} FROM {p}wcov GROUP BY window_id) USING (window_id)",
    )
    implied = ", ".join(f"{delta}e0 * 0.2e0 * (" + " + ".join(f"c{x}{y}" for y in range(N)) + f") AS m{x}" for x in range(N))
    c_all = ", ".join(f"c{x}{y}" for x in range(N) for y in range(N))
    cte(f"{p}prob_bl", (f"{p}prob",), f"SELECT window_id, {implied}, {c_all} FROM {p}prob")
    for x in ("", "_bl"):
        cte(f"{p}cand{x}", (f"{p}prob{x}", "grid"), f"SELECT window_id, {WS}, {RET} AS ret, {VAR} AS var FROM {p}prob{x}, grid")


def best_ctes(name: str, source: str, where: str, score: str, mu: str = "wmu") -> None:
    """Grid winner per window in long form; windows without a candidate get equal weights."""
    cte(f"{name}_b", (source,), f"SELECT * FROM {source} WHERE {where} QUALIFY ROW_NUMBER() OVER (PARTITION BY window_id ORDER BY ROUND({score}, 12) DESC, {DESC}) = 1")
    cte(
        name,
        (f"{name}_b", mu),
        f"""SELECT m.window_id, m.symbol, COALESCE(b.w, 0.2e0) AS w, CASE WHEN b.w IS NULL THEN 'infeasible' ELSE 'optimal' END AS status
        FROM {mu} m LEFT JOIN ({UNPIVOT.format(src=f'{name}_b')}) b ON m.window_id = b.window_id AND m.symbol = b.symbol""",
    )


def cvar_ctes(name: str, train: str, level: float, cap: float, mu: str = "wmu") -> None:
    """Least CVaR: losses of every candidate over the training days of its window."""
    days = ", ".join(f"MAX(CASE WHEN symbol = {s} THEN ret END) AS r{k}" for k, s in enumerate(NAMES))
    cte(f"{name}_scen", (train,), f"SELECT window_id, dt, {days} FROM {train} GROUP BY window_id, dt")
    cte(
        f"cand_{name}",
        (f"{name}_scen", "grid"),
        f"""SELECT window_id, {WS}, t + SUM(GREATEST(loss - t, 0)) / ((1 - {level}e0) * COUNT(*)) AS cvar FROM
        (SELECT *, QUANTILE_DISC(loss, {level}) OVER (PARTITION BY window_id, {WS}) AS t FROM (SELECT window_id, {WS}, -({_LOSS}) AS loss FROM {name}_scen, grid WHERE {capped(cap)}))
        GROUP BY window_id, {WS}, t""",
    )
    best_ctes(name, f"cand_{name}", "TRUE", "-cvar", mu)


def inverse_vol_cte(name: str, train: str) -> None:
    cte(
        name,
        (train,),
        f"""SELECT window_id, symbol, inv / SUM(inv) OVER (PARTITION BY window_id) AS w FROM
        (SELECT window_id, symbol, 1 / (STDDEV_SAMP(ret) * SQRT(252e0) + 1e-8) AS inv FROM {train} GROUP BY window_id, symbol)""",
    )


def cap_once(src: str, cap: float) -> str:
    return f"SELECT window_id, symbol, LEAST(w, {cap}) / SUM(LEAST(w, {cap})) OVER (PARTITION BY window_id) AS w FROM {src}"


def exchange_cte(name: str, prob: str, seek: float, cap: float) -> None:
    """Best weights (window_id, w) for seek * mu'w - w'Sigma w / 2 within a cap, for problems (window_id, symbols, mu,
    cov) of any size: weight moves between the pair that gains most until no pair gains 1e-10."""
    cte(
        f"{name}_run",
        (prob,),
        f"""SELECT window_id, 0 AS k, mu, cov, list_transform(mu, lambda x: 1e0 / len(mu)) AS w,
        list_transform(range(len(mu)), lambda i: list_sum(cov[i * len(mu) + 1:(i + 1) * len(mu)]) / len(mu)) AS g FROM {prob}
        UNION ALL
        SELECT window_id, k + 1, mu, cov, list_transform(w, lambda x, q: x + CASE q WHEN i THEN d WHEN j THEN -d ELSE 0e0 END),
          list_transform(g, lambda x, q: x + d * (cov[(q - 1) * n + i] - cov[(q - 1) * n + j])) FROM
        (SELECT *, LEAST({cap}e0 - w[i], w[j], pull / (cov[(i - 1) * n + i] + cov[(j - 1) * n + j] - 2 * cov[(i - 1) * n + j])) AS d FROM
        (SELECT *, list_position(up, list_max(up)) AS i, list_position(dn, list_min(dn)) AS j, list_max(up) - list_min(dn) AS pull FROM
        (SELECT *, len(mu) AS n, list_transform(w, lambda x, q: CASE WHEN x < {cap}e0 - 1e-12 THEN {seek}e0 * mu[q] - g[q] ELSE -1e300 END) AS up,
          list_transform(w, lambda x, q: CASE WHEN x > 0 THEN {seek}e0 * mu[q] - g[q] ELSE 1e300 END) AS dn FROM {name}_run)) WHERE pull > 1e-10) WHERE k < 20000""",
    )
    cte(name, (f"{name}_run",), f"SELECT window_id, arg_max(w, k) AS w FROM {name}_run GROUP BY window_id")
