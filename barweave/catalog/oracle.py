"""SQL texts of the shared tables, composed into one statement per checked query."""

from __future__ import annotations

_CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, needs: tuple[str, ...], body: str, recursive_cols: str = "") -> None:
    _CTES[name] = (needs, body)


def with_ctes(needs: tuple[str, ...] | list[str], body: str, **local: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in _CTES[n][0]:
            visit(d)
        order.append(n)

    for n in needs:
        visit(n)
    parts = [f"{n} AS ({_CTES[n][1]})" for n in order] + [f"{n} AS ({b})" for n, b in local.items()]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body if parts else body


def r(expr: str, name: str | None = None, digits: int = 6) -> str:
    """Rounded output column; + 0.0 turns a negative zero into zero."""
    return f"ROUND({expr}, {digits}) + 0.0 AS {name or expr}"


def d(expr: str = "dt", name: str | None = None) -> str:
    return f"CAST(CAST({expr} AS DATE) AS VARCHAR) AS {name or expr.split('.')[-1]}"


def _bars_sql(trades: str) -> dict[str, str]:
    return {
        "daily": f"SELECT symbol, dt, AVG(px) AS m, SUM(qty) AS volume, COUNT(*) AS n FROM {trades} GROUP BY symbol, dt",
        "lvl": """SELECT symbol, dt, volume, n,
          ROUND(AVG(m) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 62 PRECEDING AND CURRENT ROW), 6) AS level,
          ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY dt) AS rn FROM {p}daily""",
        "b": """SELECT symbol, dt, volume, n, level, rn,
          COALESCE(LAG(level) OVER (PARTITION BY symbol ORDER BY dt), level) AS open FROM {p}lvl WHERE rn >= 63""",
        "bars": """SELECT symbol, dt, open,
          ROUND(GREATEST(open, level) * (1e0 + 1e-3 * n / (n + 1)), 6) AS high,
          ROUND(LEAST(open, level) * (1e0 - 1e-3 * n / (n + 1)), 6) AS low,
          level AS close, level AS adj_close, volume, rn - 62 AS rn FROM {p}b""",
    }


def _register_bars(prefix: str, trades: str, final: str) -> None:
    texts = _bars_sql(trades)
    cte(f"{prefix}daily", (trades,), texts["daily"])
    cte(f"{prefix}lvl", (f"{prefix}daily",), texts["lvl"].format(p=prefix))
    cte(f"{prefix}b", (f"{prefix}lvl",), texts["b"].format(p=prefix))
    cte(final, (f"{prefix}b",), texts["bars"].format(p=prefix))


cte(
    "trades",
    (),
    """SELECT r_name AS symbol, CAST(l_shipdate AS DATE) AS dt, l_extendedprice AS px, l_quantity AS qty
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
cte("mkt_trades", ("trades",), "SELECT 'MKT' AS symbol, dt, px, qty FROM trades")
cte(
    "brand_trades",
    (),
    """SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS dt, l_extendedprice AS px, l_quantity AS qty
  FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
_register_bars("", "trades", "bars")
_register_bars("mkt_", "mkt_trades", "mkt")
_register_bars("brand_", "brand_trades", "brand_bars")
cte("ticks", (), "SELECT event_type AS symbol, ts, 100.0e0 + value / 7 AS adj_close FROM events")

cte(
    "dirty",
    ("bars",),
    """SELECT symbol, dt,
  CASE WHEN rn % 223 <> 0 THEN open END AS open,
  CASE WHEN rn % 223 <> 0 THEN (CASE WHEN rn % 137 = 0 THEN -high WHEN rn % 113 = 0 THEN low * 0.5e0 ELSE high END) END AS high,
  CASE WHEN rn % 223 <> 0 THEN (CASE WHEN rn % 101 = 0 THEN -low ELSE low END) END AS low,
  CASE WHEN rn % 223 <> 0 THEN (CASE WHEN rn % 101 = 0 AND rn % 2 = 0 THEN -close ELSE close END) END AS close,
  CASE WHEN rn % 223 <> 0 AND rn > 2 AND rn % 97 <> 0 THEN
    (CASE WHEN rn % 211 = 0 THEN 0e0 WHEN symbol = 'EUROPE' AND rn % 301 = 0 THEN adj_close * 2 ELSE adj_close END) END AS adj_close,
  CASE WHEN rn % 223 <> 0 AND rn % 89 NOT IN (0, 1) THEN volume END AS volume,
  rn, src
  FROM bars, UNNEST(CASE WHEN rn % 127 = 0 THEN [0, 1] ELSE [0] END) AS u(src)
  WHERE NOT (symbol = 'ASIA' AND rn % 3 = 0)""",
)
