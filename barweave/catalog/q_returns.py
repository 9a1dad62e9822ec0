"""Returns, curves, filters, panels and alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from barweave.catalog.oracle import cte, d, r, with_ctes
from barweave.catalog.q_quality import WORLD, dirty, universe
from barweave.catalog.registry import query
from barweave.operators import quality as Q
from barweave.operators import returns as R
from barweave.operators.quality import fill_forward_backward
from barweave.sources import derived as D

W = "(PARTITION BY symbol ORDER BY dt)"
cte("ret", ("bars",), f"SELECT * FROM (SELECT symbol, dt, adj_close / NULLIF(LAG(adj_close) OVER {W}, 0) - 1 AS ret FROM bars) WHERE ret IS NOT NULL")
cte("mkt_ret", ("mkt",), f"SELECT * FROM (SELECT dt, adj_close / NULLIF(LAG(adj_close) OVER {W}, 0) - 1 AS bench_ret FROM mkt) WHERE bench_ret IS NOT NULL")
cte("brand_ret", ("brand_bars",), f"SELECT * FROM (SELECT symbol, dt, adj_close / NULLIF(LAG(adj_close) OVER {W}, 0) - 1 AS ret FROM brand_bars) WHERE ret IS NOT NULL")
TW = "(PARTITION BY symbol ORDER BY ts)"
cte("tick_ret", ("ticks",), f"SELECT * FROM (SELECT symbol, ts, adj_close / NULLIF(LAG(adj_close) OVER {TW}, 0) - 1 AS ret FROM ticks) WHERE ret IS NOT NULL")
CUM = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def rets(spark, sf):
    return R.simple_returns(D.bars(spark, sf)).select("symbol", "dt", "ret")


def bench(spark, sf):
    return R.simple_returns(D.market(spark, sf)).select("dt", F.col("ret").alias("bench_ret"))


@query("simple_returns", with_ctes(["ret"], f"SELECT symbol, {d()}, {r('ret')} FROM ret"))
def _(spark, sf):
    return rets(spark, sf)


@query("simple_returns_ticks", with_ctes(["tick_ret"], f"SELECT symbol, CAST(ts AS VARCHAR) AS ts, {r('ret')} FROM tick_ret"))
def _(spark, sf):
    return R.simple_returns(D.ticks(spark, sf), order="ts").select("symbol", "ts", "ret")


@query(
    "log_returns",
    with_ctes(["bars"], f"SELECT symbol, {d()}, {r('log_ret')} FROM (SELECT symbol, dt, LN(adj_close / LAG(adj_close) OVER {W}) AS log_ret FROM bars) WHERE log_ret IS NOT NULL"),
)
def _(spark, sf):
    return R.log_returns(D.bars(spark, sf)).select("symbol", "dt", "log_ret")


cte("equity", ("ret",), f"SELECT symbol, dt, ret, PRODUCT(1 + ret) OVER (PARTITION BY symbol ORDER BY dt {CUM}) AS equity FROM ret")
cte("drawdowns", ("equity",), f"SELECT *, equity / MAX(equity) OVER (PARTITION BY symbol ORDER BY dt {CUM}) - 1 AS drawdown FROM equity")


@query("equity_curve", with_ctes(["equity"], f"SELECT symbol, {d()}, {r('equity')} FROM equity"))
def _(spark, sf):
    return R.equity_curve(rets(spark, sf)).select("symbol", "dt", "equity")


@query("drawdown_curve", with_ctes(["drawdowns"], f"SELECT symbol, {d()}, {r('drawdown')} FROM drawdowns"))
def _(spark, sf):
    return R.drawdown_curve(rets(spark, sf)).select("symbol", "dt", "drawdown")


@query(
    "equity_curve_ticks",
    with_ctes(["tick_ret"], f"SELECT symbol, CAST(ts AS VARCHAR) AS ts, {r(f'PRODUCT(1 + ret / 1000) OVER (PARTITION BY symbol ORDER BY ts {CUM})', 'equity')} FROM tick_ret"),
)
def _(spark, sf):
    # ticks have no calendar bound: numbered in two levels, cut into slices, slice products carried over
    ret = R.simple_returns(D.ticks(spark, sf), order="ts").withColumn("ret", F.col("ret") / 1000)
    return R.equity_curve(ret, order="ts", slice_rows=512).select("symbol", "ts", "equity")


@query(
    "drawdown_curve_ticks",
    with_ctes(
        ["tick_ret"],
        f"""SELECT symbol, CAST(ts AS VARCHAR) AS ts, {r(f'equity / MAX(equity) OVER (PARTITION BY symbol ORDER BY ts {CUM}) - 1', 'drawdown')}
        FROM (SELECT *, PRODUCT(1 + ret / 1000) OVER (PARTITION BY symbol ORDER BY ts {CUM}) AS equity FROM tick_ret)""",
    ),
)
def _(spark, sf):
    ret = R.simple_returns(D.ticks(spark, sf), order="ts").withColumn("ret", F.col("ret") / 1000)
    return R.drawdown_curve(ret, order="ts", slice_rows=512).select("symbol", "ts", "drawdown")


# ---- filters and panels ---------------------------------------------------------------------

BARS = f"symbol, {d()}, {r('adj_close')}"


@query("date_range_filter", with_ctes(["bars"], f"SELECT {BARS} FROM bars WHERE dt BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'"))
def _(spark, sf):
    return R.date_range_filter(D.bars(spark, sf), "1996-01-01", "1997-12-31").select("symbol", "dt", "adj_close")


@query(
    "complete_dates_only",
    with_ctes(["dirty"], f"""SELECT {BARS} FROM dirty WHERE src = 0 AND adj_close IS NOT NULL AND dt IN
      (SELECT dt FROM dirty WHERE adj_close IS NOT NULL GROUP BY dt HAVING COUNT(DISTINCT symbol) = 5)"""),
)
def _(spark, sf):
    return R.complete_dates_only(Q.dedup_bars(dirty(spark, sf), first_by="src")).select("symbol", "dt", "adj_close")


@query("drop_all_null_dates", with_ctes(["dirty"], f"SELECT DISTINCT {d()} FROM dirty WHERE adj_close IS NOT NULL"))
def _(spark, sf):
    return R.drop_all_null_dates(dirty(spark, sf)).select("dt").distinct()


@query(
    "lookback_filter",
    with_ctes(
        ["bars"],
        " UNION ALL ".join(
            f"SELECT '{p}' AS period, {BARS} FROM bars WHERE dt > (SELECT MAX(dt) FROM bars) - INTERVAL {i}"
            for p, i in (("5y", "5 YEAR"), ("1mo", "1 MONTH"), ("30d", "30 DAY"))
        ),
    ),
)
def _(spark, sf):
    bars = D.bars(spark, sf).select("symbol", "dt", "adj_close")
    parts = [R.lookback_filter(bars, p).select(F.lit(p).alias("period"), "*") for p in ("5y", "1mo", "30d")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


cte("cal", ("bars",), "SELECT DISTINCT dt FROM bars")
cte(
    "panel",
    ("bars", "cal"),
    f"""SELECT symbol, dt, price FROM (SELECT n.symbol, c.dt, n.adj_close AS price FROM
      (SELECT symbol, dt, adj_close, LEAD(dt) OVER {W} AS nd FROM bars) n JOIN cal c ON c.dt >= n.dt AND (n.nd IS NULL OR c.dt < n.nd))
      QUALIFY COUNT(*) OVER (PARTITION BY dt) = (SELECT COUNT(DISTINCT symbol) FROM bars)""",
)
cte("panel_ret", ("panel",), f"SELECT * FROM (SELECT symbol, dt, price / LAG(price) OVER {W} - 1 AS ret FROM panel) WHERE ret IS NOT NULL")


def panel(spark, sf):
    return R.filled_panel(D.bars(spark, sf))


def panel_rets(spark, sf):
    return R.simple_returns(panel(spark, sf), price="price").select("symbol", "dt", "ret")


@query("filled_panel", with_ctes(["panel"], f"SELECT symbol, {d()}, {r('price')} FROM panel"))
def _(spark, sf):
    return panel(spark, sf)


REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def _wide(where: str, source: str) -> str:
    picks = ", ".join(r(f"MAX(CASE WHEN symbol = '{s}' THEN adj_close END)", '"' + s.lower().replace(" ", "_") + '"') for s in REGIONS)
    nulls = " + ".join(f"COUNT(CASE WHEN symbol = '{s}' THEN adj_close END)" for s in REGIONS)
    return f"SELECT {d()}, {picks} FROM {source} GROUP BY dt HAVING {nulls} {where}"


def _lower(df):
    return df.select(*[F.col(f"`{c}`").alias(c.lower().replace(" ", "_")) for c in df.columns])


@query("rebuild_panel", with_ctes(["once"], _wide("= 5", "once")))
def _(spark, sf):
    once = Q.dedup_bars(dirty(spark, sf), first_by="src")
    return _lower(R.rebuild_panel(once, REGIONS, how="any"))


@query("rebuild_panel_outer", with_ctes(["once"], _wide("> 0", "once")))
def _(spark, sf):
    once = Q.dedup_bars(dirty(spark, sf), first_by="src")
    return _lower(R.rebuild_panel(once, REGIONS, how="all"))


# ---- alignment ------------------------------------------------------------------------------


@query("align_inner", with_ctes(["ret", "mkt_ret"], f"SELECT symbol, {d()}, {r('ret')}, {r('bench_ret')} FROM ret JOIN mkt_ret USING (dt)"))
def _(spark, sf):
    return R.align_inner(rets(spark, sf), bench(spark, sf))


@query("align_left_benchmark", with_ctes(["bars", "mkt_ret"], f"SELECT {BARS}, {r('bench_ret')} FROM bars LEFT JOIN mkt_ret USING (dt)"))
def _(spark, sf):
    return R.align_left_benchmark(D.bars(spark, sf).select("symbol", "dt", "adj_close"), bench(spark, sf))


@query(
    "align_outer",
    with_ctes(
        ["dirty"],
        f"""SELECT {d()}, {r('asia')}, {r('europe')} FROM (SELECT dt, adj_close AS asia FROM dirty WHERE symbol = 'ASIA' AND src = 0)
        FULL JOIN (SELECT dt, adj_close AS europe FROM dirty WHERE symbol = 'EUROPE' AND src = 0) USING (dt)""",
    ),
)
def _(spark, sf):
    once = Q.dedup_bars(dirty(spark, sf), first_by="src")
    one = lambda s: once.filter(F.col("symbol") == s.upper()).select("dt", F.col("adj_close").alias(s))
    return R.align_outer(one("asia"), one("europe"))


@query("missing_symbols", f"SELECT symbol FROM {WORLD} WHERE symbol NOT IN (SELECT r_name FROM region)")
def _(spark, sf):
    return universe(spark, sf).join(D.bars(spark, sf).select("symbol").distinct(), "symbol", "left_anti")


@query("available_symbols", "SELECT r_name AS symbol FROM region")
def _(spark, sf):
    return universe(spark, sf).join(D.bars(spark, sf).select("symbol").distinct(), "symbol", "left_semi")


@query(
    "union_universe",
    f"SELECT symbol, COUNT(*) AS n, COUNT(*) > 1 AS duplicate FROM (SELECT symbol FROM {WORLD} UNION ALL SELECT 'MKT' UNION ALL SELECT r_name FROM region WHERE r_name = 'ASIA') GROUP BY symbol",
)
def _(spark, sf):
    core = universe(spark, sf)
    marks = D.market(spark, sf).select("symbol").distinct().unionByName(core.filter(F.col("symbol") == "ASIA"))
    return core.unionByName(marks).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) > 1).alias("duplicate"))


@query(
    "latest_row",
    with_ctes(["bars"], f"SELECT symbol, {d()}, {r('adj_close')}, {r('volume')} FROM bars QUALIFY ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY dt DESC) = 1"),
)
def _(spark, sf):
    return R.latest_row(D.bars(spark, sf)).select("symbol", "dt", "adj_close", "volume")


cte("holed", ("ticks",), "SELECT symbol, ts, CASE WHEN CAST(FLOOR(adj_close * 100) AS BIGINT) % 5 >= 2 THEN adj_close END AS adj_close FROM ticks")


@query(
    "fill_ticks",
    with_ctes(
        ["holed"],
        f"""SELECT symbol, CAST(ts AS VARCHAR) AS ts, {r('COALESCE(LAST_VALUE(adj_close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), FIRST_VALUE(adj_close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))', 'adj_close')}
        FROM holed""",
    ),
)
def _(spark, sf):
    """Holes in ticks filled forward, then backward, over many slices."""
    keep = F.floor(F.col("adj_close") * 100) % 5 >= 2
    holed = D.ticks(spark, sf).withColumn("adj_close", F.when(keep, F.col("adj_close")))
    return fill_forward_backward(holed, order="ts", cols=["adj_close"], slice_rows=256)
