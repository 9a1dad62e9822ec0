"""Storage round trips over bars derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from barweave.catalog.oracle import cte, d, r, with_ctes
from barweave.catalog.oracle_grid import REGIONS
from barweave.catalog.q_metrics import PERF
from barweave.catalog.q_quality import BARS_OUT, KEEP, WORLD, cleaned, dirty, universe
from barweave.catalog.q_returns import _lower, _wide, rets
from barweave.catalog.registry import query
from barweave.operators import metrics as M
from barweave.operators import quality as Q
from barweave.session import workspace
from barweave.sources import derived as D
from barweave.sources import store as S

# the raw layer holds de-duplicated faulty bars of every symbol, the processed one clean bars of two
cte(
    "layers",
    ("once", "clean"),
    """SELECT 'raw' AS layer, symbol, dt, open, high, low, close, adj_close, volume FROM once
    UNION ALL SELECT 'processed', symbol, dt, open, high, low, close, adj_close, volume FROM clean WHERE symbol IN ('ASIA', 'EUROPE')""",
)


def store(spark, sf, fmt="csv"):
    root = workspace(spark, "bars")
    raw = Q.dedup_bars(dirty(spark, sf).drop("rn"), first_by="src")
    S.write_bars(raw, root, "raw", "5y", fmt)
    S.write_bars(cleaned(spark, sf).filter(F.col("symbol").isin("ASIA", "EUROPE")), root, "processed", "5y", fmt)
    return root


_best = f"SELECT {BARS_OUT} FROM layers WHERE layer = CASE WHEN symbol IN ('ASIA', 'EUROPE') THEN 'processed' ELSE 'raw' END"


@query("read_bars", with_ctes(["layers"], _best))
def _(spark, sf):
    return S.read_bars(spark, store(spark, sf)).select(*KEEP)


@query("read_bars_parquet", with_ctes(["layers"], _best + " AND symbol <> 'AFRICA' AND dt BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'"))
def _(spark, sf):
    asked = [*[s for s in REGIONS if s != "AFRICA"], "ATLANTIS"]
    return S.read_bars(spark, store(spark, sf, "parquet"), asked, fmt="parquet", start="1995-01-01", end="1996-12-31").select(*KEEP)


@query("write_bars", with_ctes(["layers"], f"SELECT layer, symbol, '5y' AS period, COUNT(*) AS rows, {r('SUM(volume)', 'volume', 2)} FROM layers GROUP BY layer, symbol"), digits=2)
def _(spark, sf):
    root = store(spark, sf, "parquet")
    # a second write of one symbol replaces only that symbol
    S.write_bars(S.read_bars(spark, root, ["ASIA"], fmt="parquet"), root, "processed", "5y", "parquet")
    return S.stored_bars(spark, root, "parquet").groupBy("layer", "symbol", "period").agg(F.count(F.lit(1)).alias("rows"), F.sum("volume").alias("volume"))


@query("dataset_inventory", with_ctes(["layers"], "SELECT layer, '5y' AS period, symbol, COUNT(*) AS rows, TRUE AS has_files FROM layers GROUP BY layer, symbol"))
def _(spark, sf):
    inv = S.dataset_inventory(spark, store(spark, sf))
    return inv.select("layer", "period", "symbol", "rows", ((F.col("files") > 0) & (F.col("bytes") > 0)).alias("has_files"))


@query(
    "read_many_skip_missing",
    with_ctes(["bars"], f"SELECT symbol, COUNT(dt) AS rows, COUNT(dt) = 0 AS missing FROM {WORLD} LEFT JOIN bars USING (symbol) GROUP BY symbol"),
)
def _(spark, sf):
    got, missing = S.read_many(D.bars(spark, sf).select("symbol", "dt"), universe(spark, sf))
    counted = got.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows")).withColumn("missing", F.lit(False))
    return counted.unionByName(missing.select("symbol", F.lit(0).cast("long").alias("rows"), F.lit(True).alias("missing")))


def stored_panel(spark, sf):
    path = workspace(spark, "panel")
    S.write_panel(Q.dedup_bars(dirty(spark, sf), first_by="src"), path, REGIONS)
    return path


@query("write_panel", with_ctes(["once"], _wide(">= 0", "once")))
def _(spark, sf):
    schema = "dt DATE, " + ", ".join(f"`{s}` DOUBLE" for s in REGIONS)
    return _lower(spark.read.schema(schema).option("header", True).csv(stored_panel(spark, sf)))


@query(
    "read_price_panel",
    with_ctes(
        ["once"],
        f"""SELECT {d()}, symbol, {r('adj_close', 'price')} FROM once WHERE symbol IN ('AFRICA', 'ASIA', 'EUROPE') AND adj_close IS NOT NULL
        QUALIFY COUNT(*) OVER (PARTITION BY dt) = 3""",
    ),
)
def _(spark, sf):
    return S.read_price_panel(spark, stored_panel(spark, sf), REGIONS, ["AFRICA", "ASIA", "ATLANTIS", "EUROPE"])


@query("write_results", with_ctes(["met"], f"SELECT symbol, {', '.join(PERF)} FROM met"))
def _(spark, sf):
    root = workspace(spark, "results")
    m = M.performance_metrics(rets(spark, sf))
    S.write_results({"metrics": m}, root, "json")
    return spark.read.schema(m.schema).json(f"{root}/metrics")
