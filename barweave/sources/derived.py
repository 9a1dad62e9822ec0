"""Bars derived from the order-line and event tables.

A symbol is the region of the supplier (or a part brand); its price level is the 63-row mean of
the daily mean line price, so that daily moves have the size of market returns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barweave.schemas import BAR_COLUMNS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def region_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The four-way join is left to the optimizer: it broadcasts a side only below
    # spark.sql.autoBroadcastJoinThreshold and splits hot supplier keys (AQE) otherwise.
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    homes = (
        supp.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", F.col("r_name").alias("symbol"))
    )
    return line.join(homes, F.col("l_suppkey") == F.col("s_suppkey")).select(
        "symbol",
        F.to_date("l_shipdate").alias("dt"),
        F.col("l_extendedprice").alias("px"),
        F.col("l_quantity").alias("qty"),
    )


def brand_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        "symbol",
        F.to_date("l_shipdate").alias("dt"),
        F.col("l_extendedprice").alias("px"),
        F.col("l_quantity").alias("qty"),
    )


def bars_from_trades(trades: DataFrame, level_rows: int = 63) -> DataFrame:
    """Daily bars of (symbol, dt, px, qty) trades; the warm-up rows of the level are dropped."""
    daily = trades.groupBy("symbol", "dt").agg(
        F.avg("px").alias("m"), F.sum("qty").alias("volume"), F.count(F.lit(1)).alias("n")
    )
    o = Window.partitionBy("symbol").orderBy("dt")
    level = daily.select(
        "symbol",
        "dt",
        "volume",
        "n",
        F.round(F.avg("m").over(o.rowsBetween(-(level_rows - 1), 0)), 6).alias("level"),
        F.row_number().over(o).cast("long").alias("_rn"),
    ).filter(F.col("_rn") >= level_rows)
    opened = level.withColumn("open", F.coalesce(F.lag("level").over(o), F.col("level")))
    spread: Column = F.lit(1e-3) * F.col("n") / (F.col("n") + 1)
    return opened.select(
        "symbol",
        "dt",
        "open",
        F.round(F.greatest("open", "level") * (1.0 + spread), 6).alias("high"),
        F.round(F.least("open", "level") * (1.0 - spread), 6).alias("low"),
        F.col("level").alias("close"),
        F.col("level").alias("adj_close"),
        "volume",
        (F.col("_rn") - (level_rows - 1)).alias("rn"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_trades(region_trades(spark, sf_dir))


def brand_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_trades(brand_trades(spark, sf_dir))


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All regions pooled into one benchmark series."""
    return bars_from_trades(region_trades(spark, sf_dir).withColumn("symbol", F.lit("MKT")))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values as an unbounded tick series per event type."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), "ts", (F.lit(100.0) + F.col("value") / 7).alias("adj_close")
    )


def faulty(bars: DataFrame) -> DataFrame:
    """Bars with faults placed by row number, and a column ``src`` that tells copies apart."""
    rn = F.col("rn")

    def every(k: int) -> Column:
        return rn % k == 0

    void = every(223)
    low = F.when(every(101), -F.col("low")).otherwise(F.col("low"))
    close = F.when(every(101) & every(2), -F.col("close")).otherwise(F.col("close"))
    high = (
        F.when(every(137), -F.col("high")).when(every(113), F.col("low") * 0.5).otherwise(F.col("high"))
    )
    adj = (
        F.when((rn <= 2) | every(97), F.lit(None))
        .when(every(211), F.lit(0.0))
        .when((F.col("symbol") == "EUROPE") & every(301), F.col("adj_close") * 2)
        .otherwise(F.col("adj_close"))
    )
    volume = F.when((rn % 89).isin(0, 1), F.lit(None)).otherwise(F.col("volume"))
    faults = {"open": F.col("open"), "high": high, "low": low, "close": close, "adj_close": adj, "volume": volume}
    copies = F.when(every(127), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        bars.filter(~((F.col("symbol") == "ASIA") & every(3)))
        .select(
            "symbol",
            "dt",
            *[F.when(~void, faults[c]).alias(c) for c in BAR_COLUMNS],
            "rn",
            F.explode(copies).alias("src"),
        )
    )
