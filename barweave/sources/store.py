"""Stored bars: layers of datasets per period and symbol, wide panels and result tables.

Layout: ``root/layer=<raw|processed>/period=<p>/symbol=<s>/part-*``. Layer, period and symbol are
partition columns, so a reader for some symbols of one period opens only their folders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barweave.schemas import BAR_COLUMNS, BAR_SCHEMA

# Layers in order of preference, headers of single-symbol files.
LAYERS = ["processed", "raw"]
FILE_HEADER = ["Date", "Open", "High", "Low", "Close", "Adj Close", "Volume"]

_FILE_ROWS = T.StructType([f for f in BAR_SCHEMA.fields if f.name != "symbol"])
STORED_SCHEMA = T.StructType(
    _FILE_ROWS.fields + [T.StructField(c, T.StringType()) for c in ("layer", "period", "symbol")]
)


def write_bars(bars: DataFrame, root: str, layer: str, period: str, fmt: str = "csv", symbol: str = "symbol") -> None:
    """Replaces the datasets of the given symbols and period in a layer and leaves all others.

    Rows are spread by symbol and year, so a long or hot symbol is written by several tasks.
    """
    if layer not in LAYERS:
        raise ValueError(f"unknown layer {layer!r}")
    rows = bars.select("dt", *BAR_COLUMNS, F.lit(layer).alias("layer"), F.lit(period).alias("period"), F.col(symbol).alias("symbol"))
    out = rows.repartition("symbol", F.year("dt")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if fmt == "csv":
        out = out.option("header", True)
    out.partitionBy("layer", "period", "symbol").format(fmt).save(root)


def stored_bars(spark: SparkSession, root: str, fmt: str = "csv") -> DataFrame:
    """All layers with an explicit schema; nothing is inferred from the files."""
    reader = spark.read.schema(STORED_SCHEMA)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(root)


def read_bars(spark: SparkSession, root: str, symbols: Sequence[str] | None = None, period: str = "5y", fmt: str = "csv",
              start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of one period, each symbol from its best layer. Symbols without data are skipped."""
    rows = stored_bars(spark, root, fmt).filter(F.col("period") == period)
    if symbols is not None:
        rows = rows.filter(F.col("symbol").isin(list(symbols)))
    # the layer is chosen per symbol from partition columns only
    have = rows.select("symbol", "layer").distinct()
    rank = F.array_position(F.array(*[F.lit(x) for x in LAYERS]), F.col("layer"))
    best = have.groupBy("symbol").agg(F.min_by("layer", rank).alias("layer"))
    out = rows.join(best, ["symbol", "layer"], "left_semi")
    if start:
        out = out.filter(F.col("dt") >= F.to_date(F.lit(start)))
    if end:
        out = out.filter(F.col("dt") <= F.to_date(F.lit(end)))
    return out.select("symbol", "dt", *BAR_COLUMNS)


def read_symbol_files(spark: SparkSession, root: str, layer: str = "raw", period: str = "5y") -> DataFrame:
    """Single-symbol CSV files named ``<symbol>_<period>_<layer>.csv`` under ``root/layer``."""
    rows = (
        spark.read.schema(_FILE_ROWS).option("header", True).option("enforceSchema", True)
        .csv(f"{root.rstrip('/')}/{layer}/*_{period}_{layer}.csv")
    )
    name = F.regexp_extract(F.col("_metadata.file_path"), rf"([^/]+)_{period}_{layer}\.csv", 1)
    return rows.select(F.url_decode(name).alias("symbol"), "dt", *BAR_COLUMNS)


def read_many(available: DataFrame, universe: DataFrame, key: str = "symbol") -> tuple[DataFrame, DataFrame]:
    """Bars of the symbols asked for that exist, and the symbols that are missing."""
    return available.join(universe.select(key).distinct(), key, "left_semi"), universe.select(key).distinct().join(
        available.select(key).distinct(), key, "left_anti"
    )


def dataset_inventory(spark: SparkSession, root: str, fmt: str = "csv") -> DataFrame:
    """(layer, period, symbol, files, bytes, rows) of what is stored."""
    per_file = (
        stored_bars(spark, root, fmt)
        .select("layer", "period", "symbol", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_size").alias("_b"))
        .groupBy("layer", "period", "symbol", "_f", "_b")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return per_file.groupBy("layer", "period", "symbol").agg(
        F.count(F.lit(1)).alias("files"), F.sum("_b").alias("bytes"), F.sum("_n").alias("rows")
    )


def write_panel(bars: DataFrame, path: str, symbols: Sequence[str], price: str = "adj_close") -> None:
    """Wide date x symbol prices; the symbols are given, so no pass looks for columns."""
    wide = bars.groupBy("dt").pivot("symbol", list(symbols)).agg(F.first(price, ignorenulls=True))
    wide.write.mode("overwrite").option("header", True).csv(path)


def read_price_panel(spark: SparkSession, path: str, stored: Sequence[str], symbols: Sequence[str]) -> DataFrame:
    """(dt, symbol, price) of the requested symbols the panel has, on dates where all have a price.

    ``stored`` names the panel's columns, in order.
    """
    schema = T.StructType([T.StructField("dt", T.DateType())] + [T.StructField(s, T.DoubleType()) for s in stored])
    wanted = [s for s in symbols if s in set(stored)]
    wide = spark.read.schema(schema).option("header", True).csv(path).select("dt", *[f"`{s}`" for s in wanted])
    return wide.na.drop("any").unpivot("dt", [f"`{s}`" for s in wanted], "symbol", "price")


def write_results(tables: dict[str, DataFrame], root: str, fmt: str = "json") -> None:
    """One folder per result table. CSV tables carry a header."""
    for name, df in tables.items():
        out = df.write.mode("overwrite")
        if fmt == "csv":
            out = out.option("header", True)
        out.format(fmt).save(f"{root.rstrip('/')}/{name}")
