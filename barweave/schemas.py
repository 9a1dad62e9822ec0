"""Column contracts. Key of bars: (symbol, dt)."""

from pyspark.sql import types as T

PRICE_COLUMNS = ["open", "high", "low", "close", "adj_close"]
BAR_COLUMNS = PRICE_COLUMNS + ["volume"]

BAR_SCHEMA = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("dt", T.DateType())]
    + [T.StructField(c, T.DoubleType()) for c in BAR_COLUMNS]
)

TRADING_DAYS = 252
RISK_FREE = 0.02
