"""Work on unbounded series equals a plain pass, also when one key holds almost everything."""

import numpy as np
import pandas as pd
import pytest

from barweave.operators import quality as Q
from barweave.operators import returns as R
from barweave.operators.features import add_features
from barweave.operators.series import row_index


@pytest.fixture(scope="module")
def ticks(spark):
    rng = np.random.default_rng(3)
    n = 900
    # one hour of one symbol holds most rows
    hot = pd.DataFrame({"symbol": "hot", "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), unit="s")})
    rare = pd.DataFrame({"symbol": "rare", "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(40) * 7, unit="h")})
    pdf = pd.concat([hot, rare], ignore_index=True)
    pdf["adj_close"] = 100 + rng.normal(size=len(pdf)).cumsum() * 0.01
    return pdf, spark.createDataFrame(pdf.sample(frac=1, random_state=1)).repartition(3)


def test_row_index(ticks):
    pdf, df = ticks
    got = row_index(df, ["symbol"], "ts").toPandas().sort_values(["symbol", "ts"])
    want = pdf.sort_values(["symbol", "ts"]).groupby("symbol").cumcount() + 1
    assert got["rn"].tolist() == want.tolist()


def test_returns_and_curves(ticks):
    pdf, df = ticks
    ret = R.simple_returns(df, order="ts")
    want = pdf.sort_values(["symbol", "ts"]).copy()
    want["ret"] = want.groupby("symbol")["adj_close"].pct_change()
    want = want.dropna()
    got = ret.toPandas().sort_values(["symbol", "ts"])
    assert np.allclose(got["ret"], want["ret"])
    curve = R.drawdown_curve(ret, order="ts", slice_rows=64).toPandas().sort_values(["symbol", "ts"])
    equity = want.groupby("symbol")["ret"].transform(lambda r: (1 + r).cumprod())
    peak = equity.groupby(want["symbol"]).cummax()
    assert np.allclose(curve["equity"], equity) and np.allclose(curve["drawdown"], equity / peak - 1)


def test_features_slices(ticks, spark):
    pdf, df = ticks
    wide = df.selectExpr("symbol", "ts", "adj_close", "adj_close as high", "adj_close as low", "1.0D as volume")
    got = add_features(wide, order="ts", only=["momentum_1m", "ma_63"]).toPandas().sort_values(["symbol", "ts"])
    g = pdf.sort_values(["symbol", "ts"]).groupby("symbol")["adj_close"]
    assert np.allclose(got["momentum_1m"], g.pct_change(21), equal_nan=True)
    assert np.allclose(got["ma_63"], g.transform(lambda x: x.rolling(63).mean()), equal_nan=True)


def test_fill_unbounded(ticks, spark):
    pdf, _ = ticks
    holes = pdf.copy()
    holes.loc[holes.index % 5 < 2, "adj_close"] = np.nan
    rows = [(s, t.to_pydatetime(), None if np.isnan(v) else float(v)) for s, t, v in holes.itertuples(index=False)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, adj_close double")
    got = Q.fill_forward_backward(df, order="ts", cols=["adj_close"]).toPandas().sort_values(["symbol", "ts"])
    want = holes.sort_values(["symbol", "ts"]).groupby("symbol")["adj_close"].transform(lambda x: x.ffill().bfill())
    assert np.allclose(got["adj_close"], want)


def test_fill_over_many_slices_and_partitions(spark):
    """The value carried between slices does not depend on the order in which their rows meet."""
    from barweave.operators.series import running
    from pyspark.sql import functions as F

    n = 4000
    rows = [("k", i, None if i % 7 < 4 else float(i), None if i % 300 else float(i)) for i in range(n)]
    df = spark.createDataFrame(rows, "symbol string, tick long, a double, b double").repartition(40)
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for size in (130, 300):
            out = running(df, ["symbol"], "tick", {"x": F.col("a"), "y": F.col("b")}, lambda v: F.last(v, ignorenulls=True), lambda b, h: F.coalesce(h, b), slice_rows=size)
            got = out.toPandas().sort_values("tick")
            want = pd.DataFrame(rows, columns=["s", "t", "a", "b"])[["a", "b"]].ffill()
            assert np.allclose(got["x"], want["a"], equal_nan=True) and np.allclose(got["y"], want["b"])
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_asof_last(spark):
    from datetime import date

    left = spark.createDataFrame([(1, date(2024, 1, 1)), (2, date(2024, 3, 5)), (3, date(2024, 3, 5)), (4, date(2025, 1, 1))], "id int, dt date")
    right = spark.createDataFrame([(date(2024, 1, 20), "a"), (date(2024, 3, 5), "b"), (date(2024, 3, 6), "c")], "dt date, v string")
    got = {r["id"]: r["v"] for r in R.asof_last(left, right, "dt", "v", default="none").collect()}
    assert got == {1: "none", 2: "b", 3: "b", 4: "c"}
