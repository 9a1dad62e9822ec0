import math

from pyspark.sql import functions as F

from barweave.operators import metrics as M
from barweave.operators import returns as R


def test_known_series(series):
    m = M.comprehensive_metrics(series).first()
    expected = {
        "total_return": 0.014668, "annual_return": 0.843352, "annual_volatility": 0.205451, "sharpe_ratio": 4.007541,
        "max_drawdown": -0.02, "sortino_ratio": 4.890003, "calmar_ratio": 42.167613, "win_rate": 0.666667,
    }
    for k, v in expected.items():
        assert math.isclose(m[k], v, abs_tol=2e-6), k


def test_beta_mixes_degrees_of_freedom(series):
    bench = series.select("dt", (0.8 * F.col("ret")).alias("bench_ret"))
    m = M.relative_metrics(series, bench).first()
    assert math.isclose(m["beta"], 1.5, rel_tol=1e-9)
    assert math.isclose(m["information_ratio"], 3.066429, abs_tol=2e-6)


def test_no_losses_gives_sharpe_and_one_loss_gives_zero(series):
    up = series.withColumn("ret", F.abs("ret"))
    m = M.comprehensive_metrics(up).first()
    assert m["sortino_ratio"] == m["sharpe_ratio"]
    one = series.filter("ret > -0.01")
    assert M.comprehensive_metrics(one).first()["sortino_ratio"] == 0.0


def test_fewer_than_two_shared_dates_give_no_relative_metrics(series):
    bench = series.limit(1).select("dt", F.col("ret").alias("bench_ret"))
    assert M.relative_metrics(series, bench).count() == 0


def test_curves(series):
    rows = R.drawdown_curve(series).orderBy("dt").collect()
    assert rows[0]["drawdown"] == 0.0
    assert all(r["drawdown"] <= 0 for r in rows)
    assert math.isclose(rows[-1]["equity"], 1.014668, abs_tol=1e-6)


def test_input_order_does_not_matter(series):
    a = M.comprehensive_metrics(series).first()
    b = M.comprehensive_metrics(series.orderBy(F.desc("ret"))).first()
    assert all(math.isclose(a[c], b[c], rel_tol=1e-9) for c in a.asDict() if c != "symbol")


def test_excess_returns_align_on_date(spark, series):
    both = series.withColumnRenamed("symbol", "strategy").unionByName(
        series.filter("ret > 0").select(F.lit("y").alias("strategy"), "dt", (F.col("ret") / 2).alias("ret"))
    )
    out = M.excess_returns(both, "x", "y").collect()
    assert len(out) == 4 and all(r["ret"] > 0 for r in out)


def test_worst_fall_of_pieces_equals_the_curve(spark):
    """One key holds most rows; ranges, batches and keys are cut anywhere."""
    import numpy as np
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    rows = [(k, t, float(r)) for k, n in (("hot", 5000), ("b", 40), ("c", 1)) for t, r in enumerate(rng.normal(0, 0.02, n))] + [(None, 1, -0.5), (None, 2, 0.1), (None, 3, -0.5)]
    df = spark.createDataFrame(rows + [("b", 99, None), ("none", 1, None)], "symbol string, ts long, ret double").repartition(7)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {r.symbol: r.max_drawdown for r in M.max_drawdown(df, order="ts").collect()}
        for key in (None, "hot", "b", "c"):
            level = np.cumprod([1 + r for k, _, r in rows if k == key])
            assert abs(got[key] - (level / np.maximum.accumulate(level) - 1).min()) < 1e-12
        assert set(got) == {None, "hot", "b", "c"}
        whole = M.max_drawdown(df.filter("symbol = 'hot'"), (), order="ts").first()
        assert abs(whole.max_drawdown - got["hot"]) < 1e-12 and M.max_drawdown(df.limit(0), order="ts").count() == 0
        both = {r.symbol: r.max_drawdown for r in M.comprehensive_metrics(df.filter("symbol is not null"), order="ts").collect()}
        assert abs(both["hot"] - got["hot"]) < 1e-12 and both["none"] is None
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
