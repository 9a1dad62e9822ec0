from datetime import date, timedelta

from pyspark.sql import functions as F

from barweave.operators import quality as Q
from barweave.plans.processing import process_bars

COLS = "symbol string, dt date, open double, high double, low double, close double, adj_close double, volume double"


def bars(spark, rows):
    return spark.createDataFrame([(s, date(2024, 1, 1) + timedelta(k), *v) for s, k, v in rows], COLS)


def test_negative_low_takes_close_then_open(spark):
    df = bars(spark, [("a", 0, (10.0, 12.0, -1.0, 11.0, 11.0, 1.0)), ("a", 1, (10.0, 12.0, -1.0, -11.0, 11.0, 1.0)), ("a", 2, (10.0, 12.0, 9.0, 11.0, 11.0, 1.0))])
    low = [r["low"] for r in Q.fix_negative_low(df).orderBy("dt").collect()]
    assert low == [11.0, 10.0, 9.0]


def test_clean_fills_forward_then_backward_and_drops_empty(spark):
    n = None
    df = bars(spark, [("a", 0, (n, n, n, n, n, n)), ("a", 1, (1.0, 2.0, 0.5, 1.0, 1.0, 5.0)), ("a", 2, (2.0, n, 1.5, 2.0, n, n)), ("b", 0, (n, n, n, n, n, n))])
    out = Q.clean_bars(df).orderBy("symbol", "dt").collect()
    assert [(r["symbol"], r["high"], r["volume"]) for r in out] == [("a", 2.0, 5.0)] * 3


def test_copies_collapse_whatever_their_number(spark):
    one = bars(spark, [("a", 0, (1.0, 2.0, 0.5, 1.0, 1.0, 5.0))])
    many = one.crossJoin(spark.range(500)).drop("id")
    assert Q.dedup_bars(many).collect() == one.collect()


def test_reports(spark):
    df = bars(spark, [("good", k, (10.0, 12.0, 9.0, 11.0, 11.0, 1.0)) for k in range(10)] + [("bad", k, (10.0, 8.0, 9.0, 11.0, 0.0, 1.0)) for k in range(10)])
    universe = spark.createDataFrame([("good",), ("bad",), ("none",)], "symbol string")
    out = process_bars(df, "minmax", universe=universe)
    got = {r["symbol"]: (r["success"], list(r["issues"])) for r in out.outcome.collect()}
    assert got["good"] == (True, []) and not got["bad"][0] and got["none"] == (False, [Q.NO_DATA])
    assert {r["symbol"] for r in out.data.collect()} == {"good"}
    q = out.quality.first()
    assert 0 <= q["quality_metrics"]["completeness"] <= 1


def test_weekdays_by_arithmetic_equal_counting(spark):
    days = spark.range(60).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("a"))
    pairs = days.crossJoin(days.withColumnRenamed("a", "b")).filter("a <= b")
    listed = F.size(F.filter(F.sequence("a", "b"), lambda d: F.weekday(d) < 5))
    assert pairs.filter(Q.weekday_count(F.col("a"), F.col("b")) != listed).count() == 0


def test_normalisers(spark):
    df = bars(spark, [("a", k, (1.0 + k, 2.0, 0.5, 1.0 + k, 1.0 + k, 5.0)) for k in range(5)])
    z = Q.normalize_zscore(df).agg(F.avg("open"), F.stddev_samp("open"), F.min("high")).first()
    assert abs(z[0]) < 1e-12 and abs(z[1] - 1) < 1e-12 and z[2] == 2.0
    m = Q.normalize_minmax(df).agg(F.min("open"), F.max("open")).first()
    assert (m[0], m[1]) == (0.0, 1.0)


def test_copies_with_a_source_are_hashed_without_a_sort(spark):
    df = bars(spark, [("a", 0, (1.0, 2.0, 0.5, 1.0, 1.0, 5.0)), ("a", 0, (None, 3.0, 0.5, 1.0, 1.0, 6.0))]).withColumn("src", F.monotonically_increasing_id())
    first = df.withColumn("src", F.when(F.col("volume") == 6, 0).otherwise(1))
    out = Q.dedup_bars(first, first_by="src")
    assert [(r["open"], r["high"], r["volume"]) for r in out.collect()] == [(None, 3.0, 6.0)]
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
