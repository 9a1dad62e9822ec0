from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest

from barweave.operators import covariance as C


def long(spark, x, names=None, group=None):
    names = names or [f"a{k}" for k in range(x.shape[1])]
    rows = [
        (date(2024, 1, 1) + timedelta(t), n, float(x[t, k]))
        for t in range(x.shape[0]) for k, n in enumerate(names) if not np.isnan(x[t, k])
    ]
    return spark.createDataFrame(rows, "dt date, symbol string, ret double")


def matrix(df, col, n):
    got = {(r["i"], r["j"]): r[col] for r in df.collect()}
    return np.array([[got[(f"a{i}", f"a{j}")] for j in range(n)] for i in range(n)])


X4 = np.array([[1, 2], [-1, 0], [2, -1], [-2, -1]], float)
T = np.arange(13)
X1 = ((7 * T) % 13) - 6
X13 = np.column_stack([X1, 2 * X1 + 0.5 * (((5 * T) % 13) - 6)]).astype(float)


@pytest.mark.parametrize("fn", [C.cov_ledoit_wolf, C.cov_oas])
def test_saturated_shrinkage_is_identity(spark, fn):
    assert np.allclose(matrix(fn(long(spark, X4), days=1), "cov", 2), 2 * np.eye(2))


def test_partial_shrinkage(spark):
    df = long(spark, X13)
    assert np.allclose(matrix(C.cov_ledoit_wolf(df, days=1), "cov", 2), [[17.345586, 25.079920], [25.079920, 60.154414]], atol=1e-5)
    assert np.allclose(matrix(C.cov_oas(df, days=1), "cov", 2), [[21.246565, 20.509076], [20.509076, 56.253435]], atol=1e-5)


def test_many_assets_over_several_tiles(spark, monkeypatch):
    monkeypatch.setattr(C, "TILE", 3)
    x = np.random.default_rng(1).normal(size=(30, 8))
    x[::7, 2] = np.nan
    df = long(spark, x)
    assert np.allclose(matrix(C.correlation_matrix(df), "corr", 8), pd.DataFrame(x).corr().to_numpy())
    assert np.allclose(matrix(C.cov_sample(df, days=1), "cov", 8), pd.DataFrame(x).cov().to_numpy())


def ledoit_wolf(x):
    """The published formulas on a whole matrix."""
    t, p = x.shape
    x = x - x.mean(axis=0)
    s = x.T @ x / t
    m = np.trace(s) / p
    delta = ((s - m * np.eye(p)) ** 2).sum() / p
    beta = (((x * x).sum(axis=1) ** 2).sum() / t - (s * s).sum()) / (p * t)
    a = min(beta, delta) / delta
    return (1 - a) * s + a * m * np.eye(p), a


@pytest.mark.parametrize("level", [0.0, 1e6])
def test_shrinkage_from_one_read_at_any_level(spark, level):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(180, 5)) * [1, 2, 0.5, 1, 3] + rng.normal(size=(180, 1)) + 0.02 * np.arange(180)[:, None]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = C.cov_ledoit_wolf(long(spark, x + level).repartition(6), days=1)
        want, a = ledoit_wolf(x)
        assert np.allclose(matrix(got, "cov", 5), want, rtol=1e-7) and abs(got.first()["shrinkage"] / a - 1) < 1e-7
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    # the rows are read once, while the states are made; what is left reads states alone
    assert "ret" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_shrinkage_takes_complete_dates_or_raises(spark):
    x = np.random.default_rng(8).normal(size=(60, 4))
    x[::5, 1] = np.nan
    x[1::7, 3] = np.nan
    want, a = ledoit_wolf(x[~np.isnan(x).any(axis=1)])
    for parts in (1, 7):
        got = C.cov_ledoit_wolf(long(spark, x).repartition(parts), days=1)
        assert np.allclose(matrix(got, "cov", 4), want) and abs(got.first()["shrinkage"] - a) < 1e-12
    x[np.arange(60), np.arange(60) % 4] = np.nan
    with pytest.raises(Exception, match="all items"):
        C.cov_oas(long(spark, x)).collect()
