import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barweave.operators import allocation as A
from barweave.operators import orderstats as O
from barweave.operators import regime as G

HARD = [0.0, -0.0, 1e-300, -1e-300, 1e308, -1e308, float("inf"), -float("inf"), 5e-324, 1.0, 1.0 + 2**-52]


def all_ranks(spark, values, key="k"):
    n = len(values)
    rows = spark.createDataFrame([(key, v) for v in values], "key string, v double")
    return O.order_statistics(rows, ["key"], F.col("v"), lambda c: [F.lit(r) for r in range(1, n + 1)]).first()


@pytest.mark.parametrize("slots", [2, 7, 2048])
def test_every_rank_of_hard_values(spark, monkeypatch, slots):
    monkeypatch.setattr(O, "SLOTS", slots)
    values = HARD + [random.Random(1).gauss(0, 1) for _ in range(9)] + [1.0] * 5
    got = all_ranks(spark, values)
    assert got.n == len(values) and got.ranked == sorted(values)


def test_keys_nulls_and_empty_tables(spark):
    rows = spark.createDataFrame([("a", 3.0), ("a", None), ("a", 1.0), ("b", float("nan")), ("c", None), (None, 2.0), ("d", 7.0), ("d", 7.0)], "key string, v double")
    got = {r.key: r.ranked for r in O.order_statistics(rows.filter("key is not null"), ["key"], F.col("v"), lambda n: [F.lit(1), n]).collect()}
    assert got == {"a": [1.0, 3.0], "d": [7.0, 7.0]}
    assert O.order_statistics(rows.limit(0), ["key"], F.col("v"), lambda n: [n]).count() == 0
    one = O.percentiles(rows, [], F.col("v"), [0.0, 0.5, 1.0]).first()
    assert (one.n, one.percentiles) == (5, [1.0, 3.0, 7.0])


def test_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(2)
    data = {k: rng.lognormal(size=n) for k, n in (("x", 1), ("y", 2), ("z", 501))}
    rows = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs], "key string, v double").repartition(5)
    shares = [1 / 3, 2 / 3, 0.95]
    for r in O.percentiles(rows, ["key"], F.col("v"), shares).collect():
        assert np.allclose(r.percentiles, np.quantile(data[r.key], shares), rtol=1e-12)


def test_a_key_of_many_values_is_never_gathered(spark):
    """One portfolio holds nearly all rows: the rank is exact and no plan gathers a key's values."""
    n = 2_000_000
    rows = spark.range(n, numPartitions=8).select(F.when(F.col("id") % 100 == 0, "small").otherwise("hot").alias("portfolio_id"), (-((F.col("id") * 7919) % n) / n).alias("ret"))
    out = A.cvar_of_portfolio(rows, confidence=0.9)
    plan = out._jdf.queryExecution().toString().lower()
    assert "percentile" not in plan
    got = {r.portfolio_id: r for r in out.collect()}
    for name, keep in (("small", lambda i: i % 100 == 0), ("hot", lambda i: i % 100 != 0)):
        losses = np.sort(np.array([((i * 7919) % n) / n for i in range(n) if keep(i)]))
        level = losses[math.ceil(round(len(losses) * 0.9, 9)) - 1]
        assert got[name]["var"] == level and abs(got[name].cvar - (level + np.maximum(losses - level, 0).sum() / (0.1 * len(losses)))) < 1e-9


def test_labels_by_thirds(spark):
    rows = spark.createDataFrame([(k, float(v)) for k in "ab" for v in range(9)] + [("b", None)], "key string, rolling_return double")
    got = G.regime_rule_labels(rows, ["key"]).groupBy("key", "regime").count().collect()
    assert {(r.key, r.regime): r["count"] for r in got} == {("a", "Bear"): 3, ("a", "Sideways"): 3, ("a", "Bull"): 3, ("b", "Bear"): 3, ("b", "Sideways"): 4, ("b", "Bull"): 3}
