from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barweave.operators import features as X
from barweave.operators import learning as L
from barweave.operators import regime as G


def labels(spark, names):
    return spark.createDataFrame([(date(2024, 1, 1) + timedelta(k), n) for k, n in enumerate(names)], "dt date, regime string")


def test_transitions(spark):
    rows = {r["current"]: r for r in G.regime_transitions(labels(spark, ["Bull", "Bull", "Bear", "Sideways", "Sideways", "Bull"])).collect()}
    assert (rows["Bull"]["Bull"], rows["Bull"]["Bear"]) == (0.5, 0.5)
    assert rows["Bear"]["Sideways"] == 1.0
    assert (rows["Sideways"]["Sideways"], rows["Sideways"]["Bull"]) == (0.5, 0.5)


def test_regime_never_left_has_zeros(spark):
    rows = G.regime_transitions(labels(spark, ["Bull", "Bear"])).collect()
    assert len(rows) == 3
    for r in rows:
        assert round(r["Bull"] + r["Bear"] + r["Sideways"], 9) in (0.0, 1.0)


def test_smoothing_by_majority_then_recency(spark):
    out = G.regime_smoothing(labels(spark, ["Bull", "Bear", "Bear", "Bull"]), 4).orderBy("dt").collect()
    assert [r["smoothed"] for r in out] == ["Bull", "Bear", "Bear", "Bull"]


def test_labels_by_mean_with_more_states(spark):
    df = spark.createDataFrame([(k, v) for k, v in [(0, 0.1), (0, 0.2), (1, -0.3), (2, 0.0), (3, 0.9)]], "state long, rolling_return double")
    got = {r["state"]: r["regime"] for r in G.regime_labels(df).collect()}
    assert got == {0: "Sideways", 1: "Bear", 2: "Sideways", 3: "Bull"}


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    rows = []
    for s in ("a", "b"):
        x = rng.normal(size=(240, 25))
        y = 0.01 * np.sign(x[:, 0]) + 0.002 * rng.normal(size=240)
        rows += [(s, date(2020, 1, 1) + timedelta(t), *map(float, x[t]), float(y[t])) for t in range(240)]
    cols = [f"f{k}" for k in range(25)]
    return cols, spark.createDataFrame(rows, "symbol string, dt date, " + ", ".join(f"{c} double" for c in cols) + ", target double").cache()


def test_split_sizes(table):
    _, df = table
    got = {(r["symbol"], r["part"]): r["count"] for r in L.chronological_split(df.filter("dt < '2020-04-11'"), validation=True).groupBy("symbol", "part").count().collect()}
    assert got[("a", "test")] == 21 and got[("a", "validation")] == 20 and got[("a", "train")] == 60
    edge = L.chronological_split(df).groupBy("part").agg(F.min("dt").alias("lo"), F.max("dt").alias("hi")).collect()
    parts = {r["part"]: r for r in edge}
    assert parts["train"]["hi"] < parts["test"]["lo"]


def test_folds_only_look_back(table):
    _, df = table
    f = L.time_series_folds(df.select("symbol", "dt"))
    g = f.groupBy("fold").agg(F.max(F.when(F.col("part") == "train", F.col("dt"))).alias("hi"), F.min(F.when(F.col("part") == "test", F.col("dt"))).alias("lo"),
                              F.count(F.when(F.col("part") == "test", 1)).alias("n")).collect()
    assert len(g) == 5 and all(r["hi"] < r["lo"] and r["n"] == 80 for r in g)


def test_relevance_finds_the_signal(table):
    cols, df = table
    assert L.feature_relevance(df, cols).orderBy(F.desc("mi")).first()["feature"] == "f0"
    assert len(L.select_features(df, cols)) == 20 and "f0" in L.select_features(df, cols)


def test_models_learn_and_report(table, monkeypatch):
    cols, df = table
    monkeypatch.setitem(L.FOREST, "numTrees", 10)
    monkeypatch.setitem(L.BOOSTED, "maxIter", 15)
    forecasts, info = L.fit_models(df, cols)
    rep = L.model_report(forecasts, info)
    rows = rep.collect()
    assert {(r["model"], r["scope"]) for r in rows} == {(m, s) for m in ("rf", "gbt", "ensemble") for s in ("all", "test")}
    assert all(r["directional_accuracy"] > 0.8 for r in rows if r["scope"] == "test" and r["model"] != "gbt")
    assert all(r["n_features"] <= 40 and r["n_features_original"] == 25 for r in rows)
    imp = L.combined_importance(*(L.feature_importance(info[m]["model"], info[m]["cols"], forecasts) for m in ("gbt", "rf")))
    assert abs(imp.agg(F.sum("importance")).first()[0] - 1) < 1e-6
    assert L.top_features(imp, 1).first()["feature"] == "f0"
    e = forecasts.select(F.max(F.abs(F.col("yhat") - 0.6 * F.col("yhat_gbt") - 0.4 * F.col("yhat_rf")))).first()[0]
    assert e < 1e-12


def test_input_columns():
    assert len(X.input_columns("gbt")) == 41 and len(X.input_columns("rf")) == 30
    assert len(X.input_columns("gbt", bench=True)) == 46


def test_another_symbol_does_not_change_features(spark):
    rng = np.random.default_rng(0)
    rows = [(s, date(2020, 1, 1) + timedelta(t), float(p), float(p), float(p), 1.0) for s in "ab" for t, p in enumerate(100 + rng.normal(size=300).cumsum() * 0.1)]
    df = spark.createDataFrame(rows, "symbol string, dt date, high double, low double, adj_close double, volume double")
    both = {tuple(r) for r in X.feature_table(df).filter("symbol = 'a'").collect()}
    alone = {tuple(r) for r in X.feature_table(df.filter("symbol = 'a'")).collect()}
    assert both == alone and len(both) == 300 - 252 - 1


def test_feature_table_shuffles_once(spark):
    df = spark.createDataFrame([("a", date(2020, 1, 1), 1.0, 1.0, 1.0, 1.0)], "symbol string, dt date, high double, low double, adj_close double, volume double")
    plan = X.feature_table(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_boosting_waits_on_a_plateau():
    flat = [5.0, 4.0, *[4.5] * 19, 3.0, *[3.5] * 30, 1.0]
    assert L.stopping_round(flat) == (22, True)  # nineteen rounds without gain are borne, thirty are not
    assert L.stopping_round(flat, patience=5) == (2, True) and L.stopping_round([3.0, 2.0, 1.0]) == (3, False)
    assert L.stopping_round([2.0, 2.0, 2.0], patience=2) == (1, True)


def test_boosted_model_has_the_trees_of_its_best_round(table):
    cols, df = table
    parts = L.chronological_split(df, validation=True)
    rows = {p: L.model_inputs(parts.filter(F.col("part") == p), cols).cache() for p in ("train", "validation")}
    model = L.gbt_return_model(rows["train"], rows["validation"], patience=4, maxIter=24)
    full = L.gbt_return_model(rows["train"], maxIter=24)
    curve = full.evaluateEachIteration(rows["validation"].select((F.col("y") * L.SCALE).alias("_y"), "features"), "squared")
    assert model.getNumTrees == L.stopping_round(curve, 4)[0] > 1 and full.getNumTrees == 24
    a, b = (m.trees[k].toDebugString.split("\n", 1)[1] for m in (model, full) for k in (model.getNumTrees - 1,))
    assert a == b
