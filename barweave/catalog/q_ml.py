"""Model queries on the feature table of the regional bars."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from barweave.catalog.oracle import cte, d, r, with_ctes
from barweave.catalog.q_metrics import predictions
from barweave.catalog.q_returns import bench, panel
from barweave.catalog.registry import query
from barweave.operators import features as X
from barweave.operators import learning as L
from barweave.operators.returns import align_left_benchmark
from barweave.plans import walkforward as B
from barweave.session import settle
from barweave.sources import derived as D

GBT, RF = X.input_columns("gbt"), X.input_columns("rf")
cte("ft", ("f3",), "SELECT symbol, dt, target, " + ", ".join(GBT) + " FROM f3 WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in ["price_change", "log_returns", *X.FEATURE_COLUMNS, "target"]))
W = "(PARTITION BY symbol ORDER BY dt)"
cte("ftn", ("ft",), f"SELECT *, ROW_NUMBER() OVER {W} AS rn, COUNT(*) OVER (PARTITION BY symbol) AS n FROM ft")


def table(spark, sf):
    return X.feature_table(D.bars(spark, sf))


@query(
    "chronological_split",
    with_ctes(
        ["ftn"],
        f"""SELECT symbol, {d()}, CASE WHEN rn <= n - CEIL(n / 5e0) THEN 'train' ELSE 'test' END AS part,
        CASE WHEN rn <= n - CEIL(n / 5e0) - CEIL((n - CEIL(n / 5e0)) / 4e0) THEN 'train' WHEN rn <= n - CEIL(n / 5e0) THEN 'validation' ELSE 'test' END AS part3 FROM ftn""",
    ),
)
def _(spark, sf):
    three = L.chronological_split(table(spark, sf).select("symbol", "dt"), validation=True).withColumnRenamed("part", "part3")
    return L.chronological_split(three)


@query(
    "time_series_folds",
    with_ctes(
        ["ftn"],
        f"""SELECT CAST(k AS BIGINT) AS fold, symbol, {d()}, CASE WHEN rn <= n - (5 - k) * (n // 6) THEN 'train' ELSE 'test' END AS part
        FROM ftn, range(5) t(k) WHERE rn <= n - (4 - k) * (n // 6)""",
    ),
)
def _(spark, sf):
    return L.time_series_folds(table(spark, sf).select("symbol", "dt")).select("fold", "symbol", "dt", "part")


_long = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in GBT)
cte("mi_base", ("ft",), f"SELECT symbol, dt, {_long}, NTILE(10) OVER (PARTITION BY symbol ORDER BY ROUND(target, 9), dt) AS ty FROM ft")
cte(
    "mi",
    ("mi_base",),
    f"""SELECT feature, SUM(c / n * LN(c * n / (cx * cy))) AS mi FROM (SELECT *, SUM(c) OVER (PARTITION BY feature) * 1e0 AS n, SUM(c) OVER (PARTITION BY feature, tx) AS cx, SUM(c) OVER (PARTITION BY feature, ty) AS cy FROM
      (SELECT feature, tx, ty, COUNT(*) AS c FROM (SELECT feature, ty, NTILE(10) OVER (PARTITION BY symbol, feature ORDER BY ROUND(value, 9), dt) AS tx FROM
        (UNPIVOT mi_base ON {', '.join(GBT)} INTO NAME feature VALUE value)) GROUP BY feature, tx, ty)) GROUP BY feature""",
)


@query(
    "feature_relevance",
    with_ctes(["mi"], f"SELECT feature, {r('mi', 'mi', 4)}, ROW_NUMBER() OVER (ORDER BY ROUND(mi, 9) DESC, feature) <= 20 AS selected FROM mi"),
    digits=4,
)
def _(spark, sf):
    mi = settle(L.feature_relevance(table(spark, sf), GBT))
    best = mi.orderBy(F.desc(F.round("mi", 9)), "feature").limit(L.TOP_FEATURES).select("feature", F.lit(True).alias("selected"))
    return mi.join(best, "feature", "left").na.fill(False, ["selected"])


@query("ensemble_prediction", with_ctes(["pred"], f"SELECT symbol, {d()}, {r('0.6e0 * yhat + 0.4e0 * (0.5e0 * yhat)', 'yhat')} FROM pred"))
def _(spark, sf):
    both = predictions(spark, sf).select("symbol", "dt", F.col("yhat").alias("yhat_gbt"), (0.5 * F.col("yhat")).alias("yhat_rf"))
    return L.ensemble_prediction(both).select("symbol", "dt", "yhat")


_sets = {name: X.input_columns(name, bench=True) for name in ("gbt", "rf")}
_sizes = ", ".join(f"CAST({len(c)} AS BIGINT) AS {n}_size, {r(' + '.join(c), f'{n}_sum', 4)}" for n, c in _sets.items())
_have = " AND ".join(f"{c} IS NOT NULL" for c in ["price_change", "log_returns", *X.FEATURE_COLUMNS, *X.MARKET_COLUMNS, "target"])


@query("model_inputs", with_ctes(["f3"], f"SELECT symbol, {d()}, {_sizes} FROM f3 WHERE {_have}"), digits=4)
def _(spark, sf):
    """Size and sum of the input vectors of both models, benchmark columns included."""
    bars = align_left_benchmark(D.bars(spark, sf), bench(spark, sf))
    full = X.feature_table(bars, bench="bench_ret")
    out = full
    for name, cols in _sets.items():
        vec = L.model_inputs(out, cols, keep=out.columns).withColumn("_a", vector_to_array("features")).drop("y", "features")
        out = vec.withColumns({f"{name}_size": F.size("_a"), f"{name}_sum": F.aggregate("_a", F.lit(0.0), lambda s, x: s + x)}).drop("_a")
    return out.select("symbol", "dt", *[f"{n}_{x}" for n in _sets for x in ("size", "sum")])


def fitted(spark, sf):
    forecasts, info = L.fit_models(table(spark, sf), GBT, RF)
    return settle(forecasts), info


@query("return_model_forecasts")
def _(spark, sf):
    return fitted(spark, sf)[0]


@query("rf_return_model")
def _(spark, sf):
    """Forest forecasts of the test rows."""
    parts = settle(L.chronological_split(table(spark, sf)))
    cols = L.select_features(parts.filter("part = 'train'"), RF)
    model = L.rf_return_model(L.model_inputs(parts.filter("part = 'train'"), cols))
    return L.predict(model, L.model_inputs(parts.filter("part = 'test'"), cols)).select("symbol", "dt", "y", "yhat")


@query("gbt_return_model")
def _(spark, sf):
    """Boosted-tree forecasts of the test rows, stopped on the validation rows."""
    parts = settle(L.chronological_split(table(spark, sf), validation=True))
    cols = L.select_features(parts.filter("part = 'train'"), GBT)
    train, hold, test = (L.model_inputs(parts.filter(F.col("part") == p), cols) for p in ("train", "validation", "test"))
    return L.predict(L.gbt_return_model(train, hold), test).select("symbol", "dt", "y", "yhat")


@query("time_series_cv")
def _(spark, sf):
    # only training rows are seen, with the features chosen on them
    train = settle(L.chronological_split(table(spark, sf))).filter("part = 'train'").drop("part")
    scores = settle(L.time_series_cv(train, L.select_features(train, RF)))
    # five rows of scores and one of summary
    return scores.join(F.broadcast(L.cv_summary(scores)), F.lit(True))


@query("feature_importance")
def _(spark, sf):
    like, info = fitted(spark, sf)
    gbt, rf = (L.feature_importance(info[m]["model"], info[m]["cols"], like) for m in ("gbt", "rf"))
    return L.combined_importance(gbt, rf)


@query("top_features")
def _(spark, sf):
    like, info = fitted(spark, sf)
    gbt, rf = (L.feature_importance(info[m]["model"], info[m]["cols"], like) for m in ("gbt", "rf"))
    return L.top_features(L.combined_importance(gbt, rf), 15)


@query("model_report")
def _(spark, sf):
    return L.model_report(*fitted(spark, sf))


@query("model_comparison")
def _(spark, sf):
    return L.model_comparison(L.model_report(*fitted(spark, sf)))


def window_rows(spark, sf):
    """Feature rows per window of three years of training and two quarters of test."""
    windows = B.walk_forward_windows(panel(spark, sf).select("dt"), train_days=756, test_days=126)
    return L.window_feature_rows(X.add_features(D.bars(spark, sf), only=[*RF, "target"]), windows)


cte(
    "win3",
    ("pcal",),
    """SELECT 0 AS n, s.m0 AS st, (SELECT MAX(c.dt) FROM pcal c WHERE c.dt <= s.m0 + 756) AS te, (SELECT MAX(c.dt) FROM pcal c WHERE c.dt <= s.m0 + 882) AS xe
   FROM (SELECT MIN(dt) m0, MAX(dt) m1 FROM pcal) s WHERE s.m0 + 882 <= s.m1
   UNION ALL
   SELECT n + 1, xe + 1, (SELECT MAX(c.dt) FROM pcal c WHERE c.dt <= win3.xe + 757), (SELECT MAX(c.dt) FROM pcal c WHERE c.dt <= win3.xe + 883)
   FROM win3 WHERE win3.xe + 883 <= (SELECT MAX(dt) FROM pcal)""",
)


@query(
    "window_feature_rows",
    with_ctes(
        ["f3", "win3"],
        f"""SELECT window_id, symbol, {d()}, {r('target')} FROM (SELECT CAST(w.n AS BIGINT) AS window_id, symbol, dt, target,
          ROW_NUMBER() OVER (PARTITION BY w.n, symbol ORDER BY dt) AS rn, COUNT(*) OVER (PARTITION BY w.n, symbol) AS cnt FROM f3 JOIN win3 w ON dt BETWEEN st AND te)
        WHERE rn > 252 AND rn < cnt AND cnt - 253 >= 50""",
    ),
)
def _(spark, sf):
    return window_rows(spark, sf).select("window_id", "symbol", "dt", "target")


@query("latest_prediction")
def _(spark, sf):
    """Forest signal of every window and symbol."""
    return L.latest_prediction(window_rows(spark, sf), RF)
