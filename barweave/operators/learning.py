"""Return models on feature tables: splits, relevance, tree models, scores and forecasts.

Models are fitted by ``pyspark.ml`` over all rows of the given table at once; a table filtered to one
symbol or window gives the model of that symbol or window.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.operators.metrics import regression_scores
from barweave.operators.series import calendar_bounded, row_index
from barweave.session import settle

# Sizes of the models and of their inputs.
SEED = 42
FOREST = {"numTrees": 100, "maxDepth": 8, "minInstancesPerNode": 10, "featureSubsetStrategy": "sqrt", "seed": SEED}
BOOSTED = {"maxIter": 200, "maxDepth": 4, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "minInstancesPerNode": 5, "seed": SEED}
TOP_FEATURES = 20
GBT_SHARE = 0.6
PATIENCE = 20
WARM_UP = 252
MIN_ROWS = 50
# boosting sees returns in percent
SCALE = 100.0


# ---- splits ---------------------------------------------------------------------------------


def _numbered(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """Adds ``_rn`` (1-based) and ``_n``, the rows of the key."""
    rows = row_index(df, key, order, "_rn")
    if calendar_bounded(df, order):
        return rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*key)))
    return rows.join(df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")), key)


def _ceil_share(n: Column, k: int) -> Column:
    """ceil(n / k) in integers."""
    return F.floor((n + (k - 1)) / k)


def chronological_split(df: DataFrame, key: Sequence[str] = ("symbol",), order: str = "dt", validation: bool = False) -> DataFrame:
    """Adds ``part``: the last fifth of a key is test, and with ``validation`` the last quarter of
    the rest validation."""
    n, rn = F.col("_n"), F.col("_rn")
    rest = n - _ceil_share(n, 5)
    train = rest - _ceil_share(rest, 4) if validation else rest
    part = F.when(rn <= train, "train").when(rn <= rest, "validation").otherwise("test")
    return _numbered(df, list(key), order).withColumn("part", part).drop("_rn", "_n")


def time_series_folds(df: DataFrame, key: Sequence[str] = ("symbol",), order: str = "dt", folds: int = 5) -> DataFrame:
    """Each row once per fold that uses it, with ``fold`` and ``part``: test blocks of equal size at
    the end of the key, each trained on everything before it."""
    rows = _numbered(df, list(key), order)
    size = F.floor(F.col("_n") / (folds + 1))
    uses = F.transform(
        F.sequence(F.lit(0), F.lit(folds - 1)),
        lambda k: F.struct(
            k.cast("long").alias("fold"),
            F.when(F.col("_rn") <= F.col("_n") - (folds - k) * size, "train")
            .when(F.col("_rn") <= F.col("_n") - (folds - 1 - k) * size, "test")
            .alias("part"),
        ),
    )
    out = rows.withColumn("_u", F.explode(F.filter(uses, lambda u: u["part"].isNotNull())))
    return out.select(*df.columns, "_u.fold", "_u.part")


# ---- relevance ------------------------------------------------------------------------------


def feature_relevance(df: DataFrame, cols: Sequence[str], target: str = "target", key: Sequence[str] = ("symbol",), order: str = "dt",
                      bins: int = 10) -> DataFrame:
    """(feature, mi): mutual information of each feature with the target, both in rank bins per key.

    Ranks are taken per key and feature over a calendar-bounded series, and only bin counts leave
    that stage.
    """
    if not calendar_bounded(df, order):
        raise ValueError("rank bins need a series ordered by date")
    key = list(key)
    base = df.withColumn("_ty", F.ntile(bins).over(Window.partitionBy(*key).orderBy(F.round(target, 9), order)))
    long = base.select(*key, order, "_ty", *[F.col(c).cast("double").alias(c) for c in cols]).unpivot([*key, order, "_ty"], list(cols), "feature", "value")
    ranked = long.withColumn("_tx", F.ntile(bins).over(Window.partitionBy(*key, "feature").orderBy(F.round("value", 9), order)))
    counts = ranked.groupBy("feature", "_tx", "_ty").agg(F.count(F.lit(1)).alias("_c"))

    def total(*by: str) -> Column:  # at most bins x bins rows per feature
        return F.sum("_c").over(Window.partitionBy("feature", *by))

    joint = counts.withColumns({"_all": total(), "_cx": total("_tx"), "_cy": total("_ty")})
    p = F.col("_c") / F.col("_all")
    return joint.groupBy("feature").agg(F.sum(p * F.ln(F.col("_c") * F.col("_all") / (F.col("_cx") * F.col("_cy")))).alias("mi"))


def select_features(df: DataFrame, cols: Sequence[str], n: int = TOP_FEATURES, **kw) -> list[str]:
    """Names of the n most relevant features, in table order; all when there are no more than n."""
    if len(cols) <= n:
        return list(cols)
    best = feature_relevance(df, cols, **kw).orderBy(F.desc(F.round("mi", 9)), "feature").limit(n)
    chosen = {r["feature"] for r in best.collect()}  # n names
    return [c for c in cols if c in chosen]


# ---- models ---------------------------------------------------------------------------------


def model_inputs(df: DataFrame, cols: Sequence[str], target: str | None = "target", keep: Sequence[str] = ("symbol", "dt")) -> DataFrame:
    """(keep, y, features) with the columns assembled into one vector."""
    y = [F.col(target).alias("y")] if target else []
    numbers = [F.col(c).cast("double").alias(f"_x_{c}") for c in cols]
    flat = df.select(*keep, *y, *numbers)
    return VectorAssembler(inputCols=[f"_x_{c}" for c in cols], outputCol="features").transform(flat).select(*keep, *(["y"] if target else []), "features")


def rf_return_model(train: DataFrame, **params) -> Model:
    """Random forest on (y, features). Splits do not depend on scale, so inputs are not scaled."""
    return RandomForestRegressor(featuresCol="features", labelCol="y", predictionCol="yhat", **{**FOREST, **params}).fit(train)


def stopping_round(errors: Sequence[float], patience: int = PATIENCE) -> tuple[int, bool]:
    """(best round from 1, whether ``patience`` rounds after it brought no gain) of a validation curve.

    The curve is read from its start, so a later and lower error behind the stop does not count.
    """
    best = 0
    for k, error in enumerate(errors):
        if error < errors[best]:
            best = k
        if k - best >= patience:
            return best + 1, True
    return best + 1, False


def gbt_return_model(train: DataFrame, validation: DataFrame | None = None, patience: int = PATIENCE, **params) -> Model:
    """Boosted trees on (y, features); with validation rows boosting ends when ``patience`` rounds brought no gain,
    and the model has the trees up to the best round.

    Rounds come in doubled lots, and one pass over the validation rows gives the error after every round of a
    lot. The first trees of a longer model are those of a shorter one, so the best model is fitted at its length.
    """
    params = {**BOOSTED, **params}
    most = params.pop("maxIter")
    rows = train.select((F.col("y") * SCALE).alias("_y"), "features")
    fitted = lambda rounds: GBTRegressor(featuresCol="features", labelCol="_y", predictionCol="yhat", maxIter=rounds, **params).fit(rows)
    if validation is None:
        return fitted(most)
    held = settle(validation.select((F.col("y") * SCALE).alias("_y"), "features"))
    rounds = min(most, patience + 4)
    while True:
        model = fitted(rounds)
        best, stopped = stopping_round(model.evaluateEachIteration(held, "squared"), patience)
        if stopped or rounds == most:
            return model if best == rounds else fitted(best)
        rounds = min(most, 2 * rounds)


def predict(model: Model, inputs: DataFrame, out: str = "yhat") -> DataFrame:
    """Adds the forecast return."""
    scale = SCALE if "GBT" in type(model).__name__ else 1.0
    return model.transform(inputs).withColumn("yhat", F.col("yhat") / scale).withColumnRenamed("yhat", out)


def ensemble_prediction(predictions: DataFrame, gbt: str = "yhat_gbt", rf: str = "yhat_rf", share: float = GBT_SHARE, out: str = "yhat") -> DataFrame:
    return predictions.withColumn(out, share * F.col(gbt) + (1 - share) * F.col(rf))


def feature_importance(model: Model, cols: Sequence[str], like: DataFrame) -> DataFrame:
    """(feature, importance); one row per input column."""
    rows = [(c, float(v)) for c, v in zip(cols, model.featureImportances.toArray())]
    return like.sparkSession.createDataFrame(rows, "feature string, importance double")


def combined_importance(gbt: DataFrame, rf: DataFrame, share: float = GBT_SHARE) -> DataFrame:
    """Weighted sum of two importance tables; a feature missing in one counts 0 there."""
    both = gbt.select("feature", (share * F.col("importance")).alias("importance")).unionByName(
        rf.select("feature", ((1 - share) * F.col("importance")).alias("importance"))
    )
    return both.groupBy("feature").agg(F.sum("importance").alias("importance"))


def top_features(importance: DataFrame, n: int = 15) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(n)


def _each(items: Sequence, work: Callable, parallelism: int) -> list:
    """Fits of independent models submitted side by side, so that one does not wait for another."""
    with ThreadPool(min(parallelism, max(1, len(items)))) as pool:
        return pool.map(inheritable_thread_target(work), items)


def time_series_cv(df: DataFrame, cols: Sequence[str], fit: Callable[[DataFrame], Model] = rf_return_model, folds: int = 5,
                   key: Sequence[str] = ("symbol",), order: str = "dt", parallelism: int = 2) -> DataFrame:
    """(fold, n, mse) of forward-chaining folds."""
    rows = settle(model_inputs(time_series_folds(df, key, order, folds), cols, keep=[*key, order, "fold", "part"]))

    def score(k: int) -> DataFrame:
        mine = rows.filter(F.col("fold") == k)
        got = predict(fit(mine.filter("part = 'train'")), mine.filter("part = 'test'"))
        err = F.col("y") - F.col("yhat")
        return got.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg(err * err).alias("mse"))

    parts = _each(range(folds), score, parallelism)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cv_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("mse").alias("cv_mse"), F.stddev_pop("mse").alias("cv_std"))


# ---- forecasts per window -------------------------------------------------------------------


def window_feature_rows(features: DataFrame, windows: DataFrame, key: Sequence[str] = ("symbol",), order: str = "dt") -> DataFrame:
    """Feature rows of the training span of each window that a model of that window may see.

    Features look back over rows only, so they are computed once for the whole history; a window
    leaves out the rows whose look-back would leave it, and its last row, whose target lies beyond.
    ``features`` holds every bar of the key, with NULL features in the warm-up.
    """
    days = windows.select("window_id", F.explode(F.sequence("train_start", "train_end")).alias(order))
    rows = features.join(days, order)
    w = Window.partitionBy("window_id", *key)
    return (
        rows.withColumns({"_rn": F.row_number().over(w.orderBy(order)), "_n": F.count(F.lit(1)).over(w)})
        .filter((F.col("_rn") > WARM_UP) & (F.col("_rn") < F.col("_n")))
        .withColumn("_usable", F.count(F.lit(1)).over(w))
        .filter(F.col("_usable") >= MIN_ROWS)
        .drop("_rn", "_n", "_usable")
    )


def latest_prediction(rows: DataFrame, cols: Sequence[str], fit: Callable[[DataFrame], Model] = rf_return_model,
                      key: Sequence[str] = ("symbol",), order: str = "dt", parallelism: int = 2) -> DataFrame:
    """(window_id, key, signal): forecast of each window's model at the last row of each key.

    One model per window, pooled over the keys; windows are a short list of one calendar.
    """
    inputs = settle(model_inputs(rows, cols, keep=["window_id", *key, order]))
    ids = [r["window_id"] for r in inputs.select("window_id").distinct().orderBy("window_id").collect()]
    if not ids:
        return inputs.select("window_id", *key, F.lit(None).cast("double").alias("signal"))
    last = inputs.groupBy("window_id", *key).agg(F.max_by("features", order).alias("features"))

    def signal(w) -> DataFrame:
        model = fit(inputs.filter(F.col("window_id") == w))
        return predict(model, last.filter(F.col("window_id") == w), "signal").select("window_id", *key, "signal")

    parts = _each(ids, signal, parallelism)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---- reports --------------------------------------------------------------------------------


def fit_models(df: DataFrame, cols: Sequence[str], rf_cols: Sequence[str] | None = None, key: Sequence[str] = ("symbol",), order: str = "dt",
               select: int = TOP_FEATURES) -> tuple[DataFrame, dict]:
    """Forecasts (key, order, part, y, yhat_rf, yhat_gbt, yhat) of all rows, and the models with
    their columns and times. Both models choose their features on their training rows."""
    rf_cols = list(rf_cols or cols)
    names = list(dict.fromkeys([*cols, *rf_cols]))
    parts = settle(chronological_split(df.select(*key, order, "target", *names), key, order, validation=True))
    # the forest has no use for validation rows and trains on them too
    seen = {"rf": parts.filter("part <> 'test'"), "gbt": parts.filter("part = 'train'")}
    chosen = {"rf": select_features(seen["rf"], rf_cols, select, key=key, order=order), "gbt": select_features(seen["gbt"], cols, select, key=key, order=order)}
    info: dict = {}
    out = parts.select(*key, order, "part", F.col("target").alias("y"), *names)
    for name in ("rf", "gbt"):
        started = time.time()
        train = model_inputs(seen[name], chosen[name], keep=[])
        if name == "rf":
            model = rf_return_model(train)
        else:
            model = gbt_return_model(train, model_inputs(parts.filter("part = 'validation'"), chosen[name], keep=[]))
        trees = model.getNumTrees
        info[name] = {"model": model, "cols": chosen[name], "n_features_original": len(rf_cols if name == "rf" else cols), "seconds": time.time() - started,
                      "iterations": trees, "stopped_early": name == "gbt" and trees < BOOSTED["maxIter"]}
        vec = VectorAssembler(inputCols=chosen[name], outputCol="features")
        flat = out.select(*[F.col(c).cast("double").alias(c) if c in names else F.col(c) for c in out.columns])
        out = predict(model, vec.transform(flat), f"yhat_{name}").drop("features")
    return ensemble_prediction(out.select(*key, order, "part", "y", "yhat_rf", "yhat_gbt")), info


def model_report(forecasts: DataFrame, info: dict, key: Sequence[str] = ("symbol",)) -> DataFrame:
    """One row per (key, model, scope): scores on all rows and on the test rows only."""
    used = {m: info[m] for m in ("rf", "gbt")}
    used["ensemble"] = {"cols": {*info["rf"]["cols"], *info["gbt"]["cols"]}, "n_features_original": info["gbt"]["n_features_original"],
                        "seconds": info["rf"]["seconds"] + info["gbt"]["seconds"], "iterations": info["gbt"]["iterations"],
                        "stopped_early": info["gbt"]["stopped_early"]}
    struct = lambda m, c: F.struct(
        F.lit(m).alias("model"), F.col(c).alias("yhat"), F.lit(used[m]["n_features_original"]).alias("n_features_original"),
        F.lit(len(used[m]["cols"])).alias("n_features"), F.lit(used[m]["iterations"]).alias("iterations"),
        F.lit(used[m]["stopped_early"]).alias("stopped_early"), F.lit(float(used[m]["seconds"])).alias("training_seconds"),
    )
    models = F.array(struct("rf", "yhat_rf"), struct("gbt", "yhat_gbt"), struct("ensemble", "yhat"))
    scopes = F.when(F.col("part") == "test", F.array(F.lit("all"), F.lit("test"))).otherwise(F.array(F.lit("all")))
    long = forecasts.select(*key, "y", F.explode(models).alias("_m"), "part").select(*key, "y", "_m.*", F.explode(scopes).alias("scope"))
    about = ["model", "n_features_original", "n_features", "iterations", "stopped_early", "training_seconds"]
    return regression_scores(long, [*key, *about, "scope"])


def model_comparison(report: DataFrame, key: str = "symbol") -> DataFrame:
    """Per model and scope: mean scores, mean time and features, share stopped early, best symbol."""
    return report.groupBy("model", "scope").agg(
        F.avg("r2").alias("mean_r2"), F.avg("mse").alias("mean_mse"), F.avg("directional_accuracy").alias("mean_directional_accuracy"),
        F.avg("training_seconds").alias("mean_training_seconds"), F.avg("n_features").alias("mean_features"),
        F.avg(F.col("stopped_early").cast("double")).alias("early_stop_rate"), F.max_by(key, "r2").alias("best_r2"),
        F.max_by(key, "directional_accuracy").alias("best_direction"),
    )
