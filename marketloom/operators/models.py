"""Models on Spark ML (and `boosting` for trees that grow leaf by leaf), and their evaluation with plain aggregates.

Fits loop over a handful of folds or parameter sets on the driver; each fit is a distributed job, or none where sums suffice
(`additive`).
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.expr import div
from marketloom.operators import additive, boosting, isotonic, sampler
from marketloom.operators.ordering import cumulative, positions, quantiles
from marketloom.operators.pit import embargo_folds, walk_forward_bounds
from marketloom.session import materialize

LOWER_IS_BETTER = ("RMSE", "MAE", "MedAE", "LogLoss")
EPS = 2.220446049250313e-16


# --- model factory ---------------------------------------------------------------------------------


def preprocessing(features: list[str], scale: bool = True) -> list:
    """Median imputation and standardising; both learn from the training rows only."""
    filled = [f"_{c}_filled" for c in features]
    stages = [Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_raw" if scale else "_x")]
    if scale:
        stages.append(StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True))
    return stages


def _linear(label: str, l1: float, alpha: float) -> LinearRegression:
    return LinearRegression(featuresCol="_x", labelCol=label, predictionCol="prediction", regParam=alpha, elasticNetParam=l1, standardization=False)


def pipeline(name: str, features: list[str], label: str, rows: int = 0, **kw) -> Pipeline:
    """Unfitted pipeline by name. `rows` (training size) turns a ridge penalty on the sum of squares into one on the mean."""
    cols = {"featuresCol": "_x", "labelCol": label}
    seed = kw.pop("seed", 42)
    trees = {"numTrees": kw.pop("n_estimators", 100), "maxDepth": kw.pop("max_depth", 5), "seed": seed} if name.startswith("random_forest") else {}
    boost = {}
    if name.startswith(("xgboost", "gbt")):
        boost = {"maxIter": kw.pop("n_estimators", 50), "maxDepth": kw.pop("max_depth", 4), "stepSize": kw.pop("learning_rate", 0.1), "subsamplingRate": kw.pop("subsample", 1.0), "seed": seed}
    alpha = kw.pop("alpha", 1.0)
    if name == "linear_regression":
        return Pipeline(stages=[*preprocessing(features), _linear(label, 0.0, 0.0)])
    if name == "ridge":
        return Pipeline(stages=[*preprocessing(features), _linear(label, 0.0, alpha / max(rows, 1))])
    if name == "lasso":
        return Pipeline(stages=[*preprocessing(features), _linear(label, 1.0, alpha)])
    if name == "elastic_net":
        return Pipeline(stages=[*preprocessing(features), _linear(label, kw.pop("l1_ratio", 0.5), alpha)])
    if name == "logistic_regression":
        return Pipeline(stages=[*preprocessing(features), LogisticRegression(**cols, regParam=1.0 / max(rows, 1), standardization=False)])
    if name == "random_forest_regressor":
        return Pipeline(stages=[*preprocessing(features, False), RandomForestRegressor(**cols, **trees)])
    if name == "random_forest_classifier":
        return Pipeline(stages=[*preprocessing(features, False), RandomForestClassifier(**cols, **trees)])
    if name in ("gbt_regressor", "xgboost_regressor"):
        return Pipeline(stages=[*preprocessing(features), GBTRegressor(**cols, **boost)])
    if name in ("gbt_classifier", "xgboost_classifier"):
        return Pipeline(stages=[*preprocessing(features), GBTClassifier(**cols, **boost)])
    raise ValueError(f"Unknown model: {name}")


def baseline_predictions(train: DataFrame, test: DataFrame, label: str, name: str) -> DataFrame:
    """Constant forecasts learned from the training rows (one aggregate row, joined on a constant)."""
    if name == "baseline_zero_return":
        return test.withColumn("prediction", F.lit(0.0))
    if name == "baseline_historical_mean":
        fit = train.agg(F.avg(label).alias("prediction"))
    elif name == "baseline_majority_class":
        share = F.avg(F.col(label).cast("double"))
        fit = train.agg(F.when(share > 0.5, 1.0).otherwise(0.0).alias("prediction"), share.alias("probability"))
    else:
        raise ValueError(f"Unknown baseline: {name}")
    return test.withColumn("_k", F.lit(1)).join(F.broadcast(fit.withColumn("_k", F.lit(1))), "_k").drop("_k")


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Rows with `prediction`, and `probability` of class 1 for classifiers; helper columns dropped."""
    out = model.transform(df)
    if "probability" in out.columns:
        out = out.withColumn("probability", vector_to_array("probability")[1])
    return out.select(*df.columns, *[c for c in ("prediction", "probability") if c in out.columns])


def fit_predict(name: str, train: DataFrame, test: DataFrame, features: list[str], label: str, **kw) -> DataFrame:
    if name.startswith("baseline_"):
        return baseline_predictions(train, test, label, name)
    if name.startswith("lightgbm_"):
        objective = "logistic" if name.endswith("classifier") else "squared"
        return boosting.fit(train, features, label, boosting.Boosting(objective, **({"n_estimators": 100} | kw))).transform(test)
    rows = train.count() if name in ("ridge", "logistic_regression") else 0
    return predict(pipeline(name, features, label, rows, **kw).fit(train), test)


# --- metrics ---------------------------------------------------------------------------------------


def regression_metrics(df: DataFrame, by: list[str], y: str = "actual", yhat: str = "prediction") -> DataFrame:
    e = F.col(y) - F.col(yhat)
    rows = df.withColumn("_ae", F.abs(e))
    both = (F.col(y) != 0) & (F.col(yhat) != 0)
    g = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_ae").alias("MAE"), F.sqrt(F.avg(e * e)).alias("RMSE"), (1 - div(F.sum(e * e), F.var_pop(y) * F.count(F.lit(1)))).alias("R2"),
        F.avg(F.when(both, (F.signum(y) == F.signum(yhat)).cast("double"))).alias("Directional_Accuracy"),
    )
    return g.join(quantiles(rows, by, "_ae", {"MedAE": 0.5}), by)


def classification_metrics(df: DataFrame, by: list[str], y: str = "actual", yhat: str = "prediction") -> DataFrame:
    """Counts and ratios with a zero division giving zero."""
    pos, hit = F.col(y) == 1, F.col(yhat) == 1
    g = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(pos & hit).alias("TP"), F.count_if(~pos & hit).alias("FP"), F.count_if(~pos & ~hit).alias("TN"), F.count_if(pos & ~hit).alias("FN")
    )
    ratio = lambda a, b: F.coalesce(div(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn = F.col("TP"), F.col("FP"), F.col("FN")
    return g.withColumns(
        {"Accuracy": ratio(tp + F.col("TN"), F.col("n")), "Precision": ratio(tp, tp + fp), "Recall": ratio(tp, tp + fn), "F1": ratio(2 * tp, 2 * tp + fp + fn)}
    )


def probability_metrics(df: DataFrame, by: list[str], y: str = "actual", p: str = "probability") -> DataFrame:
    """ROC_AUC from ranks, PR_AUC as average precision, LogLoss; null areas when one class is absent.

    Scores are counted per value first, so ties and large groups are handled by ordering.py.
    """
    counts = df.where(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(y) == 1).alias("pos"))
    c = cumulative(counts, by, p, ["n", "pos"])
    rank = F.col("n_before") + (F.col("n") + 1) / F.lit(2.0)
    precision = (F.col("pos_total") - F.col("pos_before")) / (F.col("n_total") - F.col("n_before"))
    q = F.least(F.greatest(F.col(p), F.lit(EPS)), F.lit(1 - EPS))
    loss = -(F.col("pos") * F.ln(q) + (F.col("n") - F.col("pos")) * F.ln(1 - q))
    g = c.groupBy(*by).agg(
        F.max("pos_total").alias("_p"), F.max("n_total").alias("_n"), F.sum(F.col("pos") * rank).alias("_r"), F.sum(F.col("pos") * precision).alias("_ap"), F.sum(loss).alias("_ll")
    )
    np, nn = F.col("_p").cast("double"), (F.col("_n") - F.col("_p")).cast("double")
    return g.select(
        *by, div(F.col("_r") - np * (np + 1) / 2, np * nn).alias("ROC_AUC"), F.when(nn > 0, div(F.col("_ap"), np)).alias("PR_AUC"), (F.col("_ll") / F.col("_n")).alias("LogLoss")
    )


def brier(df: DataFrame, by: list[str], y: str = "actual", p: str = "probability") -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(p) - F.col(y)) ** 2).alias("Brier_Score"))


def reliability_curve(df: DataFrame, by: list[str], y: str = "actual", p: str = "probability", bins: int = 10) -> DataFrame:
    """Mean outcome and mean forecast in uniform bins; a value on an edge belongs to the lower bin."""
    edges = F.array(*[F.lit(i * (1.0 / bins)) for i in range(1, bins)])
    b = F.size(F.filter(edges, lambda e: e < F.col(p)))
    return df.withColumn("bin", b).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("prob_true"), F.avg(p).alias("prob_pred"))


def calibrate(calibration: DataFrame, test: DataFrame, y: str = "actual", score: str = "probability", method: str = "isotonic") -> DataFrame:
    """`calibrated` probability on `test`, learned from independent rows. Equal scores are pooled first."""
    if method == "isotonic":
        return isotonic.fit(calibration, score, y).predict(test, score)
    if method != "sigmoid":
        raise ValueError(f"Unknown calibration: {method}")
    two = calibration.groupBy(score, F.col(y).cast("double").alias("_y")).agg(F.count(F.lit(1)).cast("double").alias("_w"))
    vec = VectorAssembler(inputCols=[score], outputCol="_s")
    fit = LogisticRegression(featuresCol="_s", labelCol="_y", weightCol="_w", probabilityCol="_p", predictionCol="_c", rawPredictionCol="_r").fit(vec.transform(two))
    out = fit.transform(vec.transform(test))
    return out.withColumn("calibrated", vector_to_array("_p")[1]).drop("_s", "_p", "_c", "_r")


class HoldoutLocked(PermissionError):
    """The holdout is opened only on explicit confirmation."""


def evaluate_holdout(df: DataFrame, by: list[str], certified: bool, classification: bool, y: str = "actual") -> DataFrame:
    if not certified:
        raise HoldoutLocked("Final holdout evaluation needs explicit certification")
    if classification:
        return classification_metrics(df, by, y).join(probability_metrics(df, by, y), by).join(brier(df, by, y), by)
    e = F.col(y) - F.col("prediction")
    residual = df.groupBy(*by).agg(F.avg(e).alias("Residual_Mean_Bias"), F.var_pop(e).alias("Residual_Variance"))
    return regression_metrics(df, by, y).join(residual, by)


def compare_to_baseline(model: DataFrame, baseline: DataFrame) -> DataFrame:
    """metric, value tables side by side with the winner."""
    j = model.select("metric", F.col("value").alias("model_value")).join(baseline.select("metric", F.col("value").alias("baseline_value")), "metric")
    lower = F.col("metric").isin(*LOWER_IS_BETTER)
    better = F.when(lower, F.col("model_value") < F.col("baseline_value")).otherwise(F.col("model_value") > F.col("baseline_value"))
    return j.withColumn("improvement", F.when(lower, F.col("baseline_value") - F.col("model_value")).otherwise(F.col("model_value") - F.col("baseline_value"))).withColumn("beats_baseline", better)


# --- validation ------------------------------------------------------------------------------------


def walk_forward(df: DataFrame, name: str, features: list[str], label: str, at: str, train_window: int, step: int, gap: int = 0, mode: str = "expanding", **kw) -> DataFrame:
    """Out-of-fold predictions: (rows, fold, prediction[, probability]). A fresh pipeline per fold."""
    lo, hi = df.agg(F.min(at), F.max(at)).first()
    kind = df.schema[at].dataType.simpleString()
    lit = lambda v: F.lit(v).cast(kind)
    out = None
    for k, a, b, c, d in walk_forward_bounds(lo, hi, train_window, step, gap, mode):
        train = df.where((F.col(at) >= lit(a)) & (F.col(at) < lit(b)))
        test = df.where((F.col(at) >= lit(c)) & (F.col(at) < lit(d)))
        if train.isEmpty() or test.isEmpty():
            continue
        rows = fit_predict(name, train, test, features, label, **kw).withColumn("fold", F.lit(k))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("No valid folds completed.")
    return out


def fold_summary(metrics: DataFrame, primary: str) -> DataFrame:
    """Mean, population std, best and worst fold of one metric."""
    lower = primary in LOWER_IS_BETTER
    best, worst = (F.min_by, F.max_by) if lower else (F.max_by, F.min_by)
    m = F.col(primary)
    return metrics.agg(
        F.count(F.lit(1)).alias("folds_completed"), F.avg(m).alias("mean_primary_metric"), F.stddev_pop(m).alias("std_primary_metric"),
        best("fold", m).alias("best_fold"), worst("fold", m).alias("worst_fold"),
    ).withColumn("primary_metric", F.lit(primary))


def walk_forward_linear(df: DataFrame, name: str, features: list[str], label: str, at: str, train_window: int, step: int, gap: int = 0, mode: str = "expanding", alpha: float = 1.0) -> DataFrame:
    """n, RMSE and R2 of a linear model on every fold of `walk_forward`, all folds from one pass over the rows."""
    lo, hi = df.agg(F.min(at), F.max(at)).first()
    ranges = [(k, ((a, False), (b, False)), ((c, False), (d, False))) for k, a, b, c, d in walk_forward_bounds(lo, hi, train_window, step, gap, mode)]
    rows = [(f.fold, *f.score(name, alpha).values()) for f in additive.folds(df, features, label, at, ranges)]
    if not rows:
        raise ValueError("No valid folds completed.")
    return df.sparkSession.createDataFrame(rows, "fold int, n long, RMSE double, R2 double")


# Search ranges (low, high, logarithmic).
SEARCH_SPACE = {
    "xgboost": {"n_estimators": (50, 300, False), "max_depth": (2, 8, False), "learning_rate": (1e-3, 0.1, True), "subsample": (0.5, 1.0, False)},
    "lightgbm": {"n_estimators": (50, 300, False), "max_depth": (2, 8, False), "learning_rate": (1e-3, 0.1, True), "num_leaves": (10, 50, False)},
    "linear": {"alpha": (1e-4, 1e2, True)},
}


def search_space(name: str) -> dict:
    kind = {"gbt": "xgboost", "xgboost": "xgboost", "lightgbm": "lightgbm", "ridge": "linear", "lasso": "linear", "elastic": "linear"}.get(name.split("_")[0])
    if kind is None:
        raise ValueError(f"No search space for {name}")
    return SEARCH_SPACE[kind]


def search(
    df: DataFrame, name: str, features: list[str], label: str, at: str, trials: int = 20, metric: str = "RMSE", n_splits: int = 3, gap: int = 0,
    seed: int = 42, startup: int = 10, space: dict | None = None,
) -> DataFrame:
    """A table of trials with their mean fold metric over embargoed folds, best first: candidate, params, value, metric, rank.

    Parameters are suggested from the trials before (`sampler`). Linear models judged by RMSE or R2 take every fold and trial from
    one pass (`additive`); others fit each fold of each trial.
    """
    days = embargo_folds(df, at, n_splits, gap)
    spans = days.groupBy("fold", "role").agg(F.min(at).alias("a"), F.max(at).alias("b")).collect()  # two rows a fold
    at_fold = {(r.fold, r.role): ((r.a, False), (r.b, True)) for r in spans}
    numbers = sorted({k for k, _ in at_fold})
    sign = 1.0 if metric in LOWER_IS_BETTER else -1.0
    if name in additive.PENALTIES and metric in ("RMSE", "R2"):
        parts = additive.folds(df, features, label, at, [(k, at_fold[k, "TRAIN"], at_fold[k, "VALIDATION"]) for k in numbers])

        def value(p: dict) -> float:
            return sum(f.score(name, p.get("alpha", 1.0))[metric] for f in parts) / len(parts)
    else:
        rows = materialize(df.join(days, at), "folds")

        def value(p: dict) -> float:
            preds = None
            for k in numbers:
                part = rows.where(F.col("fold") == k)
                one = fit_predict(name, part.where("role = 'TRAIN'"), part.where("role = 'VALIDATION'"), features, label, **p)
                preds = one if preds is None else preds.unionByName(one)
            if metric in ("PR_AUC", "ROC_AUC", "LogLoss"):
                m = probability_metrics(preds, ["fold"], label)
            else:
                m = regression_metrics(preds, ["fold"], label) if metric in ("RMSE", "MAE", "MedAE", "R2") else classification_metrics(preds, ["fold"], label)
            return float(m.agg(F.avg(metric)).first()[0])

    done = sampler.minimise(space or search_space(name), lambda p: sign * value(p), trials, seed, startup)
    out = df.sparkSession.createDataFrame([(i, str(sorted(p.items())), sign * v) for i, (p, v) in enumerate(done)], "candidate int, params string, value double").withColumn("metric", F.lit(metric))
    order = F.asc("value") if metric in LOWER_IS_BETTER else F.desc("value")
    return out.withColumn("rank", F.row_number().over(Window.orderBy(order, "candidate")))  # one row a trial


# --- explanation -----------------------------------------------------------------------------------


def shuffled(df: DataFrame, column: str, keys: list[str], seed: int) -> DataFrame:
    """The frame with one column permuted over all rows.

    Rows get two random but repeatable positions; the value at position i of the second order goes to the
    row at position i of the first. Positions come from range-cut running counts, not one global sort.
    """

    def placed(salt: str) -> DataFrame:
        h = df.withColumn("_h", F.xxhash64(F.lit(f"{salt}{seed}"), *keys)).withColumn("_one", F.lit(1))
        pos = positions(h, ["_one"], "_h").select("_h", "n_before")
        tie = F.row_number().over(Window.partitionBy("_h").orderBy(*keys)) - 1
        return h.withColumn("_tie", tie).join(pos, "_h").withColumn("_i", F.col("n_before") + F.col("_tie")).drop("_h", "_one", "_tie", "n_before")

    values = placed("b").select("_i", F.col(column).alias("_v"))
    return placed("a").join(values, "_i").withColumn(column, F.col("_v")).select(*df.columns)


def permutation_importance(model: PipelineModel, df: DataFrame, features: list[str], label: str, keys: list[str], repeats: int = 5, seed: int = 42) -> DataFrame:
    """Mean and population std of the fall in R2 when one feature is shuffled."""
    scored = predict(model, df).withColumns({"feature": F.lit("(none)"), "repeat": F.lit(0)})
    for c in features:
        for k in range(repeats):
            scored = scored.unionByName(predict(model, shuffled(df, c, keys, seed + k)).withColumns({"feature": F.lit(c), "repeat": F.lit(k)}))
    e = F.col(label) - F.col("prediction")
    r2 = scored.groupBy("feature", "repeat").agg((1 - F.sum(e * e) / F.nullif(F.var_pop(label) * F.count(F.lit(1)), F.lit(0.0))).alias("r2"))
    base = r2.where("feature = '(none)'").select(F.col("r2").alias("_base"), F.lit(1).alias("_k"))
    drops = r2.where("feature <> '(none)'").withColumn("_k", F.lit(1)).join(base, "_k").withColumn("_d", F.col("_base") - F.col("r2"))
    return drops.groupBy("feature").agg(F.avg("_d").alias("importance_value"), F.stddev_pop("_d").alias("importance_std"))


def linear_attributions(model: PipelineModel, df: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """Exact attributions of a linear model: coef x (value - training mean), with the mean forecast as base."""
    imputer, _, scaler, reg = model.stages
    fill = imputer.surrogateDF.first().asDict()
    cols = []
    for i, c in enumerate(features):
        sd = float(scaler.std[i]) or 1.0
        x = (F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c)), F.lit(float(fill[c]))) - float(scaler.mean[i])) / sd
        cols.append((c, x * float(reg.coefficients[i])))
    phi = F.map_from_arrays(F.array(*[F.lit(c) for c, _ in cols]), F.array(*[v for _, v in cols]))
    total = sum((v for _, v in cols), F.lit(float(reg.intercept)))
    return df.select(*keys, F.lit(float(reg.intercept)).alias("base_value"), phi.alias("attributions"), total.alias("prediction"))


def global_attributions(local: DataFrame) -> DataFrame:
    return local.select(F.explode("attributions").alias("feature", "phi")).groupBy("feature").agg(F.avg(F.abs("phi")).alias("importance_value"), F.stddev_pop("phi").alias("importance_std"))


def importance_stability(history: DataFrame, by: list[str] = ("model_version", "feature")) -> DataFrame:
    """Coefficient of variation over periods and its class; at least two periods."""
    g = history.groupBy(*by).agg(F.count(F.lit(1)).alias("periods"), (F.stddev_pop("importance_value") / F.nullif(F.avg("importance_value") + 1e-9, F.lit(0.0))).alias("stability_score"))
    label = F.when(F.col("stability_score") < 0.5, "STABLE").when(F.col("stability_score") > 1.5, "UNSTABLE").otherwise("REGIME_DEPENDENT")
    return g.where("periods >= 2").withColumn("stability_classification", label)


def ablation(df: DataFrame, groups: dict[str, list[str]], name: str, label: str, at: str, train_window: int, step: int, gap: int = 0, **kw) -> DataFrame:
    """Accuracy of cumulative feature groups, each measured walk-forward, with increments and stability."""
    rows = None
    for i, g in enumerate(groups):
        feats = [c for k in list(groups)[: i + 1] for c in groups[k]]
        m = classification_metrics(walk_forward(df, name, feats, label, at, train_window, step, gap, **kw), ["fold"], label)
        one = m.agg(F.avg("Accuracy").alias("accuracy"), F.min("Accuracy").alias("worst_fold")).select(F.lit(i).alias("step"), F.lit(g).alias("feature_group"), "accuracy", "worst_fold")
        rows = one if rows is None else rows.unionByName(one)
    prev = F.lag("accuracy").over(Window.orderBy("step"))
    return rows.withColumn("increment", F.col("accuracy") - F.coalesce(prev, F.lit(0.0))).withColumn("is_stable", F.col("worst_fold") >= 0.5)


