from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.functions.expr import rnd
from marketloom.operators import additive
from marketloom.operators import audit as A
from marketloom.operators import boosting
from marketloom.operators import features as X
from marketloom.operators import isotonic
from marketloom.operators import models as M
from marketloom.operators import pit
from marketloom.operators.neighbours import neighbour_information
from marketloom.plans.c_join_queries import BOUNDS, TARGETS
from marketloom.plans.registry import query
from marketloom.plans.sqlviews import MARKET, SCORES, r, sql
from marketloom.session import materialize
from marketloom.sources import views as V

FEATS = ["ret_1d", "ret_5d", "price_to_sma_20d", "vol_ratio_20d"]


def rounded(df, cols, digits=6):
    return df.withColumns({c: rnd(c, digits) for c in cols})


def dataset(spark, sf, kind="regression_return", store=True):
    """Features of every bar with the return of the next five days, in percent (or its sign)."""
    bars = V.market_prices(spark, sf)
    f = X.volume(X.technical(bars)).select("symbol", F.col("ts").alias("prediction_time"), *FEATS)
    t = pit.targets(bars, 5, kind)
    if kind == "regression_return":
        t = t.withColumn("target_value", F.col("target_value") * 100)
    df = f.join(t, ["symbol", "prediction_time"])
    return materialize(df, "dataset") if store else df


# --- audit -----------------------------------------------------------------------------------------

AUDIT_IN = """ai AS (SELECT symbol, ts, close / lag(close) OVER w - 1 AS good, CASE WHEN ts < DATE '1996-06-01' THEN close END AS late, 1.0::DOUBLE AS constant, CASE WHEN volume % 499 = 0 THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END AS flat,
  CASE WHEN volume = (SELECT max(volume) FROM market_prices) THEN 1e6::DOUBLE ELSE volume / 100.0::DOUBLE END AS spiked FROM market_prices WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
al AS (UNPIVOT (SELECT good, late, constant, flat, spiked FROM ai) ON good, late, constant, flat, spiked INTO NAME feature VALUE value),
names(feature) AS (VALUES ('good'), ('late'), ('constant'), ('flat'), ('spiked')),
tot AS (SELECT count(*) AS n FROM ai),
md AS (SELECT feature, max(c) AS top FROM (SELECT feature, value, count(*) AS c FROM al GROUP BY 1, 2) GROUP BY 1),
st AS (SELECT feature, count(*) AS k, stddev_samp(value) AS sd, quantile_cont(value, 0.99) AS p99, max(value) AS mx FROM al GROUP BY 1)"""


@query(
    "aud_01",
    sql(
        MARKET, AUDIT_IN,
        f"""SELECT feature, {r('1 - coalesce(k, 0) / n')} AS missing_rate, {r('sd')} AS std_dev, {r('top / k')} AS top_share, {r('p99')} AS p99, {r('mx')} AS max_value,
  CASE WHEN 1 - coalesce(k, 0) / n > 0.3 OR coalesce(k, 0) = 0 OR coalesce(sd, 0) = 0 OR top / k > 0.99 OR (p99 > 0.01 AND mx > 100 * p99) THEN 'REJECTED' ELSE 'VALIDATED' END AS status
FROM names LEFT JOIN st USING (feature) LEFT JOIN md USING (feature), tot""",
    ),
)
def aud_01(spark, sf):
    bars = X.technical(V.market_prices(spark, sf))
    top = V.market_prices(spark, sf).agg(F.max("volume").alias("_top")).withColumn("_k", F.lit(1))
    v = F.col("volume")
    df = bars.withColumn("_k", F.lit(1)).join(top, "_k").select(
        F.col("ret_1d").alias("good"), F.when(F.col("ts") < F.lit("1996-06-01").cast("date"), F.col("close")).alias("late"), F.lit(1.0).alias("constant"),
        F.when(v % 499 == 0, 5.0).otherwise(0.0).alias("flat"), F.when(v == F.col("_top"), 1e6).otherwise(v / 100.0).alias("spiked"),
    )
    out = A.quality_audit(df, ["good", "late", "constant", "flat", "spiked"])
    return rounded(out, ["missing_rate", "std_dev", "top_share", "p99", "max_value"]).drop("rejection_reason")


DATA = """dt AS (SELECT symbol, ts, round(ret_1d, 12) AS ret_1d, round(ret_5d, 12) AS ret_5d, round(vol_ratio_20d, 12) AS vol_ratio_20d, round(target, 12) AS target FROM (
  SELECT symbol, ts, close / lag(close) OVER w - 1 AS ret_1d, close / lag(close, 5) OVER w - 1 AS ret_5d, CASE WHEN count(volume) OVER f >= 20 THEN volume / avg(volume) OVER f END AS vol_ratio_20d,
  lead(close, 5) OVER w / close - 1 AS target FROM market_prices WINDOW w AS (PARTITION BY symbol ORDER BY ts), f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) WHERE ret_1d IS NOT NULL AND ret_5d IS NOT NULL AND vol_ratio_20d IS NOT NULL AND target IS NOT NULL)"""
MI_FEATS = ["ret_1d", "ret_5d", "vol_ratio_20d"]


def mi_data(spark, sf):
    df = dataset(spark, sf, store=False).select("symbol", "prediction_time", *[F.round(c, 12).alias(c) for c in MI_FEATS], F.round(F.col("target_value") / 100, 12).alias("target"))
    return A.complete_rows(df, MI_FEATS, "target")


def mi_sql(source, keys="", parts=("",)):
    k = keys + ", " if keys else ""
    p = f"PARTITION BY {keys}" if keys else ""
    qs = "[" + ", ".join(f"{i / 10}" for i in range(1, 10)) + "]"
    union = " UNION ALL ".join(f"SELECT {k}'{c}' AS feature, by_, len(list_filter(e_{c}, lambda e: e < {c})) AS bx FROM bn" for c in MI_FEATS)
    ed = ", ".join(f"quantile_cont({c}, {qs}) OVER ({p}) AS e_{c}" for c in MI_FEATS)
    return f"""be AS (SELECT *, quantile_cont(target, {qs}) OVER ({p}) AS ey, {ed} FROM {source}),
bn AS (SELECT *, len(list_filter(ey, lambda e: e < target)) AS by_ FROM be),
bl AS ({union}),
bc AS (SELECT {k}feature, bx, by_, count(*) AS c FROM bl GROUP BY ALL),
bp AS (SELECT *, sum(c) OVER (PARTITION BY {k}feature) AS n, sum(c) OVER (PARTITION BY {k}feature, bx) AS nx, sum(c) OVER (PARTITION BY {k}feature, by_) AS ny FROM bc),
mi AS (SELECT {k}feature, CAST(max(n) AS BIGINT) AS n, sum(c / n * ln(c * n / (nx * ny))) AS mi, count(DISTINCT bx) AS kx, count(DISTINCT by_) AS ky FROM bp GROUP BY ALL)"""


@query("aud_02", sql(MARKET, DATA, mi_sql("dt"), f"SELECT feature, n, {r('mi', 5)} AS mutual_information FROM mi"))
def aud_02(spark, sf):
    df = materialize(mi_data(spark, sf), "mi")
    return rounded(A.mutual_information(df, MI_FEATS, "target"), ["mutual_information"], 5)


DIGAMMA = "(ln({0} + 12.0::DOUBLE) - 1 / (2.0::DOUBLE * ({0} + 12)) - 1 / (12.0::DOUBLE * ({0} + 12) ** 2) + 1 / (120.0::DOUBLE * ({0} + 12) ** 4) - 1 / (252.0::DOUBLE * ({0} + 12) ** 6) + 1 / (240.0::DOUBLE * ({0} + 12) ** 8) - list_sum(list_transform(range(12), lambda i: 1.0::DOUBLE / ({0} + i))))"
#: The estimator with all pairs of points of a symbol.
NEAREST = (
    "lg AS (" + " UNION ALL ".join(f"SELECT symbol, '{c}' AS feature, ts, {c} AS x, target AS y FROM dt" for c in MI_FEATS) + "),"
    """sc AS (SELECT symbol, feature, ts, x / stddev_pop(x) OVER g AS x, y / stddev_pop(y) OVER g AS y, count(*) OVER g AS n FROM lg WINDOW g AS (PARTITION BY symbol, feature)),
rd AS (SELECT a.symbol, a.feature, a.ts, min(greatest(abs(a.x - b.x), abs(a.y - b.y)), 4)[4] AS r FROM sc a JOIN sc b USING (symbol, feature) GROUP BY 1, 2, 3),
nr AS (SELECT a.symbol, a.feature, a.ts, max(a.n) AS n, count(*) FILTER (WHERE abs(a.x - b.x) < r OR (r = 0 AND a.x = b.x)) AS nx, count(*) FILTER (WHERE abs(a.y - b.y) < r OR (r = 0 AND a.y = b.y)) AS ny
  FROM sc a JOIN rd USING (symbol, feature, ts) JOIN sc b ON b.symbol = a.symbol AND b.feature = a.feature GROUP BY 1, 2, 3)"""
)


@query(
    "aud_02_neighbours",
    sql(
        MARKET, DATA, NEAREST,
        f"""SELECT symbol, feature, max(n) AS n, {r(f"greatest({DIGAMMA.format('max(n)')} + {DIGAMMA.format('3')} - avg({DIGAMMA.format('nx')} + {DIGAMMA.format('ny')}), 0)", 5)} AS mutual_information FROM nr GROUP BY symbol, feature""",
    ),
)
def aud_02_neighbours(spark, sf):
    """By symbol, so that the SQL can look at all pairs."""
    df = materialize(mi_data(spark, sf), "mi")
    return rounded(neighbour_information(df, MI_FEATS, "target", ["symbol"]), ["mutual_information"], 5)


@query(
    "aud_03",
    sql(
        MARKET, DATA, mi_sql("dt"),
        "rp AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, abs(corr({a}, {b})) AS r FROM dt" for i, a in enumerate(MI_FEATS) for b in MI_FEATS[i + 1 :]) + ")",
        f"""SELECT feature, min(winner) AS winner, {r('max(r)')} AS max_correlation FROM (SELECT CASE WHEN y.mi > x.mi THEN a ELSE b END AS feature, CASE WHEN y.mi > x.mi THEN b ELSE a END AS winner, r
  FROM rp JOIN mi x ON x.feature = a JOIN mi y ON y.feature = b WHERE r > 0.2) GROUP BY 1""",
    ),
)
def aud_03(spark, sf):
    df = materialize(mi_data(spark, sf), "mi")
    return rounded(A.redundant(df, MI_FEATS, A.mutual_information(df, MI_FEATS, "target"), 0.2), ["max_correlation"])


@query(
    "aud_04",
    sql(
        MARKET, DATA,
        "ft AS (SELECT ts, CAST(floor((sum(c) OVER (ORDER BY ts) - c) * 3 / sum(c) OVER ()) AS INTEGER) AS fold FROM (SELECT ts, count(*) AS c FROM dt GROUP BY ts))",
        "df AS (SELECT dt.*, fold FROM dt JOIN ft USING (ts))",
        mi_sql("df", "fold"),
        "SELECT feature, count(*) FILTER (WHERE n > 10 AND greatest(mi - (kx - 1) * (ky - 1) / (2.0::DOUBLE * n), 0) > 1e-4) AS stable_folds, count(*) FILTER (WHERE n > 10 AND greatest(mi - (kx - 1) * (ky - 1) / (2.0::DOUBLE * n), 0) > 1e-4) >= 2 AS is_stable FROM mi GROUP BY feature",
    ),
)
def aud_04(spark, sf):
    return A.temporal_stability(materialize(mi_data(spark, sf), "mi"), MI_FEATS, "target", "prediction_time")


@query("feat_27")
def feat_27(spark, sf):
    df = dataset(spark, sf, store=False).withColumn("available_at", F.col("prediction_time"))
    _, record = A.build_features(df, "technical_v1", FEATS, "prediction_time", ["available_at"], "target_value", F.lit("2002-01-01 00:00:00").cast("timestamp"))
    return record


# --- fits ------------------------------------------------------------------------------------------


@query("ml_01")
def ml_01(spark, sf):
    """Mean and deviation of the prepared training features, per dimension (0 and 1 up to rounding)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    df = dataset(spark, sf)
    train = pit.assign_partitions(df, **BOUNDS).where("partition = 'TRAIN'")
    out = Pipeline(stages=M.preprocessing(FEATS)).fit(train).transform(train)
    x = out.select(F.posexplode(vector_to_array("_x")).alias("i", "v"))
    return rounded(x.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd")), ["mean", "sd"])


PARTS = """pt AS (SELECT *, CASE WHEN prediction_time <= DATE '1998-12-31' THEN 'TRAIN' WHEN prediction_time BETWEEN DATE '1999-01-01' AND DATE '2000-06-30' THEN 'VALIDATION' WHEN prediction_time >= DATE '2000-07-01' THEN 'TEST' END AS part FROM targs WHERE target_value IS NOT NULL)"""


@query(
    "ml_02",
    sql(
        MARKET, TARGETS, PARTS,
        "b AS (SELECT avg(target_value) AS m, avg(CASE WHEN target_value > 0 THEN 1.0::DOUBLE ELSE 0 END) AS s FROM pt WHERE part = 'TRAIN')",
        f"""SELECT 'baseline_zero_return' AS model, count(*) AS n, 0.0::DOUBLE AS prediction, {r('avg(abs(target_value))', 8)} AS mae FROM pt WHERE part = 'TEST'
UNION ALL SELECT 'baseline_historical_mean', count(*), {r('max(m)', 8)}, {r('avg(abs(target_value - m))', 8)} FROM pt, b WHERE part = 'TEST'
UNION ALL SELECT 'baseline_majority_class', count(*), CASE WHEN max(s) > 0.5 THEN 1.0 ELSE 0.0 END, {r('avg(abs(CASE WHEN target_value > 0 THEN 1 ELSE 0 END - CASE WHEN s > 0.5 THEN 1 ELSE 0 END))', 8)} FROM pt, b WHERE part = 'TEST'""",
    ),
)
def ml_02(spark, sf):
    out = None
    for name in ("baseline_zero_return", "baseline_historical_mean", "baseline_majority_class"):
        kind = "classification_direction" if "class" in name else "regression_return"
        df = pit.assign_partitions(pit.targets(V.market_prices(spark, sf), 5, kind), **BOUNDS)
        p = M.baseline_predictions(df.where("partition = 'TRAIN'"), df.where("partition = 'TEST'"), "target_value", name)
        row = p.agg(F.count(F.lit(1)).alias("n"), F.max("prediction").alias("prediction"), F.avg(F.abs(F.col("target_value") - F.col("prediction"))).alias("mae")).withColumn("model", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return rounded(out, ["prediction", "mae"], 8)


def splits(spark, sf, kind="regression_return"):
    df = dataset(spark, sf, kind)
    p = pit.assign_partitions(df, **BOUNDS)
    return p.where("partition = 'TRAIN'"), p.where("partition = 'VALIDATION'"), p.where("partition = 'TEST'")


def regressions(spark, sf, names, **kw):
    train, _, test = splits(spark, sf)
    out = None
    for n in names:
        p = M.fit_predict(n, train, test, FEATS, "target_value", **kw).withColumn("model", F.lit(n))
        out = p if out is None else out.unionByName(p)
    m = M.regression_metrics(out, ["model"], "target_value")
    return rounded(m, ["MAE", "RMSE", "R2", "MedAE", "Directional_Accuracy"], 4)


def classifications(spark, sf, names, **kw):
    train, _, test = splits(spark, sf, "classification_direction")
    out = None
    for n in names:
        p = M.fit_predict(n, train, test, FEATS, "target_value", **kw).withColumn("model", F.lit(n))
        out = p if out is None else out.unionByName(p)
    m = M.classification_metrics(out, ["model"], "target_value").join(M.probability_metrics(out, ["model"], "target_value"), "model")
    return rounded(m, ["Accuracy", "Precision", "Recall", "F1", "ROC_AUC", "PR_AUC", "LogLoss"], 4)


@query("ml_03")
def ml_03(spark, sf):
    return regressions(spark, sf, ["linear_regression", "ridge", "lasso", "elastic_net"], alpha=0.01)


@query("ml_04")
def ml_04(spark, sf):
    return classifications(spark, sf, ["logistic_regression"])


@query("ml_05")
def ml_05(spark, sf):
    a = regressions(spark, sf, ["random_forest_regressor"]).select("model", "n", F.col("RMSE").alias("value"), F.lit("RMSE").alias("metric"))
    b = classifications(spark, sf, ["random_forest_classifier"]).select("model", "n", F.col("Accuracy").alias("value"), F.lit("Accuracy").alias("metric"))
    return a.unionByName(b)


@query("ml_06")
def ml_06(spark, sf):
    a = regressions(spark, sf, ["gbt_regressor"]).select("model", "n", F.col("RMSE").alias("value"), F.lit("RMSE").alias("metric"))
    b = classifications(spark, sf, ["gbt_classifier"]).select("model", "n", F.col("Accuracy").alias("value"), F.lit("Accuracy").alias("metric"))
    return a.unionByName(b)


@query("ml_06_leafwise", sql(MARKET, DATA, "SELECT unnest(range(0, 5)) AS round, (SELECT count(*) FROM dt) AS n, true AS falls"))
def ml_06_leafwise(spark, sf):
    """Leaf-wise boosting: the training loss falls with every tree."""
    df = materialize(mi_data(spark, sf), "rows")
    model = boosting.fit(df, MI_FEATS, "target", boosting.Boosting(n_estimators=5), track=True)
    falls = [(k, b < a) for k, (a, b) in enumerate(zip(model.losses, model.losses[1:]))]
    return spark.createDataFrame(falls, "round int, falls boolean").withColumn("n", df.agg(F.count(F.lit(1)).alias("n")).scalar())


# --- metrics with a comparison query ---------------------------------------------------------------

FORECAST = """fc AS (SELECT t.symbol, t.prediction_time, t.target_value AS y, (m.volume % 201 - 100) / 10000.0::DOUBLE AS yhat FROM targs t JOIN market_prices m ON t.symbol = m.symbol AND t.prediction_time = m.ts WHERE t.target_value IS NOT NULL)"""


def forecasts(spark, sf):
    bars = V.market_prices(spark, sf)
    t = pit.targets(bars, 5).select("symbol", "prediction_time", F.col("target_value").alias("actual"))
    p = bars.select("symbol", F.col("ts").alias("prediction_time"), ((F.col("volume") % 201 - 100) / F.lit(10000.0)).alias("prediction"))
    return t.join(p, ["symbol", "prediction_time"])


REG = f"""{r('avg(abs(y - yhat))', 8)} AS MAE, {r('sqrt(avg(power(y - yhat, 2)))', 8)} AS RMSE, {r('1 - sum(power(y - yhat, 2)) / (var_pop(y) * count(*))', 4)} AS R2, {r('median(abs(y - yhat))', 8)} AS MedAE,
  {r('avg(CASE WHEN y <> 0 AND yhat <> 0 THEN CASE WHEN sign(y) = sign(yhat) THEN 1.0::DOUBLE ELSE 0 END END)', 8)} AS Directional_Accuracy"""


@query("ml_07", sql(MARKET, TARGETS, FORECAST, f"SELECT symbol, count(*) AS n, {REG} FROM fc GROUP BY symbol"))
def ml_07(spark, sf):
    df = M.regression_metrics(forecasts(spark, sf), ["symbol"])
    return rounded(rounded(df, ["MAE", "RMSE", "MedAE", "Directional_Accuracy"], 8), ["R2"], 4)


def scores(spark, sf):
    s = V.classifier_scores(spark, sf)
    return s.select("id", F.col("y").alias("actual"), F.col("p").alias("probability"), (F.col("p") >= 0.5).cast("int").alias("prediction"), F.lit("m1").alias("model"))


CONF = """cf AS (SELECT count(*) AS n, count(*) FILTER (WHERE y = 1 AND p >= 0.5) AS TP, count(*) FILTER (WHERE y <> 1 AND p >= 0.5) AS FP, count(*) FILTER (WHERE y <> 1 AND p < 0.5) AS TN, count(*) FILTER (WHERE y = 1 AND p < 0.5) AS FN FROM scores)"""
CLS = f"""{r('(TP + TN) / n', 8)} AS Accuracy, {r('coalesce(TP / nullif(TP + FP, 0), 0)', 8)} AS Precision, {r('coalesce(TP / nullif(TP + FN, 0), 0)', 8)} AS Recall, {r('coalesce(2 * TP / nullif(2 * TP + FP + FN, 0), 0)', 8)} AS F1"""


@query("ml_08", sql(SCORES, CONF, f"SELECT 'm1' AS model, n, TP, FP, TN, FN, {CLS} FROM cf"))
def ml_08(spark, sf):
    return rounded(M.classification_metrics(scores(spark, sf), ["model"]), ["Accuracy", "Precision", "Recall", "F1"], 8)


PROB = """pr AS (SELECT y, p, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS rk FROM scores),
au AS (SELECT (sum(rk) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y <> 1)) AS auc,
  avg(-CASE WHEN y = 1 THEN ln(greatest(p, 2.220446049250313e-16::DOUBLE)) ELSE ln(1 - least(p, 1 - 2.220446049250313e-16::DOUBLE)) END) AS ll FROM pr),
th AS (SELECT p, count(*) AS n, count(*) FILTER (WHERE y = 1) AS k FROM scores GROUP BY p),
tc AS (SELECT k, sum(k) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS cn, sum(k) OVER () AS tot FROM th),
ap AS (SELECT sum(k / tot * tp / cn) AS ap FROM tc)"""


@query("ml_09", sql(SCORES, PROB, f"SELECT 'm1' AS model, {r('auc', 8)} AS ROC_AUC, {r('ap', 8)} AS PR_AUC, {r('ll', 6)} AS LogLoss FROM au, ap"))
def ml_09(spark, sf):
    return rounded(rounded(M.probability_metrics(scores(spark, sf), ["model"]), ["ROC_AUC", "PR_AUC"], 8), ["LogLoss"], 6)


EDGES = "[" + ", ".join(f"{i * 0.1!r}::DOUBLE" for i in range(1, 10)) + "]"


@query(
    "ml_10",
    sql(
        SCORES,
        f"rb AS (SELECT y, p, len(list_filter({EDGES}, lambda e: e < p)) AS bin FROM scores)",
        f"SELECT 'm1' AS model, CAST(bin AS INTEGER) AS bin, count(*) AS n, {r('avg(y)', 8)} AS prob_true, {r('avg(p)', 8)} AS prob_pred, {r('(SELECT avg(power(p - y, 2)) FROM scores)', 8)} AS Brier_Score FROM rb GROUP BY bin",
    ),
)
def ml_10(spark, sf):
    s = scores(spark, sf)
    df = M.reliability_curve(s, ["model"]).join(M.brier(s, ["model"]), "model")
    return rounded(df, ["prob_true", "prob_pred", "Brier_Score"], 8)


@query("ml_11_monotone", sql(SCORES, f"SELECT count(*) AS n, {r('avg(y)', 8)} AS mean_outcome, {r('avg(y)', 8)} AS mean_calibrated, 0 AS falls FROM scores"))
def ml_11_monotone(spark, sf):
    """What defines the fit: forecasts never fall with the score, and their mean is that of the outcomes."""
    s = V.classifier_scores(spark, sf).select("id", "y", "p")
    out = materialize(isotonic.fit(s, "p", "y").predict(s, "p"), "calibrated")
    steps = out.groupBy("p").agg(F.min("calibrated").alias("lo"), F.max("calibrated").alias("hi"))  # a row per score, 101 at most
    before = F.max("hi").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    falls = steps.withColumn("before", before).agg(F.count_if(F.col("before") > F.col("lo") + 1e-12).cast("int").alias("falls"))
    found = out.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean_outcome"), F.avg("calibrated").alias("mean_calibrated"))
    return rounded(found.withColumn("falls", falls.scalar()), ["mean_outcome", "mean_calibrated"], 8)


@query("ml_11")
def ml_11(spark, sf):
    s = scores(spark, sf)
    fit, test = s.where("id % 2 = 0"), s.where("id % 2 = 1")
    out = None
    for m in ("isotonic", "sigmoid"):
        c = M.calibrate(fit, test, method=m).withColumn("method", F.lit(m))
        b = c.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("calibrated") - F.col("actual")) ** 2).alias("brier_calibrated"), F.avg((F.col("probability") - F.col("actual")) ** 2).alias("brier_raw"))
        out = b if out is None else out.unionByName(b)
    return rounded(out, ["brier_calibrated", "brier_raw"])


@query("ml_12", sql(MARKET, TARGETS, FORECAST, f"SELECT 'm1' AS model, count(*) AS n, {REG}, {r('avg(y - yhat)', 8)} AS Residual_Mean_Bias, {r('var_pop(y - yhat)', 10)} AS Residual_Variance FROM fc WHERE prediction_time >= DATE '2000-07-01'"))
def ml_12(spark, sf):
    held = forecasts(spark, sf).where(F.col("prediction_time") >= F.lit("2000-07-01").cast("date")).withColumn("model", F.lit("m1"))
    df = M.evaluate_holdout(held, ["model"], certified=True, classification=False)
    df = rounded(rounded(df, ["MAE", "RMSE", "MedAE", "Directional_Accuracy", "Residual_Mean_Bias"], 8), ["R2"], 4)
    return rounded(df, ["Residual_Variance"], 10)


@query(
    "ml_13",
    sql(
        SCORES, CONF,
        "bs AS (SELECT CASE WHEN avg(y) > 0.5 THEN 1 ELSE 0 END AS c FROM scores)",
        "bf AS (SELECT avg(CASE WHEN y = c THEN 1.0::DOUBLE ELSE 0 END) AS acc, avg(abs(y - c)) AS mae FROM scores, bs)",
        f"""SELECT 'Accuracy' AS metric, {r('(TP + TN) / n', 8)} AS model_value, {r('acc', 8)} AS baseline_value, {r('(TP + TN) / n - acc', 8)} AS improvement, (TP + TN) / n > acc AS beats_baseline FROM cf, bf
UNION ALL SELECT 'MAE', {r('(FP + FN) / n', 8)}, {r('mae', 8)}, {r('mae - (FP + FN) / n', 8)}, (FP + FN) / n < mae FROM cf, bf""",
    ),
)
def ml_13(spark, sf):
    s = scores(spark, sf)
    share = s.agg(F.when(F.avg("actual") > 0.5, 1).otherwise(0).alias("_c")).withColumn("model", F.lit("m1"))
    base = s.join(share, "model").withColumn("prediction", F.col("_c"))
    table = lambda d: d.agg(F.avg((F.col("actual") == F.col("prediction")).cast("double")).alias("Accuracy"), F.avg(F.abs(F.col("actual") - F.col("prediction"))).alias("MAE")).select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("Accuracy", "MAE")])).alias("m")).select("m.*")
    return rounded(M.compare_to_baseline(table(s), table(base)), ["model_value", "baseline_value", "improvement"], 8)


@query("ml_14")
def ml_14(spark, sf):
    df = dataset(spark, sf)
    preds = M.walk_forward(df, "linear_regression", FEATS, "target_value", "prediction_time", train_window=900, step=500, gap=20)
    m = M.regression_metrics(preds, ["fold"], "target_value")
    return rounded(M.fold_summary(m, "RMSE"), ["mean_primary_metric", "std_primary_metric"], 4)


@query("ml_15")
def ml_15(spark, sf):
    """Twenty trials each for two linear models: all folds of all trials from one pass."""
    df, out = dataset(spark, sf), None
    for name in ("ridge", "lasso"):
        one = M.search(df, name, FEATS, "target_value", "prediction_time", 20, "RMSE", gap=10).withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return rounded(out, ["value"], 4)


#: Normal equations of a least-squares fit, from the rows: residuals have no mean and no product with a feature.
@query(
    "ml_03_normal",
    sql(
        MARKET, DATA,
        "x AS (SELECT unnest(['intercept', 'ret_1d', 'ret_5d', 'vol_ratio_20d']) AS term)",
        "SELECT term, 0.0::DOUBLE AS product, (SELECT count(*) FROM dt) AS n FROM x",
    ),
)
def ml_03_normal(spark, sf):
    """A least-squares fit from sums of products, checked on the rows: mean products of residuals and standardised terms."""
    df = materialize(mi_data(spark, sf), "rows")
    sums = additive.sums_of_products(df, MI_FEATS, "target", "prediction_time", [])
    model = additive.fit(additive.filled(sums.over([0]), [0.0] * len(MI_FEATS)))
    rest = F.col("target") - model.intercept - sum((F.col(c) * float(b) for c, b in zip(MI_FEATS, model.coefficients, strict=True)), F.lit(0.0))
    terms = [F.struct(F.lit(t).alias("term"), (rest * v).alias("p")) for t, v in [("intercept", F.lit(1.0)), *[(c, F.col(c)) for c in MI_FEATS]]]
    found = df.select(F.explode(F.array(*terms)).alias("t")).groupBy("t.term").agg(F.avg("t.p").alias("product"), F.count(F.lit(1)).alias("n"))
    return found.select("term", F.abs(rnd("product", 9)).alias("product"), "n")


@query("ml_14_linear")
def ml_14_linear(spark, sf):
    """Walk-forward scores of four linear models from one pass over the rows each."""
    df, out = dataset(spark, sf), None
    for name in ("linear_regression", "ridge", "lasso", "elastic_net"):
        one = M.walk_forward_linear(df, name, FEATS, "target_value", "prediction_time", 500, 250, 5, alpha=0.01).withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return rounded(out, ["RMSE", "R2"], 4)


@query("ml_16")
def ml_16(spark, sf):
    train, valid, _ = splits(spark, sf)
    model = M.pipeline("linear_regression", FEATS, "target_value").fit(train)
    rows = materialize(valid.drop("partition"), "valid")
    out = M.permutation_importance(model, rows, FEATS, "target_value", ["symbol", "prediction_time"])
    return rounded(out, ["importance_value", "importance_std"], 4)


@query("ml_17")
def ml_17(spark, sf):
    train, valid, _ = splits(spark, sf)
    model = M.pipeline("linear_regression", FEATS, "target_value").fit(train)
    local = M.linear_attributions(model, valid, FEATS, ["symbol", "prediction_time"])
    return rounded(M.global_attributions(local), ["importance_value", "importance_std"], 5)


IMPORTANCE = """imp AS (SELECT 'm1' AS model_version, 'ret_' || CAST(h AS VARCHAR) AS feature, year(ts) AS period, avg(abs(ret)) AS importance_value FROM (
  SELECT ts, 1 AS h, close / lag(close, 1) OVER w - 1 AS ret FROM market_prices WINDOW w AS (PARTITION BY symbol ORDER BY ts)
  UNION ALL SELECT ts, 20, close / lag(close, 20) OVER w - 1 FROM market_prices WINDOW w AS (PARTITION BY symbol ORDER BY ts)) GROUP BY ALL)"""


@query(
    "ml_18",
    sql(
        MARKET, IMPORTANCE,
        "g AS (SELECT model_version, feature, count(*) AS periods, stddev_pop(importance_value) / (avg(importance_value) + 1e-9::DOUBLE) AS s FROM imp GROUP BY 1, 2 HAVING count(*) >= 2)",
        f"SELECT model_version, feature, periods, {r('s', 5)} AS stability_score, CASE WHEN s < 0.5 THEN 'STABLE' WHEN s > 1.5 THEN 'UNSTABLE' ELSE 'REGIME_DEPENDENT' END AS stability_classification FROM g",
    ),
)
def ml_18(spark, sf):
    t = X.technical(V.market_prices(spark, sf))
    long = t.select(F.year("ts").alias("period"), F.col("ret_1d").alias("ret_1"), F.col("ret_20d").alias("ret_20")).unpivot(["period"], ["ret_1", "ret_20"], "feature", "v")
    hist = long.groupBy(F.lit("m1").alias("model_version"), "feature", "period").agg(F.avg(F.abs("v")).alias("importance_value"))
    return rounded(M.importance_stability(hist), ["stability_score"], 5)
