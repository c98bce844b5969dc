"""Robustness of predictions by asset, year and regime; reproduction checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.expr import TRADING_DAYS, div, gated, last_n, series
from marketloom.operators.windows import add_expanding_median


def label_regimes(df: DataFrame, by: str = "symbol", ts: str = "ts", window: int = 60) -> DataFrame:
    """Regime_{High,Low}Vol_{Pos,Neg}Ret from trailing values and their expanding median; Unknown while warming up."""
    w = series(by, ts)
    near = last_n(w, window)
    df = df.withColumns(
        {
            "vol_60d": gated(F.stddev_samp("daily_return").over(near) * float(TRADING_DAYS) ** 0.5, "daily_return", near, window),
            "ret_60d": div("close", F.lag("close", window).over(w)) - 1,
        }
    )
    df = add_expanding_median(df, {"exp_med_vol": "vol_60d"}, by, ts)
    label = F.concat(
        F.lit("Regime_"), F.when(F.col("vol_60d") > F.col("exp_med_vol"), "HighVol").otherwise("LowVol"), F.lit("_"), F.when(F.col("ret_60d") > 0, "PosRet").otherwise("NegRet")
    )
    return df.withColumn("regime_label", F.when(F.col("vol_60d").isNull() | F.col("ret_60d").isNull(), "Regime_Unknown").otherwise(label))


def add_outcome(df: DataFrame, h: int = 20, by: str = "symbol", ts: str = "ts") -> DataFrame:
    """actual = 1 where the next h-day return is positive; null without a full future."""
    fwd = div(F.lead("close", h).over(series(by, ts)), "close") - 1
    return df.withColumn("_fwd", fwd).withColumn("actual", F.when(F.col("_fwd").isNotNull(), (F.col("_fwd") > 0).cast("int"))).drop("_fwd")


def score(df: DataFrame, by: list[str], predicted: str = "predicted", actual: str = "actual") -> DataFrame:
    """Accuracy, F1, the accuracy of always predicting 1, and the share of rows without an outcome or prediction."""
    p, a = F.col(predicted), F.col(actual)
    known = p.isNotNull() & a.isNotNull()
    g = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(known).alias("sample_size"), F.count_if(known & (p == a)).alias("_ok"), F.count_if(known & (a == 1)).alias("_base"),
        F.count_if((p == 1) & (a == 1)).alias("_tp"), F.count_if((p == 1) & (a == 0)).alias("_fp"), F.count_if((p == 0) & (a == 1)).alias("_fn"),
    )
    n = F.col("sample_size").cast("double")
    f1 = F.coalesce(div(2.0 * F.col("_tp"), (2 * F.col("_tp") + F.col("_fp") + F.col("_fn")).cast("double")), F.lit(0.0))
    g = g.where("sample_size > 0").withColumns({"accuracy": F.col("_ok") / n, "f1_score": f1, "baseline_accuracy": F.col("_base") / n, "missingness_pct": 1 - n / F.col("rows")})
    return g.withColumn("beats_baseline", (F.col("accuracy") > F.col("baseline_accuracy")).cast("int")).drop("_ok", "_base", "_tp", "_fp", "_fn", "rows")


def by_asset(df: DataFrame, by: str = "symbol", stable: float = 0.52) -> DataFrame:
    return score(df, [by]).withColumn("status", F.when(F.col("accuracy") > stable, "STABLE").otherwise("UNSTABLE"))


def by_year(df: DataFrame, ts: str = "ts") -> DataFrame:
    """One row per year; the first worst and the last best year are flagged."""
    s = score(df.withColumn("year", F.year(ts)), ["year"])
    worst = F.row_number().over(Window.orderBy("accuracy", "year"))
    best = F.row_number().over(Window.orderBy(F.desc("accuracy"), F.desc("year")))
    return s.withColumns({"is_worst_period": (worst == 1).cast("int"), "is_best_period": (best == 1).cast("int")})


def by_regime(df: DataFrame) -> DataFrame:
    return score(df, ["regime_label"])


def reproduction(original: DataFrame, rerun: DataFrame, tolerance: Column, keys: tuple[str, ...] = ("run", "metric")) -> DataFrame:
    """Metric by metric difference of two runs; a metric missing on one side fails."""
    a = original.select(*keys, F.col("value").alias("original_value"))
    b = rerun.select(*keys, F.col("value").alias("rerun_value"))
    j = a.join(b, list(keys), "full_outer").withColumn("difference", F.abs(F.col("original_value") - F.col("rerun_value"))).withColumn("tolerance", tolerance)
    return j.withColumn("status", F.when(F.col("difference") <= F.col("tolerance"), "PASSED").otherwise("FAILED"))
