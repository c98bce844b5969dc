"""Drift, alerts and realised performance.

Drift samples come in long form (feature, sample REF or CUR, value). Nothing about a feature is sorted in
one task: cut points and distribution functions come from value counts (ordering.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.expr import div
from marketloom.operators.joins import price_around
from marketloom.operators.ordering import cumulative, quantiles

EPSILON = 0.0001


def drift_samples(df: DataFrame, features: list[str], reference: Column, current: Column) -> DataFrame:
    """Long samples of the two periods, given as row conditions."""
    label = F.when(reference, "REF").when(current, "CUR")
    rows = df.withColumn("sample", label).where(F.col("sample").isNotNull())
    long = rows.select("sample", *[F.col(c).cast("double").alias(c) for c in features]).unpivot(["sample"], features, "feature", "value")
    return long.where(F.col("value").isNotNull())


def psi(samples: DataFrame, bins: int = 10, by: str = "feature") -> DataFrame:
    """Population stability index over quantile bins of the reference sample.

    Current values outside the reference range fall in no bin but stay in the denominator; an empty share
    counts as 0.0001.
    """
    names = {f"_e{i}": i / bins for i in range(bins + 1)}
    edges = quantiles(samples.where("sample = 'REF'"), [by], "value", names).select(by, F.array(*names).alias("_edges"))
    inner = F.slice("_edges", 2, bins - 1)
    inside = (F.col("value") >= F.element_at("_edges", 1)) & (F.col("value") <= F.element_at("_edges", -1))
    b = F.when(inside, F.size(F.filter(inner, lambda e: e <= F.col("value"))))
    binned = samples.join(edges, by).withColumn("_bin", b)
    counts = binned.groupBy(by, "_bin").agg(F.count_if(F.col("sample") == "REF").alias("_r"), F.count_if(F.col("sample") == "CUR").alias("_c"))
    totals = counts.groupBy(by).agg(F.sum("_r").alias("_refs"), F.sum("_c").alias("_curs"))
    grid = totals.where("_refs > 0 AND _curs > 0").withColumn("_bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    share = lambda n, d: F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(EPSILON)).otherwise(F.coalesce(n, F.lit(0)) / d)
    cells = grid.join(counts, [by, "_bin"], "left").withColumns({"_e": share(F.col("_r"), F.col("_refs")), "_a": share(F.col("_c"), F.col("_curs"))})
    return cells.groupBy(by).agg(F.sum((F.col("_a") - F.col("_e")) * F.ln(F.col("_a") / F.col("_e"))).alias("value"))


def ks(samples: DataFrame, by: str = "feature") -> DataFrame:
    """Largest distance between the two distribution functions."""
    counts = samples.groupBy(by, F.col("value").alias("_v")).agg(F.count_if(F.col("sample") == "REF").alias("r"), F.count_if(F.col("sample") == "CUR").alias("c"))
    cum = cumulative(counts, [by], "_v", ["r", "c"])
    gap = F.abs(div((F.col("r_before") + F.col("r")).cast("double"), F.col("r_total").cast("double")) - div((F.col("c_before") + F.col("c")).cast("double"), F.col("c_total").cast("double")))
    return cum.groupBy(by).agg(F.max(gap).alias("value"))


def drift(samples: DataFrame, method: str = "PSI", threshold: float = 0.2, by: str = "feature") -> DataFrame:
    """One row per feature: value, status, and the severity of the alert it raises."""
    if method not in ("PSI", "KS"):
        raise ValueError(f"Unknown drift method: {method}")
    v = (psi(samples, by=by) if method == "PSI" else ks(samples, by)).withColumnRenamed("value", "drift_value")
    drifted = F.col("drift_value") > threshold
    return v.select(
        by, F.lit(method).alias("metric"), "drift_value", F.lit(threshold).alias("threshold"), F.when(drifted, "DRIFTED").otherwise("OK").alias("status"),
        F.when(F.col("drift_value") > threshold * 1.5, "CRITICAL").when(drifted, "WARNING").alias("severity"),
    )


def drift_signals(drifts: DataFrame, at: Column, by: str = "feature") -> DataFrame:
    """Signals for `update_alerts`; features without drift resolve their alert."""
    message = F.format_string("Feature %s has drifted (%s: %.4f > %s)", by, "metric", "drift_value", F.col("threshold").cast("string"))
    return drifts.select(
        F.concat(F.lit("drift_"), by).alias("metric"), F.lit("DRIFT").alias("source"), (F.col("status") == "DRIFTED").alias("is_firing"),
        F.col("drift_value").alias("observed_value"), "threshold", "severity", message.alias("message"), at.alias("at"),
    )


ALERT_COLUMNS = ["alert_id", "metric", "source", "observed_value", "threshold", "severity", "message", "timestamp", "status"]


def update_alerts(alerts: DataFrame, signals: DataFrame) -> DataFrame:
    """Next alert table: one ACTIVE row per (metric, source), refreshed while firing, RESOLVED when it stops."""
    active = alerts.where("status = 'ACTIVE'").select(*[F.col(c).alias(f"old_{c}") for c in ALERT_COLUMNS])
    closed = alerts.where("status <> 'ACTIVE'").select(*ALERT_COLUMNS)
    j = active.join(signals, (F.col("old_metric") == F.col("metric")) & (F.col("old_source") == F.col("source")), "full_outer")
    fire, known = F.coalesce("is_firing", F.lit(False)), F.col("old_alert_id").isNotNull()
    new_id = F.sha2(F.concat_ws("|", "metric", "source", F.col("at").cast("string")), 256)
    pick = lambda new, old: F.when(fire, F.col(new)).otherwise(F.col(old))
    nxt = j.where(fire | known).select(
        F.coalesce("old_alert_id", new_id).alias("alert_id"), F.coalesce("old_metric", "metric").alias("metric"), F.coalesce("old_source", "source").alias("source"),
        pick("observed_value", "old_observed_value").alias("observed_value"), F.coalesce("old_threshold", "threshold").alias("threshold"),
        pick("severity", "old_severity").alias("severity"), pick("message", "old_message").alias("message"), pick("at", "old_timestamp").alias("timestamp"),
        F.when(F.col("is_firing") == False, "RESOLVED").otherwise("ACTIVE").alias("status"),  # noqa: E712
    )
    return nxt.unionByName(closed)


def resolve_predictions(predictions: DataFrame, prices: DataFrame, resolved: DataFrame, now: Column, horizon_days: int = 20) -> DataFrame:
    """Outcome of every elapsed prediction that has none yet.

    predictions: prediction_id, entity_id, prediction_time, predicted_value, probability, model_version.
    prices: symbol, ts, close.
    """
    todo = predictions.join(resolved.select("prediction_id"), "prediction_id", "left_anti").withColumn("target_date", F.date_add("prediction_time", horizon_days))
    due = todo.where(F.col("target_date") <= F.to_date(now)).withColumnRenamed("entity_id", "symbol")
    priced = price_around(due, prices, "symbol", "prediction_time", "target_date").where(F.col("price_t0").isNotNull() & F.col("price_t1").isNotNull())
    actual = F.when((F.col("price_t1") - F.col("price_t0")) / F.col("price_t0") > 0, "OUTPERFORM").otherwise("UNDERPERFORM")
    return priced.withColumn("actual", actual).select(
        "prediction_id", F.col("symbol").alias("entity_id"), "prediction_time", F.col("predicted_value").alias("prediction"), "probability", "actual",
        F.lit(horizon_days).alias("horizon"), "model_version", (F.col("predicted_value") == F.col("actual")).cast("int").alias("is_correct"), now.alias("calculated_at"),
    )


def trailing_accuracy(performance: DataFrame, now: Column, days: int, at: str = "calculated_at") -> DataFrame:
    recent = performance.where(F.col(at) >= F.date_sub(F.to_date(now), days))
    return recent.groupBy("model_version").agg(F.count(F.lit(1)).alias("n"), F.avg("is_correct").alias("accuracy"))
