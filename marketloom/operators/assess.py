"""Assessments of every entity as of a cutoff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The caveats stored with every assessment.
LIMITATIONS = [
    "SHAP explains model behavior, not causality.",
    "Statistical associations do not guarantee future returns.",
    "Predictions are strictly out-of-sample and bounded by temporal firewalls.",
]


def assess(
    entities: DataFrame, articles: DataFrame, sentiments: DataFrame, topics: DataFrame, predictions: DataFrame, explanations: DataFrame,
    findings: DataFrame, risk: DataFrame, cutoff: Column, recent: int = 10, last_findings: int = 3,
) -> DataFrame:
    """One assessment row per entity, from facts known at the cutoff.

    articles: article_id, entity_id, published_at. sentiments: article_id, sentiment_label.
    topics: article_id, topic. predictions: entity_id, prediction_id, prediction_time, model_version,
    prediction. explanations: prediction_id, attributions. findings: created_at, finding.
    risk: entity_id, classification, var_95, cvar_95.
    The k latest rows per entity are pruned in the map tasks, so a busy entity does not gather in one task.
    """
    day = F.to_date(cutoff)
    w = Window.partitionBy("entity_id").orderBy(F.desc("published_at"), "article_id")
    near = articles.where(F.col("published_at") <= cutoff).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= recent)
    read = near.join(sentiments, "article_id", "left").join(topics, "article_id", "left")
    facts = read.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("recent_articles"),
        *[F.count_if(F.col("sentiment_label") == s).alias(s.lower()) for s in ("POSITIVE", "NEGATIVE", "NEUTRAL")],
        F.sort_array(F.collect_set("topic")).alias("topics"),
    )
    newest = F.max_by(F.struct("prediction_id", "model_version", "prediction"), F.struct("prediction_time", "prediction_id"))
    pred = predictions.where(F.col("prediction_time") <= day).groupBy("entity_id").agg(newest.alias("p")).select("entity_id", "p.*")
    pred = pred.join(explanations, "prediction_id", "left")
    top = findings.where(F.col("created_at") <= cutoff).orderBy(F.desc("created_at"), "finding").limit(last_findings)
    stat = top.agg(F.sort_array(F.collect_list("finding")).alias("findings")).withColumn("_k", F.lit(1))
    out = entities.select("entity_id").distinct().withColumn("_k", F.lit(1))
    out = out.join(facts, "entity_id", "left").join(pred, "entity_id", "left").join(risk, "entity_id", "left").join(stat, "_k", "left").drop("_k")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    text = F.when(F.col("prediction").isNotNull(), F.format_string("Expected return: %.4f", "prediction")).otherwise("No forecast yet")
    payload = F.struct(
        F.struct(
            zero("recent_articles").alias("Recent_Articles_Count"), F.coalesce("topics", F.array().cast("array<string>")).alias("Dominant_Topics"),
            F.struct(zero("positive").alias("POSITIVE"), zero("negative").alias("NEGATIVE"), zero("neutral").alias("NEUTRAL")).alias("Sentiment_Distribution"),
        ).alias("OBSERVED_FACTS"),
        F.struct(text.alias("Prediction"), F.coalesce("model_version", F.lit("None")).alias("Model_Version")).alias("MODEL_PREDICTIONS"),
        F.struct(F.col("findings").alias("Findings")).alias("STATISTICAL_ASSOCIATIONS"),
        F.struct(F.coalesce("classification", F.lit("UNKNOWN")).alias("Classification"), F.struct(F.col("var_95").alias("VaR_95"), F.col("cvar_95").alias("CVaR_95")).alias("Metrics")).alias("RISK_MEASUREMENTS"),
        F.struct(F.col("attributions").alias("Local_SHAP_Explanation")).alias("INTERPRETATIONS"),
        F.array(*[F.lit(s) for s in LIMITATIONS]).alias("LIMITATIONS"),
    )
    return out.select(
        "entity_id", cutoff.alias("data_cutoff_time"), F.coalesce("model_version", F.lit("Unknown")).alias("model_version"), F.lit("v1").alias("feature_version"),
        F.lit("deterministic_v1").alias("methodology_version"), "prediction", F.coalesce("classification", F.lit("UNKNOWN")).alias("risk_classification"), payload.alias("structured_assessment"),
    )


def provenance(assessments: DataFrame, by: str = "entity_id", at: str = "data_cutoff_time") -> DataFrame:
    """Versions and cutoff behind the newest assessment of each entity."""
    fields = [c for c in assessments.columns if c != by]
    return assessments.groupBy(by).agg(F.max_by(F.struct(*fields), at).alias("a")).select(by, "a.*")
