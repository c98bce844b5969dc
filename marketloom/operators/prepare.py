"""Warehouse rows to analytical tables: dedup, pivots, resampling, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.expr import finite
from marketloom.operators.features import METRIC_TAGS, concept_panel, warehouse_metric
from marketloom.operators.joins import monthly_market

STATEMENT_COLUMNS = {
    "Revenue": "revenue",
    "Net Income": "net_income",
    "Operating Income": "operating_income",
    "Total Assets": "total_assets",
    "Total Liabilities": "total_liabilities",
    "Cash and Cash Equivalents": "cash_and_equivalents",
    "Long-Term Debt": "long_term_debt",
    "Shareholders' Equity": "shareholders_equity",
}


def statements(filing_facts: DataFrame) -> DataFrame:
    """One wide row per company, period end and form; the latest filing of a fact wins.

    `max_by` keeps one value per key on the map side, so no group is sorted.
    """
    known = filing_facts.withColumn("metric", warehouse_metric("concept")).where(F.col("metric") != "Unknown")
    newest = F.max_by(F.struct("value", "form_type"), F.struct("filing_date", "accession_number"))
    latest = known.groupBy("cik", "end_date", "metric").agg(newest.alias("v")).select("cik", "end_date", "metric", "v.*")
    wide = latest.groupBy("cik", "end_date", "form_type").pivot("metric", list(METRIC_TAGS)).agg(F.first("value"))
    for metric, name in STATEMENT_COLUMNS.items():
        wide = wide.withColumnRenamed(metric, name)
    annual = F.col("form_type").contains("10-K")
    return wide.withColumns({"is_annual": annual, "fiscal_period": F.when(annual, "FY").otherwise("Q")})


def macro_table(obs: DataFrame, names: dict[str, str]) -> DataFrame:
    """Latest vintage of each series and month, one column per series."""
    wide = obs.groupBy("observation_date").pivot("series_id", list(names)).agg(F.max_by("value", "realtime_start"))
    for s, c in names.items():
        wide = wide.withColumnRenamed(s, c)
    return wide


def monthly_published(obs: DataFrame, series: list[str]) -> DataFrame:
    """Last value published in each calendar month, one column per series.

    Equal release dates are settled by the newer observation.
    """
    latest = F.max_by("value", F.when(F.col("value").isNotNull(), F.struct("realtime_start", "observation_date")))
    return obs.groupBy(F.last_day("realtime_start").alias("month_end")).pivot("series_id", series).agg(latest)


def align_point_in_time(returns: DataFrame, obs: DataFrame, series: list[str], by: str = "symbol") -> DataFrame:
    """Monthly market return beside the macro values published by that month end."""
    macro = monthly_published(obs, series)
    return monthly_market(returns, by=by).join(macro.select("month_end", *[finite(f"`{s}`").alias(s) for s in series]), "month_end")


def class_counts(df: DataFrame, by: list[str], label: str) -> DataFrame:
    return df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))


def content_hash(title: str = "title", url: str = "url", source: str = "source_name") -> Column:
    return F.sha2(F.lower(F.concat_ws("|", F.col(title), F.col(url), F.col(source))), 256)


def split_duplicates(articles: DataFrame, order: list[str]) -> DataFrame:
    """Adds content_hash, canonical_article_id and is_duplicate; the first by `order` is canonical.

    The canonical row is a `min` per hash joined back, so a widely copied article is never one sorted group.
    """
    hashed = articles.withColumn("content_hash", content_hash())
    first = hashed.groupBy("content_hash").agg(F.min(F.struct(*order, "article_id")).alias("_first"))
    return (
        hashed.join(first, "content_hash")
        .withColumn("canonical_article_id", F.col("_first.article_id"))
        .withColumn("is_duplicate", F.col("article_id") != F.col("canonical_article_id"))
        .drop("_first")
    )


def duplicates_log(split: DataFrame) -> DataFrame:
    return split.where("is_duplicate").select(
        "canonical_article_id",
        F.col("article_id").alias("duplicate_article_id"),
        F.lit("Identical content_hash (title+url+source)").alias("decision_reason"),
    )


def run_counters(processed: DataFrame, run_id: str = "run_id", status: str = "status") -> DataFrame:
    return processed.groupBy(run_id).agg(
        F.count(F.lit(1)).alias("received"),
        F.count_if(F.col(status) == "INSERTED").alias("inserted"),
        F.count_if(F.col(status) == "DUPLICATE").alias("duplicates"),
        F.count_if(F.col(status) == "ERROR").alias("errors"),
    )


def unmapped_concepts(facts: DataFrame, sample: int = 10) -> DataFrame:
    """Per company: how many distinct tags have no metric, and the first few by name.

    Tags are made distinct before the sample is taken; `sample` only limits the listing.
    """
    tags = facts.where(warehouse_metric("concept") == "Unknown").select("cik", "concept").distinct()
    w = Window.partitionBy("cik").orderBy("concept")
    few = tags.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= sample)
    names = few.groupBy("cik").agg(F.sort_array(F.collect_list("concept")).alias("unmapped_concepts"))
    return tags.groupBy("cik").agg(F.count(F.lit(1)).alias("unmapped_count")).join(names, "cik")


def dataset_summary(dataset: DataFrame) -> DataFrame:
    return dataset.groupBy("partition").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("target_value").alias("target_mean"),
        F.avg(F.when(F.col("target_value") > 0, 1.0).when(F.col("target_value").isNotNull(), 0.0)).alias("positive_ratio"),
    )


def timeline(news: DataFrame, market: DataFrame, predictions: DataFrame, cutoff: Column, news_limit: int = 20, recent: int = 5) -> DataFrame:
    """Events of every entity up to the cutoff: articles, last bars, last predictions.

    news: entity_id, article_id, title, published_at. market: symbol, ts, close, log_return.
    predictions: entity_id, prediction_id, prediction_time, model_name, prediction.
    """

    def latest(df: DataFrame, entity: str, at: str, key: str, k: int) -> DataFrame:
        w = Window.partitionBy(entity).orderBy(F.desc(at), F.asc(key))
        return df.where(F.col(at) <= cutoff).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)

    n = latest(news, "entity_id", "published_at", "article_id", news_limit).select(
        "entity_id", F.col("published_at").alias("event_time"), F.lit("NEWS EVENT").alias("type"),
        F.concat(F.lit("In the news: "), "title").alias("description"), F.col("article_id").cast("string").alias("source_id"),
    )
    m = latest(market, "symbol", "ts", "close", recent).select(
        F.col("symbol").alias("entity_id"), F.col("ts").cast("timestamp").alias("event_time"), F.lit("MARKET OBSERVATION").alias("type"),
        F.format_string("Close %.2f, log return %s", "close", F.coalesce(F.format_string("%.6f", "log_return"), F.lit("unknown"))).alias("description"),
        F.concat_ws("-", "symbol", F.col("ts").cast("string")).alias("source_id"),
    )
    p = latest(predictions, "entity_id", "prediction_time", "prediction_id", recent).select(
        "entity_id", F.col("prediction_time").cast("timestamp").alias("event_time"), F.lit("MODEL PREDICTION").alias("type"),
        F.format_string("%s expects %.4f", "model_name", "prediction").alias("description"), F.col("prediction_id").alias("source_id"),
    )
    return n.unionByName(m).unionByName(p)


__all__ = ["concept_panel"]
