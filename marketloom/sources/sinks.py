"""The run ledger and report sinks; keyed writes are in `versions`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ledger_state(events: DataFrame, run: str = "run_id", order: list[str] = ("event_time",)) -> DataFrame:
    """Latest state of each run in an append-only ledger."""
    payload = [c for c in events.columns if c != run]
    return events.groupBy(run).agg(F.max_by(F.struct(*payload), F.struct(*order)).alias("s")).select(run, "s.*")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def feature_store_rows(df: DataFrame, entity: str, observed: str, available: str, features: list[str], feature_set: str, run_id: str) -> DataFrame:
    """Wide features to long rows; null values are not stored."""
    wide = df.select(F.col(entity).alias("entity"), F.col(observed).alias("observation_time"), F.col(available).alias("availability_time"), *[F.col(c).cast("double") for c in features])
    long = wide.unpivot(["entity", "observation_time", "availability_time"], features, "feature_name", "feature_value")
    return long.where(F.col("feature_value").isNotNull()).withColumns({"feature_set": F.lit(feature_set), "run_id": F.lit(run_id)})


def write_feature_store(long: DataFrame, path: str) -> None:
    long.write.mode("append").partitionBy("feature_set").parquet(path)


def write_reports(reports: DataFrame, path: str) -> None:
    """JSON lines, one document per entity; the entity is a field of the document, not a folder."""
    reports.select("payload").write.mode("overwrite").text(path)
