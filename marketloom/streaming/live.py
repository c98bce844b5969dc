"""Continuous forms of validation, dedup, upsert and monitoring (Structured Streaming)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marketloom.operators.prepare import content_hash
from marketloom.operators.validate import is_valid
from marketloom.sources.versions import upsert_table


def read_files(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def drain(query) -> None:
    """Waits for an availableNow query and passes its error on."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def validate_stream(stream: DataFrame, check: Callable[[DataFrame], DataFrame], valid_path: str, reject_path: str, checkpoint: str):
    """Splits each micro-batch into two tables. A repeated batch rewrites its own folder, so rows never double."""

    def split(batch: DataFrame, epoch: int) -> None:
        checked = check(batch).persist()
        ok = is_valid()
        checked.where(ok).drop("findings", "scope").write.mode("overwrite").parquet(f"{valid_path}/batch={epoch}")
        checked.where(~ok).write.mode("overwrite").parquet(f"{reject_path}/batch={epoch}")
        checked.unpersist()

    return stream.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedup_stream(stream: DataFrame, out_path: str, checkpoint: str, at: str = "published_at", delay: str = "30 days"):
    """First arrival of each content hash inside the watermark; state is dropped behind it."""
    rows = stream.withColumn("content_hash", content_hash()).withWatermark(at, delay).dropDuplicatesWithinWatermark(["content_hash"])
    return rows.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def upsert_stream(stream: DataFrame, path: str, keys: list[str], update: list[str], partition: str, checkpoint: str, order: list[str]):
    """Keyed upsert of each micro-batch, one version a batch; the table remembers the last batch of each checkpoint folder, so a
    batch that is sent again after a restart is not applied again."""
    spark = stream.sparkSession

    def apply(batch: DataFrame, epoch: int) -> None:
        upsert_table(spark, path, batch, keys, update, partition, order, (checkpoint, epoch))

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def freshness_stream(stream: DataFrame, at: str, source: str, out_path: str, checkpoint: str, window: str = "1 hour", delay: str = "1 hour"):
    """Rows and latest time per source and window; a window is written once the watermark passes it."""
    g = stream.withWatermark(at, delay).groupBy(F.window(at, window), source).agg(F.count(F.lit(1)).alias("record_count"), F.max(at).alias("latest"))
    rows = g.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), source, "record_count", "latest")
    return rows.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
