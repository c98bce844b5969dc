"""Landed provider payloads (one JSON document per row) to typed rows.

Every parser takes a frame with a `payload` string column, so landing files are read with
`spark.read.text(dir, wholetext=True)` and parsed in parallel, one document per row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators.features import METRIC_TAGS, tag_map
from marketloom.operators.prepare import content_hash


def landed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "payload")


DAILY = "struct<`Time Series (Daily)`: map<string, struct<`1. open`: string, `2. high`: string, `3. low`: string, `4. close`: string, `5. volume`: string>>>"


def daily_bars(payloads: DataFrame, strict: bool = True) -> DataFrame:
    """(symbol, payload) to bars. With `strict`, one unreadable number fails the whole batch."""
    doc = F.from_json("payload", DAILY)
    rows = payloads.select("symbol", F.explode(doc["Time Series (Daily)"]).alias("day", "v"))
    num = lambda f, t: F.col("v").getField(f).try_cast(t)
    out = rows.select(
        "symbol",
        F.col("day").try_cast("date").alias("ts"),
        num("1. open", "double").alias("open"),
        num("2. high", "double").alias("high"),
        num("3. low", "double").alias("low"),
        num("4. close", "double").alias("close"),
        num("5. volume", "bigint").alias("volume"),
        F.lit("historical").alias("source_type"),
        F.lit("TIME_SERIES_DAILY").alias("endpoint"),
    )
    if not strict:
        return out
    bad = F.lit(False)
    for c in ("ts", "open", "high", "low", "close", "volume"):
        bad = bad | F.col(c).isNull()
    fail = F.raise_error(F.concat(F.lit("Failed to parse a daily row of "), "symbol"))
    return out.withColumn("symbol", F.when(bad, fail.cast("string")).otherwise(F.col("symbol")))


FACTS = "struct<facts: struct<`us-gaap`: map<string, struct<units: map<string, array<struct<`start`: string, `end`: string, val: string, accn: string, fy: string, fp: string>>>>>>>"


def company_facts(payloads: DataFrame) -> DataFrame:
    """(cik, payload) to one row per fact and unit, all tags; facts without an end date are dropped."""
    doc = F.from_json("payload", FACTS)
    concepts = payloads.select(F.lpad(F.col("cik").cast("string"), 10, "0").alias("cik"), F.explode(doc["facts"]["us-gaap"]).alias("tag", "c"))
    units = concepts.select("cik", "tag", F.explode("c.units").alias("unit", "rows"))
    rows = units.select("cik", "tag", "unit", F.explode("rows").alias("f"))
    concept = F.concat(F.lit("us-gaap:"), "tag")
    value = F.coalesce(F.col("f.val"), F.lit("0")).try_cast("double")
    out = rows.select(
        "cik",
        concept.alias("concept"),
        F.coalesce(tag_map(METRIC_TAGS, concept), F.lit("Unknown")).alias("metric"),
        "unit",
        value.alias("value"),
        F.col("f.start").try_cast("date").alias("start_date"),
        F.nullif("f.end", F.lit("")).try_cast("date").alias("end_date"),
        F.col("f.fp").alias("fiscal_period"),
        F.col("f.fy").try_cast("int").alias("fiscal_year"),
        F.col("f.accn").alias("accession_number"),
    )
    return out.where(F.col("end_date").isNotNull() & F.col("value").isNotNull())


def mapped_facts(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("metric") != "Unknown")


OBSERVATIONS = "struct<observations: array<struct<`date`: string, value: string, realtime_start: string, realtime_end: string>>>"


def macro_observations(payloads: DataFrame) -> DataFrame:
    """(series_id, payload) to vintages; a dot means no value, unreadable rows are skipped."""
    rows = payloads.select("series_id", F.explode(F.from_json("payload", OBSERVATIONS)["observations"]).alias("o"))
    out = rows.select(
        "series_id",
        F.col("o.date").try_cast("date").alias("observation_date"),
        F.nullif("o.value", F.lit(".")).try_cast("double").alias("value"),
        F.col("o.realtime_start").try_cast("date").alias("realtime_start"),
        F.col("o.realtime_end").try_cast("date").alias("realtime_end"),
        (F.col("o.value") == ".").alias("_dot"),
    )
    ok = F.col("observation_date").isNotNull() & F.col("realtime_start").isNotNull() & F.col("realtime_end").isNotNull()
    return out.where(ok & (F.col("_dot") | F.col("value").isNotNull())).drop("_dot")


SERIES = "struct<seriess: array<struct<title: string, frequency_short: string, units_short: string>>>"


def macro_series(payloads: DataFrame) -> DataFrame:
    """Metadata of each series: the first listed element, absent texts empty."""
    first = F.get(F.from_json("payload", SERIES)["seriess"], F.lit(0))
    text = lambda f: F.coalesce(F.col("s").getField(f), F.lit(""))
    rows = payloads.select("series_id", first.alias("s")).where(F.col("s").isNotNull())
    return rows.select(F.col("series_id").alias("id"), text("title").alias("title"), text("frequency_short").alias("frequency"), text("units_short").alias("units"))


ARTICLES = (
    "struct<totalResults: bigint, articles: array<struct<source: struct<id: string, name: string>, author: string, "
    "title: string, description: string, content: string, url: string, publishedAt: string>>>"
)


def articles(payloads: DataFrame) -> DataFrame:
    """(run_id, payload) to article rows with status OK or ERROR (title, url and time are required)."""
    rows = payloads.select("run_id", F.explode(F.from_json("payload", ARTICLES)["articles"]).alias("a"))
    filled = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    published = F.try_to_timestamp("a.publishedAt")
    complete = filled("a.title") & filled("a.url") & published.isNotNull()
    content = F.when(F.contains("a.content", F.lit("[+")), F.concat("a.content", F.lit(" [TRUNCATED_BY_PROVIDER]"))).otherwise(F.col("a.content"))
    out = rows.select(
        "run_id",
        F.col("a.source.id").alias("source_id"),
        F.coalesce("a.source.name", F.lit("Unknown")).alias("source_name"),
        F.col("a.author").alias("author"),
        F.col("a.title").alias("title"),
        F.col("a.description").alias("description"),
        content.alias("content"),
        F.col("a.url").alias("url"),
        published.alias("published_at"),
        F.when(complete, "OK").otherwise("ERROR").alias("status"),
    )
    return out.withColumn("content_hash", F.when(F.col("status") == "OK", content_hash())).withColumn(
        "article_id", F.when(F.col("status") == "OK", F.sha2(F.concat_ws("|", "content_hash", "published_at"), 256))
    )


def new_sources(rows: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """Sources not known yet; the first name seen wins."""
    named = rows.where(F.col("source_id").isNotNull()).groupBy("source_id").agg(F.min_by("source_name", order).alias("name"))
    return named.join(existing.select("source_id"), "source_id", "left_anti")


