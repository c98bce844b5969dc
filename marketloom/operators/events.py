"""Trading calendar, session alignment and news-market events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.operators.windows import add_forward_returns


def _day(d: Column, month: int, first: int, last: int, dow: int) -> Column:
    return (F.month(d) == month) & F.day(d).between(first, last) & (F.weekday(d) == dow)


def _fixed(d: Column) -> Column:
    md = F.month(d) * 100 + F.day(d)
    return md.isin(101, 704, 1111, 1225) | ((md == 619) & (F.year(d) >= 2021))


def federal_holiday(d: Column) -> Column:
    """US federal holidays; a fixed date on a weekend moves to the nearest weekday."""
    dow = F.weekday(d)
    observed = (
        (_fixed(d) & (dow < 5)) | ((dow == 4) & _fixed(F.date_add(d, 1))) | ((dow == 0) & _fixed(F.date_sub(d, 1)))
    )
    monday = _day(d, 1, 15, 21, 0) | _day(d, 2, 15, 21, 0) | _day(d, 5, 25, 31, 0) | _day(d, 9, 1, 7, 0) | _day(d, 10, 8, 14, 0)
    return observed | monday | _day(d, 11, 22, 28, 3)


def trading_calendar(spark: SparkSession, start: str, end: str, holidays_from: str = "2000-01-01", holidays_to: str = "2050-12-31") -> DataFrame:
    """(day, is_trading, next_trading_day). One row per calendar day, so its global window is small."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.date_add(F.lit(end).cast("date"), 14))).alias("day"))
    d = F.col("day")
    closed = federal_holiday(d) & d.between(F.lit(holidays_from).cast("date"), F.lit(holidays_to).cast("date"))
    days = days.withColumn("is_trading", (F.weekday(d) < 5) & ~closed)
    after = Window.orderBy("day").rowsBetween(1, 14)
    nxt = F.min(F.when(F.col("is_trading"), d)).over(after)
    return days.withColumn("next_trading_day", nxt).where(d <= F.lit(end).cast("date"))


def align(df: DataFrame, calendar: DataFrame, at: str = "published_at") -> DataFrame:
    """Adds market_session_relation and target_observation_date for UTC times."""
    local = F.from_utc_timestamp(F.col(at), "America/New_York")
    j = df.withColumn("_local", local).withColumn("day", F.to_date("_local")).join(calendar, "day", "left")
    minute = F.hour("_local") * 60 + F.minute("_local")
    relation = F.when(~F.col("is_trading"), "WEEKEND_HOLIDAY").when(minute < 570, "PRE_MARKET").when(minute >= 960, "POST_MARKET").otherwise("INTRADAY")
    j = j.withColumn("market_session_relation", relation)
    later = F.col("market_session_relation").isin("WEEKEND_HOLIDAY", "POST_MARKET")
    target = F.when(later, F.col("next_trading_day")).otherwise(F.col("day"))
    return j.withColumn("target_observation_date", target).drop("_local", "day", "is_trading", "next_trading_day")


def article_rows(articles: DataFrame, entities: DataFrame, sentiments: DataFrame) -> DataFrame:
    """Articles with each resolved ticker and, where there is one, their sentiment."""
    tickers = entities.where(F.col("canonical_entity_id").isNotNull()).select("article_id", F.col("canonical_entity_id").alias("entity_id")).distinct()
    return articles.join(tickers, "article_id").join(sentiments.select("article_id", "sentiment_label"), "article_id", "left")


def build_events(
    rows: DataFrame, topics: DataFrame, calendar: DataFrame, market: DataFrame, benchmark: str, horizons: list[int], existing: DataFrame | None = None, strict: bool = True
) -> DataFrame:
    """One row per article, ticker and horizon with forward, benchmark and abnormal return.

    rows: article_id, entity_id, published_at, sentiment_label. topics: article_id, topic.
    market: symbol, ts, log_return.
    """
    fwd = add_forward_returns(market, horizons, strict=strict)
    per = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"fwd_ret_{h}d").alias("ret"), F.col(f"fwd_vol_{h}d").alias("vol")) for h in horizons]))
    long = fwd.select(F.col("symbol").alias("entity_id"), F.col("ts").alias("target_observation_date"), per.alias("f")).select("entity_id", "target_observation_date", "f.*").where(F.col("ret").isNotNull())
    bench = long.where(F.col("entity_id") == benchmark).select("target_observation_date", "h", F.col("ret").alias("benchmark_return"))
    priced = long.join(bench, ["target_observation_date", "h"], "left")
    out = (
        align(rows, calendar)
        .join(topics, "article_id", "left")
        .join(priced, ["entity_id", "target_observation_date"])
        .select(
            "article_id", "entity_id", "published_at", "market_session_relation", F.col("sentiment_label").alias("sentiment"), "topic",
            F.col("target_observation_date").alias("market_observation_start"), F.date_add("target_observation_date", F.col("h")).alias("market_observation_end"),
            F.concat(F.col("h").cast("string"), F.lit("d")).alias("horizon"), F.col("ret").alias("future_return"), F.col("vol").alias("future_volatility"),
            F.lit(benchmark).alias("benchmark_id"), "benchmark_return", (F.col("ret") - F.col("benchmark_return")).alias("abnormal_return"),
            F.lit("event_study_v1").alias("methodology_version"),
        )
    )
    if existing is not None:
        out = out.join(existing.select("article_id", "entity_id", "horizon").distinct(), ["article_id", "entity_id", "horizon"], "left_anti")
    return out
