"""Joins between warehouse tables. Point-in-time joins are in asof.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.expr import finite
from marketloom.operators.asof import asof_join


def facts_with_filings(facts: DataFrame, filings: DataFrame) -> DataFrame:
    return facts.join(filings, "accession_number")


def benchmark_join(returns: DataFrame, benchmark: str, by: str = "symbol", ts: str = "ts", x: str = "log_return") -> DataFrame:
    """The benchmark is one symbol: one row per calendar day, small enough for Spark to broadcast by size."""
    bench = returns.where(F.col(by) == benchmark).select(ts, F.col(x).alias("benchmark_return"))
    return returns.join(bench, ts, "left")


def risk_free_join(returns: DataFrame, rates: DataFrame, ts: str = "ts") -> DataFrame:
    """Daily rate known on each day: latest release, ties to the newest observation.

    The rate depends on the day alone, so the as-of join runs on distinct days.
    """
    daily = rates.select("realtime_start", "observation_date", (F.col("value") / 100.0 / 252.0).alias("rfr_daily"))
    days = returns.select(ts).distinct().withColumn("_k", F.lit(1))
    known = asof_join(days, daily.withColumn("_k", F.lit(1)), ["_k"], ts, "realtime_start", ["rfr_daily"], bucket="year", tie=["observation_date"])
    return returns.join(known.drop("_k"), ts, "left")


def vintage_asof(dates: DataFrame, macro: DataFrame, ts: str, series: list[str], latest_observation: bool = False) -> DataFrame:
    """Value of each series known on each date: (date, series_id, value, observation_date, realtime_start).

    The default takes the latest release whatever month it describes; `latest_observation` keeps only
    releases of the newest month seen so far.
    """
    if latest_observation:
        w = Window.partitionBy("series_id").orderBy("realtime_start").rangeBetween(Window.unboundedPreceding, 0)
        macro = macro.withColumn("_newest", F.max("observation_date").over(w)).where(F.col("observation_date") == F.col("_newest")).drop("_newest")
    asked = dates.select(ts).distinct().withColumn("series_id", F.explode(F.array(*[F.lit(s) for s in series])))
    known = macro.withColumn("_rs", F.col("realtime_start"))
    out = asof_join(asked, known, ["series_id"], ts, "_rs", ["value", "observation_date", "realtime_start"], bucket="year", tie=["observation_date"])
    return out


def macro_levels(market: DataFrame, macro: DataFrame, names: dict[str, str], ts: str = "ts", latest_observation: bool = False) -> DataFrame:
    """Adds one level column per series to every bar."""
    long = vintage_asof(market, macro, ts, list(names), latest_observation)
    wide = long.groupBy(ts).pivot("series_id", list(names)).agg(F.first("value"))
    for s, c in names.items():
        wide = wide.withColumnRenamed(s, c)
    return market.join(wide, ts, "left")


def supervised_join(features: DataFrame, targets: DataFrame, by: str = "symbol", at: str = "prediction_time") -> DataFrame:
    return features.join(targets, [by, at])


def wide_returns(returns: DataFrame, symbols: list[str], x: str = "log_return", by: str = "symbol", ts: str = "ts") -> DataFrame:
    return returns.groupBy(ts).pivot(by, symbols).agg(F.first(x))


def monthly_market(returns: DataFrame, x: str = "log_return", by: str = "symbol", ts: str = "ts") -> DataFrame:
    return returns.groupBy(by, F.last_day(ts).alias("month_end")).agg(F.sum(finite(x)).alias(x))


def monthly_macro(obs: DataFrame, at: str = "observation_date") -> DataFrame:
    """Last value of each month per series."""
    latest = F.max_by("value", F.when(F.col("value").isNotNull(), F.struct(at, "realtime_start")))
    return obs.groupBy("series_id", F.last_day(at).alias("month_end")).agg(latest.alias("value"))


def market_with_macro(returns: DataFrame, macro: DataFrame, series: list[str]) -> DataFrame:
    wide = monthly_macro(macro).groupBy("month_end").pivot("series_id", series).agg(F.first("value"))
    return monthly_market(returns).join(wide, "month_end")


def first_per_key(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def unprocessed(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key has no result yet (null-safe against NOT IN: an anti join)."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def price_around(asked: DataFrame, prices: DataFrame, by: str, at: str, until: str, ts: str = "ts", price: str = "close") -> DataFrame:
    """Last price at or before `at` and first price at or after `until`, per entity."""
    p0 = prices.select(by, F.col(ts).alias("_t0"), F.col(price).alias("price_t0"), F.col(ts).alias("price_t0_at"))
    p1 = prices.select(by, F.col(ts).alias("_t1"), F.col(price).alias("price_t1"), F.col(ts).alias("price_t1_at"))
    out = asof_join(asked, p0, [by], at, "_t0", ["price_t0", "price_t0_at"])
    return asof_join(out, p1, [by], until, "_t1", ["price_t1", "price_t1_at"], direction="forward")


def weights_asof(returns: DataFrame, composition: DataFrame, ts: str = "ts") -> DataFrame:
    """Return rows with the weight in force that day. composition: portfolio, symbol, weight, effective_date."""
    held = composition.select("portfolio", "symbol").distinct()
    rows = returns.join(held, "symbol")
    return asof_join(rows, composition, ["portfolio", "symbol"], ts, "effective_date", ["weight", "effective_date"], bucket="year")
