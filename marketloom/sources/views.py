"""Financial tables derived from the provided star schema (definitions in FIXTURES.md).

Bars are grouped by symbol and day before anything else sees them. A symbol's series is therefore
bounded by the number of calendar days, however many raw rows the symbol has, and a hot symbol is
combined on the map side of that one aggregation.

Sums are rounded to the decimals they exactly have, so that they do not depend on the order of summation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SYMBOLS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
WEIGHTS = dict(zip(SYMBOLS, [0.30, 0.25, 0.15, 0.10, 0.10, 0.10]))
BENCHMARK = "ECONOMY"
SCENARIOS = [
    ("spring_1996", "1996-03-01", "1996-06-30"),
    ("winter_1999", "1999-01-01", "1999-03-31"),
    ("outside_2005", "2005-01-01", "2005-02-01"),
]
MACRO_SERIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Shares out a source with fewer file splits than cores, for work that is heavy per row.

    Few splits also means little data (at most one split size per core), so this shuffle stays small; a
    large source is read as it lies.
    """
    few = df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(key) if few else df


def _bars(spark: SparkSession, sf_dir: str, symbol: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    parts = table(spark, sf_dir, "part").select("p_partkey", symbol)
    px = F.lit(1000.0) + F.col("l_extendedprice") / F.col("l_quantity") / F.lit(1000.0)
    return (
        items.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col(symbol).alias("symbol"), F.to_date("l_shipdate").alias("ts"))
        .agg(
            F.max(px).alias("high"),
            F.min(px).alias("low"),
            (F.lit(1000.0) + F.round(F.sum("l_extendedprice"), 2) / F.sum("l_quantity") / F.lit(1000.0)).alias("close"),
            F.sum("l_quantity").cast("bigint").alias("volume"),
        )
        .select("symbol", "ts", ((F.col("high") + F.col("low")) / 2).alias("open"), "high", "low", "close", "volume")
    )


def market_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bars(spark, sf_dir, "p_type")


def universe_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bars(spark, sf_dir, "p_brand")


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketloom.operators.windows import add_returns

    return add_returns(market_prices(spark, sf_dir))


def macro_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two vintages per series and month: a first print of closed orders, then a revision of all."""
    month = F.to_date(F.date_trunc("month", "o_orderdate"))
    closed = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    monthly = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("series_id"), month.alias("observation_date"))
        .agg(
            (F.round(F.sum(closed), 2) / F.nullif(F.count(closed), F.lit(0))).alias("first_print"),
            (F.round(F.sum("o_totalprice"), 2) / F.count("o_totalprice")).alias("revision"),
        )
    )
    vintages = F.explode(
        F.array(
            F.struct(F.col("first_print").alias("value"), F.lit(15).alias("lag_days")),
            F.struct(F.col("revision").alias("value"), F.lit(45).alias("lag_days")),
        )
    )
    return monthly.select("series_id", "observation_date", vintages.alias("v")).select(
        "series_id",
        "observation_date",
        F.col("v.value").alias("value"),
        F.date_add(F.last_day("observation_date"), F.col("v.lag_days")).alias("realtime_start"),
    ).where(F.col("value").isNotNull())


def filing_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per filing and concept."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount", "l_tax")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    ext = F.col("l_extendedprice")
    quarter = F.to_date(F.date_trunc("quarter", "o_orderdate"))
    sums = (
        li.join(od, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(cu, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", quarter.alias("q"))
        .agg(
            F.round(F.sum(ext * (1 - F.col("l_discount"))), 4).alias("rev"),
            F.round(F.sum(ext * (1 + F.col("l_tax"))), 4).alias("assets"),
            F.round(F.sum(ext * F.col("l_discount")), 4).alias("disc"),
            F.round(F.sum(ext), 4).alias("ext"),
        )
    )
    end = F.date_sub(F.add_months("q", 3), 1)
    cik = F.lpad(F.col("c_nationkey").cast("string"), 10, "0")
    op = F.col("rev") - F.lit(0.6) * F.col("ext")
    concepts = {
        "us-gaap:Revenues": F.col("rev"),
        "us-gaap:Assets": F.col("assets"),
        "us-gaap:Liabilities": 5 * F.col("disc"),
        "us-gaap:StockholdersEquity": F.col("assets") - 5 * F.col("disc"),
        "us-gaap:OperatingIncomeLoss": op,
        "us-gaap:NetIncomeLoss": F.lit(0.5) * op,
    }
    facts = F.explode(F.array(*[F.struct(F.lit(k).alias("concept"), v.alias("value")) for k, v in concepts.items()]))
    return sums.select(
        cik.alias("cik"),
        F.concat(cik, F.year("q").cast("string"), F.quarter("q").cast("string")).alias("accession_number"),
        F.when(F.quarter("q") == 4, "10-K").otherwise("10-Q").alias("form_type"),
        F.date_add(end, 40).alias("filing_date"),
        end.alias("end_date"),
        facts.alias("f"),
    ).select("cik", "accession_number", "form_type", "filing_date", "end_date", "f.concept", "f.value")


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filing_facts(spark, sf_dir).select("cik", "accession_number", "form_type", "filing_date").distinct()


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filing_facts(spark, sf_dir).select("accession_number", "concept", "value", "end_date")


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id")
    od = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("d"))
    hours = F.make_dt_interval(F.lit(0), F.pmod(F.col("doc_id") * 7, F.lit(24)).cast("int"))
    return docs.join(od, F.col("doc_id") == F.col("o_orderkey")).select(
        F.col("doc_id").alias("article_id"),
        F.col("text").alias("title"),
        F.col("source").alias("url"),
        F.col("source").alias("source_name"),
        F.col("text").alias("content"),
        (F.col("d") + hours).alias("published_at"),
    )


def classifier_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"),
        F.col("quality").alias("y"),
        (F.pmod(F.col("doc_id") * 37, F.lit(101)) / F.lit(100.0)).alias("p"),
    )


def portfolio(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("main", s, w) for s, w in WEIGHTS.items()], "portfolio string, symbol string, weight double")


def scenarios(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCENARIOS, "scenario string, start_date string, end_date string").select(
        "scenario", F.to_date("start_date").alias("start_date"), F.to_date("end_date").alias("end_date")
    )
