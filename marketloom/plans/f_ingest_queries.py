from pyspark.sql import functions as F

from marketloom.functions.expr import rnd
from marketloom.operators import features as X
from marketloom.operators import prepare
from marketloom.operators import validate as Q
from marketloom.plans.registry import query
from marketloom.plans.sqlviews import FACTS, MACRO, MARKET, NEWS, RETURNS, r, sql
from marketloom.session import scratch_path
from marketloom.sources import payloads as P
from marketloom.sources import sinks as K
from marketloom.sources import versions as W
from marketloom.sources import views as V


def now():
    return F.lit("2002-01-01 00:00:00").cast("timestamp")


# --- landing documents built from the provided tables ----------------------------------------------


def daily_payloads(bars):
    """One document per symbol and year, as a provider would land it."""
    text = lambda c, n: F.col(c).cast("string").alias(n)
    bar = F.struct(text("open", "1. open"), text("high", "2. high"), text("low", "3. low"), text("close", "4. close"), text("volume", "5. volume"))
    doc = F.map_from_entries(F.collect_list(F.struct(F.col("ts").cast("string"), bar)))
    return bars.groupBy("symbol", F.year("ts").alias("y")).agg(doc.alias("d")).select("symbol", F.to_json(F.struct(F.col("d").alias("Time Series (Daily)"))).alias("payload"))


@query("src_02", sql(MARKET, "SELECT symbol, CAST(ts AS VARCHAR) AS ts, open, high, low, close, volume FROM market_prices"))
def src_02(spark, sf):
    return P.daily_bars(daily_payloads(V.market_prices(spark, sf))).select("symbol", "ts", "open", "high", "low", "close", "volume")


def fact_payloads(spark, sf):
    """One document per company; liabilities of first quarters lack their end date, one tag is unmapped."""
    f = V.filing_facts(spark, sf)
    end = F.when(~(F.col("concept").endswith("Liabilities") & (F.month("end_date") == 3)), F.col("end_date").cast("string"))
    name = F.replace("concept", F.lit("us-gaap:"), F.lit(""))
    name = F.when(name == "NetIncomeLoss", F.when(F.col("form_type") == "10-K", "NetIncomeLoss").otherwise("InterimIncome")).otherwise(name)
    fact = F.struct(F.lit(None).cast("string").alias("start"), end.alias("end"), F.col("value").cast("string").alias("val"), F.col("accession_number").alias("accn"), F.year("end_date").cast("string").alias("fy"), F.col("form_type").alias("fp"))
    tags = f.select("cik", name.alias("tag"), fact.alias("f")).groupBy("cik", "tag").agg(F.collect_list("f").alias("rows"))
    units = F.struct(F.create_map(F.lit("USD"), F.col("rows")).alias("units"))
    docs = tags.groupBy("cik").agg(F.map_from_entries(F.collect_list(F.struct("tag", units))).alias("m"))
    return docs.select(F.col("cik").cast("bigint").alias("cik"), F.to_json(F.struct(F.struct(F.col("m").alias("us-gaap")).alias("facts"))).alias("payload"))


METRIC = """CASE concept WHEN 'us-gaap:Revenues' THEN 'Revenue' WHEN 'us-gaap:NetIncomeLoss' THEN CASE WHEN form_type = '10-K' THEN 'Net Income' ELSE 'Unknown' END WHEN 'us-gaap:OperatingIncomeLoss' THEN 'Operating Income'
  WHEN 'us-gaap:Assets' THEN 'Total Assets' WHEN 'us-gaap:Liabilities' THEN 'Total Liabilities' ELSE 'Shareholders'' Equity' END"""


@query(
    "src_03",
    sql(
        FACTS,
        f"""SELECT * FROM (SELECT cik, concept, {METRIC} AS metric, 'USD' AS unit, value, CAST(end_date AS VARCHAR) AS end_date, CAST(year(end_date) AS INTEGER) AS fiscal_year, accession_number
FROM filing_facts WHERE NOT (concept = 'us-gaap:Liabilities' AND month(end_date) = 3)) WHERE metric <> 'Unknown'""",
    ),
)
def src_03(spark, sf):
    facts = P.mapped_facts(P.company_facts(fact_payloads(spark, sf)))
    return facts.select("cik", "concept", "metric", "unit", "value", "end_date", "fiscal_year", "accession_number")


def macro_payloads(spark, sf):
    """One document per series; February is missing, August cannot be read."""
    m = V.macro_obs(spark, sf)
    month = F.month("observation_date")
    value = F.when(month == 2, ".").when(month == 8, "n/a").otherwise(F.col("value").cast("string"))
    obs = F.struct(F.col("observation_date").cast("string").alias("date"), value.alias("value"), F.col("realtime_start").cast("string").alias("realtime_start"), F.lit("9999-12-31").alias("realtime_end"))
    return m.groupBy("series_id").agg(F.to_json(F.struct(F.collect_list(obs).alias("observations"))).alias("payload"))


@query(
    "src_04",
    sql(
        MACRO,
        """SELECT series_id, CAST(observation_date AS VARCHAR) AS observation_date, CASE WHEN month(observation_date) = 2 THEN NULL ELSE value END AS value,
  CAST(realtime_start AS VARCHAR) AS realtime_start, '9999-12-31' AS realtime_end FROM macro_obs WHERE month(observation_date) <> 8""",
    ),
)
def src_04(spark, sf):
    return P.macro_observations(macro_payloads(spark, sf))


@query("src_05", "SELECT DISTINCT o_orderpriority AS id, 'Orders ' || o_orderpriority AS title, 'M' AS frequency, '' AS units FROM orders")
def src_05(spark, sf):
    ids = V.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("series_id")).distinct()
    meta = F.struct(F.concat(F.lit("Orders "), "series_id").alias("title"), F.lit("M").alias("frequency_short"))
    later = F.struct(F.lit("ignored").alias("title"), F.lit("D").alias("frequency_short"))
    return P.macro_series(ids.select("series_id", F.to_json(F.struct(F.array(meta, later).alias("seriess"))).alias("payload")))


def news_payloads(spark, sf, page=100):
    """Pages of at most 100 articles. Every third text is cut by the provider, every 17th has no title."""
    n = V.news(spark, sf)
    i = F.col("article_id")
    art = F.struct(
        F.struct(F.when(i % 5 != 0, F.col("source_name")).alias("id"), F.col("source_name").alias("name")).alias("source"),
        F.when(i % 17 != 0, F.col("title")).alias("title"),
        F.when(i % 3 == 0, F.concat("content", F.lit(" [+12 chars]"))).otherwise(F.col("content")).alias("content"),
        F.col("url").alias("url"),
        F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt"),
    )
    doc = F.struct(F.count(F.lit(1)).alias("totalResults"), F.collect_list(art).alias("articles"))
    return n.groupBy(F.floor(i / page).alias("p")).agg(F.to_json(doc).alias("payload")).select(F.concat(F.lit("run-"), F.col("p").cast("string")).alias("run_id"), "payload")


@query(
    "src_06",
    sql(
        NEWS,
        """SELECT 'run-' || CAST(article_id // 100 AS VARCHAR) AS run_id, CASE WHEN article_id % 5 <> 0 THEN source_name END AS source_id, source_name,
  sha256(content || CASE WHEN article_id % 3 = 0 THEN ' [+12 chars]' ELSE '' END || CASE WHEN article_id % 3 = 0 OR contains(content, '[+') THEN ' [TRUNCATED_BY_PROVIDER]' ELSE '' END) AS content_sha,
  CAST(published_at AS VARCHAR) AS published_at, CASE WHEN article_id % 17 = 0 OR title = '' THEN 'ERROR' ELSE 'OK' END AS status,
  CASE WHEN article_id % 17 <> 0 AND title <> '' THEN sha256(lower(title || '|' || url || '|' || source_name)) END AS content_hash FROM news""",
    ),
)
def src_06(spark, sf):
    a = P.articles(news_payloads(spark, sf))
    return a.select("run_id", "source_id", "source_name", F.sha2("content", 256).alias("content_sha"), "published_at", "status", "content_hash")


@query(
    "src_07",
    sql(
        NEWS,
        """SELECT source_id, source_id AS name FROM (SELECT DISTINCT source_name AS source_id FROM news WHERE article_id % 5 <> 0)
WHERE source_id NOT IN (SELECT source_name FROM news WHERE article_id % 101 = 0)""",
    ),
)
def src_07(spark, sf):
    known = V.news(spark, sf).where("article_id % 101 = 0").select(F.col("source_name").alias("source_id")).distinct()
    return P.new_sources(P.articles(news_payloads(spark, sf)), known, "published_at")


# --- keyed writes ----------------------------------------------------------------------------------


def resent(batch, **earlier):
    """The batch with an earlier, larger copy of every record in front of it: by `seq` the second one must win."""
    return batch.withColumns(earlier).withColumn("seq", F.lit(1)).unionByName(batch.withColumn("seq", F.lit(2)))


def later_bars(spark, sf):
    """Bars from mid-1998 on, revised, each sent twice; the second copy must win."""
    bars = V.market_prices(spark, sf).where(F.col("ts") >= F.lit("1998-07-01").cast("date")).withColumn("year", F.year("ts"))
    revised = bars.withColumns({"close": F.col("close") + 1, "volume": F.col("volume") + 10})
    return resent(revised, close=F.col("close") + 100, volume=F.col("volume") + 1000)


UPSERTED = """SELECT symbol, CAST(ts AS VARCHAR) AS ts, open, high, low, CASE WHEN ts >= DATE '1998-07-01' THEN close + 1 ELSE close END AS close,
  CAST(CASE WHEN ts >= DATE '1998-07-01' THEN volume + 10 ELSE volume END AS BIGINT) AS volume FROM market_prices"""


@query("snk_01", sql(MARKET, UPSERTED))
def snk_01(spark, sf):
    path = scratch_path(spark, "prices")
    bars = V.market_prices(spark, sf).where(F.col("ts") < F.lit("1999-01-01").cast("date")).withColumns({"year": F.year("ts"), "seq": F.lit(0)})
    keys, cols = ["symbol", "ts", "year"], ["open", "high", "low", "close", "volume"]
    W.upsert_table(spark, path, bars, keys, cols, "year", ["seq"])
    out = W.upsert_table(spark, path, later_bars(spark, sf), keys, cols, "year", ["seq"])
    return out.select("symbol", "ts", *cols)


@query(
    "snk_02",
    sql(
        FACTS,
        """SELECT accession_number, concept, CAST(end_date AS VARCHAR) AS end_date, CASE WHEN form_type = '10-K' THEN value + 5 ELSE value END AS value,
  CASE WHEN year(end_date) >= 2000 THEN 'batch' ELSE 'table' END AS origin FROM filing_facts""",
    ),
)
def snk_02(spark, sf):
    """Facts before 2000 are in the table; the batch brings all later ones and revised annual ones of any year."""
    f = V.filing_facts(spark, sf)
    cols, late = ["accession_number", "concept", "end_date"], F.year("end_date") >= 2000
    old = f.where(~late).select(*cols, "value", F.lit("table").alias("origin"))
    annual = F.col("form_type") == "10-K"
    new = f.where(late | annual).select(*cols, F.when(annual, F.col("value") + 5).otherwise(F.col("value")).alias("value"), F.lit("batch").alias("origin"))
    return W.keyed_upsert(old, resent(new, value=F.col("value") + 1000), cols, ["value"], ["seq"])


@query(
    "snk_03",
    sql(
        MACRO,
        """SELECT series_id, CAST(observation_date AS VARCHAR) AS observation_date, CAST(realtime_start AS VARCHAR) AS realtime_start, value,
  CASE WHEN realtime_start < DATE '1999-01-01' THEN '1999-12-31' ELSE '9999-12-31' END AS realtime_end FROM macro_obs""",
    ),
)
def snk_03(spark, sf):
    m = V.macro_obs(spark, sf)
    cut = F.lit("1999-01-01").cast("date")
    old = m.withColumn("realtime_end", F.lit("9999-12-31").cast("date"))
    new = m.where(F.col("realtime_start") < cut).withColumn("realtime_end", F.lit("1999-12-31").cast("date"))
    new = resent(new, value=F.col("value") + 1, realtime_end=F.lit("2999-12-31").cast("date"))
    out = W.keyed_upsert(old, new, ["series_id", "observation_date", "realtime_start"], ["value", "realtime_end"], ["seq"])
    return out.select("series_id", "observation_date", "realtime_start", "value", "realtime_end")


@query("snk_04", "SELECT c_custkey AS cik, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) || ' INC' ELSE c_name END AS name, c_mktsegment AS segment FROM customer")
def snk_04(spark, sf):
    c = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("cik"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    new = c.where("cik % 3 = 0").select("cik", F.concat(F.upper("name"), F.lit(" INC")).alias("name"), F.lit("changed").alias("segment"))
    return W.keyed_upsert(c, resent(new, name=F.lit("zzz, the earlier name")), ["cik"], ["name"], ["seq"])


@query(
    "snk_05",
    sql(
        RETURNS,
        f"""SELECT symbol, CAST(ts AS VARCHAR) AS original_timestamp, 'v1.0' AS dataset_version, CASE WHEN ts >= DATE '2000-01-01' THEN close * 2 ELSE close END AS close,
  volume, {r('log_return', 8)} AS log_return FROM returns""",
    ),
)
def snk_05(spark, sf):
    """Strict form: the stored volume is not refreshed."""
    rows = V.returns(spark, sf).select("symbol", F.col("ts").alias("original_timestamp"), F.lit("v1.0").alias("dataset_version"), "close", "volume", "log_return")
    new = rows.where(F.col("original_timestamp") >= F.lit("2000-01-01").cast("date")).withColumns({"close": F.col("close") * 2, "volume": F.col("volume") + 99})
    new = resent(new, close=F.col("close") * 9, log_return=F.lit(1e6))
    out = W.keyed_upsert(rows, new, ["symbol", "original_timestamp", "dataset_version"], ["close", "log_return"], ["seq"])
    return out.withColumn("log_return", rnd("log_return", 8))


@query(
    "snk_06",
    """SELECT user_id AS run_id, status, records, CAST(ts AS VARCHAR) AS event_time FROM (
  SELECT user_id, event_type AS status, CAST(floor(value) AS BIGINT) AS records, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""",
)
def snk_06(spark, sf):
    e = V.table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("status"), F.floor("value").alias("records"), F.col("ts").cast("timestamp").alias("event_time"), "event_id")
    return K.ledger_state(e, order=["event_time", "event_id"]).drop("event_id")


def defective(bars):
    """Bars with known faults, by volume."""
    v = F.col("volume")
    return bars.select(
        "symbol", "ts", "open",
        F.when(v % 37 == 0, F.col("low") - 1).otherwise(F.col("high")).alias("high"),
        "low",
        F.when(v % 43 != 0, F.col("close")).alias("close"),
        F.when(v % 41 == 0, -v).otherwise(v).alias("volume"),
    )


DEFECTIVE = """bad AS (SELECT symbol, ts, open, CASE WHEN volume % 37 = 0 THEN low - 1 ELSE high END AS high, low, CASE WHEN volume % 43 <> 0 THEN close END AS close,
  CASE WHEN volume % 41 = 0 THEN -volume ELSE volume END AS volume FROM market_prices),
flag AS (SELECT *, CASE WHEN close IS NULL THEN 'missing_fields' WHEN high < low THEN 'high_less_than_low' WHEN volume < 0 THEN 'negative_volume' END AS check_name FROM bad)"""


@query(
    "snk_07",
    sql(
        MARKET, FACTS, MACRO, DEFECTIVE,
        """SELECT 'market' AS dataset, count(*) AS received, count(*) FILTER (WHERE check_name IS NULL) AS stored, count(check_name) AS failures,
  CAST(sum(volume) FILTER (WHERE check_name IS NULL) AS BIGINT) AS total FROM flag
UNION ALL SELECT 'filings', count(*), count(*), count(*) FILTER (WHERE concept = 'us-gaap:Assets' AND month(end_date) = 6),
  CAST(sum(CAST(round(CASE WHEN concept = 'us-gaap:Assets' AND month(end_date) = 6 THEN NULL ELSE value END * 100) AS BIGINT)) AS BIGINT)
  FROM filing_facts WHERE NOT (concept = 'us-gaap:NetIncomeLoss' AND form_type <> '10-K') AND NOT (concept = 'us-gaap:Liabilities' AND month(end_date) = 3)
UNION ALL SELECT 'macro', count(*), count(*), count(*) FILTER (WHERE month(observation_date) = 2),
  CAST(sum(CAST(round(CASE WHEN month(observation_date) = 2 THEN NULL ELSE value END * 100) AS BIGINT)) AS BIGINT) FROM macro_obs WHERE month(observation_date) <> 8""",
    ),
)
def snk_07(spark, sf):
    """Parse, check, upsert records that are sent twice, and report, for the three datasets."""
    market = defective(P.daily_bars(daily_payloads(V.market_prices(spark, sf))))
    facts = P.mapped_facts(P.company_facts(fact_payloads(spark, sf)))
    facts = facts.withColumn("value", F.when(~((F.col("metric") == "Total Assets") & (F.month("end_date") == 6)), F.col("value")))
    macro = P.macro_observations(macro_payloads(spark, sf))
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint")
    jobs = [
        ("market", Q.check_market(market), "ts", ["symbol", "ts", "year"], ["open", "high", "low", "close", "volume"], "volume", F.col("volume")),
        ("filings", Q.check_filings(facts), "end_date", ["accession_number", "concept", "end_date", "year"], ["value"], "value", cents("value")),
        ("macro", Q.check_macro(macro), "observation_date", ["series_id", "observation_date", "realtime_start", "year"], ["value", "realtime_end"], "value", cents("value")),
    ]
    out = None
    for name, checked, day, keys, update, measure, amount in jobs:
        batch = resent(Q.valid_rows(checked).withColumn("year", F.year(day)), **{measure: F.col(measure) + 7})
        stored = W.upsert_table(spark, scratch_path(spark, name), batch, keys, update, "year", ["seq"])
        seen = checked.agg(F.count(F.lit(1)).alias("received"), F.sum((F.size("findings") > 0).cast("bigint")).alias("failures")).withColumn("dataset", F.lit(name))
        kept = stored.agg(F.count(F.lit(1)).alias("stored"), F.sum(amount).alias("total")).withColumn("dataset", F.lit(name))
        row = seen.join(kept, "dataset").select("dataset", "received", "stored", "failures", "total")
        out = row if out is None else out.unionByName(row)
    return out


@query("snk_08", sql(MARKET, "SELECT symbol, CAST(year(ts) AS VARCHAR) AS year, CAST(count(*) AS VARCHAR) AS n, CAST(max(volume) AS VARCHAR) AS max_volume FROM market_prices GROUP BY symbol, year(ts)"))
def snk_08(spark, sf):
    path = scratch_path(spark, "report")
    K.write_csv(V.market_prices(spark, sf).groupBy("symbol", F.year("ts").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.max("volume").alias("max_volume")), path)
    return spark.read.schema("symbol string, year string, n string, max_volume string").option("header", True).csv(path)


@query(
    "snk_09",
    sql(
        MARKET,
        "f AS (SELECT symbol, ts, close / lag(close) OVER w - 1 AS ret_1d, close - lag(close, 20) OVER w AS mom_20d FROM market_prices WINDOW w AS (PARTITION BY symbol ORDER BY ts))",
        f"""SELECT symbol AS entity, CAST(ts AS VARCHAR) AS observation_time, CAST(ts AS VARCHAR) AS availability_time, 'ret_1d' AS feature_name, {r('ret_1d', 8)} AS feature_value, 'technical_v1' AS feature_set, 'run-1' AS run_id FROM f WHERE ret_1d IS NOT NULL
UNION ALL SELECT symbol, CAST(ts AS VARCHAR), CAST(ts AS VARCHAR), 'mom_20d', {r('mom_20d', 8)}, 'technical_v1', 'run-1' FROM f WHERE mom_20d IS NOT NULL""",
    ),
)
def snk_09(spark, sf):
    path = scratch_path(spark, "features")
    long = K.feature_store_rows(X.technical(V.market_prices(spark, sf)), "symbol", "ts", "ts", ["ret_1d", "mom_20d"], "technical_v1", "run-1")
    K.write_feature_store(long, path)
    return spark.read.schema(long.schema).parquet(path).withColumn("feature_value", rnd("feature_value", 8))


@query("snk_10", sql(RETURNS, f"SELECT symbol, count(*) AS total_observations, {r('exp(sum(log_return)) - 1', 6)} AS cumulative_return FROM returns GROUP BY symbol"))
def snk_10(spark, sf):
    from marketloom.operators.stats import profile

    path = scratch_path(spark, "reports")
    p = profile(V.returns(spark, sf))
    K.write_reports(p.select("symbol", F.to_json(F.struct(*p.columns)).alias("payload")), path)
    doc = F.from_json("value", "symbol string, total_observations bigint, cumulative_return double")
    return spark.read.text(path).select(doc.alias("d")).select("d.symbol", "d.total_observations", rnd("d.cumulative_return").alias("cumulative_return"))


# --- validation ------------------------------------------------------------------------------------

MESSAGE = """CASE check_name WHEN 'missing_fields' THEN 'a price or the volume is not given' WHEN 'high_less_than_low' THEN 'high ' || CAST(high AS VARCHAR) || ' lies under low ' || CAST(low AS VARCHAR)
  ELSE 'volume ' || CAST(volume AS VARCHAR) || ' below zero' END"""


@query("val_01", sql(MARKET, DEFECTIVE, f"SELECT symbol || '@' || CAST(ts AS VARCHAR) AS scope, check_name, 'CRITICAL' AS severity, {MESSAGE} AS message FROM flag WHERE check_name IS NOT NULL"))
def val_01(spark, sf):
    return Q.findings(Q.check_market(defective(V.market_prices(spark, sf))))


@query(
    "val_02",
    sql(
        FACTS,
        """SELECT accession_number || ' | ' || concept AS scope, 'missing_end_date' AS check_name, 'CRITICAL' AS severity, 'no end date' AS message FROM filing_facts WHERE month(end_date) = 3
UNION ALL SELECT accession_number || ' | ' || concept, 'missing_value', 'WARNING', 'no value' FROM filing_facts WHERE form_type = '10-K' AND concept = 'us-gaap:Assets'""",
    ),
)
def val_02(spark, sf):
    f = V.filing_facts(spark, sf)
    f = f.withColumns({"value": F.when(~((F.col("form_type") == "10-K") & (F.col("concept") == "us-gaap:Assets")), F.col("value")), "end_date": F.when(F.month("end_date") != 3, F.col("end_date"))})
    return Q.findings(Q.check_filings(f))


@query(
    "val_03",
    sql(
        MACRO,
        "SELECT series_id || '@' || CAST(observation_date AS VARCHAR) AS scope, 'missing_observation' AS check_name, 'WARNING' AS severity, 'no value for the day, as sources mark by a dot' AS message FROM macro_obs WHERE month(observation_date) = 2",
    ),
)
def val_03(spark, sf):
    m = V.macro_obs(spark, sf).withColumn("value", F.when(F.month("observation_date") != 2, F.col("value")))
    return Q.findings(Q.check_macro(m))


@query(
    "val_04",
    sql(
        MARKET, DEFECTIVE,
        f"""SELECT check_name, 'market_prices' AS dataset, symbol || '@' || CAST(ts AS VARCHAR) AS record_scope, 'FAILED' AS status, 'CRITICAL' AS severity, {MESSAGE} AS message, '2002-01-01 00:00:00' AS detected_at FROM flag WHERE check_name IS NOT NULL
UNION ALL SELECT 'fred_validation_suite', 'economic_observations', 'all', 'PASSED', 'INFO', 'Check passed successfully.', '2002-01-01 00:00:00'""",
    ),
)
def val_04(spark, sf):
    bad = Q.results(Q.check_market(defective(V.market_prices(spark, sf))), "market_prices", "market_validation_suite", now())
    good = Q.results(Q.check_macro(V.macro_obs(spark, sf)), "economic_observations", "fred_validation_suite", now())
    return bad.unionByName(good)


@query(
    "val_05",
    sql(
        MARKET,
        """SELECT symbol, CAST(CAST(ts AS TIMESTAMP) AS VARCHAR) AS original_timestamp, CASE WHEN volume % 43 <> 0 THEN close END AS close, CASE WHEN volume % 41 <> 0 THEN volume END AS volume, 'v1.0' AS dataset_version,
  concat_ws(',', CASE WHEN volume % 43 = 0 THEN 'close' END, CASE WHEN volume % 41 = 0 THEN 'volume' END) AS contract_errors FROM market_prices""",
    ),
)
def val_05(spark, sf):
    v = F.col("volume")
    raw = V.market_prices(spark, sf).select(
        F.lit("provider").alias("source"), "symbol", F.col("ts").cast("string").alias("original_timestamp"),
        F.when(v % 43 != 0, F.col("close").cast("string")).alias("close"), F.when(v % 41 == 0, F.lit("n/a")).otherwise(v.cast("string")).alias("volume"),
    )
    out = Q.apply_contract(raw, "market", now())
    return out.select("symbol", "original_timestamp", "close", "volume", "dataset_version", F.concat_ws(",", "contract_errors").alias("contract_errors"))


@query(
    "val_06",
    sql(
        NEWS,
        "h AS (SELECT *, sha256(lower(title || '|' || url || '|' || source_name)) AS content_hash FROM news)",
        """SELECT count(*) AS total_articles, count(*) FILTER (WHERE published_at IS NULL) AS missing_publication_time, count(*) FILTER (WHERE coalesce(url, '') = '') AS missing_url, count(*) FILTER (WHERE coalesce(title, '') = '') AS missing_title,
  count(*) FILTER (WHERE published_at > TIMESTAMP '2001-06-01') AS future_timestamps, (SELECT count(*) FROM (SELECT content_hash FROM h GROUP BY 1 HAVING count(*) > 1)) AS unhandled_duplicate_hashes,
  (SELECT count(*) - count(DISTINCT content_hash) FROM h) AS total_duplicates_intercepted, 'FAIL' AS status FROM h""",
    ),
)
def val_06(spark, sf):
    split = prepare.split_duplicates(V.news(spark, sf), ["published_at"])
    return Q.news_quality(split, prepare.duplicates_log(split), F.lit("2001-06-01").cast("timestamp"))


@query(
    "val_07",
    f"""SELECT 'lineitem' AS source_table, count(*) AS record_count, 0.0::DOUBLE AS missing_rate, {r('1 - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) / count(*)', 8)} AS duplicate_rate,
  {r("epoch(TIMESTAMP '2002-01-01' - max(l_shipdate)) / 3600.0::DOUBLE", 6)} AS freshness_hours, epoch(TIMESTAMP '2002-01-01' - max(l_shipdate)) > 86400 AS is_stale FROM lineitem""",
)
def val_07(spark, sf):
    df = Q.table_quality(V.table(spark, sf, "lineitem"), "lineitem", "l_shipdate", ["l_orderkey", "l_linenumber"], now())
    return df.withColumns({"duplicate_rate": rnd("duplicate_rate", 8), "freshness_hours": rnd("freshness_hours")})


@query(
    "val_08",
    f"""WITH f AS (SELECT source AS source_name, epoch(TIMESTAMP '2002-01-01' - max(o_orderdate)) / 3600.0::DOUBLE AS lag, count(*) AS n FROM documents JOIN orders ON doc_id = o_orderkey GROUP BY source),
t AS (SELECT DISTINCT source AS source_name FROM documents)
SELECT t.source_name, {r('lag', 6)} AS data_lag_hours, CASE WHEN lag > 4800 THEN 'STALE' WHEN n < 30 THEN 'DEGRADED' ELSE 'PASS' END AS gate_status FROM t LEFT JOIN f ON t.source_name = f.source_name""",
)
def val_08(spark, sf):
    seen = V.news(spark, sf).groupBy("source_name").agg(
        ((F.unix_micros(now()) - F.unix_micros(F.max(F.date_trunc("day", "published_at")))) / F.lit(3600e6)).alias("data_lag_hours"),
        F.when(F.count(F.lit(1)) < 30, "DEGRADED").otherwise("OK").alias("freshness_status"),
    )
    limits = V.table(spark, sf, "documents").select(F.col("source").alias("source_name")).distinct().withColumn("max_lag_hours", F.lit(4800.0))
    return Q.freshness_gate(seen, limits).select("source_name", rnd("data_lag_hours").alias("data_lag_hours"), "gate_status")


GATED = """gb AS (SELECT symbol, ts, CASE WHEN symbol = 'LARGE' AND volume % 43 = 0 THEN NULL WHEN symbol = 'PROMO' AND volume % 41 = 0 THEN 0 ELSE close END AS close FROM market_prices
  UNION ALL SELECT symbol, ts, close FROM market_prices WHERE symbol = 'SMALL' AND volume % 37 = 0)"""


def gate_input(spark, sf):
    bars = V.market_prices(spark, sf)
    s, v = F.col("symbol"), F.col("volume")
    close = F.when((s == "LARGE") & (v % 43 == 0), F.lit(None)).when((s == "PROMO") & (v % 41 == 0), 0.0).otherwise(F.col("close"))
    return bars.withColumn("close", close).unionByName(bars.where((s == "SMALL") & (v % 37 == 0)))


@query(
    "val_09",
    sql(
        MARKET, GATED,
        """SELECT symbol, CAST(count(*) AS BIGINT) AS rows, count(*) FILTER (WHERE close IS NULL) AS null_prices, count(*) FILTER (WHERE close <= 0) AS non_positive_prices, count(*) - count(DISTINCT ts) AS duplicate_timestamps FROM gb GROUP BY symbol""",
    ),
)
def val_09(spark, sf):
    return Q.price_violations(gate_input(spark, sf))


@query(
    "val_10",
    sql(
        MARKET, DEFECTIVE,
        """SELECT symbol, count(*) FILTER (WHERE volume < 0) AS negative_volumes, count(*) FILTER (WHERE high < low) AS high_below_low, count(*) - count(DISTINCT ts) AS duplicate_timestamps FROM bad GROUP BY symbol""",
    ),
)
def val_10(spark, sf):
    return Q.volume_violations(defective(V.market_prices(spark, sf)))


@query(
    "val_11",
    "WITH s AS (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) >= 10) SELECT o_orderkey, o_custkey FROM orders JOIN s USING (o_custkey)",
)
def val_11(spark, sf):
    orders = V.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return Q.enough_observations(orders, "o_orderkey", "o_custkey", 10).select("o_orderkey", "o_custkey")


@query(
    "val_12",
    sql(
        MARKET,
        "g AS (SELECT symbol, ts, CASE WHEN volume % 3 <> 0 THEN close END AS a, CASE WHEN volume % 5 <> 0 THEN close END AS b, CASE WHEN volume % 7 <> 0 THEN close END AS c, CASE WHEN volume % 11 <> 0 THEN close END AS d, CASE WHEN volume % 13 <> 0 THEN close END AS e FROM market_prices)",
        f"""SELECT * FROM (SELECT symbol, CAST(ts AS VARCHAR) AS ts, last_value(a IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS a, {r('coalesce(b, avg(b) OVER (PARTITION BY symbol))', 8)} AS b, coalesce(c, 0) AS c, d, e FROM g) WHERE e IS NOT NULL""",
    ),
)
def val_12(spark, sf):
    v = F.col("volume")
    g = V.market_prices(spark, sf).select("symbol", "ts", *[F.when(v % k != 0, F.col("close")).alias(c) for c, k in zip("abcde", (3, 5, 7, 11, 13))])
    out = Q.apply_missing_policy(g, {"a": "forward_fill", "b": "mean_impute", "c": "zero_fill", "d": "ignore", "e": "drop"})
    return out.withColumn("b", rnd("b", 8))


@query(
    "val_13",
    sql(
        MARKET,
        "f AS (SELECT " + ", ".join(f"close / lag(close, {n}) OVER w AS ret_{n}d" for n in (1, 20, 252)) + " FROM market_prices WINDOW w AS (PARTITION BY symbol ORDER BY ts))",
        " UNION ALL ".join(f"SELECT 'ret_{n}d' AS feature, {r(f'100.0::DOUBLE * avg(CASE WHEN ret_{n}d IS NULL THEN 1.0 ELSE 0.0 END)')} AS missing_pct FROM f" for n in (1, 20, 252)),
    ),
)
def val_13(spark, sf):
    df = Q.missingness(X.technical(V.market_prices(spark, sf)), [f"ret_{n}d" for n in (1, 20, 252)])
    return df.withColumn("missing_pct", rnd("missing_pct"))


@query("val_14", "SELECT event_id, CAST(ts AS VARCHAR) AS ts, event_type, value FROM events ORDER BY events.ts DESC, event_id LIMIT 50")
def val_14(spark, sf):
    e = V.table(spark, sf, "events").select("event_id", "ts", "event_type", "value")
    return Q.latest(e, [F.desc("ts"), F.asc("event_id")], 50)
