from pyspark.sql import functions as F

from marketloom.functions.expr import rnd
from marketloom.operators import features as X
from marketloom.operators import joins as J
from marketloom.operators import pit, prepare
from marketloom.operators.asof import asof_join
from marketloom.plans.registry import query
from marketloom.plans.sqlviews import FACTS, MACRO, MARKET, NEWS, RETURNS, r, sql
from marketloom.sources import views as V


@query(
    "join_01",
    sql(
        FACTS,
        """SELECT f.accession_number, f.concept, f.value, CAST(f.end_date AS VARCHAR) AS end_date, g.cik, g.form_type, CAST(g.filing_date AS VARCHAR) AS filing_date
FROM filing_facts f JOIN (SELECT DISTINCT cik, accession_number, form_type, filing_date FROM filing_facts) g ON f.accession_number = g.accession_number""",
    ),
)
def join_01(spark, sf):
    return J.facts_with_filings(V.facts(spark, sf), V.filings(spark, sf))


def typed_events(spark, sf, kind):
    return V.table(spark, sf, "events").where(F.col("event_type") == kind).select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value")


@query(
    "join_02",
    """SELECT l.event_id, l.user_id, CAST(l.ts AS VARCHAR) AS ts, r.value AS feature, CAST(r.ts AS VARCHAR) AS available_at
FROM (SELECT * FROM events WHERE event_type = 'purchase') l
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type IN ('view', 'click')) r ON l.user_id = r.user_id AND l.ts >= r.ts""",
)
def join_02(spark, sf):
    seen = typed_events(spark, sf, "view").unionByName(typed_events(spark, sf, "click"))
    feature = seen.select("user_id", F.col("ts").alias("available_at"), F.col("value").alias("feature")).withColumn("_at", F.col("available_at"))
    out = asof_join(typed_events(spark, sf, "purchase").drop("value"), feature, ["user_id"], "ts", "_at", ["feature", "available_at"], bucket="hour")
    return out.select("event_id", "user_id", "ts", "feature", "available_at")


@query(
    "join_03",
    sql(
        MARKET,
        MACRO,
        "days AS (SELECT DISTINCT ts FROM market_prices)",
        "s AS (SELECT DISTINCT series_id FROM macro_obs)",
        "v AS (SELECT series_id, realtime_start, max(observation_date) AS observation_date, max_by(value, observation_date) AS value FROM macro_obs GROUP BY 1, 2)",
        """SELECT CAST(d.ts AS VARCHAR) AS ts, d.series_id, v.value, CAST(v.observation_date AS VARCHAR) AS observation_date, CAST(v.realtime_start AS VARCHAR) AS realtime_start
FROM (SELECT ts, series_id FROM days, s) d ASOF LEFT JOIN v ON d.series_id = v.series_id AND d.ts >= v.realtime_start""",
    ),
)
def join_03(spark, sf):
    return J.vintage_asof(V.market_prices(spark, sf), V.macro_obs(spark, sf), "ts", V.MACRO_SERIES)


FEATURES = "feats AS (SELECT symbol, ts AS prediction_time, close / lag(close, 5) OVER w - 1 AS ret_5d, volume / nullif(lag(volume) OVER w, 0)::DOUBLE - 1 AS vol_change_1d FROM market_prices WINDOW w AS (PARTITION BY symbol ORDER BY ts))"
TARGETS = "targs AS (SELECT symbol, ts AS prediction_time, lead(ts, 5) OVER w AS target_end_time, lead(close, 5) OVER w / close - 1 AS target_value FROM market_prices WINDOW w AS (PARTITION BY symbol ORDER BY ts))"


def features(spark, sf):
    df = X.volume(X.technical(V.market_prices(spark, sf)))
    return df.select("symbol", F.col("ts").alias("prediction_time"), "ret_5d", "vol_change_1d")


@query(
    "join_04",
    sql(
        MARKET,
        FEATURES,
        TARGETS,
        f"""SELECT symbol, CAST(prediction_time AS VARCHAR) AS prediction_time, CAST(target_end_time AS VARCHAR) AS target_end_time,
  {r('ret_5d', 8)} AS ret_5d, {r('vol_change_1d', 8)} AS vol_change_1d, {r('target_value', 8)} AS target_value
FROM feats JOIN targs USING (symbol, prediction_time) WHERE target_value IS NOT NULL""",
    ),
)
def join_04(spark, sf):
    df = J.supervised_join(features(spark, sf), pit.targets(V.market_prices(spark, sf), 5))
    return df.select("symbol", "prediction_time", "target_end_time", *[rnd(c, 8).alias(c) for c in ("ret_5d", "vol_change_1d", "target_value")])


@query(
    "join_05",
    sql(
        RETURNS,
        f"""SELECT a.symbol, CAST(a.ts AS VARCHAR) AS ts, {r('a.log_return', 8)} AS log_return, {r('b.log_return', 8)} AS benchmark_return
FROM returns a LEFT JOIN returns b ON a.ts = b.ts AND b.symbol = 'ECONOMY'""",
    ),
)
def join_05(spark, sf):
    df = J.benchmark_join(V.returns(spark, sf), V.BENCHMARK)
    return df.select("symbol", "ts", rnd("log_return", 8).alias("log_return"), rnd("benchmark_return", 8).alias("benchmark_return"))


@query(
    "join_06",
    sql(
        MARKET,
        MACRO,
        "rate AS (SELECT realtime_start AS rs, max_by(value, observation_date) / 100 / 252 AS rfr FROM macro_obs WHERE series_id = '1-URGENT' GROUP BY 1)",
        f"SELECT p.symbol, CAST(p.ts AS VARCHAR) AS ts, {r('b.rfr', 6)} AS rfr_daily FROM market_prices p ASOF LEFT JOIN rate b ON p.ts >= b.rs",
    ),
)
def join_06(spark, sf):
    rates = V.macro_obs(spark, sf).where(F.col("series_id") == "1-URGENT")
    return J.risk_free_join(V.market_prices(spark, sf), rates).select("symbol", "ts", rnd("rfr_daily", 6).alias("rfr_daily"))


@query(
    "join_07",
    sql(
        RETURNS,
        "SELECT CAST(ts AS VARCHAR) AS ts, "
        + ", ".join(f"max(CASE WHEN symbol = '{s}' THEN {r('log_return', 8)} END) AS {s.lower()}" for s in V.SYMBOLS)
        + " FROM returns GROUP BY ts",
    ),
)
def join_07(spark, sf):
    df = J.wide_returns(V.returns(spark, sf), V.SYMBOLS)
    return df.select("ts", *[rnd(s, 8).alias(s.lower()) for s in V.SYMBOLS])


MONTHLY = """mm AS (SELECT symbol, last_day(ts) AS month_end, coalesce(sum(log_return), 0) AS log_return, count(log_return) AS n FROM returns GROUP BY 1, 2)"""


@query(
    "join_08",
    sql(
        RETURNS,
        MACRO,
        MONTHLY,
        "mac AS (SELECT series_id, last_day(observation_date) AS month_end, max_by(value, realtime_start) AS value FROM macro_obs GROUP BY 1, 2)",
        f"""SELECT m.symbol, CAST(m.month_end AS VARCHAR) AS month_end, CASE WHEN max(m.n) > 0 THEN {r('max(m.log_return)', 8)} END AS log_return,
  max(CASE WHEN series_id = '1-URGENT' THEN value END) AS urgent, max(CASE WHEN series_id = '5-LOW' THEN value END) AS low
FROM mm m JOIN mac ON m.month_end = mac.month_end GROUP BY m.symbol, m.month_end""",
    ),
)
def join_08(spark, sf):
    df = J.market_with_macro(V.returns(spark, sf), V.macro_obs(spark, sf), V.MACRO_SERIES)
    return df.select("symbol", "month_end", rnd("log_return", 8).alias("log_return"), F.col("1-URGENT").alias("urgent"), F.col("5-LOW").alias("low"))


# A prediction for every bar of a symbol, from the bar's own numbers.
PREDICTIONS = """predictions AS (SELECT symbol || '-' || CAST(ts AS VARCHAR) AS prediction_id, symbol AS entity_id, ts AS prediction_time,
  CASE WHEN day(ts) % 2 = 1 THEN 'm1' ELSE 'm2' END AS model_version, (volume % 201 - 100) / 10000.0::DOUBLE AS prediction,
  (volume % 101) / 100.0::DOUBLE AS probability, CASE WHEN volume % 2 = 0 THEN 'OUTPERFORM' ELSE 'UNDERPERFORM' END AS predicted_value
  FROM market_prices)"""


def predictions(spark, sf):
    v = F.col("volume")
    return V.market_prices(spark, sf).select(
        F.concat_ws("-", "symbol", F.col("ts").cast("string")).alias("prediction_id"),
        F.col("symbol").alias("entity_id"),
        F.col("ts").alias("prediction_time"),
        F.when(F.day("ts") % 2 == 1, "m1").otherwise("m2").alias("model_version"),
        ((v % 201 - 100) / F.lit(10000.0)).alias("prediction"),
        ((v % 101) / F.lit(100.0)).alias("probability"),
        F.when(v % 2 == 0, "OUTPERFORM").otherwise("UNDERPERFORM").alias("predicted_value"),
    )


AROUND = """around AS (SELECT p.*, a.close AS price_t0, a.ts AS price_t0_at, b.close AS price_t1, b.ts AS price_t1_at
  FROM (SELECT *, prediction_time + 20 AS target_date FROM predictions) p
  ASOF LEFT JOIN market_prices a ON p.entity_id = a.symbol AND p.prediction_time >= a.ts
  ASOF LEFT JOIN market_prices b ON p.entity_id = b.symbol AND p.target_date <= b.ts)"""


@query(
    "join_12",
    sql(
        MARKET,
        PREDICTIONS,
        AROUND,
        "SELECT prediction_id, price_t0, CAST(price_t0_at AS VARCHAR) AS price_t0_at, price_t1, CAST(price_t1_at AS VARCHAR) AS price_t1_at FROM around",
    ),
)
def join_12(spark, sf):
    asked = predictions(spark, sf).withColumn("target_date", F.date_add("prediction_time", 20)).withColumnRenamed("entity_id", "symbol")
    df = J.price_around(asked, V.market_prices(spark, sf), "symbol", "prediction_time", "target_date")
    return df.select("prediction_id", "price_t0", "price_t0_at", "price_t1", "price_t1_at")


COMPOSITION = """composition(symbol, weight, effective_date) AS (VALUES ('ECONOMY', 0.6::DOUBLE, DATE '1996-01-01'), ('PROMO', 0.4::DOUBLE, DATE '1996-01-01'),
  ('ECONOMY', 0.2::DOUBLE, DATE '1999-06-01'), ('PROMO', 0.8::DOUBLE, DATE '1999-06-01'))"""


@query(
    "join_15",
    sql(
        RETURNS,
        COMPOSITION,
        f"""SELECT r.symbol, CAST(r.ts AS VARCHAR) AS ts, {r('r.log_return', 8)} AS log_return, c.weight, CAST(c.effective_date AS VARCHAR) AS effective_date
FROM (SELECT * FROM returns WHERE symbol IN ('ECONOMY', 'PROMO')) r ASOF LEFT JOIN composition c ON r.symbol = c.symbol AND r.ts >= c.effective_date""",
    ),
)
def join_15(spark, sf):
    rows = [("ECONOMY", 0.6, "1996-01-01"), ("PROMO", 0.4, "1996-01-01"), ("ECONOMY", 0.2, "1999-06-01"), ("PROMO", 0.8, "1999-06-01")]
    comp = spark.createDataFrame(rows, "symbol string, weight double, d string").select(F.lit("main").alias("portfolio"), "symbol", "weight", F.to_date("d").alias("effective_date"))
    df = J.weights_asof(V.returns(spark, sf), comp)
    return df.select("symbol", "ts", rnd("log_return", 8).alias("log_return"), "weight", "effective_date")


AMENDED = """amended AS (SELECT * FROM filing_facts UNION ALL
  SELECT cik, accession_number || 'A', form_type, filing_date + 10, end_date, concept, value * 1.01::DOUBLE FROM filing_facts WHERE form_type = '10-Q' AND month(end_date) = 3)"""
METRIC = """CASE concept WHEN 'us-gaap:Revenues' THEN 'Revenue' WHEN 'us-gaap:NetIncomeLoss' THEN 'Net Income' WHEN 'us-gaap:OperatingIncomeLoss' THEN 'Operating Income'
  WHEN 'us-gaap:Assets' THEN 'Total Assets' WHEN 'us-gaap:Liabilities' THEN 'Total Liabilities' WHEN 'us-gaap:StockholdersEquity' THEN 'Shareholders'' Equity' END"""


def amended(spark, sf):
    base = V.filing_facts(spark, sf)
    again = base.where((F.col("form_type") == "10-Q") & (F.month("end_date") == 3)).select(
        "cik", F.concat("accession_number", F.lit("A")).alias("accession_number"), "form_type", F.date_add("filing_date", 10).alias("filing_date"),
        "end_date", "concept", (F.col("value") * 1.01).alias("value"),
    )
    return base.unionByName(again)


STATEMENTS = """stm AS (SELECT cik, end_date, form_type, max(CASE WHEN metric = 'Revenue' THEN value END) AS revenue, max(CASE WHEN metric = 'Net Income' THEN value END) AS net_income,
  max(CASE WHEN metric = 'Operating Income' THEN value END) AS operating_income, max(CASE WHEN metric = 'Total Assets' THEN value END) AS total_assets,
  max(CASE WHEN metric = 'Total Liabilities' THEN value END) AS total_liabilities, CAST(NULL AS DOUBLE) AS cash_and_equivalents, CAST(NULL AS DOUBLE) AS long_term_debt,
  max(CASE WHEN metric = 'Shareholders'' Equity' THEN value END) AS shareholders_equity
  FROM (SELECT *, """ + METRIC + """ AS metric, row_number() OVER (PARTITION BY cik, end_date, concept ORDER BY filing_date DESC, accession_number DESC) AS k FROM amended) WHERE k = 1
  GROUP BY 1, 2, 3)"""


@query(
    "agg_01",
    sql(
        FACTS,
        AMENDED,
        STATEMENTS,
        "SELECT *  REPLACE (CAST(end_date AS VARCHAR) AS end_date), contains(form_type, '10-K') AS is_annual, CASE WHEN contains(form_type, '10-K') THEN 'FY' ELSE 'Q' END AS fiscal_period FROM stm",
    ),
)
def agg_01(spark, sf):
    return prepare.statements(amended(spark, sf))


MACRO_NAMES = dict(zip(V.MACRO_SERIES, ["fedfunds", "cpiaucsl", "unrate", "gdp", "gs10"]))


@query(
    "agg_02",
    sql(
        MACRO,
        "latest AS (SELECT series_id, observation_date, max_by(value, realtime_start) AS value FROM macro_obs GROUP BY 1, 2)",
        "SELECT CAST(observation_date AS VARCHAR) AS observation_date, "
        + ", ".join(f"max(CASE WHEN series_id = '{s}' THEN value END) AS {c}" for s, c in MACRO_NAMES.items())
        + " FROM latest GROUP BY 1",
    ),
)
def agg_02(spark, sf):
    return prepare.macro_table(V.macro_obs(spark, sf), MACRO_NAMES)


@query(
    "agg_03",
    sql(
        FACTS,
        """SELECT cik, CAST(filing_date AS VARCHAR) AS filing_date, max(CASE WHEN concept = 'us-gaap:Revenues' THEN value END) AS revenue, max(CASE WHEN concept = 'us-gaap:NetIncomeLoss' THEN value END) AS net_income,
  max(CASE WHEN concept = 'us-gaap:OperatingIncomeLoss' THEN value END) AS operating_income, max(CASE WHEN concept = 'us-gaap:Assets' THEN value END) AS assets,
  max(CASE WHEN concept = 'us-gaap:Liabilities' THEN value END) AS liabilities, max(CASE WHEN concept = 'us-gaap:StockholdersEquity' THEN value END) AS equity
FROM filing_facts GROUP BY 1, 2""",
    ),
)
def agg_03(spark, sf):
    return X.concept_panel(V.filing_facts(spark, sf))


@query(
    "agg_04",
    sql(RETURNS, MONTHLY, f"SELECT symbol, CAST(month_end AS VARCHAR) AS month_end, CASE WHEN n > 0 THEN {r('log_return', 8)} END AS log_return FROM mm"),
)
def agg_04(spark, sf):
    return J.monthly_market(V.returns(spark, sf)).select("symbol", "month_end", rnd("log_return", 8).alias("log_return"))


PUBLISHED = """pub AS (SELECT last_day(realtime_start) AS month_end, series_id, max_by(value, (realtime_start, observation_date)) AS value FROM macro_obs GROUP BY 1, 2)"""


@query(
    "agg_05",
    sql(
        RETURNS,
        MACRO,
        MONTHLY,
        PUBLISHED,
        f"""SELECT m.symbol, CAST(m.month_end AS VARCHAR) AS month_end, max(CASE WHEN m.n > 0 THEN {r('m.log_return', 8)} END) AS log_return,
  """
        + ", ".join(f"max(CASE WHEN series_id = '{s}' THEN value END) AS {c}" for s, c in MACRO_NAMES.items())
        + " FROM mm m JOIN pub ON m.month_end = pub.month_end GROUP BY m.symbol, m.month_end",
    ),
)
def agg_05(spark, sf):
    df = prepare.align_point_in_time(V.returns(spark, sf), V.macro_obs(spark, sf), V.MACRO_SERIES)
    return df.select("symbol", "month_end", rnd("log_return", 8).alias("log_return"), *[F.col(s).alias(c) for s, c in MACRO_NAMES.items()])


HASHED = """hashed AS (SELECT article_id, published_at, sha256(lower(title || '|' || url || '|' || source_name)) AS content_hash FROM news),
canon AS (SELECT h.*, first_value(article_id) OVER (PARTITION BY content_hash ORDER BY published_at, article_id) AS canonical_article_id FROM hashed h)"""


@query(
    "agg_08",
    sql(
        NEWS,
        HASHED,
        "SELECT canonical_article_id, article_id AS duplicate_article_id, 'Identical content_hash (title+url+source)' AS decision_reason FROM canon WHERE article_id <> canonical_article_id",
    ),
)
def agg_08(spark, sf):
    return prepare.duplicates_log(prepare.split_duplicates(V.news(spark, sf), ["published_at"]))


@query(
    "agg_09",
    sql(
        NEWS,
        HASHED,
        """SELECT strftime(c.published_at, '%Y-%m') AS run_id, count(*) AS received, count(*) FILTER (WHERE length(n.title) >= 50 AND c.article_id = canonical_article_id) AS inserted,
  count(*) FILTER (WHERE length(n.title) >= 50 AND c.article_id <> canonical_article_id) AS duplicates, count(*) FILTER (WHERE length(n.title) < 50) AS errors
FROM canon c JOIN news n ON c.article_id = n.article_id GROUP BY 1""",
    ),
)
def agg_09(spark, sf):
    df = prepare.split_duplicates(V.news(spark, sf), ["published_at"])
    status = F.when(F.length("title") < 50, "ERROR").when(F.col("is_duplicate"), "DUPLICATE").otherwise("INSERTED")
    return prepare.run_counters(df.select(F.date_format("published_at", "yyyy-MM").alias("run_id"), status.alias("status")))


@query(
    "agg_11",
    """WITH tags AS (SELECT DISTINCT lpad(CAST(c_nationkey AS VARCHAR), 10, '0') AS cik, 'us-gaap:' || replace(p_name, ' ', '') AS concept
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey)
SELECT cik, count(*) AS unmapped_count, array_to_string(list_slice(list_sort(list(concept)), 1, 10), ',') AS unmapped_concepts FROM tags GROUP BY cik""",
)
def agg_11(spark, sf):
    li = V.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    od = V.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    cu = V.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    pa = V.table(spark, sf, "part").select("p_partkey", "p_name")
    df = li.join(od, li.l_orderkey == od.o_orderkey).join(cu, F.col("o_custkey") == F.col("c_custkey")).join(pa, F.col("l_partkey") == F.col("p_partkey"))
    tags = df.select(F.lpad(F.col("c_nationkey").cast("string"), 10, "0").alias("cik"), F.concat(F.lit("us-gaap:"), F.replace("p_name", F.lit(" "), F.lit(""))).alias("concept"))
    return prepare.unmapped_concepts(tags).withColumn("unmapped_concepts", F.concat_ws(",", "unmapped_concepts"))


@query(
    "pit_01",
    """SELECT 'receipt_time' AS availability_column, count(*) FILTER (WHERE l_shipdate + INTERVAL 2 DAY > o_orderdate + INTERVAL 60 DAY) AS leaked_rows FROM lineitem JOIN orders ON l_orderkey = o_orderkey
UNION ALL SELECT 'ship_time', count(*) FILTER (WHERE l_shipdate > o_orderdate + INTERVAL 60 DAY) FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def pit_01(spark, sf):
    li = V.table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate")
    od = V.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    df = li.join(od, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.date_add("o_orderdate", 60).alias("prediction_time"), F.to_date("l_shipdate").alias("ship_time"), F.date_add("l_shipdate", 2).alias("receipt_time")
    )
    return pit.leakage_report(df, "prediction_time", ["ship_time", "receipt_time"])


@query(
    "pit_02",
    sql(
        MARKET,
        FEATURES,
        TARGETS,
        """SELECT 'available_at_after_prediction_time' AS check_name, count(*) FILTER (WHERE prediction_time - 1 > prediction_time) AS violations FROM feats JOIN targs USING (symbol, prediction_time) WHERE target_value IS NOT NULL
UNION ALL SELECT 'target_not_after_prediction', count(*) FILTER (WHERE target_end_time <= prediction_time) FROM feats JOIN targs USING (symbol, prediction_time) WHERE target_value IS NOT NULL""",
    ),
)
def pit_02(spark, sf):
    df = J.supervised_join(features(spark, sf), pit.targets(V.market_prices(spark, sf), 5)).withColumn("available_at", F.date_sub("prediction_time", 1))
    return pit.dataset_violations(df, ["available_at"])


@query(
    "pit_03",
    sql(
        MARKET,
        NEWS,
        FACTS,
        PREDICTIONS,
        """SELECT 'market' AS source, count(*) AS n, CAST(max(ts) AS VARCHAR) AS latest FROM market_prices WHERE ts <= DATE '1998-06-30'
UNION ALL SELECT 'news', count(*), CAST(max(published_at) AS VARCHAR) FROM news WHERE published_at <= TIMESTAMP '1998-06-30 12:00:00'
UNION ALL SELECT 'prediction', count(*), CAST(max(prediction_time) AS VARCHAR) FROM predictions WHERE prediction_time <= DATE '1998-06-30'
UNION ALL SELECT 'filing', count(*), CAST(max(filing_date) AS VARCHAR) FROM (SELECT DISTINCT accession_number, filing_date FROM filing_facts) WHERE filing_date <= DATE '1998-06-30'""",
    ),
)
def pit_03(spark, sf):
    cutoff = F.lit("1998-06-30 12:00:00").cast("timestamp")
    tables = {"market": V.market_prices(spark, sf), "news": V.news(spark, sf), "prediction": predictions(spark, sf), "filing": V.filings(spark, sf)}
    parts = [
        pit.known_by(df, name, cutoff).agg(F.count(F.lit(1)).alias("n"), F.max(pit.KNOWN_AT[name]).cast("string").alias("latest")).select(F.lit(name).alias("source"), "n", "latest")
        for name, df in tables.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


TARGET_COLS = f"symbol, CAST(prediction_time AS VARCHAR) AS prediction_time, CAST(target_end_time AS VARCHAR) AS target_end_time"


@query("tgt_01", sql(MARKET, TARGETS, f"SELECT {TARGET_COLS}, {r('target_value', 8)} AS target_value FROM targs WHERE target_value IS NOT NULL"))
def tgt_01(spark, sf):
    return pit.targets(V.market_prices(spark, sf), 5).withColumn("target_value", rnd("target_value", 8))


@query("tgt_02", sql(MARKET, TARGETS, f"SELECT {TARGET_COLS}, CASE WHEN target_value > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS target_value FROM targs WHERE target_value IS NOT NULL"))
def tgt_02(spark, sf):
    return pit.targets(V.market_prices(spark, sf), 5, "classification_direction")


BOUNDS = {"train_end": "1998-12-31", "validation": ("1999-01-01", "2000-06-30"), "test_start": "2000-07-01"}
PARTITION = """CASE WHEN prediction_time <= DATE '1998-12-31' THEN 'TRAIN' WHEN prediction_time BETWEEN DATE '1999-01-01' AND DATE '2000-06-30' THEN 'VALIDATION' WHEN prediction_time >= DATE '2000-07-01' THEN 'TEST' END"""


@query(
    "join_04_dataset",
    sql(
        MARKET,
        FEATURES,
        TARGETS,
        f"""SELECT symbol, CAST(prediction_time AS VARCHAR) AS prediction_time, CAST(target_end_time AS VARCHAR) AS target_end_time, {r('ret_5d', 8)} AS ret_5d, {r('target_value', 8)} AS target_value,
  CASE WHEN prediction_time <= DATE '1998-12-31' THEN 'TRAIN' WHEN prediction_time BETWEEN DATE '1999-01-01' AND DATE '2000-06-30' THEN 'VALIDATION' ELSE 'TEST' END AS partition
FROM feats JOIN targs USING (symbol, prediction_time) WHERE target_value IS NOT NULL AND (prediction_time <= DATE '1998-12-31' OR prediction_time >= DATE '1999-01-01')""",
    ),
)
def join_04_dataset(spark, sf):
    """The supervised dataset in one call: joined, checked for leakage (prices are known on their day), split by time."""
    known = features(spark, sf).withColumn("prices_known_at", F.col("prediction_time"))
    df = pit.build_dataset(known, pit.targets(V.market_prices(spark, sf), 5), ["prices_known_at"], **BOUNDS)
    return df.select("symbol", "prediction_time", "target_end_time", rnd("ret_5d", 8).alias("ret_5d"), rnd("target_value", 8).alias("target_value"), "partition")


@query("ds_01", sql(MARKET, TARGETS, f"SELECT symbol, CAST(prediction_time AS VARCHAR) AS prediction_time, {PARTITION} AS partition FROM targs WHERE target_value IS NOT NULL"))
def ds_01(spark, sf):
    return pit.assign_partitions(pit.targets(V.market_prices(spark, sf), 5), **BOUNDS).select("symbol", "prediction_time", "partition")


@query(
    "agg_12",
    sql(
        MARKET,
        TARGETS,
        f"""SELECT {PARTITION} AS partition, count(*) AS n, {r('avg(target_value)', 8)} AS target_mean, {r('avg(CASE WHEN target_value > 0 THEN 1.0 ELSE 0.0 END)', 8)} AS positive_ratio
FROM targs WHERE target_value IS NOT NULL GROUP BY 1""",
    ),
)
def agg_12(spark, sf):
    df = prepare.dataset_summary(pit.assign_partitions(pit.targets(V.market_prices(spark, sf), 5), **BOUNDS))
    return df.select("partition", "n", rnd("target_mean", 8).alias("target_mean"), rnd("positive_ratio", 8).alias("positive_ratio"))


@query(
    "ds_02",
    sql(
        MARKET,
        "t AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM market_prices))",
        "f AS (SELECT CAST(unnest(range(0, 4)) AS INTEGER) AS fold)",
        "x AS (SELECT *, n // 5 AS size, n - (fold + 1) * (n // 5) AS start FROM t, f)",
        """SELECT CAST(ts AS VARCHAR) AS ts, fold, CASE WHEN i >= start AND i < start + size THEN 'VALIDATION' WHEN i < start - 10 THEN 'TRAIN' END AS role
FROM x WHERE start - 10 > 0 AND ((i >= start AND i < start + size) OR i < start - 10)""",
    ),
)
def ds_02(spark, sf):
    return pit.embargo_folds(V.market_prices(spark, sf), "ts", n_splits=4, gap=10)


@query(
    "ds_03",
    sql(
        MARKET,
        "b AS (SELECT min(ts) AS lo, max(ts) AS hi FROM market_prices)",
        "k AS (SELECT CAST(unnest(range(1, 30)) AS INTEGER) AS fold)",
        "f AS (SELECT fold, lo AS train_start, lo + 365 + (fold - 1) * 180 AS train_end, lo + 385 + (fold - 1) * 180 AS test_start, least(lo + 565 + (fold - 1) * 180, hi) AS test_end, hi FROM b, k)",
        """SELECT fold, role, count(*) AS n, CAST(min(ts) AS VARCHAR) AS first_day, CAST(max(ts) AS VARCHAR) AS last_day FROM (
  SELECT fold, 'TRAIN' AS role, ts FROM market_prices JOIN f ON ts >= train_start AND ts < train_end WHERE test_start < hi
  UNION ALL SELECT fold, 'TEST', ts FROM market_prices JOIN f ON ts >= test_start AND ts < test_end WHERE test_start < hi) GROUP BY 1, 2""",
    ),
)
def ds_03(spark, sf):
    rows = pit.walk_forward_folds(V.market_prices(spark, sf), "ts", 365, 180, 20)
    return rows.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_day"), F.max("ts").alias("last_day"))
