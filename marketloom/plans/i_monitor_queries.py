from pyspark.sql import functions as F

from marketloom.functions.expr import rnd
from marketloom.operators import assess as I
from marketloom.operators import models as M
from marketloom.operators import monitor as N
from marketloom.operators import prepare
from marketloom.operators import research as S
from marketloom.operators import risk as R
from marketloom.operators import validate as Q
from marketloom.plans.c_join_queries import AROUND, PREDICTIONS, predictions
from marketloom.plans.f_ingest_queries import DEFECTIVE, UPSERTED, defective, later_bars
from marketloom.plans.g_text_queries import FEEL_OK, FOUND_OK, RESOLVED, TOPICS_OK, annotated, main_topics, tickers
from marketloom.plans.h_model_queries import FEATS, dataset
from marketloom.plans.registry import query
from marketloom.plans.sqlviews import MARKET, NEWS, RETURNS, r, sql
from marketloom.session import materialize, scratch_path
from marketloom.sources import views as V
from marketloom.sources.versions import read_table
from marketloom.streaming import keyed, live


def at(s):
    return F.lit(s).cast("timestamp")


def rounded(df, cols, digits=6):
    return df.withColumns({c: rnd(c, digits) for c in cols})


# --- drift and performance -------------------------------------------------------------------------

SAMPLES = """lo AS (SELECT ts, volume::DOUBLE AS volume, close FROM market_prices),
dl AS (SELECT 'volume' AS feature, volume AS value, ts FROM lo UNION ALL SELECT 'close', close, ts FROM lo),
ds AS (SELECT feature, value, CASE WHEN ts < DATE '1998-01-01' THEN 'REF' WHEN ts >= DATE '1999-01-01' THEN 'CUR' END AS s FROM dl WHERE ts < DATE '1998-01-01' OR ts >= DATE '1999-01-01')"""


def samples(df, features):
    d = lambda s: F.lit(s).cast("date")
    return N.drift_samples(df, features, F.col("ts") < d("1998-01-01"), F.col("ts") >= d("1999-01-01"))


QS = "[" + ", ".join(str(i / 10) for i in range(11)) + "]"
PSI = f"""pe AS (SELECT feature, quantile_cont(value, {QS}) AS e FROM ds WHERE s = 'REF' GROUP BY feature),
pb AS (SELECT d.feature, d.s, CASE WHEN value BETWEEN e[1] AND e[11] THEN len(list_filter(e[2:10], lambda x: x <= value)) END AS b FROM ds d JOIN pe USING (feature)),
pc AS (SELECT feature, b, count(*) FILTER (WHERE s = 'REF') AS r, count(*) FILTER (WHERE s = 'CUR') AS c FROM pb GROUP BY 1, 2),
pt AS (SELECT feature, sum(r) AS rr, sum(c) AS cc FROM pc GROUP BY 1),
pg AS (SELECT pt.*, unnest(range(0, 10)) AS b FROM pt),
ps AS (SELECT pg.feature, CASE WHEN coalesce(r, 0) = 0 THEN 0.0001::DOUBLE ELSE r / rr END AS e, CASE WHEN coalesce(c, 0) = 0 THEN 0.0001::DOUBLE ELSE c / cc END AS a FROM pg LEFT JOIN pc ON pc.feature = pg.feature AND pc.b = pg.b),
psi AS (SELECT feature, sum((a - e) * ln(a / e)) AS v FROM ps GROUP BY 1)"""
KS = """kc AS (SELECT feature, value, count(*) FILTER (WHERE s = 'REF') AS r, count(*) FILTER (WHERE s = 'CUR') AS c FROM ds GROUP BY 1, 2),
kf AS (SELECT feature, abs(sum(r) OVER w / sum(r) OVER t - sum(c) OVER w / sum(c) OVER t) AS gap FROM kc WINDOW w AS (PARTITION BY feature ORDER BY value), t AS (PARTITION BY feature)),
ks AS (SELECT feature, max(gap) AS v FROM kf GROUP BY 1)"""


@query("mon_01", sql(MARKET, SAMPLES, PSI, f"SELECT feature, {r('v')} AS value FROM psi"))
def mon_01(spark, sf):
    return rounded(N.psi(samples(V.market_prices(spark, sf), ["volume", "close"])), ["value"])


@query("mon_02", sql(MARKET, SAMPLES, KS, f"SELECT feature, {r('v')} AS value FROM ks"))
def mon_02(spark, sf):
    return rounded(N.ks(samples(V.market_prices(spark, sf), ["volume", "close"])), ["value"])


DRIFT = "0.05::DOUBLE AS threshold, CASE WHEN v > 0.05 THEN 'DRIFTED' ELSE 'OK' END AS status, CASE WHEN v > 0.05 * 1.5 THEN 'CRITICAL' WHEN v > 0.05 THEN 'WARNING' END AS severity"


@query("mon_03", sql(MARKET, SAMPLES, PSI, KS, f"SELECT feature, 'PSI' AS metric, {r('v')} AS drift_value, {DRIFT} FROM psi UNION ALL SELECT feature, 'KS', {r('v')}, {DRIFT} FROM ks"))
def mon_03(spark, sf):
    s = samples(V.market_prices(spark, sf), ["volume", "close"])
    return rounded(N.drift(s, "PSI", 0.05).unionByName(N.drift(s, "KS", 0.05)), ["drift_value"])


@query(
    "mon_04",
    sql(
        MARKET, PREDICTIONS,
        "ds AS (SELECT model_version AS feature, prediction AS value, CASE WHEN prediction_time < DATE '1998-01-01' THEN 'REF' ELSE 'CUR' END AS s FROM predictions WHERE prediction_time < DATE '1998-01-01' OR prediction_time >= DATE '1999-01-01')",
        KS, f"SELECT feature AS model_version, 'KS' AS metric, {r('v')} AS drift_value, {DRIFT} FROM ks",
    ),
)
def mon_04(spark, sf):
    t, d = F.col("prediction_time"), lambda s: F.lit(s).cast("date")
    label = F.when(t < d("1998-01-01"), "REF").when(t >= d("1999-01-01"), "CUR")
    s = predictions(spark, sf).select("model_version", F.col("prediction").alias("value"), label.alias("sample")).where("sample IS NOT NULL")
    return rounded(N.drift(s, "KS", 0.05, by="model_version"), ["drift_value"])


ALERTS = """ol AS (SELECT DISTINCT 'drift_' || p_type AS metric FROM part WHERE p_type IN ('LARGE', 'SMALL', 'PROMO')),
lv AS (SELECT p_type, count(*) / 1.0::DOUBLE AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
th AS (SELECT avg(v) AS t FROM lv),
sg AS (SELECT 'drift_' || p_type AS metric, v > t AS firing, v FROM lv, th WHERE p_type <> 'PROMO')"""


@query(
    "mon_05",
    "WITH " + ALERTS + """ SELECT coalesce(o.metric, s.metric) AS metric, 'DRIFT' AS source, CASE WHEN s.firing THEN s.v ELSE 0.5::DOUBLE END AS observed_value, CASE WHEN s.firing = false THEN 'RESOLVED' ELSE 'ACTIVE' END AS status,
  CASE WHEN s.firing THEN '2002-01-01 00:00:00' ELSE '2001-12-31 00:00:00' END AS timestamp FROM ol o FULL OUTER JOIN sg s ON o.metric = s.metric WHERE o.metric IS NOT NULL OR s.firing""",
)
def mon_05(spark, sf):
    """Alerts on symbols with more rows than average; three symbols have an active alert already."""
    li = V.table(spark, sf, "lineitem").select("l_partkey").join(V.table(spark, sf, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    lv = li.groupBy("p_type").agg((F.count(F.lit(1)) / F.lit(1.0)).alias("v"))
    mean = lv.agg(F.avg("v").alias("t")).withColumn("_k", F.lit(1))
    j = lv.withColumn("_k", F.lit(1)).join(mean, "_k").where("p_type <> 'PROMO'")
    signals = j.select(
        F.concat(F.lit("drift_"), "p_type").alias("metric"), F.lit("DRIFT").alias("source"), (F.col("v") > F.col("t")).alias("is_firing"), F.col("v").alias("observed_value"),
        F.col("t").alias("threshold"), F.lit("WARNING").alias("severity"), F.lit("busy").alias("message"), at("2002-01-01").alias("at"),
    )
    old = V.table(spark, sf, "part").where(F.col("p_type").isin("LARGE", "SMALL", "PROMO")).select("p_type").distinct()
    alerts = old.select(
        F.concat(F.lit("a-"), "p_type").alias("alert_id"), F.concat(F.lit("drift_"), "p_type").alias("metric"), F.lit("DRIFT").alias("source"), F.lit(0.5).alias("observed_value"),
        F.lit(0.2).alias("threshold"), F.lit("WARNING").alias("severity"), F.lit("old").alias("message"), at("2001-12-31").alias("timestamp"), F.lit("ACTIVE").alias("status"),
    )
    return N.update_alerts(alerts, signals).select("metric", "source", "observed_value", "status", "timestamp")


RESOLVED_PREDICTIONS = """rp AS (SELECT *, CASE WHEN (price_t1 - price_t0) / price_t0 > 0 THEN 'OUTPERFORM' ELSE 'UNDERPERFORM' END AS actual FROM around
  WHERE price_t0 IS NOT NULL AND price_t1 IS NOT NULL AND target_date <= DATE '2001-06-30' AND NOT (entity_id = 'LARGE' AND model_version = 'm1'))"""


def performance(spark, sf):
    p = predictions(spark, sf)
    done = p.where("entity_id = 'LARGE' AND model_version = 'm1'").select("prediction_id")
    return N.resolve_predictions(p, V.market_prices(spark, sf), done, at("2001-06-30"))


@query("mon_06", sql(MARKET, PREDICTIONS, AROUND, RESOLVED_PREDICTIONS, "SELECT prediction_id, entity_id, CAST(prediction_time AS VARCHAR) AS prediction_time, predicted_value AS prediction, actual, CAST(20 AS INTEGER) AS horizon, model_version, CAST(predicted_value = actual AS INTEGER) AS is_correct FROM rp"))
def mon_06(spark, sf):
    return performance(spark, sf).drop("probability", "calculated_at")


@query("mon_07", sql(MARKET, PREDICTIONS, AROUND, RESOLVED_PREDICTIONS, f"SELECT model_version, count(*) AS n, {r('avg(CAST(predicted_value = actual AS INTEGER))', 8)} AS accuracy FROM rp WHERE prediction_time >= DATE '2001-06-30' - 365 GROUP BY 1"))
def mon_07(spark, sf):
    """Trailing year by prediction day (all rows here are computed on one day)."""
    return rounded(N.trailing_accuracy(performance(spark, sf), at("2001-06-30"), 365, "prediction_time"), ["accuracy"], 8)


# --- research --------------------------------------------------------------------------------------

REGIMES = """rg0 AS (SELECT symbol, ts, close, volume, CASE WHEN count(daily_return) OVER f >= 60 THEN stddev_samp(daily_return) OVER f * sqrt(252) END AS vol_60d, close / lag(close, 60) OVER w - 1 AS ret_60d,
  lead(close, 20) OVER w / close - 1 AS fwd FROM returns WINDOW w AS (PARTITION BY symbol ORDER BY ts), f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
rg1 AS (SELECT *, quantile_cont(vol_60d, 0.5) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS med FROM rg0),
rg AS (SELECT symbol, ts, CASE WHEN vol_60d IS NULL OR ret_60d IS NULL THEN 'Regime_Unknown' ELSE 'Regime_' || CASE WHEN vol_60d > med THEN 'HighVol' ELSE 'LowVol' END || '_' || CASE WHEN ret_60d > 0 THEN 'PosRet' ELSE 'NegRet' END END AS regime_label,
  CASE WHEN volume % 7 <> 0 THEN CASE WHEN volume % 2 = 0 THEN 1 ELSE 0 END END AS predicted, CASE WHEN fwd IS NOT NULL THEN CASE WHEN fwd > 0 THEN 1 ELSE 0 END END AS actual FROM rg1)"""
SCORE = f"""count(*) FILTER (WHERE predicted IS NOT NULL AND actual IS NOT NULL) AS sample_size, {r('avg(CASE WHEN predicted = actual THEN 1.0::DOUBLE WHEN predicted <> actual THEN 0 END)', 8)} AS accuracy,
  {r('coalesce(2 * count(*) FILTER (WHERE predicted = 1 AND actual = 1) / nullif(2 * count(*) FILTER (WHERE predicted = 1 AND actual = 1) + count(*) FILTER (WHERE predicted <> actual), 0), 0)', 8)} AS f1_score,
  {r('avg(CASE WHEN predicted IS NOT NULL THEN actual END)', 8)} AS baseline_accuracy, {r('1 - count(*) FILTER (WHERE predicted IS NOT NULL AND actual IS NOT NULL) / count(*)', 8)} AS missingness_pct,
  CAST(avg(CASE WHEN predicted = actual THEN 1.0::DOUBLE WHEN predicted <> actual THEN 0 END) > avg(CASE WHEN predicted IS NOT NULL THEN actual END) AS INTEGER) AS beats_baseline"""
SCORED = ["accuracy", "f1_score", "baseline_accuracy", "missingness_pct"]


def regimes(spark, sf, label=True):
    df = V.returns(spark, sf)
    df = S.label_regimes(df) if label else df
    v = F.col("volume")
    return S.add_outcome(df).withColumn("predicted", F.when(v % 7 != 0, (v % 2 == 0).cast("int")))


@query("res_01", sql(RETURNS, REGIMES, "SELECT symbol, CAST(ts AS VARCHAR) AS ts, regime_label FROM rg"))
def res_01(spark, sf):
    return S.label_regimes(V.returns(spark, sf)).select("symbol", "ts", "regime_label")


@query("res_02", sql(RETURNS, REGIMES, f"SELECT *, CASE WHEN accuracy > 0.52 THEN 'STABLE' ELSE 'UNSTABLE' END AS status FROM (SELECT symbol, {SCORE} FROM rg GROUP BY symbol)"))
def res_02(spark, sf):
    return rounded(S.by_asset(regimes(spark, sf, False)), SCORED, 8)


@query(
    "res_03",
    sql(
        RETURNS, REGIMES,
        f"""SELECT *, CAST(row_number() OVER (ORDER BY accuracy, year) = 1 AS INTEGER) AS is_worst_period, CAST(row_number() OVER (ORDER BY accuracy DESC, year DESC) = 1 AS INTEGER) AS is_best_period FROM (SELECT year(ts)::INTEGER AS year, {SCORE} FROM rg GROUP BY 1 HAVING count(*) FILTER (WHERE predicted IS NOT NULL AND actual IS NOT NULL) > 0)""",
    ),
)
def res_03(spark, sf):
    return rounded(S.by_year(regimes(spark, sf, False)), SCORED, 8)


@query("res_04", sql(RETURNS, REGIMES, f"SELECT regime_label, {SCORE} FROM rg GROUP BY 1"))
def res_04(spark, sf):
    return rounded(S.by_regime(regimes(spark, sf)), SCORED, 8)


@query("res_05")
def res_05(spark, sf):
    df = dataset(spark, sf, "classification_direction")
    groups = {"A": FEATS[:2], "B": FEATS[2:3], "C": FEATS[3:]}
    out = M.ablation(df, groups, "logistic_regression", "target_value", "prediction_time", train_window=1200, step=700, gap=20)
    return rounded(out, ["accuracy", "worst_fold", "increment"], 4)


@query(
    "res_06",
    """WITH a AS (SELECT o_orderpriority AS run, 'orders' AS metric, count(*) * 1.0::DOUBLE AS value FROM orders GROUP BY 1 UNION ALL SELECT o_orderpriority, 'finished', count(*) FILTER (WHERE o_orderstatus = 'F') FROM orders GROUP BY 1),
b AS (SELECT o_orderpriority AS run, 'orders' AS metric, count(*) * 1.0::DOUBLE AS value FROM orders GROUP BY 1 UNION ALL SELECT o_orderpriority, 'finished', count(*) FILTER (WHERE o_orderstatus <> 'P') FROM orders GROUP BY 1)
SELECT run, metric, a.value AS original_value, b.value AS rerun_value, abs(a.value - b.value) AS difference, 0.00001::DOUBLE AS tolerance, CASE WHEN abs(a.value - b.value) <= 0.00001 THEN 'PASSED' ELSE 'FAILED' END AS status FROM a FULL OUTER JOIN b USING (run, metric)""",
)
def res_06(spark, sf):
    """A rerun that counts a status too many must fail on that metric alone."""

    def table(cond):
        g = V.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("run")).agg(F.count(F.lit(1)).cast("double").alias("orders"), F.count_if(cond).cast("double").alias("finished"))
        return g.unpivot(["run"], ["orders", "finished"], "metric", "value")

    s = F.col("o_orderstatus")
    return S.reproduction(table(s == "F"), table(s != "P"), F.lit(1e-5))


# --- assessment ------------------------------------------------------------------------------------

CUT = "2000-03-31 12:00:00"
TIMELINE = f"""tn AS (SELECT r.canonical_entity_id AS entity_id, n.published_at AS t, 'NEWS EVENT' AS type, sha256('In the news: ' || n.title) AS description, CAST(n.article_id AS VARCHAR) AS source_id,
  row_number() OVER (PARTITION BY r.canonical_entity_id ORDER BY n.published_at DESC, n.article_id) AS k FROM news n JOIN res r USING (article_id) WHERE r.canonical_entity_id IS NOT NULL AND n.published_at <= TIMESTAMP '{CUT}'),
tm AS (SELECT symbol, CAST(ts AS TIMESTAMP) AS t, 'MARKET OBSERVATION' AS type, sha256(printf('Close %.2f, log return %s', close, coalesce(printf('%.6f', log_return), 'unknown'))) AS description, symbol || '-' || CAST(ts AS VARCHAR) AS source_id,
  row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM returns WHERE ts <= DATE '2000-03-31'),
tq AS (SELECT entity_id, CAST(prediction_time AS TIMESTAMP) AS t, 'MODEL PREDICTION' AS type, sha256(printf('%s expects %.4f', model_version, prediction)) AS description, prediction_id AS source_id,
  row_number() OVER (PARTITION BY entity_id ORDER BY prediction_time DESC, prediction_id) AS k FROM predictions WHERE prediction_time <= DATE '2000-03-31')"""


@query(
    "agg_10",
    sql(
        NEWS, FOUND_OK, RESOLVED, RETURNS, PREDICTIONS, TIMELINE,
        """SELECT entity_id, CAST(t AS VARCHAR) AS event_time, type, description, source_id FROM tn WHERE k <= 20
UNION ALL SELECT symbol, CAST(t AS VARCHAR), type, description, source_id FROM tm WHERE k <= 5 UNION ALL SELECT entity_id, CAST(t AS VARCHAR), type, description, source_id FROM tq WHERE k <= 5""",
    ),
)
def agg_10(spark, sf):
    n = V.news(spark, sf).join(entity_articles(spark, annotated(spark, sf)), "article_id")
    p = predictions(spark, sf).withColumnRenamed("model_version", "model_name")
    out = prepare.timeline(n, V.returns(spark, sf), p, at(CUT))
    return out.withColumn("description", F.sha2("description", 256))


def entity_articles(spark, seen):
    return tickers(spark, seen).where("canonical_entity_id IS NOT NULL").select("article_id", F.col("canonical_entity_id").alias("entity_id")).distinct()


def assessments(spark, sf, cut, seen=None):
    seen = annotated(spark, sf) if seen is None else seen
    arts = seen.select("article_id", "published_at").join(entity_articles(spark, seen), "article_id")
    feel = seen.select("article_id", "sentiment_label")
    main = main_topics(seen)
    p = predictions(spark, sf)
    why = p.where("model_version = 'm1'").select("prediction_id", F.create_map(F.lit("volume"), F.col("prediction") / 2).alias("attributions"))
    rets = V.returns(spark, sf).where(F.col("ts") <= F.to_date(at(cut)))
    tail = R.historical(rets, ["symbol"], "daily_return", 0.95)
    vol = rets.groupBy("symbol").agg((F.stddev_samp("daily_return") * 252**0.5).alias("annualized_volatility"))
    m = tail.join(vol, "symbol").join(R.max_drawdown(rets, ["symbol"], "ts", "daily_return"), "symbol")
    m = m.withColumns({"historical_cvar": F.col("cvar"), "cvar_99": F.lit(0.0), "top_3_risk_concentration": F.lit(0.0)})
    risk = R.classify(m).select(F.col("symbol").alias("entity_id"), "classification", F.col("var").alias("var_95"), F.col("cvar").alias("cvar_95"))
    by_label = seen.where(F.col("published_at") <= at(cut)).groupBy("sentiment_label").agg(F.max("published_at").alias("created_at"), F.count(F.lit(1)).alias("c"))
    finds = by_label.select("created_at", F.format_string("%s articles: %d", "sentiment_label", "c").alias("finding"))
    return I.assess(p.select("entity_id"), arts, feel, main, p, why, finds, risk, at(cut))


ASSESS = f"""na AS (SELECT * FROM tn WHERE k <= 10),
nf AS (SELECT na.entity_id, count(*) AS n, count(*) FILTER (WHERE sentiment_label = 'POSITIVE') AS pos, count(*) FILTER (WHERE sentiment_label = 'NEGATIVE') AS neg, string_agg(DISTINCT topic, ',' ORDER BY topic) AS topics
  FROM na LEFT JOIN sent s ON s.article_id = CAST(na.source_id AS BIGINT) LEFT JOIN main m ON m.article_id = CAST(na.source_id AS BIGINT) GROUP BY 1),
np AS (SELECT entity_id, max_by(prediction_id, (prediction_time, prediction_id)) AS pid FROM predictions WHERE prediction_time <= DATE '2000-03-31' GROUP BY 1),
rv AS (SELECT symbol, quantile_cont(daily_return, 0.05) AS v, stddev_samp(daily_return) * sqrt(252) AS vol FROM returns WHERE ts <= DATE '2000-03-31' AND daily_return IS NOT NULL GROUP BY 1),
rc AS (SELECT symbol, abs(avg(daily_return) FILTER (WHERE daily_return <= v)) AS es, max(vol) AS vol, abs(min(dd)) AS dd FROM (SELECT r.symbol, r.daily_return, v, vol, w.dd FROM returns r JOIN rv USING (symbol)
  JOIN (SELECT symbol, ts, wl / max(wl) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS dd FROM (SELECT symbol, ts, exp(sum(ln(1 + daily_return)) OVER (PARTITION BY symbol ORDER BY ts)) AS wl FROM returns WHERE daily_return IS NOT NULL AND ts <= DATE '2000-03-31')) w ON w.symbol = r.symbol AND w.ts = r.ts) GROUP BY 1)"""


@query(
    "int_01",
    sql(
        NEWS, FOUND_OK, RESOLVED, FEEL_OK, TOPICS_OK, RETURNS, PREDICTIONS, TIMELINE, ASSESS,
        """SELECT p.entity_id, q.model_version, printf('Expected return: %.4f', q.prediction) AS prediction_text, q.model_version = 'm1' AS has_explanation, coalesce(n, 0) AS recent_articles, coalesce(pos, 0) AS positive, coalesce(neg, 0) AS negative,
  coalesce(topics, '') AS topics, CASE WHEN dd > 0.4 THEN 'CRITICAL' WHEN dd > 0.2 OR es > 0.05 THEN 'HIGH' WHEN vol > 0.15 OR es > 0.02 THEN 'MODERATE' ELSE 'LOW' END AS risk_classification, (SELECT CAST(count(DISTINCT sentiment_label) AS INTEGER) FROM sent JOIN news USING (article_id) WHERE published_at <= TIMESTAMP '"""
        + CUT + """') AS findings
FROM np p JOIN predictions q ON q.prediction_id = p.pid LEFT JOIN nf ON nf.entity_id = p.entity_id JOIN rc ON rc.symbol = p.entity_id""",
    ),
)
def int_01(spark, sf):
    a = assessments(spark, sf, CUT)
    s = F.col("structured_assessment")
    facts = s["OBSERVED_FACTS"]
    return a.select(
        "entity_id", "model_version", s["MODEL_PREDICTIONS"]["Prediction"].alias("prediction_text"), s["INTERPRETATIONS"]["Local_SHAP_Explanation"].isNotNull().alias("has_explanation"),
        facts["Recent_Articles_Count"].alias("recent_articles"), facts["Sentiment_Distribution"]["POSITIVE"].alias("positive"), facts["Sentiment_Distribution"]["NEGATIVE"].alias("negative"),
        F.concat_ws(",", facts["Dominant_Topics"]).alias("topics"), "risk_classification", F.size(s["STATISTICAL_ASSOCIATIONS"]["Findings"]).alias("findings"),
    )


@query(
    "int_02",
    sql(
        MARKET, PREDICTIONS,
        f"""SELECT entity_id, '{CUT}' AS data_cutoff_time, max_by(model_version, (prediction_time, prediction_id)) AS model_version, 'v1' AS feature_version, 'deterministic_v1' AS methodology_version FROM predictions WHERE prediction_time <= DATE '2000-03-31' GROUP BY entity_id""",
    ),
)
def int_02(spark, sf):
    """The newer of two assessments of each entity."""
    seen = annotated(spark, sf)  # both read the same annotations
    both = assessments(spark, sf, CUT, seen).unionByName(assessments(spark, sf, "1998-06-30 00:00:00", seen))
    return I.provenance(both.drop("structured_assessment")).select("entity_id", "data_cutoff_time", "model_version", "feature_version", "methodology_version")


# --- streams ---------------------------------------------------------------------------------------


def landed(spark, df, name, by):
    """Lands a table as several files, so that a stream takes it in several micro-batches."""
    path = scratch_path(spark, name)
    df.repartition(by).write.parquet(path)
    return path


@query(
    "st_01",
    sql(MARKET, DEFECTIVE, "SELECT CASE WHEN check_name IS NULL THEN 'valid' ELSE 'rejected' END AS sink, symbol, count(*) AS n, CAST(sum(volume) AS BIGINT) AS volume FROM flag GROUP BY 1, 2"),
)
def st_01(spark, sf):
    src = landed(spark, defective(V.market_prices(spark, sf)), "in", "symbol")
    schema = spark.read.parquet(src).schema
    ok, bad = scratch_path(spark, "valid"), scratch_path(spark, "rejected")
    live.drain(live.validate_stream(live.read_files(spark, src, schema, 2), Q.check_market, ok, bad, scratch_path(spark, "ck")))
    part = lambda p, s: spark.read.parquet(p).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume")).withColumn("sink", F.lit(s))
    return part(ok, "valid").unionByName(part(bad, "rejected"))


def in_turns(spark, arrivals, start, path):
    """Lands the arrivals turn by turn (column `turn`) and runs the stream on each, from the checkpoint of the one before. Returns
    the table and a side table of the rows that came too late."""
    src, ck, queries = scratch_path(spark, "in"), scratch_path(spark, "ck"), []
    arrivals = materialize(arrivals, "arrivals")
    schema = arrivals.drop("turn").schema
    for turn in range(arrivals.agg(F.coalesce(F.max("turn"), F.lit(-1)).alias("t")).first().t + 1):
        arrivals.where(F.col("turn") == turn).drop("turn").write.mode("append").parquet(src)
        queries.append(start(live.read_files(spark, src, schema), path, ck))
        live.drain(queries[-1])
    late = scratch_path(spark, "late")
    spark.createDataFrame(keyed.late_rows(queries), keyed.LATE).write.parquet(late)  # a row per micro-batch
    return read_table(spark, path), spark.read.parquet(late)


def with_late(table, late):
    """The rows, and the number that came too late beside each."""
    return table.withColumn("late_rows", late.agg(F.sum("late_rows").alias("n")).scalar())


#: Turns of two years; some articles come a turn late, a third is published again 0 to 400 days later.
ARRIVALS = """sent AS (SELECT article_id, title, url, source_name, published_at FROM news
  UNION ALL SELECT article_id + 1000000000, title, url, source_name, published_at + to_days(CAST((article_id % 5) * 100 AS INTEGER)) FROM news WHERE article_id % 3 = 0),
arrivals AS (SELECT *, least((year(published_at) - 1995) // 2 + CASE WHEN article_id % 50 = 7 THEN 1 ELSE 0 END, 3) AS turn, sha256(lower(title || '|' || url || '|' || source_name)) AS content_hash FROM sent),
marks AS (SELECT t.turn, max(a.published_at) - INTERVAL 7 DAY AS mark FROM (SELECT DISTINCT turn FROM arrivals) t LEFT JOIN arrivals a ON a.turn < t.turn GROUP BY t.turn),
judged AS (SELECT a.*, mark IS NOT NULL AND published_at <= mark AS late FROM arrivals a JOIN marks USING (turn)),
passed AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY published_at, article_id) AS k FROM judged
  WHERE NOT late AND published_at <= (SELECT max(published_at) - INTERVAL 7 DAY FROM arrivals)),
decided AS (SELECT content_hash, k, article_id, published_at, article_id AS first_id, published_at AS first_at FROM passed WHERE k = 1
  UNION ALL SELECT p.content_hash, p.k, p.article_id, p.published_at, if(p.published_at > first_at + INTERVAL 365 DAY, p.article_id, first_id), if(p.published_at > first_at + INTERVAL 365 DAY, p.published_at, first_at)
  FROM decided d JOIN passed p ON p.content_hash = d.content_hash AND p.k = d.k + 1)"""


@query(
    "st_02",
    "WITH RECURSIVE " + NEWS + "," + ARRIVALS + """ SELECT content_hash, article_id, CASE WHEN article_id = first_id THEN 'NEW' ELSE 'DUPLICATE' END AS decision, first_id AS canonical_article_id,
  (SELECT count(*) FROM judged WHERE late) AS late_rows FROM decided""",
)
def st_02(spark, sf):
    """State of a hash lives for a year after its first article; the watermark is a week behind."""
    n = materialize(V.news(spark, sf).select("article_id", "published_at", prepare.content_hash().alias("content_hash")), "hashes")  # texts are read once
    again = n.where("article_id % 3 = 0")
    again = again.withColumns({"published_at": F.col("published_at") + F.make_dt_interval(((F.col("article_id") % 5) * 100).cast("int")), "article_id": F.col("article_id") + 1_000_000_000})
    sent = n.unionByName(again)
    turn = F.floor((F.year("published_at") - 1995) / 2) + F.when(F.col("article_id") % 50 == 7, 1).otherwise(0)
    sent = sent.withColumn("turn", F.least(turn, F.lit(3)).cast("int"))

    def start(stream, path, ck):
        decisions = keyed.first_articles(stream, ttl_days=365, delay="7 days").withColumn("year", F.year("published_at"))
        return keyed.run(spark, decisions, path, ck, ["article_id", "year"], ["published_at"], "year")

    return with_late(*in_turns(spark, sent, start, scratch_path(spark, "dedup"))).select("content_hash", "article_id", "decision", "canonical_article_id", "late_rows")


#: Turns of ten days; some signals come a turn late. An alert ends by a signal that does not fire or after six hours without one.
SIGNALS = """arrivals AS (SELECT 'type_' || event_type AS metric, 'group_' || CAST(user_id % 5 AS VARCHAR) AS source, value > 40 AS firing, value, ts, event_id,
  least((day(ts) - 1) // 10 + CASE WHEN event_id % 40 = 3 THEN 1 ELSE 0 END, 2) AS turn FROM events),
marks AS (SELECT t.turn, date_trunc('millisecond', max(a.ts)) - INTERVAL 1 DAY AS mark FROM (SELECT DISTINCT turn FROM arrivals) t LEFT JOIN arrivals a ON a.turn < t.turn GROUP BY t.turn),
judged AS (SELECT a.*, mark IS NOT NULL AND ts <= mark AS late FROM arrivals a JOIN marks USING (turn)),
ending AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY AS hi FROM arrivals),
passed AS (SELECT judged.*, hi, date_trunc('millisecond', ts) AS ms FROM judged, ending WHERE NOT late AND ts <= hi),
near AS (SELECT *, lag(firing) OVER w AS before, lag(ms) OVER w AS ms_before, lead(firing) OVER w AS after, lead(ms) OVER w AS ms_after, lead(ts) OVER w AS ts_after FROM passed WINDOW w AS (PARTITION BY metric, source ORDER BY ts, event_id)),
runs AS (SELECT *, sum(CASE WHEN before AND ms_before + INTERVAL 6 HOUR >= ms THEN 0 ELSE 1 END) OVER (PARTITION BY metric, source ORDER BY ts, event_id) AS run FROM near WHERE firing),
alerts AS (SELECT metric, source, min(ts) AS opened_at, max(ts) AS last_at, max(ms) + INTERVAL 6 HOUR AS silent_at, arg_max(value, (ts, event_id)) AS observed_value, arg_max_null(after, (ts, event_id)) AS after,
  arg_max_null(ms_after, (ts, event_id)) AS ms_after, arg_max_null(ts_after, (ts, event_id)) AS ts_after, count(*) AS n, max(hi) AS hi FROM runs GROUP BY metric, source, run),
ended AS (SELECT *, CASE WHEN silent_at < coalesce(ms_after, hi) THEN silent_at WHEN ms_after IS NOT NULL THEN ts_after END AS resolved_at FROM alerts)"""


@query(
    "mon_05_stream",
    "WITH " + SIGNALS + """ SELECT metric, source, CAST(opened_at AS VARCHAR) AS opened_at, observed_value, CASE WHEN observed_value > 100 THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
  CAST(coalesce(resolved_at, last_at) AS VARCHAR) AS timestamp, CASE WHEN resolved_at IS NULL THEN 'ACTIVE' ELSE 'RESOLVED' END AS status, n + CASE WHEN resolved_at IS NULL THEN 0 ELSE 1 END AS changes,
  (SELECT count(*) FROM judged WHERE late) AS late_rows FROM ended""",
)
def mon_05_stream(spark, sf):
    """Alerts as a state machine over the events as they arrive."""
    e = V.table(spark, sf, "events")
    value = F.col("value")
    sent = e.select(
        F.concat(F.lit("type_"), "event_type").alias("metric"), F.concat(F.lit("group_"), (F.col("user_id") % 5).cast("string")).alias("source"), (value > 40).alias("is_firing"), value.alias("observed_value"),
        F.lit(40.0).alias("threshold"), F.when(value > 100, "CRITICAL").otherwise("WARNING").alias("severity"), F.format_string("%s at %.2f", "event_type", value).alias("message"),
        F.col("ts").cast("timestamp").alias("signal_time"), F.col("event_id").alias("signal_id"),
        F.least(F.floor((F.dayofmonth("ts") - 1) / 10) + F.when(F.col("event_id") % 40 == 3, 1).otherwise(0), F.lit(2)).cast("int").alias("turn"),
    )

    def start(stream, path, ck):
        changes = keyed.alert_changes(stream, silence_days=0.25, delay="1 day").withColumn("month", F.date_format("opened_at", "yyyy-MM"))
        return keyed.run(spark, changes, path, ck, ["alert_id", "month"], ["changes"], "month")

    table, late = in_turns(spark, sent, start, scratch_path(spark, "alerts"))
    return with_late(table, late).select("metric", "source", "opened_at", "observed_value", "severity", "timestamp", "status", "changes", "late_rows")


@query("st_03", sql(MARKET, UPSERTED))
def st_03(spark, sf):
    bars = V.market_prices(spark, sf).where(F.col("ts") < F.lit("1999-01-01").cast("date")).withColumns({"year": F.year("ts"), "seq": F.lit(0)})
    first, then = landed(spark, bars, "old", "symbol"), landed(spark, later_bars(spark, sf), "new", "symbol")
    table = scratch_path(spark, "prices")
    keys, cols = ["symbol", "ts", "year"], ["open", "high", "low", "close", "volume"]
    for src in (first, then):
        stream = live.read_files(spark, src, spark.read.parquet(src).schema, 2)
        live.drain(live.upsert_stream(stream, table, keys, cols, "year", scratch_path(spark, "ck"), ["seq"]))
    return read_table(spark, table).select("symbol", "ts", *cols)


@query(
    "st_04",
    """WITH m AS (SELECT max(ts) AS hi FROM events)
SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS VARCHAR) AS window_start, event_type, count(*) AS record_count, CAST(max(ts) AS VARCHAR) AS latest FROM events, m GROUP BY 1, 2, time_bucket(INTERVAL 1 HOUR, ts), hi HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= hi - INTERVAL 1 HOUR""",
)
def st_04(spark, sf):
    """Closed windows only: the last ones wait for later events."""
    e = V.table(spark, sf, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    src = scratch_path(spark, "in")
    e.write.parquet(src)
    out = scratch_path(spark, "windows")
    stream = live.read_files(spark, src, spark.read.parquet(src).schema)
    live.drain(live.freshness_stream(stream, "ts", "event_type", out, scratch_path(spark, "ck")))
    return spark.read.parquet(out).select("window_start", "event_type", "record_count", "latest")

