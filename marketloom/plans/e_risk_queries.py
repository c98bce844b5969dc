from pyspark.sql import functions as F

from marketloom.functions.expr import rnd
from marketloom.operators import risk as R
from marketloom.plans.registry import query
from marketloom.plans.sqlviews import PORTFOLIO, RETURNS, SCENARIOS, r, sql
from marketloom.sources import views as V

NN = "rr AS (SELECT symbol, ts, daily_return AS x FROM returns WHERE daily_return IS NOT NULL)"


def rounded(df, cols, digits=8):
    return df.withColumns({c: rnd(c, digits) for c in cols})


@query("risk_01", sql(RETURNS, NN, f"SELECT symbol, count(*) AS sample_size, {r('quantile_cont(x, 0.05)', 8)} AS var FROM rr GROUP BY symbol"))
def risk_01(spark, sf):
    return rounded(R.historical(V.returns(spark, sf), ["symbol"], "daily_return"), ["var"]).select("symbol", "sample_size", "var")


VARS = "vr AS (SELECT symbol, count(*) AS n, quantile_cont(x, 0.05) AS v FROM rr GROUP BY symbol)"


@query("risk_02", sql(RETURNS, NN, VARS, f"SELECT symbol, {r('v', 8)} AS var, {r('avg(x) FILTER (WHERE x <= v)', 8)} AS cvar FROM rr JOIN vr USING (symbol) GROUP BY symbol, v"))
def risk_02(spark, sf):
    return rounded(R.historical(V.returns(spark, sf), ["symbol"], "daily_return"), ["var", "cvar"]).select("symbol", "var", "cvar")


Z95 = "-1.6448536269514722::DOUBLE"


@query("risk_03", sql(RETURNS, NN, f"SELECT symbol, count(*) AS sample_size, {r(f'avg(x) + {Z95} * stddev_pop(x)', 8)} AS var, {r('kurtosis_pop(x)', 5)} AS excess_kurtosis FROM rr GROUP BY symbol HAVING count(*) >= 30"))
def risk_03(spark, sf):
    df = R.parametric(V.returns(spark, sf), ["symbol"], "daily_return")
    return rounded(rounded(df, ["var"]), ["excess_kurtosis"], 5)


@query(
    "risk_04",
    sql(
        RETURNS, NN, VARS,
        f"""SELECT symbol, 'historical' AS method, 0.95::DOUBLE AS confidence_level, n AS sample_size, {r('v', 8)} AS var, {r('avg(x) FILTER (WHERE x <= v)', 8)} AS cvar, '' AS warnings
FROM rr JOIN vr USING (symbol) GROUP BY symbol, v, n
UNION ALL SELECT symbol, 'parametric_normal', 0.95::DOUBLE, count(*), {r(f'avg(x) + {Z95} * stddev_pop(x)', 8)}, NULL, CASE WHEN kurtosis_pop(x) > 1 THEN printf('Fat Tail Warning: excess kurtosis %.2f, losses reach further than a normal curve allows|', kurtosis_pop(x)) ELSE '' END || 'The normal method gives no expected loss beyond its value at risk' FROM rr GROUP BY symbol""",
    ),
)
def risk_04(spark, sf):
    rets = V.returns(spark, sf)
    both = R.risk_metrics(rets, ["symbol"], "daily_return").unionByName(R.risk_metrics(rets, ["symbol"], "daily_return", method="parametric_normal"))
    return rounded(both, ["var", "cvar"]).withColumn("warnings", F.array_join("warnings", "|"))


@query(
    "risk_05",
    sql(
        RETURNS, NN,
        "bt AS (SELECT symbol, x, CASE WHEN count(x) OVER f >= 252 THEN quantile_cont(x, 0.05) OVER f END AS v FROM rr WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING))",
        "g AS (SELECT symbol, count(*) AS total_predictions, count(*) FILTER (WHERE x < v) AS exceedances FROM bt WHERE v IS NOT NULL GROUP BY symbol)",
        f"""SELECT symbol, total_predictions, exceedances, {r('total_predictions * 0.05::DOUBLE')} AS expected_exceedances, {r('exceedances / total_predictions')} AS empirical_exceedance_rate,
  {r('exceedances / total_predictions / 0.05::DOUBLE')} AS exceedance_ratio,
  CASE WHEN exceedances / total_predictions / 0.05 > 1.5 THEN 'UNDERESTIMATING' WHEN exceedances / total_predictions / 0.05 < 0.5 THEN 'OVERESTIMATING' ELSE 'VALID' END AS verdict,
  exceedances / total_predictions / 0.05 BETWEEN 0.5 AND 1.5 AS is_valid FROM g""",
    ),
)
def risk_05(spark, sf):
    df = R.var_backtest(V.returns(spark, sf), "symbol", "ts", "daily_return")
    return rounded(df, ["expected_exceedances", "empirical_exceedance_rate", "exceedance_ratio"], 6)


STREAM = """stream AS (SELECT ts, CASE WHEN count(daily_return) = 6 THEN sum(daily_return * weight) END AS pr FROM returns JOIN portfolio USING (symbol) GROUP BY ts)"""
COV = """ph AS (SELECT symbol, ts, daily_return AS x, weight AS w FROM returns JOIN portfolio USING (symbol) WHERE daily_return IS NOT NULL),
cv AS (SELECT a.symbol AS a, b.symbol AS b, a.w AS wa, b.w AS wb, count(*) AS n, covar_samp(a.x, b.x) AS cov FROM ph a JOIN ph b ON a.ts = b.ts GROUP BY 1, 2, 3, 4)"""


@query("risk_06", sql(RETURNS, PORTFOLIO, STREAM, f"SELECT 'main' AS portfolio, CAST(ts AS VARCHAR) AS ts, {r('pr', 8)} AS portfolio_return FROM stream"))
def risk_06(spark, sf):
    return rounded(R.portfolio_returns(V.returns(spark, sf), V.portfolio(spark)), ["portfolio_return"])


def refused_weights(spark):
    """The portfolio beside one whose weights do not add up, one with an asset that is not traded, and one with both faults."""
    main = V.portfolio(spark)
    heavy = main.withColumns({"portfolio": F.lit("heavy"), "weight": F.col("weight") * 1.2})
    foreign = main.withColumns({"portfolio": F.lit("foreign"), "symbol": F.when(F.col("symbol") == "SMALL", "FOREIGN").otherwise(F.col("symbol"))})
    both = foreign.withColumns({"portfolio": F.lit("both"), "weight": F.col("weight") * 0.5})
    return main.unionByName(heavy).unionByName(foreign).unionByName(both)


@query(
    "risk_06_refused",
    sql(
        RETURNS, PORTFOLIO,
        "all_(portfolio, symbol, weight) AS (SELECT 'main', symbol, weight FROM portfolio UNION ALL SELECT 'heavy', symbol, weight * 1.2 FROM portfolio UNION ALL SELECT p, CASE symbol WHEN 'SMALL' THEN 'FOREIGN' ELSE symbol END, weight * f FROM portfolio, (VALUES ('foreign', 1.0), ('both', 0.5)) x(p, f))",
        f"""SELECT portfolio, {r('sum(weight)', 8)} AS total_weight, count(*) FILTER (WHERE symbol NOT IN (SELECT symbol FROM returns)) AS missing_assets,
  CASE WHEN abs(sum(weight) - 1) > 0.01 THEN 'BAD_WEIGHTS' WHEN count(*) FILTER (WHERE symbol NOT IN (SELECT symbol FROM returns)) > 0 THEN 'MISSING_ASSETS' ELSE 'OK' END AS status FROM all_ GROUP BY portfolio""",
    ),
)
def risk_06_refused(spark, sf):
    return rounded(R.check_weights(refused_weights(spark), V.returns(spark, sf)), ["total_weight"])


@query("risk_07", sql(RETURNS, PORTFOLIO, COV, f"SELECT a, b, n, {r('cov', 12)} AS cov FROM cv WHERE a <= b"))
def risk_07(spark, sf):
    return rounded(R.covariance(V.returns(spark, sf), V.portfolio(spark)), ["cov"], 12)


@query("risk_08", sql(RETURNS, PORTFOLIO, COV, f"SELECT 'main' AS portfolio, {r('sqrt(greatest(sum(wa * wb * cov), 0))', 8)} AS daily_volatility, {r('sqrt(greatest(sum(wa * wb * cov), 0)) * sqrt(252)', 8)} AS annualized_volatility FROM cv"))
def risk_08(spark, sf):
    w = V.portfolio(spark)
    return rounded(R.portfolio_volatility(R.covariance(V.returns(spark, sf), w), w), ["daily_volatility", "annualized_volatility"])


WEALTH = """wl AS (SELECT ts, pr, exp(sum(ln(1 + pr)) OVER (ORDER BY ts)) AS wealth FROM stream WHERE pr IS NOT NULL),
dw AS (SELECT ts, pr, wealth / max(wealth) OVER (ORDER BY ts) - 1 AS dd FROM wl)"""


@query("risk_09", sql(RETURNS, PORTFOLIO, STREAM, WEALTH, f"SELECT 'main' AS portfolio, {r('min(dd)', 8)} AS max_drawdown FROM dw"))
def risk_09(spark, sf):
    s = R.portfolio_returns(V.returns(spark, sf), V.portfolio(spark))
    return rounded(R.max_drawdown(s, ["portfolio"], "ts", "portfolio_return"), ["max_drawdown"])


TAIL = "tl AS (SELECT quantile_cont(pr, 0.05) AS v95, quantile_cont(pr, 0.01) AS v99 FROM stream WHERE pr IS NOT NULL)"
METRICS = f"""{r('(SELECT sqrt(sum(wa * wb * cov)) FROM cv)', 8)} AS daily_volatility, {r('(SELECT sqrt(sum(wa * wb * cov)) FROM cv) * sqrt(252)', 8)} AS annualized_volatility,
  {r('(SELECT min(dd) FROM dw)', 8)} AS max_drawdown, {r('v95', 8)} AS historical_var, {r('(SELECT avg(pr) FROM stream WHERE pr <= v95)', 8)} AS historical_cvar"""


@query("risk_10", sql(RETURNS, PORTFOLIO, STREAM, COV, WEALTH, TAIL, f"SELECT 'main' AS portfolio, {METRICS} FROM tl"))
def risk_10(spark, sf):
    df = R.portfolio_metrics(V.returns(spark, sf), V.portfolio(spark))
    return rounded(df, ["daily_volatility", "annualized_volatility", "max_drawdown", "historical_var", "historical_cvar"])


ATTR = """at0 AS (SELECT a AS symbol, wa AS weight, sum(wb * cov) AS cw FROM cv GROUP BY 1, 2),
at1 AS (SELECT symbol, weight, cw, sqrt(sum(weight * cw) OVER ()) AS vol FROM at0),
attr AS (SELECT symbol, weight, cw / vol AS mcr, weight * cw / vol AS ccr, weight * cw / vol / vol AS pcr FROM at1)"""


@query("risk_11", sql(RETURNS, PORTFOLIO, COV, ATTR, f"SELECT 'main' AS portfolio, symbol, weight, {r('mcr', 8)} AS mcr, {r('ccr', 8)} AS ccr, {r('pcr', 8)} AS pcr FROM attr"))
def risk_11(spark, sf):
    w = V.portfolio(spark)
    return rounded(R.attribution(R.covariance(V.returns(spark, sf), w), w), ["mcr", "ccr", "pcr"])


@query(
    "risk_12",
    sql(
        RETURNS, PORTFOLIO, COV, ATTR,
        "rk AS (SELECT *, row_number() OVER (ORDER BY weight DESC, symbol) AS kw, row_number() OVER (ORDER BY pcr DESC, symbol) AS kr FROM attr)",
        f"""SELECT 'main' AS portfolio, {r('sum(weight) FILTER (WHERE kw <= 3)', 8)} AS top_3_weight_concentration, {r('sum(pcr) FILTER (WHERE kr <= 3)', 8)} AS top_3_risk_concentration,
  string_agg(symbol, ',' ORDER BY kw) FILTER (WHERE kw <= 3) AS top_weight_assets, string_agg(symbol, ',' ORDER BY kr) FILTER (WHERE kr <= 3) AS top_risk_assets,
  coalesce(string_agg(symbol, ',' ORDER BY symbol) FILTER (WHERE pcr / weight > 2), '') AS risk_outliers FROM rk""",
    ),
)
def risk_12(spark, sf):
    w = V.portfolio(spark)
    df = R.concentration(R.attribution(R.covariance(V.returns(spark, sf), w), w))
    df = df.withColumns({c: F.concat_ws(",", c) for c in ("top_weight_assets", "top_risk_assets", "risk_outliers")})
    return rounded(df, ["top_3_weight_concentration", "top_3_risk_concentration"])


RECOVERY = """rc0 AS (SELECT s.scenario, t.ts, t.pr, row_number() OVER (PARTITION BY s.scenario ORDER BY t.ts) - 1 AS i FROM stream t JOIN scenarios s ON t.ts >= s.start_date WHERE t.pr IS NOT NULL),
rc1 AS (SELECT *, round(exp(sum(CASE WHEN i > 0 THEN ln(1 + pr) ELSE 0 END) OVER (PARTITION BY scenario ORDER BY ts)), 12) AS w FROM rc0),
rc2 AS (SELECT *, max(CASE WHEN w < 1 THEN 1 ELSE 0 END) OVER (PARTITION BY scenario ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fell FROM rc1),
rec AS (SELECT scenario, coalesce(min(i) FILTER (WHERE w >= 1 AND fell = 1), -1) AS recovery_trading_days FROM rc2 GROUP BY scenario)"""
STRESS = """sw AS (SELECT s.scenario, t.ts, t.pr FROM stream t JOIN scenarios s ON t.ts BETWEEN s.start_date AND s.end_date),
sc AS (SELECT s.scenario, a.symbol AS a, b.symbol AS b, a.w AS wa, b.w AS wb, covar_samp(a.x, b.x) AS cov FROM ph a JOIN ph b ON a.ts = b.ts JOIN scenarios s ON a.ts BETWEEN s.start_date AND s.end_date GROUP BY 1, 2, 3, 4, 5),
sv AS (SELECT scenario, sqrt(sum(wa * wb * cov)) * sqrt(252) AS vol FROM sc GROUP BY 1),
sd0 AS (SELECT scenario, ts, pr, exp(sum(ln(1 + pr)) OVER (PARTITION BY scenario ORDER BY ts)) AS w FROM sw WHERE pr IS NOT NULL),
sd AS (SELECT scenario, min(dd) AS dd FROM (SELECT scenario, w / max(w) OVER (PARTITION BY scenario ORDER BY ts) - 1 AS dd FROM sd0) GROUP BY 1),
sb AS (SELECT scenario, count(*) AS days, exp(sum(ln(1 + pr))) - 1 AS tr, quantile_cont(pr, 0.05) AS v FROM sw GROUP BY 1),
span AS (SELECT min(ts) AS lo, max(ts) AS hi FROM stream)"""


@query(
    "risk_13",
    sql(
        RETURNS, PORTFOLIO, SCENARIOS, STREAM, COV, STRESS, RECOVERY,
        f"""SELECT scenario, 'main' AS portfolio, CASE WHEN lo <= start_date AND hi >= end_date THEN CASE WHEN coalesce(days, 0) < 5 THEN 'INSUFFICIENT_DATA' ELSE 'VALID' END ELSE 'UNAVAILABLE' END AS status,
  CAST(start_date AS VARCHAR) AS start_date, CAST(end_date AS VARCHAR) AS end_date, coalesce(days, 0) AS trading_days, {r('tr', 8)} AS total_return, {r('dd', 8)} AS max_drawdown,
  {r('vol', 8)} AS annualized_volatility, {r('v', 8)} AS realized_var_95, CASE WHEN days IS NOT NULL THEN recovery_trading_days END AS recovery_trading_days
FROM scenarios LEFT JOIN sb USING (scenario) LEFT JOIN sv USING (scenario) LEFT JOIN sd USING (scenario) LEFT JOIN rec USING (scenario), span""",
    ),
)
def risk_13(spark, sf):
    df = R.stress(V.returns(spark, sf), V.portfolio(spark), V.SCENARIOS)
    return rounded(df, ["total_return", "max_drawdown", "annualized_volatility", "realized_var_95"])


@query("risk_14", sql(RETURNS, PORTFOLIO, SCENARIOS, STREAM, RECOVERY, "SELECT scenario, 'main' AS portfolio, recovery_trading_days FROM rec"))
def risk_14(spark, sf):
    return R.recovery(R.portfolio_returns(V.returns(spark, sf), V.portfolio(spark)), V.SCENARIOS)


@query(
    "risk_15",
    sql(
        RETURNS, PORTFOLIO, SCENARIOS, COV,
        """pd AS (SELECT scenario, 'PRE' AS period, start_date - 365 AS lo, start_date AS hi FROM scenarios UNION ALL SELECT scenario, 'CRASH', start_date, end_date FROM scenarios),
pc AS (SELECT p.scenario, p.period, a.symbol AS a, a.w AS wa, b.w AS wb, covar_samp(a.x, b.x) AS cov FROM ph a JOIN ph b ON a.ts = b.ts JOIN pd p ON a.ts BETWEEN p.lo AND p.hi GROUP BY p.scenario, p.period, a.symbol, b.symbol, a.w, b.w),
pa AS (SELECT scenario, period, a AS symbol, wa * sum(wb * cov) AS c FROM pc GROUP BY scenario, period, a, wa),
pp AS (SELECT scenario, period, symbol, c / sum(c) OVER (PARTITION BY scenario, period) AS pcr FROM pa),
dy AS (SELECT p.scenario, p.period, count(DISTINCT r.ts) AS days FROM returns r JOIN pd p ON r.ts BETWEEN p.lo AND p.hi GROUP BY 1, 2)""",
        f"""SELECT a.scenario, 'main' AS portfolio, a.symbol, {r('a.pcr', 8)} AS pre_crash_pcr, {r('b.pcr', 8)} AS crash_pcr, {r('b.pcr - a.pcr', 8)} AS shift
FROM pp a JOIN pp b ON a.scenario = b.scenario AND a.symbol = b.symbol AND a.period = 'PRE' AND b.period = 'CRASH'
JOIN dy x ON x.scenario = a.scenario AND x.period = 'PRE' AND x.days > 50 JOIN dy y ON y.scenario = a.scenario AND y.period = 'CRASH' AND y.days >= 5""",
    ),
)
def risk_15(spark, sf):
    df = R.attribution_shift(V.returns(spark, sf), V.portfolio(spark), V.SCENARIOS)
    return rounded(df, ["pre_crash_pcr", "crash_pcr", "shift"])


CLASS = """CASE WHEN dd > 0.40 OR es99 > 0.10 THEN 'CRITICAL' WHEN dd > 0.20 OR es95 > 0.05 OR conc > 0.60 THEN 'HIGH' WHEN vol > 0.15 OR es95 > 0.02 THEN 'MODERATE' ELSE 'LOW' END"""


PCT = "printf('%.1f%%', {} * 100)"


@query(
    "risk_16",
    sql(
        RETURNS, NN,
        "q AS (SELECT symbol, quantile_cont(x, 0.05) AS v95, quantile_cont(x, 0.01) AS v99 FROM rr GROUP BY symbol)",
        "t AS (SELECT symbol, abs(avg(x) FILTER (WHERE x <= v95)) * 3 AS es95, abs(avg(x) FILTER (WHERE x <= v99)) * 3 AS es99, stddev_samp(x) * sqrt(252) AS vol, 0.0::DOUBLE AS conc FROM rr JOIN q USING (symbol) GROUP BY symbol)",
        "w AS (SELECT symbol, abs(min(dd)) AS dd FROM (SELECT symbol, wealth / max(wealth) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS dd FROM (SELECT symbol, ts, exp(sum(ln(1 + x)) OVER (PARTITION BY symbol ORDER BY ts)) AS wealth FROM rr)) GROUP BY symbol)",
        f"""SELECT symbol, {CLASS} AS classification, CASE {CLASS}
  WHEN 'CRITICAL' THEN concat_ws('|', CASE WHEN dd > 0.40 THEN 'Fall from the peak of ' || {PCT.format('dd')} || ' exceeds 40%' END, CASE WHEN es99 > 0.10 THEN 'Mean loss on the worst 1% of days of ' || {PCT.format('es99')} || ' exceeds 10%' END)
  WHEN 'HIGH' THEN concat_ws('|', CASE WHEN dd > 0.20 THEN 'Fall from the peak of ' || {PCT.format('dd')} || ' exceeds 20%' END, CASE WHEN es95 > 0.05 THEN 'Mean loss on the worst 5% of days of ' || {PCT.format('es95')} || ' exceeds 5%' END,
    CASE WHEN conc > 0.60 THEN 'Three assets carry ' || {PCT.format('conc')} || ' of the risk' END)
  WHEN 'MODERATE' THEN concat_ws('|', CASE WHEN vol > 0.15 THEN 'Yearly deviation of ' || {PCT.format('vol')} || ' exceeds 15%' END, CASE WHEN es95 > 0.02 THEN 'Mean loss on the worst 5% of days of ' || {PCT.format('es95')} || ' exceeds 2%' END)
  ELSE 'No limit is reached' END AS drivers
FROM t JOIN w USING (symbol)""",
    ),
)
def risk_16(spark, sf):
    """Per symbol; the tails are scaled by three so that several classes occur."""
    rets = V.returns(spark, sf)
    es = lambda c, o: R.historical(rets, ["symbol"], "daily_return", c).select("symbol", (F.col("cvar") * 3).alias(o))
    vol = rets.groupBy("symbol").agg((F.stddev_samp("daily_return") * 252**0.5).alias("annualized_volatility"), F.lit(0.0).alias("top_3_risk_concentration"))
    m = vol.join(es(0.95, "historical_cvar"), "symbol").join(es(0.99, "cvar_99"), "symbol").join(R.max_drawdown(rets, ["symbol"], "ts", "daily_return"), "symbol")
    return R.classify(m).select("symbol", "classification", F.array_join("drivers", "|").alias("drivers"))


@query(
    "risk_17",
    sql(
        RETURNS, PORTFOLIO, STREAM, COV, WEALTH, TAIL, ATTR,
        "m AS (SELECT (SELECT sqrt(sum(wa * wb * cov)) FROM cv) * sqrt(252) AS vol, abs((SELECT min(dd) FROM dw)) AS dd, abs((SELECT avg(pr) FROM stream WHERE pr <= v95)) AS es95, abs((SELECT avg(pr) FROM stream WHERE pr <= v99)) AS es99, (SELECT sum(pcr) FROM (SELECT pcr FROM attr ORDER BY pcr DESC LIMIT 3)) AS conc FROM tl)",
        f"SELECT 'main' AS portfolio, {CLASS} AS classification, {r('vol', 8)} AS annualized_volatility, {r('dd', 8)} AS drawdown, {r('es95', 8)} AS es_95, {r('es99', 8)} AS es_99, {r('conc', 8)} AS top_3_risk_concentration FROM m",
    ),
)
def risk_17(spark, sf):
    df = R.portfolio_assessment(V.returns(spark, sf), V.portfolio(spark))
    return df.select(
        "portfolio", "classification", rnd("annualized_volatility", 8).alias("annualized_volatility"), rnd(F.abs("max_drawdown"), 8).alias("drawdown"),
        rnd(F.abs("historical_cvar"), 8).alias("es_95"), rnd(F.abs("cvar_99"), 8).alias("es_99"), rnd("top_3_risk_concentration", 8).alias("top_3_risk_concentration"),
    )
