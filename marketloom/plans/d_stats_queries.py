from pyspark.sql import functions as F

from marketloom.functions.expr import rnd
from marketloom.operators import prepare
from marketloom.operators import stats as S
from marketloom.plans.c_join_queries import MACRO_NAMES, MONTHLY, PUBLISHED
from marketloom.plans.registry import query
from marketloom.plans.sqlviews import MACRO, RETURNS, r, sql
from marketloom.sources import views as V


def t_p(t: str, nu: str) -> str:
    """Two-sided t tail by Simpson's rule on the density."""
    f = f"power(1 + power(i * abs({t}) / 2000.0::DOUBLE, 2) / ({nu}), -(({nu}) + 1) / 2)"
    s = f"list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {f}))"
    norm = f"exp(lgamma((({nu}) + 1) / 2) - lgamma(({nu}) / 2)) / sqrt(({nu}) * pi())"
    return f"greatest(1 - 2 * abs({t}) / 6000.0::DOUBLE * {s} * {norm}, 0)"


def z_p(z: str) -> str:
    """Two-sided normal tail by Simpson's rule."""
    f = f"exp(-power(i * abs({z}) / 2000.0::DOUBLE, 2) / 2)"
    s = f"list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {f}))"
    return f"greatest(1 - 2 * abs({z}) / 6000.0::DOUBLE * {s} / sqrt(2 * pi()), 0)"


def pick(df, keys, cols, digits=6):
    return df.select(*keys, *[rnd(c, digits).alias(c) for c in cols])


@query("stat_01", sql(RETURNS, f"SELECT symbol, {r('exp(sum(log_return)) - 1', 8)} AS cumulative_return FROM returns GROUP BY symbol"))
def stat_01(spark, sf):
    return pick(S.profile_returns(V.returns(spark, sf)), ["symbol"], ["cumulative_return"], 8)


@query(
    "stat_02",
    sql(
        RETURNS,
        f"""SELECT symbol, {r('stddev_samp(log_return)', 8)} AS daily_volatility, {r('stddev_samp(log_return) * sqrt(252)', 8)} AS annualized_volatility,
  CASE WHEN count(*) FILTER (WHERE log_return < 0) > 1 THEN {r('stddev_samp(CASE WHEN log_return < 0 THEN log_return END) * sqrt(252)', 8)} ELSE 0 END AS downside_volatility
FROM returns GROUP BY symbol""",
    ),
)
def stat_02(spark, sf):
    return pick(S.profile_returns(V.returns(spark, sf)), ["symbol"], ["daily_volatility", "annualized_volatility", "downside_volatility"], 8)


DRAW = """dd AS (SELECT symbol, ts, close, row_number() OVER w AS i, (close - max(close) OVER w) / max(close) OVER w AS drawdown FROM returns WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
trough AS (SELECT symbol, drawdown, ts AS trough_date, i AS ti FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY drawdown, i) AS k FROM dd) WHERE k = 1),
peak AS (SELECT d.symbol, d.ts AS peak_date, d.i AS pi FROM (SELECT d.*, row_number() OVER (PARTITION BY d.symbol ORDER BY d.close DESC, d.i) AS k FROM dd d JOIN trough t ON d.symbol = t.symbol AND d.i <= t.ti) d WHERE k = 1)"""


@query(
    "stat_03",
    sql(
        RETURNS,
        DRAW,
        f"""SELECT symbol, {r('drawdown', 8)} AS max_drawdown, CAST(peak_date AS VARCHAR) AS peak_date, CAST(trough_date AS VARCHAR) AS trough_date, ti - pi AS max_drawdown_duration_obs
FROM trough JOIN peak USING (symbol)""",
    ),
)
def stat_03(spark, sf):
    return S.profile_drawdown(V.returns(spark, sf)).withColumn("max_drawdown", rnd("max_drawdown", 8))


VOL60 = """vol AS (SELECT symbol, ts, log_return, CASE WHEN count(log_return) OVER f >= 60 THEN stddev_samp(log_return) OVER f * sqrt(252) END AS v
  FROM returns WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
reg AS (SELECT symbol, count(v) AS n, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.75) AS p75, max_by(v, ts) FILTER (WHERE v IS NOT NULL) AS latest FROM vol GROUP BY symbol)"""
REGIME = f"{r('latest', 8)} AS latest_60d_volatility, {r('p25', 8)} AS threshold_25th, {r('p75', 8)} AS threshold_75th, CASE WHEN latest < p25 THEN 'Low' WHEN latest > p75 THEN 'High' ELSE 'Normal' END AS current_regime"


@query("stat_04", sql(RETURNS, VOL60, f"SELECT symbol, {REGIME} FROM reg WHERE n > 60"))
def stat_04(spark, sf):
    df = S.profile_regime(V.returns(spark, sf))
    return df.select("symbol", *[rnd(c, 8).alias(c) for c in ("latest_60d_volatility", "threshold_25th", "threshold_75th")], "current_regime")


@query(
    "stat_05",
    sql(
        RETURNS,
        DRAW,
        VOL60,
        f"""SELECT a.symbol, a.n AS total_observations, CAST(a.lo AS VARCHAR) AS start_date, CAST(a.hi AS VARCHAR) AS end_date, {r('a.cum', 8)} AS cumulative_return,
  {r('a.vol', 8)} AS annualized_volatility, {r('a.down', 8)} AS downside_volatility, {r('t.drawdown', 8)} AS max_drawdown, t.ti - p.pi AS max_drawdown_duration_obs, {REGIME}
FROM (SELECT symbol, count(*) AS n, min(ts) AS lo, max(ts) AS hi, exp(sum(log_return)) - 1 AS cum, stddev_samp(log_return) * sqrt(252) AS vol,
  stddev_samp(CASE WHEN log_return < 0 THEN log_return END) * sqrt(252) AS down FROM returns GROUP BY symbol) a
JOIN trough t USING (symbol) JOIN peak p USING (symbol) LEFT JOIN (SELECT * FROM reg WHERE n > 60) g USING (symbol)""",
    ),
)
def stat_05(spark, sf):
    df = S.profile(V.returns(spark, sf))
    cols = ["cumulative_return", "annualized_volatility", "downside_volatility", "max_drawdown", "latest_60d_volatility", "threshold_25th", "threshold_75th"]
    return df.select("symbol", "total_observations", "start_date", "end_date", "max_drawdown_duration_obs", "current_regime", *[rnd(c, 8).alias(c) for c in cols])


RET = "lr AS (SELECT symbol, ts, log_return AS x FROM returns WHERE log_return IS NOT NULL)"


def lr(spark, sf):
    return V.returns(spark, sf).where(F.col("log_return").isNotNull()).select("symbol", "ts", "log_return")


@query(
    "agg_06",
    sql(
        RETURNS,
        RET,
        f"""SELECT symbol, count(*) AS n, {r('avg(x)', 8)} AS mean, {r('median(x)', 8)} AS median, {r('var_samp(x)', 10)} AS variance, {r('stddev_samp(x)', 8)} AS std_dev,
  {r('min(x)', 8)} AS min, {r('max(x)', 8)} AS max, {r('quantile_cont(x, 0.25)', 8)} AS q25, {r('quantile_cont(x, 0.75)', 8)} AS q75,
  {r('quantile_cont(x, 0.75) - quantile_cont(x, 0.25)', 8)} AS iqr, {r('skewness(x)', 6)} AS skewness, {r('kurtosis(x)', 6)} AS kurtosis FROM lr GROUP BY symbol""",
    ),
)
def agg_06(spark, sf):
    df = S.describe(lr(spark, sf), ["symbol"], "log_return", bounded=True)
    eight = [c for c in ("mean", "median", "std_dev", "min", "max", "q25", "q75", "iqr")]
    return df.select("symbol", "n", *[rnd(c, 8).alias(c) for c in eight], rnd("variance", 10).alias("variance"), rnd("skewness").alias("skewness"), rnd("kurtosis").alias("kurtosis"))


OUT = """z AS (SELECT symbol, ts, x, (x - avg(x) OVER (PARTITION BY symbol)) / stddev_samp(x) OVER (PARTITION BY symbol) AS z_score,
  0.6745::DOUBLE * (x - median(x) OVER (PARTITION BY symbol)) / nullif(mad(x) OVER (PARTITION BY symbol), 0) AS rz FROM lr),
cls AS (SELECT *, CASE WHEN abs(rz) >= 3 THEN 'extreme' WHEN abs(rz) >= 2 THEN 'unusual' ELSE 'normal' END AS outlier_class FROM z)"""


@query("agg_07", sql(RETURNS, RET, OUT, "SELECT symbol, outlier_class, count(*) AS n FROM cls GROUP BY 1, 2"))
def agg_07(spark, sf):
    return prepare.class_counts(S.outliers(lr(spark, sf), ["symbol"], "log_return", bounded=True), ["symbol"], "outlier_class")


JB = "count(*) / 6.0::DOUBLE * (power(sk, 2) + power(ku, 2) / 4)"
JBS = """mom AS (SELECT symbol, count(*) AS n, avg(x) AS m FROM lr GROUP BY symbol),
pop AS (SELECT symbol, n, avg(power(x - m, 3)) / power(avg(power(x - m, 2)), 1.5::DOUBLE) AS sk, avg(power(x - m, 4)) / power(avg(power(x - m, 2)), 2) - 3 AS ku
  FROM lr JOIN mom USING (symbol) GROUP BY symbol, n),
jb AS (SELECT symbol, n, n / 6.0::DOUBLE * (sk * sk + ku * ku / 4) AS jb_stat FROM pop)"""


@query("stat_06", sql(RETURNS, RET, JBS, f"SELECT symbol, n, {r('jb_stat', 5)} AS jb_stat, {r('exp(-jb_stat / 2)', 8)} AS jb_p FROM jb"))
def stat_06(spark, sf):
    df = S.jarque_bera(lr(spark, sf), ["symbol"], "log_return")
    return df.select("symbol", "n", rnd("jb_stat", 5).alias("jb_stat"), rnd("jb_p", 8).alias("jb_p"))


@query("stat_07")
def stat_07(spark, sf):
    df = S.shapiro_wilk(lr(spark, sf), ["symbol"], "log_return")
    return df.select("symbol", "n", rnd("w_stat", 8).alias("w_stat"), rnd("w_p", 8).alias("w_p"))


@query("stat_08", sql(RETURNS, RET, OUT, f"SELECT symbol, CAST(ts AS VARCHAR) AS ts, {r('z_score')} AS z_score, {r('rz')} AS robust_z_score FROM cls"))
def stat_08(spark, sf):
    return pick(S.outliers(lr(spark, sf), ["symbol"], "log_return", bounded=True), ["symbol", "ts"], ["z_score", "robust_z_score"])


@query("stat_09", sql(RETURNS, RET, OUT, f"SELECT symbol, CAST(ts AS VARCHAR) AS ts, outlier_class, {r('rz')} AS robust_z_score FROM cls WHERE outlier_class <> 'normal'"))
def stat_09(spark, sf):
    df = S.outliers(lr(spark, sf), ["symbol"], "log_return", bounded=True).where(F.col("outlier_class") != "normal")
    return df.select("symbol", "ts", "outlier_class", rnd("robust_z_score").alias("robust_z_score"))


PAIRS = """pr AS (SELECT a.symbol AS a, b.symbol AS b, a.ts, a.x AS xa, b.x AS xb FROM lr a JOIN lr b ON a.ts = b.ts AND a.symbol < b.symbol),
rk AS (SELECT a, b, xa, xb, rank() OVER (PARTITION BY a, b ORDER BY xa) + (count(*) OVER (PARTITION BY a, b, xa) - 1) / 2.0::DOUBLE AS ra,
  rank() OVER (PARTITION BY a, b ORDER BY xb) + (count(*) OVER (PARTITION BY a, b, xb) - 1) / 2.0::DOUBLE AS rb FROM pr),
cr AS (SELECT a, b, count(*) AS n, corr(xa, xb) AS pearson, covar_samp(xa, xb) AS cov, corr(ra, rb) AS rho FROM rk GROUP BY 1, 2)"""


def rho_p(c):
    return t_p(f"{c} * sqrt((n - 2) / (1 - {c} * {c}))", "n - 2")


@query("join_14", sql(RETURNS, RET, PAIRS, f"SELECT a, b, n, {r('cov', 10)} AS cov FROM cr"))
def join_14(spark, sf):
    return S.pair_statistics(V.returns(spark, sf), rank=False).select("a", "b", "n", rnd("cov", 10).alias("cov"))


@query("stat_10", sql(RETURNS, RET, PAIRS, f"SELECT a, b, n, CASE WHEN n >= 30 THEN {r('pearson')} END AS pearson_r, CASE WHEN n >= 30 THEN {r(rho_p('pearson'))} END AS pearson_p, CASE WHEN n >= 30 THEN 'OK' ELSE 'Insufficient Data' END AS status FROM cr"))
def stat_10(spark, sf):
    df = S.pairwise_correlations(V.returns(spark, sf), rank=False)
    return df.select("a", "b", "n", rnd("pearson_r").alias("pearson_r"), rnd("pearson_p").alias("pearson_p"), "status")


@query("stat_11", sql(RETURNS, RET, PAIRS, f"SELECT a, b, n, CASE WHEN n >= 30 THEN {r('rho')} END AS spearman_rho, CASE WHEN n >= 30 THEN {r(rho_p('rho'))} END AS spearman_p, CASE WHEN n >= 30 THEN 'OK' ELSE 'Insufficient Data' END AS status FROM cr"))
def stat_11(spark, sf):
    df = S.pairwise_correlations(V.returns(spark, sf))
    return df.select("a", "b", "n", rnd("spearman_rho").alias("spearman_rho"), rnd("spearman_p").alias("spearman_p"), "status")


@query("stat_12", sql(RETURNS, RET, PAIRS, f"SELECT a, b, {r('pearson')} AS r FROM cr UNION ALL SELECT b, a, {r('pearson')} FROM cr UNION ALL SELECT DISTINCT symbol, symbol, 1.0::DOUBLE FROM lr"))
def stat_12(spark, sf):
    return S.correlation_matrix(V.returns(spark, sf)).withColumn("r", rnd("r"))


LAGGED = (
    """al AS (SELECT m.symbol, m.month_end, CASE WHEN m.n > 0 THEN m.log_return END AS mkt, """
    + ", ".join(f"max(CASE WHEN series_id = '{s}' THEN value END) AS {c}" for s, c in MACRO_NAMES.items())
    + " FROM mm m JOIN pub ON m.month_end = pub.month_end GROUP BY m.symbol, m.month_end, m.n, m.log_return),\n"
    + "lg AS ("
    + " UNION ALL ".join(
        f"SELECT symbol, '{c}' AS indicator, {k} AS lag_months, {c} AS macro, lead(mkt, {k}) OVER (PARTITION BY symbol ORDER BY month_end) AS market FROM al"
        for c in MACRO_NAMES.values()
        for k in (0, 1, 3, 6, 12)
    )
    + """),
lr2 AS (SELECT *, rank() OVER (PARTITION BY symbol, indicator, lag_months ORDER BY macro) + (count(*) OVER (PARTITION BY symbol, indicator, lag_months, macro) - 1) / 2.0::DOUBLE AS ra,
  rank() OVER (PARTITION BY symbol, indicator, lag_months ORDER BY market) + (count(*) OVER (PARTITION BY symbol, indicator, lag_months, market) - 1) / 2.0::DOUBLE AS rb
  FROM lg WHERE macro IS NOT NULL AND market IS NOT NULL),
lc AS (SELECT symbol, indicator, lag_months, count(*) AS n, corr(macro, market) AS rr, corr(ra, rb) AS rho FROM lr2 GROUP BY 1, 2, 3 HAVING count(*) >= 30)"""
)


def aligned(spark, sf):
    df = prepare.align_point_in_time(V.returns(spark, sf), V.macro_obs(spark, sf), V.MACRO_SERIES)
    for s, c in MACRO_NAMES.items():
        df = df.withColumnRenamed(s, c)
    return df


def lagged(spark, sf):
    return S.lagged_correlations(aligned(spark, sf), list(MACRO_NAMES.values()))


@query("stat_13", sql(RETURNS, MACRO, MONTHLY, PUBLISHED, LAGGED, f"SELECT symbol, indicator, CAST(lag_months AS INTEGER) AS lag_months, n, {r('rr')} AS pearson_r, {r('rho')} AS spearman_rho FROM lc"))
def stat_13(spark, sf):
    return lagged(spark, sf).select("symbol", "indicator", "lag_months", "n", rnd("pearson_r").alias("pearson_r"), rnd("spearman_rho").alias("spearman_rho"))


@query(
    "stat_14",
    sql(
        RETURNS, MACRO, MONTHLY, PUBLISHED, LAGGED,
        f"SELECT symbol, indicator, CAST(lag_months AS INTEGER) AS lag_months, {r(t_p('rr * sqrt((n - 2) / (1 - rr * rr))', 'n - 2'))} AS p_value, {r('0.05::DOUBLE / 25')} AS bonferroni_alpha, "
        f"{t_p('rr * sqrt((n - 2) / (1 - rr * rr))', 'n - 2')} < 0.05::DOUBLE / 25 AS significant FROM lc",
    ),
)
def stat_14(spark, sf):
    return lagged(spark, sf).select("symbol", "indicator", "lag_months", rnd("p_value").alias("p_value"), rnd("bonferroni_alpha").alias("bonferroni_alpha"), "significant")


@query(
    "stat_15",
    sql(
        RETURNS, MACRO, MONTHLY, PUBLISHED, LAGGED,
        "SELECT symbol, indicator, " + ", ".join(f"max(CASE WHEN lag_months = {k} THEN {r('rr')} END) AS lag_{k}" for k in (0, 1, 3, 6, 12)) + " FROM lc GROUP BY 1, 2",
    ),
)
def stat_15(spark, sf):
    df = S.lag_pivot(lagged(spark, sf))
    return df.select("symbol", "indicator", *[rnd(f"lag_{k}").alias(f"lag_{k}") for k in (0, 1, 3, 6, 12)])


@query("stat_16")
def stat_16(spark, sf):
    df = S.normality(lr(spark, sf), ["symbol"], "log_return")
    return df.select("symbol", "n", rnd("jb_p").alias("jb_p"), rnd("w_p").alias("w_p"), "is_normal")


SAMPLES = """smp AS (SELECT v.symbol, v.log_return AS x, CASE WHEN v.v > g.p75 THEN 'A' WHEN v.v < g.p25 THEN 'B' END AS s FROM vol v JOIN reg g USING (symbol)),
ab AS (SELECT * FROM smp WHERE s IS NOT NULL AND x IS NOT NULL)"""
GROUPS = """gm AS (SELECT symbol, count(*) FILTER (WHERE s = 'A') AS na, count(*) FILTER (WHERE s = 'B') AS nb, avg(x) FILTER (WHERE s = 'A') AS ma, avg(x) FILTER (WHERE s = 'B') AS mb,
  var_samp(x) FILTER (WHERE s = 'A') AS va, var_samp(x) FILTER (WHERE s = 'B') AS vb FROM ab GROUP BY symbol),
tt AS (SELECT *, (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1.0::DOUBLE / na + 1.0::DOUBLE / nb)) AS student_t, (ma - mb) / sqrt(va / na + vb / nb) AS welch_t,
  power(va / na + vb / nb, 2) / (power(va / na, 2) / (na - 1) + power(vb / nb, 2) / (nb - 1)) AS welch_dof,
  (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) AS cohens_d FROM gm)"""


def samples(spark, sf):
    return S.regime_samples(V.returns(spark, sf))


LEVENE = """zz AS (SELECT symbol, s, abs(x - median(x) OVER (PARTITION BY symbol, s)) AS z FROM ab),
zg AS (SELECT symbol, s, count(*) AS n, avg(z) AS zm, var_pop(z) * count(*) AS ss FROM zz GROUP BY 1, 2),
lv AS (SELECT a.symbol, a.n + b.n AS nn, (a.n * power(a.zm - (a.n * a.zm + b.n * b.zm) / (a.n + b.n), 2) + b.n * power(b.zm - (a.n * a.zm + b.n * b.zm) / (a.n + b.n), 2)) * (a.n + b.n - 2) / (a.ss + b.ss) AS f
  FROM zg a JOIN zg b ON a.symbol = b.symbol AND a.s = 'A' AND b.s = 'B')"""


@query("stat_17", sql(RETURNS, VOL60, SAMPLES, LEVENE, f"SELECT symbol, {r('f', 5)} AS levene_stat, {r(t_p('sqrt(f)', 'nn - 2'))} AS levene_p FROM lv"))
def stat_17(spark, sf):
    df = S.levene(samples(spark, sf), ["symbol"], "sample", "log_return", bounded=True)
    return df.select("symbol", rnd("levene_stat", 5).alias("levene_stat"), rnd("levene_p").alias("levene_p"))


@query(
    "stat_18",
    sql(
        RETURNS, VOL60, SAMPLES, GROUPS,
        f"SELECT symbol, na AS n_a, nb AS n_b, {r('student_t')} AS student_t, {r(t_p('student_t', 'na + nb - 2'))} AS student_p, {r('welch_t')} AS welch_t, {r('welch_dof')} AS welch_dof, {r(t_p('welch_t', 'welch_dof'))} AS welch_p FROM tt",
    ),
)
def stat_18(spark, sf):
    df = S.t_tests(S.moments(samples(spark, sf), ["symbol"], "sample", "log_return"))
    return pick(df, ["symbol", "n_a", "n_b"], ["student_t", "student_p", "welch_t", "welch_dof", "welch_p"])


MW = """mr AS (SELECT symbol, s, rank() OVER (PARTITION BY symbol ORDER BY x) + (count(*) OVER (PARTITION BY symbol, x) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY symbol, x) AS t FROM ab),
mw AS (SELECT symbol, count(*) FILTER (WHERE s = 'A') AS na, count(*) FILTER (WHERE s = 'B') AS nb, count(*) AS n, sum(rk) FILTER (WHERE s = 'A') AS ra, sum(power(t, 2) - 1) AS ties FROM mr GROUP BY symbol),
mu AS (SELECT *, ra - na * (na + 1) / 2.0::DOUBLE AS u FROM mw),
mz AS (SELECT *, (greatest(u, na * nb - u) - na * nb / 2.0::DOUBLE - 0.5::DOUBLE) / sqrt(na * nb / 12.0::DOUBLE * ((n + 1) - ties / (n * (n - 1.0::DOUBLE)))) AS z FROM mu)"""


@query("stat_19", sql(RETURNS, VOL60, SAMPLES, MW, f"SELECT symbol, na AS n_a, nb AS n_b, {r('u', 2)} AS u_stat, {r(z_p('z'))} AS mw_p FROM mz"))
def stat_19(spark, sf):
    df = S.mann_whitney(samples(spark, sf), ["symbol"], "sample", "log_return", bounded=True)
    return df.select("symbol", "n_a", "n_b", rnd("u_stat", 2).alias("u_stat"), rnd("mw_p").alias("mw_p"))


@query("stat_20", sql(RETURNS, VOL60, SAMPLES, GROUPS, MW, f"SELECT tt.symbol, {r('cohens_d')} AS cohens_d, {r('2 * u / (mz.na * mz.nb) - 1')} AS cliffs_delta FROM tt JOIN mz USING (symbol)"))
def stat_20(spark, sf):
    rows = samples(spark, sf)
    d = S.t_tests(S.moments(rows, ["symbol"], "sample", "log_return")).select("symbol", "cohens_d")
    m = S.mann_whitney(rows, ["symbol"], "sample", "log_return", bounded=True).select("symbol", "cliffs_delta")
    return pick(d.join(m, "symbol"), ["symbol"], ["cohens_d", "cliffs_delta"])


@query("stat_21")
def stat_21(spark, sf):
    """Odd against even days: samples that should not differ."""
    rows = lr(spark, sf).withColumn("sample", F.when(F.day("ts") % 2 == 1, "A").otherwise("B"))
    df = S.two_sample(rows, ["symbol"], "sample", "log_return", bounded=True)
    return df.withColumns({"p_value": rnd("p_value"), "effect_size_value": rnd("effect_size_value")})


@query("stat_22")
def stat_22(spark, sf):
    df = S.two_sample(samples(spark, sf), ["symbol"], "sample", "log_return", bounded=True)
    return df.withColumns({"p_value": rnd("p_value"), "effect_size_value": rnd("effect_size_value")})


@query("stat_23")
def stat_23(spark, sf):
    return S.eda_report(V.returns(spark, sf), aligned(spark, sf), list(MACRO_NAMES.values()))
