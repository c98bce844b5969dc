"""Return statistics, distribution tests, correlations and two-sample tests.

Functions named `profile_*` read daily bars, whose groups the calendar bounds. Everything that takes
free samples (two-sample tests, ranks, medians) goes through ordering.py and never sorts a whole group
in one task, unless the caller states with `bounded` that groups are daily bars too.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.distributions import f_tail, normal_quantile, normal_tail, t_two_sided
from marketloom.functions.expr import TRADING_DAYS, div, finite, series, so_far
from marketloom.operators.ordering import cumulative, positions, quantiles
from marketloom.operators.pairs import pair_statistics
from marketloom.operators.windows import add_drawdown, add_rolling_volatility

ANNUAL = float(TRADING_DAYS) ** 0.5
MIN_SAMPLE = 30


# --- returns profile -------------------------------------------------------------------------------


def profile_returns(df: DataFrame, by: str = "symbol", x: str = "log_return") -> DataFrame:
    """Cumulative return and volatilities."""
    down = F.when(F.col(x) < 0, F.col(x))
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("total_observations"),
        F.min("ts").alias("start_date"),
        F.max("ts").alias("end_date"),
        (F.exp(F.sum(x)) - 1).alias("cumulative_return"),
        F.stddev_samp(x).alias("daily_volatility"),
        (F.stddev_samp(x) * ANNUAL).alias("annualized_volatility"),
        F.when(F.count(down) > 1, F.stddev_samp(down) * ANNUAL).otherwise(0.0).alias("downside_volatility"),
    )


def profile_drawdown(df: DataFrame, by: str = "symbol", ts: str = "ts", price: str = "close") -> DataFrame:
    """Deepest drawdown, its trough, the peak before it and the rows between them."""
    w = series(by, ts)
    rows = add_drawdown(df, by, ts, price).withColumn("_i", F.row_number().over(w))
    # peak so far and where it was first reached, so that the trough row knows its own peak
    peak = F.max_by(F.struct(F.col(ts).alias("t"), F.col("_i").alias("i")), F.struct(price, -F.col("_i"))).over(so_far(w))
    rows = rows.withColumn("_peak", peak)
    trough = F.min_by(F.struct(F.col("drawdown"), F.col(ts).alias("t"), F.col("_i"), F.col("_peak")), F.struct("drawdown", "_i"))
    return rows.groupBy(by).agg(trough.alias("d")).select(
        by,
        F.col("d.drawdown").alias("max_drawdown"),
        F.col("d._peak.t").alias("peak_date"),
        F.col("d.t").alias("trough_date"),
        (F.col("d._i") - F.col("d._peak.i")).alias("max_drawdown_duration_obs"),
    )


def profile_regime(df: DataFrame, by: str = "symbol", ts: str = "ts", window: int = 60) -> DataFrame:
    """Latest rolling volatility against its own quartiles; needs more than 60 values."""
    v = f"volatility_{window}d"
    vols = add_rolling_volatility(df, [window], by, ts)
    q = vols.groupBy(by).agg(
        F.count(v).alias("_n"),
        F.percentile(v, 0.25).alias("threshold_25th"),
        F.percentile(v, 0.75).alias("threshold_75th"),
        F.max_by(v, F.when(F.col(v).isNotNull(), F.col(ts))).alias("latest_60d_volatility"),
    )
    last = F.col("latest_60d_volatility")
    regime = F.when(last < F.col("threshold_25th"), "Low").when(last > F.col("threshold_75th"), "High").otherwise("Normal")
    return q.where(F.col("_n") > 60).withColumn("current_regime", regime).drop("_n")


def profile(df: DataFrame, by: str = "symbol") -> DataFrame:
    return profile_returns(df, by).join(profile_drawdown(df, by), by).join(profile_regime(df, by), by, "left")


# --- distribution ----------------------------------------------------------------------------------


def describe(df: DataFrame, by: list[str], x: str, bounded: bool = False) -> DataFrame:
    """Sample moments and quartiles per group. Skewness and kurtosis carry the small-sample correction."""
    m = df.where(F.col(x).isNotNull()).groupBy(*by).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("variance"), F.stddev_samp(x).alias("std_dev"),
        F.min(x).alias("min"), F.max(x).alias("max"), F.skewness(x).alias("_g1"), F.kurtosis(x).alias("_g2"),
    )
    n = F.col("n").cast("double")
    m = m.withColumns(
        {
            "skewness": F.when(n > 2, F.col("_g1") * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))),
            "kurtosis": F.when(n > 3, ((n + 1) * F.col("_g2") + 6) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0))),
        }
    ).drop("_g1", "_g2")
    q = quantiles(df, by, x, {"q25": 0.25, "median": 0.5, "q75": 0.75}, bounded)
    return m.join(q, by).withColumn("iqr", F.col("q75") - F.col("q25"))


def jarque_bera(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """Statistic and its chi-square(2) tail, which has a closed form."""
    m = df.where(F.col(x).isNotNull()).groupBy(*by).agg(F.count(x).alias("n"), F.skewness(x).alias("_s"), F.kurtosis(x).alias("_k"))
    jb = F.col("n") / 6.0 * (F.col("_s") ** 2 + F.col("_k") ** 2 / 4.0)
    return m.withColumn("jb_stat", jb).withColumn("jb_p", F.exp(-F.col("jb_stat") / 2)).drop("_s", "_k")


# Royston's 1995 polynomial coefficients, lowest order first.
ROYSTON_A1 = [0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056]
ROYSTON_A2 = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
ROYSTON_MEAN = [-1.5861, -0.31082, -0.083751, 0.0038915]
ROYSTON_SD = [-0.4803, -0.082676, 0.0030302]
# The same for 4 to 11 values: bound, mean and logarithm of the deviation by the number of values.
ROYSTON_SMALL_BOUND = [-2.273, 0.459]
ROYSTON_SMALL_MEAN = [0.544, -0.39978, 0.025054, -6.714e-4]
ROYSTON_SMALL_SD = [1.3822, -0.77857, 0.062767, -0.0020322]


def _poly(coef: list[float], x: Column) -> Column:
    out = F.lit(coef[-1])
    for c in reversed(coef[:-1]):
        out = out * x + c
    return out


def shapiro_wilk(df: DataFrame, by: list[str], x: str, limit: int = 5000) -> DataFrame:
    """n, W and p of every group that has values; W and p are null below 3 values, from `limit` on, and without variance.

    Groups outside these bounds are set apart before anything is sorted. Outermost weights are corrected by polynomials, the
    two next to them from six values on; p is exact for three values and has its own transformation up to eleven.
    """
    clean = df.where(F.col(x).isNotNull()).select(*by, x)
    sizes = clean.groupBy(*by).agg(F.count(x).alias("n"), F.var_pop(x).alias("_v"))
    fits = (F.col("n") < limit) & (F.col("n") > 2)
    rest = sizes.where(~fits).select(*by, "n", F.lit(None).cast("double").alias("w_stat"), F.lit(None).cast("double").alias("w_p"))
    sizes = sizes.where(fits)
    w = Window.partitionBy(*by).orderBy(x)
    ranked = clean.join(sizes, by).withColumn("_i", F.row_number().over(w))
    score = normal_quantile((F.col("_i") - 0.375) / (F.col("n") + 0.25))
    ranked = ranked.withColumn("_m", score)
    low = lambda i: F.max(F.when(F.col("_i") == F.col("n") + 1 - i, F.col("_m")))
    at = lambda i: F.max(F.when(F.col("_i") == i, F.col(x)))
    top = lambda i: F.max(F.when(F.col("_i") == F.col("n") + 1 - i, F.col(x)))
    two = F.col("n") > 5
    outer = F.when(two, 2).otherwise(1)
    inner = (F.col("_i") > outer) & (F.col("_i") < F.col("n") + 1 - outer)
    g = ranked.groupBy(*by, "n", "_v").agg(
        F.sum(F.col("_m") ** 2).alias("_mm"), low(1).alias("_m1"), low(2).alias("_m2"),
        (top(1) - at(1)).alias("_d1"), (top(2) - at(2)).alias("_d2"),
        F.sum(F.when(inner, F.col("_m") * F.col(x))).alias("_mx"),
    )
    n = F.col("n").cast("double")
    root = F.sqrt("_mm")
    a1 = _poly(ROYSTON_A1, 1 / F.sqrt(n)) + F.col("_m1") / root
    g = g.withColumn("_a1", F.when(F.col("n") == 3, F.sqrt(F.lit(0.5))).otherwise(a1))
    g = g.withColumn("_a2", F.when(two, _poly(ROYSTON_A2, 1 / F.sqrt(n)) + F.col("_m2") / root).otherwise(0.0))
    left = F.col("_mm") - 2 * F.col("_m1") ** 2 - F.when(two, 2 * F.col("_m2") ** 2).otherwise(0.0)
    phi = left / (1 - 2 * F.col("_a1") ** 2 - 2 * F.col("_a2") ** 2)
    middle = F.when(F.col("n") == 3, 0.0).otherwise(F.col("_mx") / F.sqrt(phi))
    num = F.col("_a1") * F.col("_d1") + F.when(two, F.col("_a2") * F.col("_d2")).otherwise(0.0) + middle
    g = g.withColumn("w_stat", F.least(div(num**2, F.col("_v") * n), F.when(F.col("_v") > 0, 1.0)))
    gone = F.ln(1 - F.col("w_stat"))
    z = (gone - _poly(ROYSTON_MEAN, F.ln(n))) / F.exp(_poly(ROYSTON_SD, F.ln(n)))
    bound = _poly(ROYSTON_SMALL_BOUND, n)
    small = (-F.ln(bound - gone) - _poly(ROYSTON_SMALL_MEAN, n)) / F.exp(_poly(ROYSTON_SMALL_SD, n))
    three = F.greatest(F.lit(0.0), 6 / math.pi * (F.asin(F.sqrt("w_stat")) - math.asin(math.sqrt(0.75))))
    p = F.when(F.col("n") == 3, three).when((F.col("n") < 12) & (gone >= bound), 0.0)
    p = p.when(F.col("w_stat") == 1, 1.0).otherwise(normal_tail(F.when(F.col("n") < 12, small).otherwise(z)))
    p = F.when(F.col("w_stat").isNotNull(), p)
    return g.withColumn("w_p", p).select(*by, "n", "w_stat", "w_p").unionByName(rest)


def outliers(df: DataFrame, by: list[str], x: str, bounded: bool = False) -> DataFrame:
    """z_score, robust_z_score (0.6745 (x - median) / MAD) and outlier_class per row."""
    rows = df.where(F.col(x).isNotNull())
    m = rows.groupBy(*by).agg(F.avg(x).alias("_mean"), F.stddev_samp(x).alias("_sd"))
    med = quantiles(rows, by, x, {"_median": 0.5}, bounded)
    centred = rows.join(med, by).withColumn("_dev", F.abs(F.col(x) - F.col("_median")))
    mad = quantiles(centred, by, "_dev", {"_mad": 0.5}, bounded)
    rz = F.when(F.col("_mad") > 0, 0.6745 * (F.col(x) - F.col("_median")) / F.nullif(F.col("_mad"), F.lit(0.0))).otherwise(0.0)
    out = centred.join(m, by).join(mad, by).withColumn("z_score", div(F.col(x) - F.col("_mean"), "_sd")).withColumn("robust_z_score", rz)
    size = F.abs("robust_z_score")
    label = F.when(size >= 3, "extreme").when(size >= 2, "unusual").otherwise("normal")
    return out.withColumn("outlier_class", label).drop("_mean", "_sd", "_median", "_mad", "_dev")


# --- correlation -----------------------------------------------------------------------------------

def correlation_p(r: str, n: str) -> Column:
    """Two-sided p of a correlation; a perfect one has p = 0."""
    t = F.abs(F.col(r)) * F.sqrt((F.col(n) - 2) / F.nullif(1 - F.col(r) ** 2, F.lit(0.0)))
    return F.when(F.abs(F.col(r)) >= 1, F.lit(0.0)).otherwise(t_two_sided(t, (F.col(n) - 2).cast("double")))


def pairwise_correlations(df: DataFrame, **kw) -> DataFrame:
    """Pearson and Spearman with p values; pairs with fewer than 30 common days are only listed (and left out by `top` and
    `threshold`)."""
    p = pair_statistics(df, enough=MIN_SAMPLE, **kw)
    enough = F.col("n") >= MIN_SAMPLE
    return p.select(
        "a", "b", "n",
        F.when(enough, F.col("pearson")).alias("pearson_r"),
        F.when(enough, correlation_p("pearson", "n")).alias("pearson_p"),
        F.when(enough, F.col("spearman")).alias("spearman_rho"),
        F.when(enough, correlation_p("spearman", "n")).alias("spearman_p"),
        F.when(enough, "OK").otherwise("Insufficient Data").alias("status"),
    )


def correlation_matrix(df: DataFrame, min_periods: int = MIN_SAMPLE, **kw) -> DataFrame:
    """Long form (a, b, r), both triangles and the diagonal."""
    p = pair_statistics(df, diagonal=True, rank=False, **kw).where(F.col("n") >= min_periods)
    half = F.when(F.col("a") == F.col("b"), F.lit(1.0)).otherwise(F.col("pearson")).alias("r")
    both = F.explode(F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    return p.select(both.alias("k"), half).select("k.a", "k.b", "r")


def lagged_correlations(monthly: DataFrame, indicators: list[str], lags: tuple[int, ...] = (0, 1, 3, 6, 12), by: str = "symbol", alpha: float = 0.05) -> DataFrame:
    """Macro at month t against the market `lag` months later, with a Bonferroni threshold.

    Monthly rows: a group is bounded by the number of months.
    """
    w = series(by, "month_end")
    shifted = monthly.withColumns({f"_lead{k}": F.lead("log_return", k).over(w) for k in lags})
    cell = [
        F.struct(F.lit(i).alias("indicator"), F.lit(k).alias("lag_months"), finite(f"`{i}`").alias("macro"), F.col(f"_lead{k}").alias("market"))
        for i in indicators
        for k in lags
    ]
    long = shifted.select(by, F.explode(F.array(*cell)).alias("c")).select(by, "c.*").where(F.col("macro").isNotNull() & F.col("market").isNotNull())
    keys = [by, "indicator", "lag_months"]
    rank = lambda x: (F.rank().over(Window.partitionBy(*keys).orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, x)) - 1) / 2.0)
    ranked = long.withColumn("_ra", rank("macro")).withColumn("_rb", rank("market"))
    tests = len(indicators) * len(lags)
    out = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr("macro", "market").alias("pearson_r"), F.corr("_ra", "_rb").alias("spearman_rho"))
    out = out.where(F.col("n") >= MIN_SAMPLE).withColumn("p_value", correlation_p("pearson_r", "n"))
    return out.withColumn("bonferroni_alpha", F.lit(alpha / tests)).withColumn("significant", F.col("p_value") < F.col("bonferroni_alpha"))


def lag_pivot(lagged: DataFrame, lags: tuple[int, ...] = (0, 1, 3, 6, 12), by: str = "symbol") -> DataFrame:
    wide = lagged.groupBy(by, "indicator").pivot("lag_months", list(lags)).agg(F.first("pearson_r"))
    for k in lags:
        wide = wide.withColumnRenamed(str(k), f"lag_{k}")
    return wide


# --- two-sample tests ------------------------------------------------------------------------------
# Samples come in long form: test keys, a label column holding 'A' or 'B', and the value.


def normality(df: DataFrame, by: list[str], x: str, alpha: float = 0.05) -> DataFrame:
    """is_normal: never below 30 values; Shapiro-Wilk below 5000, Jarque-Bera from there."""
    jb = jarque_bera(df, by, x)
    sw = shapiro_wilk(df, by, x).drop("n")
    p = F.when(F.col("n") < 5000, F.col("w_p")).otherwise(F.col("jb_p"))
    return jb.join(sw, by, "left").withColumn("is_normal", F.coalesce((F.col("n") >= MIN_SAMPLE) & (p >= alpha), F.lit(False)))


def moments(df: DataFrame, by: list[str], label: str, x: str) -> DataFrame:
    a, b = F.when(F.col(label) == "A", F.col(x)), F.when(F.col(label) == "B", F.col(x))
    return df.groupBy(*by).agg(
        F.count(a).alias("n_a"), F.count(b).alias("n_b"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"),
        F.var_samp(a).alias("var_a"), F.var_samp(b).alias("var_b"),
    )


def levene(df: DataFrame, by: list[str], label: str, x: str, bounded: bool = False) -> DataFrame:
    """Levene's test around the medians."""
    med = quantiles(df, [*by, label], x, {"_median": 0.5}, bounded)
    dev = df.join(med, [*by, label]).withColumn("_z", F.abs(F.col(x) - F.col("_median")))
    g = dev.groupBy(*by, label).agg(F.count("_z").alias("_n"), F.avg("_z").alias("_zm"), (F.var_pop("_z") * F.count("_z")).alias("_ss"))
    t = g.groupBy(*by).agg(
        F.sum("_n").alias("_N"), F.count(F.lit(1)).alias("_k"), (F.sum(F.col("_n") * F.col("_zm")) / F.sum("_n")).alias("_grand"),
        F.sum("_ss").alias("_within"), F.sum(F.col("_n") * F.col("_zm") ** 2).alias("_sq"),
    )
    between = F.col("_sq") - F.col("_N") * F.col("_grand") ** 2
    stat = div((F.col("_N") - F.col("_k")) * between, (F.col("_k") - 1) * F.col("_within"))
    return t.withColumn("levene_stat", stat).select(
        *by, "levene_stat", f_tail("levene_stat", (F.col("_k") - 1).cast("double"), (F.col("_N") - F.col("_k")).cast("double")).alias("levene_p")
    )


def t_tests(m: DataFrame) -> DataFrame:
    """Student and Welch statistics, degrees of freedom, p values and Cohen's d from `moments`."""
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    diff = F.col("mean_a") - F.col("mean_b")
    pooled = ((na - 1) * F.col("var_a") + (nb - 1) * F.col("var_b")) / F.nullif(na + nb - 2, F.lit(0.0))
    ea, eb = F.col("var_a") / na, F.col("var_b") / nb
    m = m.withColumns(
        {
            "student_t": div(diff, F.sqrt(pooled * (1 / na + 1 / nb))),
            "welch_t": div(diff, F.sqrt(ea + eb)),
            "welch_dof": div((ea + eb) ** 2, ea**2 / F.nullif(na - 1, F.lit(0.0)) + eb**2 / F.nullif(nb - 1, F.lit(0.0))),
            "cohens_d": div(diff, F.sqrt(pooled)),
        }
    )
    return m.withColumns({"student_p": t_two_sided("student_t", na + nb - 2), "welch_p": t_two_sided("welch_t", "welch_dof")})


def mann_whitney(df: DataFrame, by: list[str], label: str, x: str, bounded: bool = False) -> DataFrame:
    """U of sample A, two-sided p with tie and continuity corrections, and Cliff's delta."""
    counts = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(
        F.count_if(F.col(label) == "A").alias("na"), F.count(F.lit(1)).alias("n")
    )
    pos = cumulative(counts, by, x, ["n", "na"], bounded=bounded)
    rank = F.col("n_before") + (F.col("n") + 1) / F.lit(2.0)
    n3 = F.col("n").cast("double")
    g = pos.groupBy(*by).agg(
        F.sum("na").alias("n_a"), F.sum("n").alias("_N"), F.sum(F.col("na") * rank).alias("_ra"), F.sum(n3**3 - n3).alias("_ties")
    )
    na = F.col("n_a").cast("double")
    nb = F.col("_N") - na
    big = F.col("_N").cast("double")
    g = g.withColumn("n_b", F.col("_N") - F.col("n_a")).withColumn("u_stat", F.col("_ra") - na * (na + 1) / 2)
    sd = F.sqrt(na * nb / 12.0 * ((big + 1) - F.col("_ties") / F.nullif(big * (big - 1), F.lit(0.0))))
    z = div(F.greatest(F.col("u_stat"), na * nb - F.col("u_stat")) - na * nb / 2 - 0.5, sd)
    g = g.withColumn("mw_p", F.least(2 * normal_tail(z), F.lit(1.0)))
    return g.withColumn("cliffs_delta", div(2 * F.col("u_stat"), na * nb) - 1).select(*by, "n_a", "n_b", "u_stat", "mw_p", "cliffs_delta")


def two_sample(
    df: DataFrame, by: list[str], label: str, x: str, alpha: float = 0.05, economic: float = 0.2, bounded: bool = False
) -> DataFrame:
    """Picks Student, Welch or Mann-Whitney from the assumptions and states both verdicts. One row per test."""
    rows = df.where(F.col(x).isNotNull()).select(*by, label, x)
    norm = normality(rows, [*by, label], x, alpha).groupBy(*by).agg(F.min(F.col("is_normal")).alias("_normal"))
    t = t_tests(moments(rows, by, label, x)).where((F.col("n_a") >= MIN_SAMPLE) & (F.col("n_b") >= MIN_SAMPLE))
    mw = mann_whitney(rows, by, label, x, bounded).drop("n_a", "n_b")
    j = t.join(norm, by).join(levene(rows, by, label, x, bounded), by).join(mw, by)
    equal = F.col("levene_p") >= alpha
    pick = lambda s, w, m: F.when(~F.col("_normal"), m).when(equal, s).otherwise(w)
    out = j.withColumns(
        {
            "test_used": pick(F.lit("Student's t-test (Independent)"), F.lit("Welch's t-test (Unequal Variances)"), F.lit("Mann-Whitney U (Non-Parametric)")),
            "p_value": pick(F.col("student_p"), F.col("welch_p"), F.col("mw_p")),
            "effect_size_metric": F.when(F.col("_normal"), "Cohen's d").otherwise("Cliff's Delta"),
            "effect_size_value": F.when(F.col("_normal"), F.col("cohens_d")).otherwise(F.col("cliffs_delta")),
        }
    )
    return out.select(
        *by, "test_used", F.col("n_a").alias("sample_a_size"), F.col("n_b").alias("sample_b_size"), "p_value",
        (F.col("p_value") < alpha).alias("is_statistically_significant"), "effect_size_metric", "effect_size_value",
        (F.abs("effect_size_value") >= economic).alias("is_economically_significant"),
    )


def regime_samples(df: DataFrame, by: str = "symbol", window: int = 60, x: str = "log_return") -> DataFrame:
    """Returns on days of high (above the 75th percentile) and low (below the 25th) rolling volatility."""
    v = f"volatility_{window}d"
    vols = add_rolling_volatility(df, [window], by)
    cuts = vols.groupBy(by).agg(F.percentile(v, 0.25).alias("_lo"), F.percentile(v, 0.75).alias("_hi"))
    label = F.when(F.col(v) > F.col("_hi"), "A").when(F.col(v) < F.col("_lo"), "B")
    return vols.join(cuts, by).withColumn("sample", label).where(F.col("sample").isNotNull() & F.col(x).isNotNull()).select(by, "sample", x)


def eda_report(df: DataFrame, market_macro: DataFrame | None = None, indicators: list[str] | None = None, by: str = "symbol") -> DataFrame:
    """One JSON document per symbol: coverage, profile, distribution, tests, correlations, macro, hypothesis."""
    rows = df.where(F.col("log_return").isNotNull())
    prof = profile(df, by)
    dist = describe(rows, [by], "log_return", bounded=True).join(jarque_bera(rows, [by], "log_return").drop("n"), by)
    pairs = pairwise_correlations(df, by=by, top=10)
    partners = F.explode(F.array(F.struct(F.col("a").alias(by), F.col("b").alias("other")), F.struct(F.col("b").alias(by), F.col("a").alias("other"))))
    # ten strongest partners: the map side prunes to ten rows per symbol, so the list is bounded
    ranked = pairs.select(partners.alias("k"), "pearson_r", "n").select("k.*", "pearson_r", "n").where(F.col("pearson_r").isNotNull())
    w = Window.partitionBy(by).orderBy(F.desc(F.abs("pearson_r")), "other")
    corr = ranked.withColumn("_rn", F.row_number().over(w)).where("_rn <= 10").groupBy(by).agg(F.sort_array(F.collect_list(F.struct("_rn", "other", "pearson_r", "n"))).alias("strongest"))
    hyp = two_sample(regime_samples(df, by), [by], "sample", "log_return", bounded=True)
    doc = prof.select(by, F.struct(*[c for c in prof.columns if c != by]).alias("returns"))
    doc = doc.join(dist.select(by, F.struct(*[c for c in dist.columns if c != by]).alias("distribution")), by, "left")
    doc = doc.join(corr.withColumnRenamed("strongest", "correlation"), by, "left")
    doc = doc.join(hyp.select(by, F.struct(*[c for c in hyp.columns if c != by]).alias("hypothesis")), by, "left")
    if market_macro is not None:
        lag = lagged_correlations(market_macro, indicators, by=by)
        mac = lag.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("indicator", "lag_months", "n", "pearson_r", "p_value", "significant"))).alias("macro"))
        doc = doc.join(mac, by, "left")
    return doc.select(by, F.to_json(F.struct(*doc.columns)).alias("payload"))


__all__ = ["positions"]
