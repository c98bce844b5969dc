"""Portfolio risk: value at risk, attribution, stress scenarios, backtests, classification.

Inputs are daily returns in long form; a portfolio has one return per day, so windows over a portfolio
or a symbol are bounded by the calendar.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.expr import TRADING_DAYS, div, series, so_far
from marketloom.operators.pairs import pair_statistics

ANNUAL = float(TRADING_DAYS) ** 0.5


def historical(df: DataFrame, by: list[str], x: str, confidence: float = 0.95) -> DataFrame:
    """Quantile VaR and the mean of returns at or below it."""
    rows = df.where(F.col(x).isNotNull())
    var = rows.groupBy(*by).agg(F.percentile(x, 1.0 - confidence).alias("var"))
    tail = F.avg(F.when(F.col(x) <= F.col("var"), F.col(x)))
    return rows.join(var, by).groupBy(*by).agg(F.count(x).alias("sample_size"), F.first("var").alias("var"), tail.alias("cvar"))


def parametric(df: DataFrame, by: list[str], x: str, confidence: float = 0.95) -> DataFrame:
    """mean + z * population std for groups of 30 and more, with a fat-tail warning."""
    z = NormalDist().inv_cdf(1.0 - confidence)
    m = df.where(F.col(x).isNotNull()).groupBy(*by).agg(
        F.count(x).alias("sample_size"), (F.avg(x) + z * F.stddev_pop(x)).alias("var"), F.kurtosis(x).alias("excess_kurtosis")
    )
    return m.where(F.col("sample_size") >= 30)


# The words before the colon, and "exceeds" with its percentage in the reasons of `classify`.
FAT_TAIL = "Fat Tail Warning: excess kurtosis %.2f, losses reach further than a normal curve allows"
NO_CVAR = "The normal method gives no expected loss beyond its value at risk"


def risk_metrics(df: DataFrame, by: list[str], x: str, confidence: float = 0.95, method: str = "historical") -> DataFrame:
    if method == "historical":
        out = historical(df, by, x, confidence).withColumn("warnings", F.array().cast("array<string>"))
    elif method == "parametric_normal":
        fat = F.when(F.col("excess_kurtosis") > 1.0, F.format_string(FAT_TAIL, "excess_kurtosis"))
        out = parametric(df, by, x, confidence).withColumns(
            {"cvar": F.lit(None).cast("double"), "warnings": F.array_compact(F.array(fat, F.lit(NO_CVAR)))}
        )
    else:
        raise ValueError(f"Unknown risk method: {method}")
    return out.select(*by, F.lit(method).alias("method"), F.lit(confidence).alias("confidence_level"), "sample_size", "var", "cvar", "warnings")


def var_backtest_rows(df: DataFrame, by: str, ts: str, x: str, window: int = 252, confidence: float = 0.95, method: str = "historical") -> DataFrame:
    """VaR at t from the `window` returns before t, and whether the return fell below it."""
    w = series(by, ts).rowsBetween(-window, -1)
    if method == "historical":
        v = F.percentile(x, 1.0 - confidence).over(w)
    else:
        v = F.avg(x).over(w) + NormalDist().inv_cdf(1.0 - confidence) * F.stddev_pop(x).over(w)
    rows = df.where(F.col(x).isNotNull()).withColumn("var_threshold", F.when(F.count(x).over(w) >= window, v))
    return rows.where(F.col("var_threshold").isNotNull()).select(by, ts, "var_threshold", F.col(x).alias("actual_return"), (F.col(x) < F.col("var_threshold")).alias("is_exceedance"))


def var_backtest(df: DataFrame, by: str, ts: str, x: str, window: int = 252, confidence: float = 0.95, method: str = "historical") -> DataFrame:
    rows = var_backtest_rows(df, by, ts, x, window, confidence, method)
    out = rows.groupBy(by).agg(F.count(F.lit(1)).alias("total_predictions"), F.count_if("is_exceedance").alias("exceedances"))
    expected = 1.0 - confidence
    out = out.withColumns(
        {
            "expected_exceedances": F.col("total_predictions") * expected,
            "empirical_exceedance_rate": F.col("exceedances") / F.col("total_predictions"),
            "exceedance_ratio": F.col("exceedances") / F.col("total_predictions") / expected,
        }
    )
    verdict = F.when(F.col("exceedance_ratio") > 1.5, "UNDERESTIMATING").when(F.col("exceedance_ratio") < 0.5, "OVERESTIMATING").otherwise("VALID")
    return out.withColumn("verdict", verdict).withColumn("is_valid", F.col("verdict") == "VALID")


# --- portfolios ------------------------------------------------------------------------------------
# weights: portfolio, symbol, weight (static holdings).


def check_weights(weights: DataFrame, returns: DataFrame, by: str = "symbol") -> DataFrame:
    """Per portfolio: total weight, number of assets without returns, and a status."""
    known = returns.select(by).distinct().withColumn("_known", F.lit(1))
    g = weights.join(known, by, "left").groupBy("portfolio").agg(
        F.sum("weight").alias("total_weight"), F.count_if(F.col("_known").isNull()).alias("missing_assets")
    )
    status = F.when(F.abs(F.col("total_weight") - 1.0) > 0.01, "BAD_WEIGHTS").when(F.col("missing_assets") > 0, "MISSING_ASSETS").otherwise("OK")
    return g.withColumn("status", status)


def accepted_weights(weights: DataFrame, returns: DataFrame, by: str = "symbol") -> DataFrame:
    """The weights; reading one of a refused portfolio is an error that names it."""
    checked = check_weights(weights, returns, by).select("portfolio", "status", "total_weight", "missing_assets")
    refused = F.raise_error(F.format_string("Portfolio %s refused: %s, weights add up to %.4f, %d assets without returns", "portfolio", "status", "total_weight", "missing_assets"))
    return weights.join(checked, "portfolio").withColumn("weight", F.when(F.col("status") == "OK", F.col("weight")).otherwise(refused.cast("double"))).select(*weights.columns)


def portfolio_returns(returns: DataFrame, weights: DataFrame, x: str = "daily_return", by: str = "symbol", ts: str = "ts", keys: tuple[str, ...] = ()) -> DataFrame:
    """One return per portfolio and day; null when any asset has none that day. Portfolios that `check_weights` refuses end the
    query with an error."""
    weights = accepted_weights(weights, returns, by)
    assets = weights.groupBy("portfolio").agg(F.count(F.lit(1)).alias("_assets"))
    j = returns.join(weights, by)
    day = j.groupBy(*keys, "portfolio", ts).agg(F.count(x).alias("_have"), F.sum(F.col(x) * F.col("weight")).alias("_r"))
    return day.join(assets, "portfolio").select(*keys, "portfolio", ts, F.when(F.col("_have") == F.col("_assets"), F.col("_r")).alias("portfolio_return"))


def covariance(returns: DataFrame, weights: DataFrame, x: str = "daily_return", by: str = "symbol", ts: str = "ts", keys: tuple[str, ...] = ()) -> DataFrame:
    """Sample covariances of the held symbols, a <= b, in long form."""
    held = returns.join(weights.select(by).distinct(), by, "left_semi")
    return pair_statistics(held, x=x, by=by, ts=ts, diagonal=True, rank=False, keys=keys).select(*keys, "a", "b", "n", "cov")


def _weighted(cov: DataFrame, weights: DataFrame) -> DataFrame:
    a = weights.select("portfolio", F.col("symbol").alias("a"), F.col("weight").alias("w_a"))
    b = weights.select("portfolio", F.col("symbol").alias("b"), F.col("weight").alias("w_b"))
    return cov.join(a, "a").join(b, ["portfolio", "b"])


def portfolio_volatility(cov: DataFrame, weights: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """sqrt(w' C w); the half matrix counts off-diagonal cells twice."""
    twice = F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0)
    v = _weighted(cov, weights).groupBy(*keys, "portfolio").agg(F.sum(F.col("w_a") * F.col("w_b") * F.col("cov") * twice).alias("_v"))
    daily = F.sqrt(F.greatest(F.col("_v"), F.lit(0.0)))
    return v.select(*keys, "portfolio", daily.alias("daily_volatility"), (daily * ANNUAL).alias("annualized_volatility"))


def max_drawdown(df: DataFrame, by: list[str], ts: str, x: str) -> DataFrame:
    """Deepest fall of compounded wealth from its running peak (which does not include the start).

    Returns of -100 % and worse have no logarithm; they leave wealth at zero from then on.
    """
    w = series(by, ts)
    rows = df.where(F.col(x).isNotNull())
    ruined = F.max((F.col(x) <= -1).cast("int")).over(so_far(w))
    logs = F.sum(F.when(F.col(x) > -1, F.ln(1 + F.col(x)))).over(so_far(w))
    rows = rows.withColumn("_w", F.when(ruined == 1, 0.0).otherwise(F.exp(logs)))
    rows = rows.withColumn("_dd", div(F.col("_w"), F.max("_w").over(so_far(w))) - 1)
    return rows.groupBy(*by).agg(F.min("_dd").alias("max_drawdown"))


def portfolio_metrics(returns: DataFrame, weights: DataFrame, confidence: float = 0.95, x: str = "daily_return") -> DataFrame:
    stream = portfolio_returns(returns, weights, x)
    vol = portfolio_volatility(covariance(returns, weights, x), weights)
    tail = historical(stream, ["portfolio"], "portfolio_return", confidence).select("portfolio", F.col("var").alias("historical_var"), F.col("cvar").alias("historical_cvar"))
    return vol.join(max_drawdown(stream, ["portfolio"], "ts", "portfolio_return"), "portfolio").join(tail, "portfolio")


def attribution(cov: DataFrame, weights: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Marginal, component and percentage contribution per asset. Components add up to the volatility."""
    mirrored = cov.select(*keys, "a", "b", "cov").unionByName(cov.where("a <> b").select(*keys, F.col("b").alias("a"), F.col("a").alias("b"), "cov"))
    g = _weighted(mirrored, weights).groupBy(*keys, "portfolio", "a", "w_a").agg(F.sum(F.col("w_b") * F.col("cov")).alias("_cw"))
    total = F.sum(F.col("w_a") * F.col("_cw")).over(Window.partitionBy(*keys, "portfolio"))
    g = g.withColumn("_vol", F.sqrt(F.greatest(total, F.lit(0.0))))
    mcr = div("_cw", "_vol")
    return g.select(*keys, "portfolio", F.col("a").alias("symbol"), F.col("w_a").alias("weight"), mcr.alias("mcr"), (F.col("w_a") * mcr).alias("ccr"), div(F.col("w_a") * mcr, "_vol").alias("pcr"))


def concentration(attr: DataFrame, top: int = 3, outlier: float = 2.0) -> DataFrame:
    """Share of the top assets by weight and by risk, and assets that carry over twice their weight."""
    by_w = F.row_number().over(Window.partitionBy("portfolio").orderBy(F.desc("weight"), "symbol"))
    by_r = F.row_number().over(Window.partitionBy("portfolio").orderBy(F.desc("pcr"), "symbol"))
    ratio = div("pcr", "weight")
    rows = attr.withColumns({"_w": by_w, "_r": by_r, "risk_to_weight_ratio": ratio})
    names = lambda k: F.transform(F.sort_array(F.collect_list(F.when(F.col(k) <= top, F.struct(k, "symbol")))), lambda s: s["symbol"])
    return rows.groupBy("portfolio").agg(
        F.sum(F.when(F.col("_w") <= top, F.col("weight"))).alias("top_3_weight_concentration"),
        F.sum(F.when(F.col("_r") <= top, F.col("pcr"))).alias("top_3_risk_concentration"),
        names("_w").alias("top_weight_assets"),
        names("_r").alias("top_risk_assets"),
        F.sort_array(F.collect_list(F.when(F.col("risk_to_weight_ratio") > outlier, F.col("symbol")))).alias("risk_outliers"),
    )


# --- stress ----------------------------------------------------------------------------------------


def _in_scenarios(df: DataFrame, scenarios: list[tuple[str, str, str]], ts: str, label) -> DataFrame:
    """Repeats each row for the scenarios it belongs to; scenarios are a short configured list."""
    hits = [label(name, F.lit(a).cast("date"), F.lit(b).cast("date"), F.col(ts)) for name, a, b in scenarios]
    return df.withColumn("_s", F.explode(F.array_compact(F.array(*hits)))).select(*df.columns, "_s.*")


def stress(returns: DataFrame, weights: DataFrame, scenarios: list[tuple[str, str, str]], x: str = "daily_return", ts: str = "ts") -> DataFrame:
    """Every portfolio in every scenario window; windows outside the data are UNAVAILABLE, never invented."""
    inside = lambda n, a, b, t: F.when((t >= a) & (t <= b), F.struct(F.lit(n).alias("scenario")))
    crash = _in_scenarios(returns, scenarios, ts, inside)
    stream = portfolio_returns(returns, weights, x)
    window = _in_scenarios(stream, scenarios, ts, inside)
    keys = ["scenario", "portfolio"]
    basic = window.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trading_days"),
        (F.exp(F.sum(F.when(F.col("portfolio_return") > -1, F.ln(1 + F.col("portfolio_return"))))) - 1).alias("total_return"),
    )
    vol = portfolio_volatility(covariance(crash, weights, x, keys=("scenario",)), weights, keys=("scenario",)).drop("daily_volatility")
    dd = max_drawdown(window, keys, ts, "portfolio_return")
    var = historical(window, keys, "portfolio_return", 0.95).select(*keys, F.col("var").alias("realized_var_95"))
    span = stream.groupBy("portfolio").agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    listed = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(a).cast("date").alias("start_date"), F.lit(b).cast("date").alias("end_date")) for n, a, b in scenarios]))
    grid = span.withColumn("s", listed).select("portfolio", "_lo", "_hi", "s.*")
    out = grid.join(basic, keys, "left").join(vol, keys, "left").join(dd, keys, "left").join(var, keys, "left").join(recovery(stream, scenarios, ts), keys, "left")
    ok = (F.col("_lo") <= F.col("start_date")) & (F.col("_hi") >= F.col("end_date"))
    status = F.when(~ok, "UNAVAILABLE").when(F.coalesce("trading_days", F.lit(0)) < 5, "INSUFFICIENT_DATA").otherwise("VALID")
    valid = ["total_return", "max_drawdown", "annualized_volatility", "realized_var_95", "recovery_trading_days"]
    out = out.withColumn("status", status)
    return out.select(*keys, "status", "start_date", "end_date", F.coalesce("trading_days", F.lit(0)).alias("trading_days"), *[F.when(F.col("status") == "VALID", F.col(c)).alias(c) for c in valid])


def recovery(stream: DataFrame, scenarios: list[tuple[str, str, str]], ts: str = "ts", x: str = "portfolio_return") -> DataFrame:
    """Trading days from the first crash day until its level is regained after a fall; -1 if never."""
    after = lambda n, a, b, t: F.when(t >= a, F.struct(F.lit(n).alias("scenario")))
    rows = _in_scenarios(stream.where(F.col(x).isNotNull()), scenarios, ts, after)
    w = Window.partitionBy("scenario", "portfolio").orderBy(ts)
    i = F.row_number().over(w) - 1
    rows = rows.withColumn("_i", i)
    rows = rows.withColumn("_w", F.round(F.exp(F.sum(F.when((F.col("_i") > 0) & (F.col(x) > -1), F.ln(1 + F.col(x))).otherwise(0.0)).over(so_far(w))), 12))
    rows = rows.withColumn("_fell", F.max((F.col("_w") < 1).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    back = F.min(F.when((F.col("_w") >= 1) & (F.col("_fell") == 1), F.col("_i")))
    return rows.groupBy("scenario", "portfolio").agg(F.coalesce(back, F.lit(-1)).alias("recovery_trading_days"))


def recovery_of_wealth(df: DataFrame, by: list[str], ts: str, wealth: str) -> DataFrame:
    """The same rule on a wealth path that already starts at its pre-crash level."""
    w = Window.partitionBy(*by).orderBy(ts)
    rows = df.withColumns({"_i": F.row_number().over(w) - 1, "_w": F.col(wealth) / F.first(wealth).over(so_far(w))})
    rows = rows.withColumn("_fell", F.max((F.col("_w") < 1).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    back = F.min(F.when((F.col("_w") >= 1) & (F.col("_fell") == 1), F.col("_i")))
    return rows.groupBy(*by).agg(F.coalesce(back, F.lit(-1)).alias("recovery_trading_days"))


def attribution_shift(returns: DataFrame, weights: DataFrame, scenarios: list[tuple[str, str, str]], x: str = "daily_return", ts: str = "ts") -> DataFrame:
    """Risk share per asset in the 365 days before a scenario (over 50 days needed) and inside it."""

    def periods(n, a, b, t):
        pre = F.when((t >= F.date_sub(a, 365)) & (t <= a), F.struct(F.lit(n).alias("scenario"), F.lit("PRE").alias("period")))
        crash = F.when((t >= a) & (t <= b), F.struct(F.lit(n).alias("scenario"), F.lit("CRASH").alias("period")))
        return F.array(pre, crash)

    hits = F.flatten(F.array(*[periods(n, F.lit(a).cast("date"), F.lit(b).cast("date"), F.col(ts)) for n, a, b in scenarios]))
    rows = returns.withColumn("_s", F.explode(F.array_compact(hits))).select(*returns.columns, "_s.*")
    keys = ("scenario", "period")
    attr = attribution(covariance(rows, weights, x, keys=keys), weights, keys=keys)
    days = rows.groupBy(*keys).agg(F.count_distinct(ts).alias("_days")).groupBy("scenario").agg(
        F.max(F.when(F.col("period") == "PRE", F.col("_days"))).alias("_pre_days"), F.max(F.when(F.col("period") == "CRASH", F.col("_days"))).alias("_crash_days")
    )
    wide = attr.groupBy("scenario", "portfolio", "symbol").agg(
        F.max(F.when(F.col("period") == "PRE", F.col("pcr"))).alias("pre_crash_pcr"), F.max(F.when(F.col("period") == "CRASH", F.col("pcr"))).alias("crash_pcr")
    )
    return (
        wide.join(days, "scenario")
        .where((F.col("_pre_days") > 50) & (F.col("_crash_days") >= 5))
        .select("scenario", "portfolio", "symbol", "pre_crash_pcr", "crash_pcr", (F.col("crash_pcr") - F.col("pre_crash_pcr")).alias("shift"))
    )


# --- classification --------------------------------------------------------------------------------


def _pct(c: Column) -> Column:
    return F.format_string("%.1f%%", c * 100)


def classify(metrics: DataFrame) -> DataFrame:
    """CRITICAL, HIGH, MODERATE or LOW with the rules that fired.

    Reads max_drawdown, cvar_99, historical_cvar, annualized_volatility and top_3_risk_concentration;
    a missing metric counts as zero.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    dd, es99, es95 = F.abs(zero("max_drawdown")), F.abs(zero("cvar_99")), F.abs(zero("historical_cvar"))
    vol, conc = zero("annualized_volatility"), zero("top_3_risk_concentration")
    critical = (dd > 0.40) | (es99 > 0.10)
    high = (dd > 0.20) | (es95 > 0.05) | (conc > 0.60)
    moderate = (vol > 0.15) | (es95 > 0.02)
    label = F.when(critical, "CRITICAL").when(high, "HIGH").when(moderate, "MODERATE").otherwise("LOW")
    lv = F.col("classification")
    rule = lambda level, cond, *text: F.when((lv == level) & cond, F.concat(*[F.lit(t) if isinstance(t, str) else t for t in text]))
    drivers = F.array_compact(
        F.array(
            rule("CRITICAL", dd > 0.40, "Fall from the peak of ", _pct(dd), " exceeds 40%"),
            rule("CRITICAL", es99 > 0.10, "Mean loss on the worst 1% of days of ", _pct(es99), " exceeds 10%"),
            rule("HIGH", dd > 0.20, "Fall from the peak of ", _pct(dd), " exceeds 20%"),
            rule("HIGH", es95 > 0.05, "Mean loss on the worst 5% of days of ", _pct(es95), " exceeds 5%"),
            rule("HIGH", conc > 0.60, "Three assets carry ", _pct(conc), " of the risk"),
            rule("MODERATE", vol > 0.15, "Yearly deviation of ", _pct(vol), " exceeds 15%"),
            rule("MODERATE", es95 > 0.02, "Mean loss on the worst 5% of days of ", _pct(es95), " exceeds 2%"),
            rule("LOW", F.lit(True), "No limit is reached"),
        )
    )
    return metrics.withColumn("classification", label).withColumn("drivers", drivers).withColumn("methodology_version", F.lit("v1.0"))


def portfolio_assessment(returns: DataFrame, weights: DataFrame, x: str = "daily_return") -> DataFrame:
    m = portfolio_metrics(returns, weights, 0.95, x)
    conc = concentration(attribution(covariance(returns, weights, x), weights))
    es99 = historical(portfolio_returns(returns, weights, x), ["portfolio"], "portfolio_return", 0.99).select("portfolio", F.col("cvar").alias("cvar_99"))
    return classify(m.join(conc, "portfolio").join(es99, "portfolio"))
