"""Feature families. Each function adds columns; unused ones are pruned by the optimizer.

Windows run over one symbol's daily bars (or one company's filings), which the calendar bounds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.expr import TRADING_DAYS, div, gated, last_n, series, so_far
from marketloom.operators.ordering import positions

# Accounting concepts and the filing tags that feed them.
CONCEPT_TAGS = {
    "revenue": ["Revenues", "SalesRevenueNet", "RevenuesNetOfInterestExpense", "SalesRevenueServicesNet"],
    "net_income": ["NetIncomeLoss", "ProfitLoss"],
    "operating_income": ["OperatingIncomeLoss"],
    "assets": ["Assets"],
    "liabilities": ["Liabilities", "LiabilitiesCurrent"],
    "equity": ["StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"],
}
# Warehouse metric names and the prefixed tags that feed them.
METRIC_TAGS = {
    "Revenue": ["us-gaap:Revenues", "us-gaap:SalesRevenueNet", "us-gaap:SalesRevenueGoodsNet"],
    "Net Income": ["us-gaap:NetIncomeLoss"],
    "Operating Income": ["us-gaap:OperatingIncomeLoss"],
    "Total Assets": ["us-gaap:Assets"],
    "Total Liabilities": ["us-gaap:Liabilities"],
    "Cash and Cash Equivalents": ["us-gaap:CashAndCashEquivalentsAtCarryingValue", "us-gaap:Cash"],
    "Long-Term Debt": ["us-gaap:LongTermDebt", "us-gaap:LongTermDebtNoncurrent"],
    "Shareholders' Equity": [
        "us-gaap:StockholdersEquity",
        "us-gaap:StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest",
    ],
}
ANNUAL = float(TRADING_DAYS) ** 0.5
EMA_DECAY = 60.0  # a block of rows ends where weights have fallen by exp(-60)


def _ema(df: DataFrame, n: int, by: str, ts: str, price: str) -> DataFrame:
    """Exponential average with span n, seeded with the first price, without a row-by-row loop.

    The average before an observation counts q^g against a, with g rows since the observation before; rows without a price
    carry the average on, and it is given from the n-th price on. As a weighted sum, a price's weight falls with the decay
    summed up after it. Blocks are cut by that decay, so that exponents stay small, and what lies before the latest earlier
    block has vanished.
    """
    if n < 2:
        raise ValueError("a span has at least two rows")
    a = 2.0 / (n + 1.0)
    q = 1.0 - a
    w = series(by, ts)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    seen = F.col(price).isNotNull()
    df = df.withColumn("_rn", F.row_number().over(w)).withColumn("_n", F.count(price).over(so_far(w)))
    df = df.withColumn("_gap", F.col("_rn") - F.last(F.when(seen, F.col("_rn")), ignorenulls=True).over(past))
    total = F.pow(F.lit(q), F.col("_gap")) + a
    unit = -math.log(q)  # the decay of an observation after a gap of one; what others have beyond it is summed up apart
    more = F.when(seen & (F.col("_gap") > 1), (F.col("_gap") - 1) * unit + F.ln(total))
    df = df.withColumn("_more", F.coalesce(F.sum(more).over(so_far(w)), F.lit(0.0)))
    df = df.withColumn("_blk", F.floor((F.col("_n") * unit + F.col("_more")) / EMA_DECAY))
    blocks = Window.partitionBy(by, "_blk").orderBy("_rn")

    def since(n0: Column, more0: Column) -> Column:
        return (F.col("_n") - n0) * unit + (F.col("_more") - more0)

    df = df.withColumn("_in", since(F.first("_n").over(blocks), F.first("_more").over(blocks)))
    weight = F.when(F.col("_gap").isNull(), F.lit(1.0)).when(F.col("_gap") == 1, F.lit(a)).otherwise(a / total)
    df = df.withColumn("_local", F.sum(weight * F.col(price) * F.exp("_in")).over(so_far(blocks)) * F.exp(-F.col("_in")))
    df = df.withColumn("_end", F.when(F.lead("_blk").over(w) != F.col("_blk"), F.struct("_local", "_n", "_more")))
    df = df.withColumn("_end", F.last("_end", ignorenulls=True).over(past))
    before = F.col("_end._local") * F.exp(-since(F.col("_end._n"), F.col("_end._more")))
    value = F.col("_local") + F.coalesce(before, F.lit(0.0))
    return df.withColumn(f"ema_{n}d", F.when(F.col("_n") >= n, value)).drop("_rn", "_n", "_gap", "_more", "_blk", "_in", "_local", "_end")


def technical(df: DataFrame, by: str = "symbol", ts: str = "ts", price: str = "close") -> DataFrame:
    w = series(by, ts)
    p = F.col(price)
    lag = lambda n: F.lag(price, n).over(w)
    cols: dict[str, Column] = {}
    for n in (1, 5, 20, 60, 120, 252):
        cols[f"ret_{n}d"] = div(p, lag(n)) - 1
    for n in (1, 5, 20):
        cols[f"log_ret_{n}d"] = F.ln(div(p, lag(n)))
    for n in (20, 50, 100, 200):
        cols[f"sma_{n}d"] = gated(F.avg(price).over(last_n(w, n)), price, last_n(w, n), n)
    for n in (20, 50, 200):
        cols[f"price_to_sma_{n}d"] = div(p, gated(F.avg(price).over(last_n(w, n)), price, last_n(w, n), n))
    year = last_n(w, TRADING_DAYS)
    cols["dist_from_rolling_high_252d"] = gated(div(p, F.max(price).over(year)) - 1, price, year, TRADING_DAYS)
    cols["dist_from_rolling_low_252d"] = gated(div(p, F.min(price).over(year)) - 1, price, year, TRADING_DAYS)
    for n in (20, 60, 120):
        cols[f"mom_{n}d"] = p - lag(n)
    return df.withColumns(cols)


def ema(df: DataFrame, spans: tuple[int, ...] = (20, 50), by: str = "symbol", ts: str = "ts", price: str = "close") -> DataFrame:
    for n in spans:
        df = _ema(df, n, by, ts, price)
    return df


def volatility(df: DataFrame, by: str = "symbol", ts: str = "ts", x: str = "log_return", price: str = "close") -> DataFrame:
    """vol_*, downside_vol_252d and max_drawdown_252d; needs `log_return`."""
    w = series(by, ts)
    year = last_n(w, TRADING_DAYS)
    down = F.when(F.col(x).isNotNull(), F.least(F.col(x), F.lit(0.0)))
    cols = {f"vol_{n}d": gated(F.stddev_samp(x).over(last_n(w, n)) * ANNUAL, x, last_n(w, n), n) for n in (20, 60, 120, 252)}
    cols["downside_vol_252d"] = gated(F.stddev_samp(down).over(year) * ANNUAL, x, year, TRADING_DAYS)
    peak = gated(F.max(price).over(year), price, year, TRADING_DAYS)
    df = df.withColumns(cols).withColumn("_dd", div(price, peak) - 1)
    return df.withColumn("max_drawdown_252d", gated(F.min("_dd").over(year), "_dd", year, TRADING_DAYS)).drop("_dd")


def risk_ratios(df: DataFrame, by: str = "symbol", ts: str = "ts", x: str = "log_return", rate: str = "rfr_daily") -> DataFrame:
    """sharpe_252d and sortino_252d on returns above the daily risk-free rate."""
    w = series(by, ts)
    year = last_n(w, TRADING_DAYS)
    df = df.withColumn("_ex", F.col(x) - F.col(rate))
    down = F.when(F.col("_ex").isNotNull(), F.least(F.col("_ex"), F.lit(0.0)))
    mean = F.avg("_ex").over(year) * float(TRADING_DAYS)
    return df.withColumns(
        {
            "sharpe_252d": gated(div(mean, F.stddev_samp("_ex").over(year) * ANNUAL), "_ex", year, TRADING_DAYS),
            "sortino_252d": gated(div(mean, F.stddev_samp(down).over(year) * ANNUAL), "_ex", year, TRADING_DAYS),
        }
    ).drop("_ex")


def benchmark_ratios(df: DataFrame, by: str = "symbol", ts: str = "ts", x: str = "log_return", b: str = "benchmark_return") -> DataFrame:
    """beta_252d divides the pair-complete covariance by the variance of every benchmark row."""
    w = series(by, ts)
    year = last_n(w, TRADING_DAYS)
    pair = F.when(F.col(x).isNotNull() & F.col(b).isNotNull(), F.lit(1))
    var = gated(F.var_samp(b).over(year), b, year, TRADING_DAYS)
    return df.withColumns(
        {
            "beta_252d": gated(div(F.covar_samp(x, b).over(year), var), pair, year, TRADING_DAYS),
            "correlation_252d": gated(F.corr(x, b).over(year), pair, year, TRADING_DAYS),
        }
    )


def tail_risk(df: DataFrame, by: str = "symbol", ts: str = "ts", x: str = "log_return") -> DataFrame:
    """var_95_252d and cvar_95_252d (mean of returns strictly below that quantile)."""
    year = last_n(series(by, ts), TRADING_DAYS)
    df = df.withColumn("var_95_252d", gated(F.percentile(x, 0.05).over(year), x, year, TRADING_DAYS))
    tail = F.filter(F.collect_list(x).over(year), lambda v: v < F.col("var_95_252d"))
    total = F.aggregate("_tail", F.lit(0.0), lambda s, v: s + v)
    df = df.withColumn("_tail", F.when(F.col("var_95_252d").isNotNull(), tail))
    return df.withColumn("cvar_95_252d", div(total, F.size("_tail").cast("double"))).drop("_tail")


def volume(df: DataFrame, by: str = "symbol", ts: str = "ts", price: str = "close", vol: str = "volume") -> DataFrame:
    w = series(by, ts)
    v = F.col(vol).cast("double")
    df = df.withColumns(
        {
            "vol_change_1d": div(v, F.lag(vol).over(w)) - 1,
            "vol_sma_20d": gated(F.avg(vol).over(last_n(w, 20)), vol, last_n(w, 20), 20),
            "vol_sma_50d": gated(F.avg(vol).over(last_n(w, 50)), vol, last_n(w, 50), 50),
            "vol_std_20d": gated(F.stddev_samp(vol).over(last_n(w, 20)), vol, last_n(w, 20), 20),
            "_signed": v * F.coalesce(F.signum(F.col(price) - F.lag(price).over(w)), F.lit(0.0)),
        }
    )
    return df.withColumns(
        {
            "vol_zscore_20d": div(v - F.col("vol_sma_20d"), "vol_std_20d"),
            "vol_ratio_20d": div(v, "vol_sma_20d"),
            "obv": F.sum("_signed").over(so_far(w)),
        }
    ).drop("_signed")


def tag_map(groups: dict[str, list[str]], tag: Column) -> Column:
    """Name of the first group listing the tag: a literal map, looked up inside codegen."""
    pairs = [F.lit(x) for name, tags in groups.items() for t in tags for x in (t, name)]
    return F.element_at(F.create_map(*pairs), tag)


def standard_concept(tag: str) -> Column:
    return F.coalesce(tag_map(CONCEPT_TAGS, F.regexp_replace(tag, "^us-gaap:", "")), F.lit("unknown"))


def warehouse_metric(tag: str) -> Column:
    return F.coalesce(tag_map(METRIC_TAGS, F.col(tag)), F.lit("Unknown"))


def concept_panel(facts: DataFrame, by: str = "cik", filed: str = "filing_date") -> DataFrame:
    """One row per company and filing date: the latest non-null value of every concept."""
    known = facts.withColumn("_c", standard_concept("concept")).where(F.col("value").isNotNull())
    latest = F.max_by("value", F.struct("end_date", "accession_number"))
    return known.groupBy(by, filed).pivot("_c", list(CONCEPT_TAGS)).agg(latest)


def fundamental(panel: DataFrame, by: str = "cik", filed: str = "filing_date") -> DataFrame:
    w = series(by, filed)
    growth = lambda c: div(c, F.lag(c, 4).over(w)) - 1
    return panel.withColumns(
        {
            "revenue_growth_yoy": growth("revenue"),
            "net_income_growth_yoy": growth("net_income"),
            "asset_growth_yoy": growth("assets"),
            "operating_margin": div("operating_income", "revenue"),
            "net_margin": div("net_income", "revenue"),
            "roa": div("net_income", "assets"),
            "roe": div("net_income", "equity"),
            "asset_turnover": div("revenue", "assets"),
            "debt_to_equity": div("liabilities", "equity"),
            "debt_to_assets": div("liabilities", "assets"),
        }
    )


def macro(aligned: DataFrame, by: str = "symbol", ts: str = "ts") -> DataFrame:
    """Changes and spreads on the daily aligned levels (fedfunds, cpi, unrate, gs10 `_level` columns)."""
    w = series(by, ts)
    lag = lambda c, n: F.lag(c, n).over(w)
    df = aligned.withColumns(
        {
            "cpi_change_1m": div("cpi_level", lag("cpi_level", 21)) - 1,
            "cpi_change_12m": div("cpi_level", lag("cpi_level", 252)) - 1,
            "unrate_change_3m": F.col("unrate_level") - lag("unrate_level", 63),
            "spread_10y_ff": F.col("gs10_level") - F.col("fedfunds_level"),
        }
    )
    year = last_n(w, TRADING_DAYS)
    return df.withColumn("cpi_volatility_12m", gated(F.stddev_samp("cpi_change_1m").over(year), "cpi_change_1m", year, TRADING_DAYS))


def cross_sectional_percentile(
    df: DataFrame, by: str, cols: dict[str, str], min_universe: int = 10, key: str = "symbol"
) -> DataFrame:
    """Average-tie percent rank per date; null while the date has too few values.

    All columns are ranked in one pass over (date, column, value) counts.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(o).alias("_c"), F.col(x).alias("_x")) for o, x in cols.items()]))
    long = df.select(by, key, pairs.alias("s")).select(by, key, "s.*").where(F.col("_x").isNotNull())
    pct = F.when(F.col("n_total") >= min_universe, F.col("avg_rank") / F.col("n_total"))
    ranks = positions(long, [by, "_c"], "_x").select(by, "_c", "_x", pct.alias("_pct"))
    wide = long.join(ranks, [by, "_c", "_x"]).groupBy(by, key).agg(*[F.max(F.when(F.col("_c") == o, F.col("_pct"))).alias(o) for o in cols])
    return df.join(wide, [by, key], "left")


def cross_sectional_zscore(df: DataFrame, by: str, cols: dict[str, str], min_universe: int = 10) -> DataFrame:
    """(x - mean) / std per date. Dates are aggregated (map-side) and joined back, never sorted whole."""
    aggs = []
    for out, x in cols.items():
        aggs += [F.count(x).alias(f"_{out}_n"), F.avg(x).alias(f"_{out}_m"), F.stddev_samp(x).alias(f"_{out}_s")]
    df = df.join(df.groupBy(by).agg(*aggs), by, "left")
    for out, x in cols.items():
        df = df.withColumn(out, F.when(F.col(f"_{out}_n") >= min_universe, div(F.col(x) - F.col(f"_{out}_m"), f"_{out}_s")))
    return df.drop(*[f"_{out}_{k}" for out in cols for k in "nms"])
