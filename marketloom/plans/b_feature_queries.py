from pyspark.sql import functions as F

from marketloom.functions.expr import rnd
from marketloom.operators import features as X
from marketloom.operators.joins import benchmark_join, macro_levels, risk_free_join
from marketloom.plans.registry import query
from marketloom.plans.sqlviews import FACTS, MACRO, MARKET, RETURNS, UNIVERSE, r, sql
from marketloom.sources import views as V

KEYS = "symbol, CAST(ts AS VARCHAR) AS ts"
ORDER = "PARTITION BY symbol ORDER BY ts"


def frame(n: int) -> str:
    return f"({ORDER} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def gate(x: str, n: int, value: str, digits: int = 8) -> str:
    return f"CASE WHEN count({x}) OVER {frame(n)} >= {n} THEN {r(value, digits)} END"


def out(df, cols, digits=8, keys=("symbol", "ts")):
    return df.select(*keys, *[rnd(c, digits).alias(c) for c in cols])


def market_sql(*exprs, table="market_prices", ctes=(MARKET,)):
    return sql(*ctes, f"SELECT {KEYS}, {', '.join(exprs)} FROM {table}")


def lag(n, c="close"):
    return f"lag({c}, {n}) OVER ({ORDER})"


RET = (1, 5, 20, 60, 120, 252)


@query("feat_01", market_sql(*[f"{r(f'close / {lag(n)} - 1', 8)} AS ret_{n}d" for n in RET]))
def feat_01(spark, sf):
    return out(X.technical(V.market_prices(spark, sf)), [f"ret_{n}d" for n in RET])


@query("feat_02", market_sql(*[f"{r(f'ln(close / {lag(n)})', 8)} AS log_ret_{n}d" for n in (1, 5, 20)]))
def feat_02(spark, sf):
    return out(X.technical(V.market_prices(spark, sf)), [f"log_ret_{n}d" for n in (1, 5, 20)])


@query("feat_03", market_sql(*[f"{gate('close', n, f'avg(close) OVER {frame(n)}', 6)} AS sma_{n}d" for n in (20, 50, 100, 200)]))
def feat_03(spark, sf):
    return out(X.technical(V.market_prices(spark, sf)), [f"sma_{n}d" for n in (20, 50, 100, 200)], 6)


def _ema_sql(n):
    a, q = 2.0 / (n + 1), 1 - 2.0 / (n + 1)
    return f"CASE WHEN n.i >= {n - 1} THEN {r(f'sum(power({q!r}::DOUBLE, n.i - m.i) * CASE WHEN m.i = 0 THEN m.close ELSE {a!r}::DOUBLE * m.close END)')} END AS ema_{n}d"


@query(
    "feat_04",
    sql(
        MARKET,
        "num AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM market_prices)",
        f"SELECT n.symbol, CAST(n.ts AS VARCHAR) AS ts, {_ema_sql(20)}, {_ema_sql(50)} "
        "FROM num n JOIN num m ON n.symbol = m.symbol AND m.i <= n.i GROUP BY n.symbol, n.ts, n.i",
    ),
)
def feat_04(spark, sf):
    return out(X.ema(V.market_prices(spark, sf)), ["ema_20d", "ema_50d"], 6)


@query("feat_05", market_sql(*[f"{gate('close', n, f'close / avg(close) OVER {frame(n)}')} AS price_to_sma_{n}d" for n in (20, 50, 200)]))
def feat_05(spark, sf):
    return out(X.technical(V.market_prices(spark, sf)), [f"price_to_sma_{n}d" for n in (20, 50, 200)])


@query(
    "feat_06",
    market_sql(
        f"{gate('close', 252, f'close / max(close) OVER {frame(252)} - 1')} AS dist_from_rolling_high_252d",
        f"{gate('close', 252, f'close / min(close) OVER {frame(252)} - 1')} AS dist_from_rolling_low_252d",
    ),
)
def feat_06(spark, sf):
    return out(X.technical(V.market_prices(spark, sf)), ["dist_from_rolling_high_252d", "dist_from_rolling_low_252d"])


@query("feat_07", market_sql(*[f"close - {lag(n)} AS mom_{n}d" for n in (20, 60, 120)]))
def feat_07(spark, sf):
    return X.technical(V.market_prices(spark, sf)).select("symbol", "ts", *[f"mom_{n}d" for n in (20, 60, 120)])


def ret_sql(*exprs, extra=(), table="returns"):
    return market_sql(*exprs, table=table, ctes=(RETURNS, *extra))


@query(
    "feat_08",
    ret_sql(*[f"{gate('log_return', n, f'stddev_samp(log_return) OVER {frame(n)} * sqrt(252)')} AS vol_{n}d" for n in (20, 60, 120, 252)]),
)
def feat_08(spark, sf):
    return out(X.volatility(V.returns(spark, sf)), [f"vol_{n}d" for n in (20, 60, 120, 252)])


@query("feat_09", ret_sql(f"{gate('log_return', 252, f'stddev_samp(CASE WHEN log_return < 0 THEN log_return WHEN log_return >= 0 THEN 0 END) OVER {frame(252)} * sqrt(252)')} AS downside_vol_252d"))
def feat_09(spark, sf):
    return out(X.volatility(V.returns(spark, sf)), ["downside_vol_252d"])


@query(
    "feat_10",
    market_sql(
        f"{gate('dd', 252, f'min(dd) OVER {frame(252)}')} AS max_drawdown_252d",
        table="dds",
        ctes=(MARKET, f"dds AS (SELECT symbol, ts, CASE WHEN count(close) OVER {frame(252)} >= 252 THEN close / max(close) OVER {frame(252)} - 1 END AS dd FROM market_prices)"),
    ),
)
def feat_10(spark, sf):
    return out(X.volatility(V.returns(spark, sf)), ["max_drawdown_252d"])


RATE = """rate AS (SELECT realtime_start AS rs, value / 1e6::DOUBLE / 100 / 252 AS rfr_daily,
  row_number() OVER (PARTITION BY realtime_start ORDER BY observation_date DESC) AS k FROM macro_obs WHERE series_id = '1-URGENT'),
excess AS (SELECT a.symbol, a.ts, a.log_return, b.rfr_daily, a.log_return - b.rfr_daily AS ex
  FROM returns a ASOF LEFT JOIN (SELECT * FROM rate WHERE k = 1) b ON a.ts >= b.rs)"""


def rate_table(spark, sf):
    """Annual percent of the first series, scaled down to a plausible rate."""
    m = V.macro_obs(spark, sf).where(F.col("series_id") == "1-URGENT")
    return m.select("observation_date", "realtime_start", (F.col("value") / 1e6).alias("value"))


@query(
    "feat_11",
    ret_sql(
        f"{gate('ex', 252, f'sqrt(252) * avg(ex) OVER {frame(252)} / nullif(stddev_samp(ex) OVER {frame(252)}, 0)', 6)} AS sharpe_252d",
        f"{gate('ex', 252, f'sqrt(252) * avg(ex) OVER {frame(252)} / nullif(stddev_samp(CASE WHEN ex < 0 THEN ex WHEN ex >= 0 THEN 0 END) OVER {frame(252)}, 0)', 6)} AS sortino_252d",
        extra=(MACRO, RATE),
        table="excess",
    ),
)
def feat_11(spark, sf):
    df = risk_free_join(V.returns(spark, sf), rate_table(spark, sf))
    return out(X.risk_ratios(df), ["sharpe_252d", "sortino_252d"], 6)


BENCH = """paired AS (SELECT a.symbol, a.ts, a.log_return, b.log_return AS benchmark_return,
  CASE WHEN a.log_return IS NOT NULL AND b.log_return IS NOT NULL THEN 1 END AS pair
  FROM returns a LEFT JOIN returns b ON a.ts = b.ts AND b.symbol = 'ECONOMY')"""


@query(
    "feat_12",
    ret_sql(
        f"CASE WHEN count(pair) OVER {frame(252)} >= 252 AND count(benchmark_return) OVER {frame(252)} >= 252 THEN "
        + r(f"covar_samp(log_return, benchmark_return) OVER {frame(252)} / nullif(var_samp(benchmark_return) OVER {frame(252)}, 0)")
        + " END AS beta_252d",
        f"{gate('pair', 252, f'corr(log_return, benchmark_return) OVER {frame(252)}', 6)} AS correlation_252d",
        extra=(BENCH,),
        table="paired",
    ),
)
def feat_12(spark, sf):
    df = benchmark_join(V.returns(spark, sf), V.BENCHMARK)
    return out(X.benchmark_ratios(df), ["beta_252d", "correlation_252d"], 6)


@query(
    "feat_13",
    ret_sql(
        f"{gate('log_return', 252, f'quantile_cont(log_return, 0.05) OVER {frame(252)}')} AS var_95_252d",
        "CASE WHEN var IS NOT NULL THEN " + r("list_avg(list_filter(tail, lambda v: v < var))", 8) + " END AS cvar_95_252d",
        extra=(f"tails AS (SELECT *, CASE WHEN count(log_return) OVER {frame(252)} >= 252 THEN quantile_cont(log_return, 0.05) OVER {frame(252)} END AS var, list(log_return) OVER {frame(252)} AS tail FROM returns)",),
        table="tails",
    ),
)
def feat_13(spark, sf):
    return out(X.tail_risk(V.returns(spark, sf)), ["var_95_252d", "cvar_95_252d"])


@query("feat_14", market_sql(f"{r(f'volume / nullif(CAST(lag(volume) OVER ({ORDER}) AS DOUBLE), 0) - 1', 8)} AS vol_change_1d"))
def feat_14(spark, sf):
    return out(X.volume(V.market_prices(spark, sf)), ["vol_change_1d"])


VOLUME_COLS = [
    f"{gate('volume', 20, f'avg(volume) OVER {frame(20)}', 6)} AS vol_sma_20d",
    f"{gate('volume', 50, f'avg(volume) OVER {frame(50)}', 6)} AS vol_sma_50d",
    f"{gate('volume', 20, f'stddev_samp(volume) OVER {frame(20)}', 6)} AS vol_std_20d",
]


@query("feat_15", market_sql(*VOLUME_COLS))
def feat_15(spark, sf):
    return out(X.volume(V.market_prices(spark, sf)), ["vol_sma_20d", "vol_sma_50d", "vol_std_20d"], 6)


@query(
    "feat_16",
    market_sql(
        f"{gate('volume', 20, f'(volume - avg(volume) OVER {frame(20)}) / nullif(stddev_samp(volume) OVER {frame(20)}, 0)', 6)} AS vol_zscore_20d",
        f"{gate('volume', 20, f'volume / nullif(avg(volume) OVER {frame(20)}, 0)', 6)} AS vol_ratio_20d",
    ),
)
def feat_16(spark, sf):
    return out(X.volume(V.market_prices(spark, sf)), ["vol_zscore_20d", "vol_ratio_20d"], 6)


@query(
    "feat_17",
    sql(
        MARKET,
        f"signed AS (SELECT symbol, ts, volume * coalesce(sign(close - {lag(1)}), 0) AS v FROM market_prices)",
        f"SELECT {KEYS}, CAST(sum(v) OVER ({ORDER} ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS obv FROM signed",
    ),
)
def feat_17(spark, sf):
    return out(X.volume(V.market_prices(spark, sf)), ["obv"], 6)


CONCEPTS = """panel AS (SELECT cik, filing_date,
  max(CASE WHEN concept = 'us-gaap:Revenues' THEN value END) AS revenue, max(CASE WHEN concept = 'us-gaap:NetIncomeLoss' THEN value END) AS net_income,
  max(CASE WHEN concept = 'us-gaap:OperatingIncomeLoss' THEN value END) AS operating_income, max(CASE WHEN concept = 'us-gaap:Assets' THEN value END) AS assets,
  max(CASE WHEN concept = 'us-gaap:Liabilities' THEN value END) AS liabilities, max(CASE WHEN concept = 'us-gaap:StockholdersEquity' THEN value END) AS equity
  FROM filing_facts GROUP BY 1, 2)"""
PANEL_KEYS = "cik, CAST(filing_date AS VARCHAR) AS filing_date"


def panel_sql(*exprs):
    return sql(FACTS, CONCEPTS, f"SELECT {PANEL_KEYS}, {', '.join(exprs)} FROM panel")


@query(
    "feat_18",
    panel_sql(
        *[
            r(f"{c} / nullif(lag({c}, 4) OVER (PARTITION BY cik ORDER BY filing_date), 0) - 1") + f" AS {o}"
            for c, o in (("revenue", "revenue_growth_yoy"), ("net_income", "net_income_growth_yoy"), ("assets", "asset_growth_yoy"))
        ]
    ),
)
def feat_18(spark, sf):
    df = X.fundamental(X.concept_panel(V.filing_facts(spark, sf)))
    return out(df, ["revenue_growth_yoy", "net_income_growth_yoy", "asset_growth_yoy"], 6, ("cik", "filing_date"))


RATIOS = {
    "operating_margin": "operating_income / nullif(revenue, 0)",
    "net_margin": "net_income / nullif(revenue, 0)",
    "roa": "net_income / nullif(assets, 0)",
    "roe": "net_income / nullif(equity, 0)",
    "asset_turnover": "revenue / nullif(assets, 0)",
    "debt_to_equity": "liabilities / nullif(equity, 0)",
    "debt_to_assets": "liabilities / nullif(assets, 0)",
}


@query("feat_19", panel_sql(*[f"{r(e)} AS {o}" for o, e in RATIOS.items()]))
def feat_19(spark, sf):
    df = X.fundamental(X.concept_panel(V.filing_facts(spark, sf)))
    return out(df, list(RATIOS), 6, ("cik", "filing_date"))


@query(
    "feat_20",
    sql(
        FACTS,
        """SELECT concept, CASE concept WHEN 'us-gaap:Revenues' THEN 'revenue' WHEN 'us-gaap:NetIncomeLoss' THEN 'net_income'
    WHEN 'us-gaap:OperatingIncomeLoss' THEN 'operating_income' WHEN 'us-gaap:Assets' THEN 'assets' WHEN 'us-gaap:Liabilities' THEN 'liabilities'
    WHEN 'us-gaap:StockholdersEquity' THEN 'equity' ELSE 'unknown' END AS standard_concept,
  CASE concept WHEN 'us-gaap:Revenues' THEN 'Revenue' WHEN 'us-gaap:NetIncomeLoss' THEN 'Net Income'
    WHEN 'us-gaap:OperatingIncomeLoss' THEN 'Operating Income' WHEN 'us-gaap:Assets' THEN 'Total Assets' WHEN 'us-gaap:Liabilities' THEN 'Total Liabilities'
    WHEN 'us-gaap:StockholdersEquity' THEN 'Shareholders'' Equity' ELSE 'Unknown' END AS metric, count(*) AS n
FROM filing_facts GROUP BY 1, 2, 3""",
    ),
)
def feat_20(spark, sf):
    df = V.filing_facts(spark, sf).groupBy("concept").agg(F.count(F.lit(1)).alias("n"))
    return df.select("concept", X.standard_concept("concept").alias("standard_concept"), X.warehouse_metric("concept").alias("metric"), "n")


SERIES = {"1-URGENT": "fedfunds_level", "2-HIGH": "cpi_level", "3-MEDIUM": "unrate_level", "4-NOT SPECIFIED": "gs10_level"}
LEVELS = (
    "days AS (SELECT DISTINCT ts FROM market_prices),\nvintage AS (SELECT series_id, realtime_start AS rs, max_by(value, observation_date) AS value FROM macro_obs GROUP BY 1, 2),\n"
    + ",\n".join(
        f"lv{i} AS (SELECT d.ts, v.value FROM days d ASOF LEFT JOIN (SELECT * FROM vintage WHERE series_id = '{s}') v ON d.ts >= v.rs)"
        for i, s in enumerate(SERIES)
    )
    + ",\naligned AS (SELECT p.symbol, p.ts, lv0.value AS fedfunds_level, lv1.value AS cpi_level, lv2.value AS unrate_level, lv3.value AS gs10_level "
    + "FROM market_prices p JOIN lv0 ON p.ts = lv0.ts JOIN lv1 ON p.ts = lv1.ts JOIN lv2 ON p.ts = lv2.ts JOIN lv3 ON p.ts = lv3.ts)"
)
MACRO_CTES = (MARKET, MACRO, LEVELS)


def aligned(spark, sf):
    return macro_levels(V.market_prices(spark, sf), V.macro_obs(spark, sf), SERIES)


@query("feat_21", market_sql(*SERIES.values(), table="aligned", ctes=MACRO_CTES))
def feat_21(spark, sf):
    return aligned(spark, sf).select("symbol", "ts", *SERIES.values())


@query(
    "feat_22",
    market_sql(
        f"{r(f'cpi_level / nullif(lag(cpi_level, 21) OVER ({ORDER}), 0) - 1', 8)} AS cpi_change_1m",
        f"{r('cpi_level / nullif(lag(cpi_level, 252) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1', 8)} AS cpi_change_12m",
        f"{r('unrate_level - lag(unrate_level, 63) OVER (PARTITION BY symbol ORDER BY ts)', 4)} AS unrate_change_3m",
        table="aligned",
        ctes=MACRO_CTES,
    ),
)
def feat_22(spark, sf):
    df = X.macro(aligned(spark, sf))
    return df.select("symbol", "ts", rnd("cpi_change_1m", 8).alias("cpi_change_1m"), rnd("cpi_change_12m", 8).alias("cpi_change_12m"), rnd("unrate_change_3m", 4).alias("unrate_change_3m"))


@query("feat_23", market_sql(f"{r('gs10_level - fedfunds_level', 4)} AS spread_10y_ff", table="aligned", ctes=MACRO_CTES))
def feat_23(spark, sf):
    return out(X.macro(aligned(spark, sf)), ["spread_10y_ff"], 4)


@query(
    "feat_24",
    market_sql(
        f"{gate('c', 252, f'stddev_samp(c) OVER {frame(252)}')} AS cpi_volatility_12m",
        table="chg",
        ctes=(*MACRO_CTES, f"chg AS (SELECT symbol, ts, cpi_level / nullif(lag(cpi_level, 21) OVER ({ORDER}), 0) - 1 AS c FROM aligned)"),
    ),
)
def feat_24(spark, sf):
    return out(X.macro(aligned(spark, sf)), ["cpi_volatility_12m"])


PANEL = """fx AS (SELECT symbol, ts, round(close / lag(close, 21) OVER w - 1, 10) AS ret_1m,
  CASE WHEN count(lr) OVER f >= 20 THEN round(stddev_samp(lr) OVER f * sqrt(252), 10) END AS vol_20d, round(volume / close, 10) AS debt_to_equity
  FROM (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS lr FROM universe_panel)
  WINDOW w AS (PARTITION BY symbol ORDER BY ts), f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""


def feature_panel(spark, sf):
    from marketloom.functions.expr import div, series
    from marketloom.operators.windows import add_returns

    w = series("symbol", "ts")
    df = X.volatility(add_returns(V.universe_panel(spark, sf)))
    return df.select(
        "symbol",
        "ts",
        F.round(div("close", F.lag("close", 21).over(w)) - 1, 10).alias("ret_1m"),
        F.round("vol_20d", 10).alias("vol_20d"),
        F.round(div("volume", "close"), 10).alias("debt_to_equity"),
    )


def _pct(x):
    return (
        f"CASE WHEN {x} IS NOT NULL AND count({x}) OVER (PARTITION BY ts) >= 10 THEN "
        + r(f"(rank() OVER (PARTITION BY ts ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY ts, {x}) - 1) / 2.0::DOUBLE) / count({x}) OVER (PARTITION BY ts)", 8)
        + " END"
    )


@query(
    "feat_25",
    sql(
        UNIVERSE,
        PANEL,
        f"SELECT {KEYS}, {_pct('ret_1m')} AS return_1m_percentile, {_pct('vol_20d')} AS volatility_20d_percentile, {_pct('debt_to_equity')} AS debt_to_equity_percentile FROM fx",
    ),
)
def feat_25(spark, sf):
    cols = {"return_1m_percentile": "ret_1m", "volatility_20d_percentile": "vol_20d", "debt_to_equity_percentile": "debt_to_equity"}
    return out(X.cross_sectional_percentile(feature_panel(spark, sf), "ts", cols), list(cols))


def _z(x):
    p = "(PARTITION BY ts)"
    return f"CASE WHEN count({x}) OVER {p} >= 10 THEN " + r(f"({x} - avg({x}) OVER {p}) / nullif(stddev_samp({x}) OVER {p}, 0)") + " END"


@query("feat_26", sql(UNIVERSE, PANEL, f"SELECT {KEYS}, {_z('ret_1m')} AS return_1m_zscore, {_z('debt_to_equity')} AS operating_margin_zscore FROM fx"))
def feat_26(spark, sf):
    cols = {"return_1m_zscore": "ret_1m", "operating_margin_zscore": "debt_to_equity"}
    return out(X.cross_sectional_zscore(feature_panel(spark, sf), "ts", cols), list(cols), 6)
