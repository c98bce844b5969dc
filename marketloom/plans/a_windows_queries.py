from pyspark.sql import functions as F

from marketloom.functions.expr import rnd
from marketloom.operators import windows as W
from marketloom.plans.registry import query
from marketloom.plans.sqlviews import MARKET, RETURNS, UNIVERSE, r, sql
from marketloom.sources import views as V


@query(
    "src_01",
    sql(
        MARKET,
        "SELECT symbol, CAST(ts AS VARCHAR) AS ts, open, high, low, close, volume FROM market_prices "
        "WHERE symbol IN ('ECONOMY', 'PROMO') AND ts >= DATE '1997-01-01'",
    ),
)
def src_01(spark, sf):
    df = V.market_prices(spark, sf)
    return df.where(F.col("symbol").isin("ECONOMY", "PROMO") & (F.col("ts") >= F.lit("1997-01-01").cast("date")))


@query("win_01", sql(RETURNS, f"SELECT symbol, CAST(ts AS VARCHAR) AS ts, {r('daily_return', 8)} AS daily_return FROM returns"))
def win_01(spark, sf):
    return V.returns(spark, sf).select("symbol", "ts", rnd("daily_return", 8).alias("daily_return"))


@query("win_02", sql(RETURNS, f"SELECT symbol, CAST(ts AS VARCHAR) AS ts, {r('log_return', 8)} AS log_return FROM returns"))
def win_02(spark, sf):
    return V.returns(spark, sf).select("symbol", "ts", rnd("log_return", 8).alias("log_return"))


@query(
    "win_03",
    sql(
        MARKET,
        f"""SELECT symbol, CAST(ts AS VARCHAR) AS ts,
  {r('avg(volume) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)')} AS rolling_7d_volume,
  {r('avg(volume) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)')} AS rolling_30d_volume
FROM market_prices""",
    ),
)
def win_03(spark, sf):
    df = W.add_rolling_volume(V.market_prices(spark, sf))
    return df.select("symbol", "ts", *[rnd(c).alias(c) for c in ("rolling_7d_volume", "rolling_30d_volume")])


@query(
    "win_04",
    sql(
        MARKET,
        f"""SELECT symbol, CAST(ts AS VARCHAR) AS ts, {r('close / max(close) OVER (PARTITION BY symbol ORDER BY ts) - 1', 8)} AS drawdown
FROM market_prices""",
    ),
)
def win_04(spark, sf):
    return W.add_drawdown(V.market_prices(spark, sf)).select("symbol", "ts", rnd("drawdown", 8).alias("drawdown"))


def _vol_sql(n):
    f = f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(log_return) {f} >= {n} THEN {r(f'stddev_samp(log_return) {f} * sqrt(252)', 8)} END AS volatility_{n}d"


@query(
    "win_05",
    sql(RETURNS, f"SELECT symbol, CAST(ts AS VARCHAR) AS ts, {', '.join(_vol_sql(n) for n in (20, 60, 252))} FROM returns"),
)
def win_05(spark, sf):
    df = W.add_rolling_volatility(V.returns(spark, sf), [20, 60, 252])
    return df.select("symbol", "ts", *[rnd(f"volatility_{n}d", 8).alias(f"volatility_{n}d") for n in (20, 60, 252)])


def _fwd_sql(h):
    f = f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    vol = f"CASE WHEN count(log_return) {f} >= {h} THEN {r(f'stddev_samp(log_return) {f}', 8)} END" if h > 1 else "CAST(NULL AS DOUBLE)"
    return f"CASE WHEN count(log_return) {f} >= {h} THEN {r(f'sum(log_return) {f}', 8)} END AS fwd_ret_{h}d, {vol} AS fwd_vol_{h}d"


@query("win_06", sql(RETURNS, f"SELECT symbol, CAST(ts AS VARCHAR) AS ts, {', '.join(_fwd_sql(h) for h in (1, 5, 20))} FROM returns"))
def win_06(spark, sf):
    df = W.add_forward_returns(V.returns(spark, sf), [1, 5, 20])
    cols = [f"fwd_{k}_{h}d" for h in (1, 5, 20) for k in ("ret", "vol")]
    return df.select("symbol", "ts", *[rnd(c, 8).alias(c) for c in cols])


EXPANDING = sql(
    RETURNS,
    """base AS (SELECT symbol, ts, close / lag(close, 60) OVER w - 1 AS ret_60d,
  CASE WHEN count(log_return) OVER f >= 60 THEN stddev_samp(log_return) OVER f * sqrt(252) END AS vol_60d
  FROM returns WINDOW w AS (PARTITION BY symbol ORDER BY ts), f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))""",
    f"""SELECT symbol, CAST(ts AS VARCHAR) AS ts, {r('quantile_cont(vol_60d, 0.5) OVER e', 8)} AS exp_med_vol,
  {r('quantile_cont(ret_60d, 0.5) OVER e', 8)} AS exp_med_ret
FROM base WINDOW e AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)""",
)


@query("win_07", EXPANDING)
def win_07(spark, sf):
    from marketloom.functions.expr import div, series

    df = W.add_rolling_volatility(V.returns(spark, sf), [60])
    df = df.withColumn("ret_60d", div("close", F.lag("close", 60).over(series("symbol", "ts"))) - 1)
    df = W.add_expanding_median(df, {"exp_med_vol": "volatility_60d", "exp_med_ret": "ret_60d"})
    return df.select("symbol", "ts", rnd("exp_med_vol", 8).alias("exp_med_vol"), rnd("exp_med_ret", 8).alias("exp_med_ret"))


@query(
    "win_08",
    sql(
        UNIVERSE,
        f"""SELECT symbol, CAST(ts AS VARCHAR) AS ts,
  {r('(rank() OVER (PARTITION BY ts ORDER BY close) + (count(*) OVER (PARTITION BY ts, close) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY ts)', 8)} AS pct
FROM universe_panel""",
    ),
)
def win_08(spark, sf):
    df = W.percent_rank(V.universe_panel(spark, sf), "ts", "close", "pct")
    return df.select("symbol", "ts", rnd("pct", 8).alias("pct"))


@query(
    "win_09",
    sql(
        MARKET,
        "SELECT symbol, CAST(ts AS VARCHAR) AS ts, lead(close, 5) OVER w AS close_lead_5, CAST(lead(ts, 5) OVER w AS VARCHAR) AS ts_lead_5 "
        "FROM market_prices WINDOW w AS (PARTITION BY symbol ORDER BY ts)",
    ),
)
def win_09(spark, sf):
    return W.add_leads(V.market_prices(spark, sf), 5, ["close", "ts"]).select("symbol", "ts", "close_lead_5", "ts_lead_5")


@query(
    "win_10",
    sql(
        MARKET,
        """SELECT symbol, CAST(ts AS VARCHAR) AS ts,
  last_value(CASE WHEN volume % 3 <> 0 THEN close END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS filled
FROM market_prices""",
    ),
)
def win_10(spark, sf):
    from marketloom.functions.expr import series

    df = V.market_prices(spark, sf).withColumn("gappy", F.when(F.col("volume") % 3 != 0, F.col("close")))
    return df.select("symbol", "ts", W.forward_fill("gappy", series("symbol", "ts")).alias("filled"))


@query(
    "win_11",
    sql(
        RETURNS,
        f"""SELECT symbol, CAST(ts AS VARCHAR) AS ts, {r('daily_return', 8)} AS daily_return, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(abs(daily_return), 10) DESC NULLS LAST, ts) AS rank FROM returns) WHERE rank <= 3""",
    ),
)
def win_11(spark, sf):
    order = [F.desc_nulls_last(F.round(F.abs("daily_return"), 10)), F.asc("ts")]
    df = W.top_k(V.returns(spark, sf), ["symbol"], order, 3)
    return df.select("symbol", "ts", rnd("daily_return", 8).alias("daily_return"), "rank")
