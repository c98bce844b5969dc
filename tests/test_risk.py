import numpy as np
import pandas as pd
import pytest

from marketloom.operators import risk as R


def wealth(spark, values):
    return spark.createDataFrame(pd.DataFrame({"p": "x", "ts": pd.date_range("2020-01-01", periods=len(values)).date, "w": values}))


def test_recovery_after_eight_days_and_never(spark):
    up = R.recovery_of_wealth(wealth(spark, [1.0, 0.9, 0.8, 0.8, 0.8, 0.85, 0.9, 0.95, 1.05, 1.1]), ["p"], "ts", "w").first()
    down = R.recovery_of_wealth(wealth(spark, [1.0, 0.9, 0.8, 0.7, 0.6]), ["p"], "ts", "w").first()
    assert up.recovery_trading_days == 8 and down.recovery_trading_days == -1


def two_assets(spark):
    rng = np.random.default_rng(1)
    days = pd.date_range("2020-01-01", periods=100).date
    pdf = pd.concat([pd.DataFrame({"symbol": s, "ts": days, "daily_return": rng.normal(0, sd, 100)}) for s, sd in (("A", 0.01), ("B", 0.03))])
    w = spark.createDataFrame([("p", "A", 0.5), ("p", "B", 0.5)], "portfolio string, symbol string, weight double")
    return pdf, spark.createDataFrame(pdf), w


def test_contributions_add_up_to_volatility(spark):
    pdf, rets, w = two_assets(spark)
    cov = R.covariance(rets, w)
    vol = R.portfolio_volatility(cov, w).first().daily_volatility
    attr = R.attribution(cov, w).toPandas().set_index("symbol")
    assert attr["ccr"].sum() == pytest.approx(vol) and attr["pcr"].sum() == pytest.approx(1.0) and attr.loc["B", "pcr"] > 0.8
    wide = pdf.pivot(index="ts", columns="symbol", values="daily_return")
    assert vol == pytest.approx((wide.mean(axis=1)).std())


def test_weights_are_checked(spark):
    _, rets, w = two_assets(spark)
    bad = w.unionByName(spark.createDataFrame([("q", "A", 0.7), ("r", "Z", 1.0)], w.schema))
    assert {r.portfolio: r.status for r in R.check_weights(bad, rets).collect()} == {"p": "OK", "q": "BAD_WEIGHTS", "r": "MISSING_ASSETS"}


def test_missing_asset_nulls_the_day(spark):
    _, rets, w = two_assets(spark)
    first = rets.agg({"ts": "min"}).first()[0]
    gap = rets.where(~((rets.symbol == "A") & (rets.ts == first)))
    out = R.portfolio_returns(gap, w).orderBy("ts").collect()
    assert out[0].portfolio_return is None and out[1].portfolio_return is not None


def test_classes(spark):
    rows = [("crit", 0.45, 0.0, 0.0, 0.0, 0.0), ("es99", 0.0, 0.12, 0.0, 0.0, 0.0), ("high", 0.25, 0.0, 0.0, 0.0, 0.0), ("conc", 0.0, 0.0, 0.0, 0.1, 0.7), ("mod", 0.0, 0.0, 0.03, 0.2, 0.0), ("low", 0.01, 0.0, 0.0, 0.05, None)]
    df = spark.createDataFrame(rows, "id string, max_drawdown double, cvar_99 double, historical_cvar double, annualized_volatility double, top_3_risk_concentration double")
    out = {r.id: (r.classification, len(r.drivers)) for r in R.classify(df).collect()}
    assert out == {"crit": ("CRITICAL", 1), "es99": ("CRITICAL", 1), "high": ("HIGH", 1), "conc": ("HIGH", 1), "mod": ("MODERATE", 2), "low": ("LOW", 1)}


def test_total_loss_stays_lost(spark):
    df = spark.createDataFrame(pd.DataFrame({"p": "x", "ts": pd.date_range("2020-01-01", periods=3).date, "r": [0.1, -1.0, 0.5]}))
    assert R.max_drawdown(df, ["p"], "ts", "r").first().max_drawdown == -1.0


def test_parametric_needs_thirty(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(10)], "g string, x double")
    assert R.parametric(df, ["g"], "x").count() == 0
    with pytest.raises(ValueError):
        R.risk_metrics(df, ["g"], "x", method="guess")


def test_refused_portfolios(spark):
    returns = spark.createDataFrame([("A", 1, 0.1), ("B", 1, 0.2)], "symbol string, ts int, daily_return double")
    good = spark.createDataFrame([("p", "A", 0.5), ("p", "B", 0.505)], "portfolio string, symbol string, weight double")
    assert R.portfolio_returns(returns, good).count() == 1
    for bad, word in (([("p", "A", 0.5), ("p", "B", 0.6)], "BAD_WEIGHTS"), ([("p", "A", 0.5), ("p", "C", 0.5)], "MISSING_ASSETS")):
        with pytest.raises(Exception, match=f"Portfolio p refused: {word}"):
            R.portfolio_returns(returns, spark.createDataFrame(bad, good.schema)).collect()
