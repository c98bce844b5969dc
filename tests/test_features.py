import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.operators import features as X
from marketloom.operators import windows as W


def bars(spark, close, volume=None, symbol="A"):
    days = pd.date_range("2020-01-01", periods=len(close)).date
    pdf = pd.DataFrame({"symbol": symbol, "ts": days, "close": np.asarray(close, float), "volume": volume if volume is not None else range(1, len(close) + 1)})
    return spark.createDataFrame(pdf)


def test_technical_on_a_rising_series(spark):
    out = X.technical(bars(spark, np.arange(100, 360))).orderBy("ts").toPandas()
    assert out["ret_1d"].iloc[1] == pytest.approx(0.01)
    assert out["sma_20d"].iloc[:19].isna().all() and out["sma_20d"].iloc[19] == pytest.approx(109.5)
    assert out["dist_from_rolling_high_252d"].iloc[-1] == pytest.approx(0.0)
    assert out["mom_20d"].iloc[-1] == pytest.approx(20.0)


@pytest.mark.parametrize("n", [30, 700, 1800])
def test_ema_matches_pandas_across_blocks(spark, n):
    close = 100 + np.cumsum(np.random.default_rng(1).normal(size=n))
    out = X.ema(bars(spark, close)).orderBy("ts").toPandas()
    for span in (20, 50):
        want = pd.Series(close).ewm(span=span, adjust=False, min_periods=span).mean()
        np.testing.assert_allclose(out[f"ema_{span}d"].astype(float), want, rtol=1e-12)


def test_ema_over_gaps(spark):
    rng = np.random.default_rng(2)
    close = 100 + np.cumsum(rng.normal(size=3000))
    close[rng.random(3000) < 0.3] = np.nan
    close[:3] = close[40] = close[1000:2200] = np.nan
    frame = bars(spark, close).withColumn("close", F.when(~F.isnan("close"), F.col("close")))
    out = X.ema(frame).orderBy("ts").toPandas()
    for span in (20, 50):
        want = pd.Series(close).ewm(span=span, adjust=False, min_periods=span).mean()
        np.testing.assert_allclose(out[f"ema_{span}d"].astype(float), want, rtol=1e-11)


def test_obv_and_zero_volume(spark):
    out = X.volume(bars(spark, [10, 11, 10, 10], [5, 7, 0, 3])).orderBy("ts").toPandas()
    assert out["obv"].tolist() == [0, 7, 7, 7]
    assert pd.isna(out["vol_change_1d"].iloc[3])


def test_expanding_median(spark):
    df = bars(spark, [3, 1, 2, 10])
    out = W.add_expanding_median(df, {"m": "close"}).orderBy("ts").toPandas()
    assert out["m"].tolist() == [3, 2, 2, 2.5]


def test_cross_section_ties_and_small_universe(spark):
    d = dt.date
    rows = [(d(2020, 1, 1), s, v) for s, v in zip("abcd", [1.0, 2.0, 2.0, 4.0])] + [(d(2020, 1, 2), "a", 1.0), (d(2020, 1, 2), "b", None)]
    df = spark.createDataFrame(rows, "ts date, symbol string, x double")
    out = {(r.ts, r.symbol): (r.p, r.z) for r in X.cross_sectional_zscore(X.cross_sectional_percentile(df, "ts", {"p": "x"}, 4), "ts", {"z": "x"}, 4).collect()}
    assert [out[(d(2020, 1, 1), s)][0] for s in "abcd"] == [0.25, 0.625, 0.625, 1.0]
    assert out[(d(2020, 1, 2), "a")] == (None, None)
    assert out[(d(2020, 1, 1), "a")][1] == pytest.approx((1 - 2.25) / np.std([1, 2, 2, 4], ddof=1))


def test_fundamentals_guard_zero_and_map_tags(spark):
    d = dt.date
    rows = [("1", "us-gaap:Revenues", 0.0, d(2020, 3, 31), d(2020, 5, 1), "x1"), ("1", "us-gaap:NetIncomeLoss", 5.0, d(2020, 3, 31), d(2020, 5, 1), "x1"),
            ("1", "Assets", 100.0, d(2019, 12, 31), d(2020, 5, 1), "x1"), ("1", "Assets", 200.0, d(2020, 3, 31), d(2020, 5, 1), "x1"), ("1", "Nonsense", 1.0, d(2020, 3, 31), d(2020, 5, 1), "x1")]
    facts = spark.createDataFrame(rows, "cik string, concept string, value double, end_date date, filing_date date, accession_number string")
    r = X.fundamental(X.concept_panel(facts)).first()
    assert r.net_margin is None and r.roa == pytest.approx(0.025) and r.assets == 200.0
