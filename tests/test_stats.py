import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.functions.distributions import beta_cdf, f_tail, normal_tail, t_two_sided
from marketloom.operators import relations as L
from marketloom.operators import stats as S


def test_published_critical_values(spark):
    df = spark.createDataFrame([(2.228139, 10.0, 3.098391, 3.0, 20.0, 1.959964)], "t double, nu double, f double, a double, b double, z double")
    r = df.select(t_two_sided("t", "nu").alias("t"), f_tail("f", "a", "b").alias("f"), normal_tail("z").alias("z")).first()
    assert r.t == pytest.approx(0.05, abs=1e-6) and r.f == pytest.approx(0.05, abs=1e-6) and r.z == pytest.approx(0.025, abs=1e-7)


def test_beta_is_symmetric_and_exact_for_uniform():
    x = np.linspace(0.01, 0.99, 50)
    np.testing.assert_allclose(beta_cdf(x, np.ones(50), np.ones(50)), x, rtol=1e-12)
    np.testing.assert_allclose(beta_cdf(x, np.full(50, 2.5), np.full(50, 4.0)), 1 - beta_cdf(1 - x, np.full(50, 4.0), np.full(50, 2.5)), rtol=1e-10)


def samples(spark, a, b):
    return spark.createDataFrame(pd.DataFrame({"k": 1, "s": ["A"] * len(a) + ["B"] * len(b), "x": np.concatenate([a, b])}))


def test_shapiro_separates_normal_from_exponential(spark):
    rng = np.random.default_rng(42)
    df = samples(spark, rng.normal(size=200), rng.exponential(size=200))
    r = {row.s: row for row in S.shapiro_wilk(df, ["s"], "x").collect()}
    assert r["A"].w_p > 0.05 and r["A"].w_stat > 0.98 and r["B"].w_p < 1e-6 and 0 < r["B"].w_stat < 0.95


def test_shapiro_published_example(spark):
    # weights of 11 men in pounds (Shapiro and Wilk 1965) extended by one value keeps n above the small-sample rule
    x = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236, 165]
    r = S.shapiro_wilk(samples(spark, x, []), ["k"], "x").first()
    assert 0.7 < r.w_stat < 0.9 and r.w_p < 0.05


def test_test_selection(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(0, 1, 100)
    same = S.two_sample(samples(spark, base, rng.normal(0, 1, 100)), ["k"], "s", "x").first()
    wide = S.two_sample(samples(spark, base, rng.normal(0, 5, 100)), ["k"], "s", "x").first()
    skew = S.two_sample(samples(spark, base, rng.exponential(1, 100)), ["k"], "s", "x").first()
    assert same.test_used.startswith("Student") and wide.test_used.startswith("Welch") and skew.test_used.startswith("Mann")
    assert skew.is_statistically_significant and skew.is_economically_significant and skew.effect_size_value < 0
    assert S.two_sample(samples(spark, base[:10], base), ["k"], "s", "x").count() == 0


def test_mann_whitney_counts_pairs(spark):
    a, b = [1.0, 2.0, 2.0, 5.0], [2.0, 3.0, 0.5]
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    r = S.mann_whitney(samples(spark, a, b), ["k"], "s", "x").first()
    assert r.u_stat == u and r.cliffs_delta == pytest.approx(2 * u / 12 - 1)


def test_returns_profile_of_four_days(spark):
    pdf = pd.DataFrame({"symbol": "A", "ts": pd.date_range("2020-01-01", periods=4).date, "close": [100.0, 110.0, 99.0, 99.0]})
    from marketloom.operators.windows import add_returns

    r = S.profile(add_returns(spark.createDataFrame(pdf))).first()
    assert r.cumulative_return == pytest.approx(-0.01) and r.max_drawdown == pytest.approx(-0.1) and r.max_drawdown_duration_obs == 1
    assert r.current_regime is None


def test_outlier_class(spark):
    x = np.random.default_rng(0).normal(0, 0.01, 51)
    x[25] = 0.5
    out = S.outliers(spark.createDataFrame(pd.DataFrame({"g": "a", "i": range(51), "x": x})), ["g"], "x").toPandas().set_index("i")
    assert out.loc[25, "outlier_class"] == "extreme"


@pytest.mark.parametrize("blocks", [1, 3])
def test_pairs_match_pandas_for_any_blocking(spark, blocks):
    rng = np.random.default_rng(5)
    wide = pd.DataFrame(rng.normal(size=(60, 5)), columns=list("abcde"), index=pd.date_range("2020-01-01", periods=60).date)
    wide.iloc[::7, 1] = np.nan
    long = wide.reset_index(names="ts").melt("ts", var_name="symbol", value_name="log_return").dropna()
    got = S.pair_statistics(spark.createDataFrame(long), blocks=blocks).toPandas().set_index(["a", "b"])
    assert len(got) == 10
    for (a, b), row in got.iterrows():
        assert row["pearson"] == pytest.approx(wide[a].corr(wide[b])) and row["spearman"] == pytest.approx(wide[[a, b]].dropna().rank().corr().iloc[0, 1])
        assert row["cov"] == pytest.approx(wide[a].cov(wide[b]))


def test_benjamini_hochberg_is_monotone(spark):
    p = [0.01, 0.04, 0.03, 0.2, 0.9]
    out = L.benjamini_hochberg(spark.createDataFrame([("f", x) for x in p], "fam string, p_value double"), ["fam"]).orderBy("p_value").toPandas()
    assert out["adjusted_p_value"].tolist() == pytest.approx([0.05, 0.2 / 3, 0.2 / 3, 0.25, 0.9])


def test_finding_text(spark):
    df = spark.createDataFrame([(0.2, 0.1), (0.001, -0.7), (None, 0.0)], "p double, c double")
    texts = [r.t for r in df.select(L.finding_text(F.lit("x"), F.col("p"), F.col("c")).alias("t")).collect()]
    assert "beyond chance" in texts[0] and "negative, strong" in texts[1] and texts[2].startswith("Too little")
    assert not math.isnan(len(texts))


def test_shapiro_wilk_of_few_values(spark):
    rng = np.random.default_rng(5)
    rows = [(n * 10_000 + k, float(v)) for n in range(3, 14) for k in range(1500) for v in rng.normal(size=n)]
    out = S.shapiro_wilk(spark.createDataFrame(pd.DataFrame(rows, columns=["g", "x"])), ["g"], "x").toPandas()
    assert len(out) == 11 * 1500 and out["w_stat"].between(0, 1).all()
    for _, p in out.groupby("n")["w_p"]:  # under the hypothesis p is uniform
        assert abs(p.mean() - 0.5) < 0.04 and abs((p < 0.1).mean() - 0.1) < 0.04
    odd = spark.createDataFrame(pd.DataFrame([(1, 2.0), (1, 3.0)] + [(2, 7.0)] * 5 + [(3, v) for v in (0.0, 0.0, 9.0)] + [(4, float(v)) for v in range(30)], columns=["g", "x"]))
    got = S.shapiro_wilk(odd, ["g"], "x", limit=30).toPandas().set_index("g")
    assert got["n"].to_dict() == {1: 2, 2: 5, 3: 3, 4: 30} and got.loc[[1, 2, 4], ["w_stat", "w_p"]].isna().all(axis=None)
    assert abs(got.loc[3, "w_stat"] - 0.75) < 1e-9 and got.loc[3, "w_p"] < 1e-4
