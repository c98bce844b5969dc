"""Folds from sums of products against fits on the rows, and the Parzen sampler."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.operators import additive as D
from marketloom.operators import models as M
from marketloom.operators import sampler as P


def frame(n=600, seed=0):
    rng = np.random.default_rng(seed)
    x = pd.DataFrame({"a": rng.normal(5, 2, n), "b": rng.normal(size=n), "c": rng.normal(size=n), "flat": 1.0})
    x["c"] += x["a"]
    x["y"] = 2 * x["a"] - x["b"] + rng.normal(size=n) + 4
    x["t"] = np.arange(n) % 60
    x.loc[::9, "b"] = np.nan
    return x


def design(sums, fill):
    """Rows as the fits see them, from the pandas frame."""
    x = sums.fillna(dict(zip(["a", "b", "c"], fill)))[["a", "b", "c"]].to_numpy()
    return (x - x.mean(axis=0)) / x.std(axis=0, ddof=1), sums["y"].to_numpy()


@pytest.mark.parametrize("name", ["linear_regression", "ridge", "lasso", "elastic_net"])
def test_fits_equal_those_on_rows(spark, name):
    x = frame()
    features, kept = ["a", "b", "c"], (x["t"] < 10) | (x["t"] >= 40)
    sums = D.sums_of_products(spark.createDataFrame(x), features, "y", "t", [(10, False), (20, False), (39, True)])
    fill = D.medians(spark.createDataFrame(x), features, (F.col("t") < 10) | (F.col("t") >= 40))
    assert np.allclose(fill, x[kept][features].median())
    model = D.fit_named(name, D.filled(sums.over([0, 3]), fill), 0.1)
    z, y = design(x[kept], fill)
    l1, l2 = D.PENALTIES[name](len(y), 0.1)
    b = model.coefficients * x[kept][features].fillna(dict(zip(features, fill))).std().to_numpy()
    slope = z.T @ (y - y.mean() - z @ b) / len(y) - l2 * b
    # At the minimum the slope is l1 towards the sign of a coefficient, and within l1 where it is 0.
    assert np.allclose(slope[b != 0], l1 * np.sign(b[b != 0]), atol=1e-8) and (np.abs(slope[b == 0]) <= l1 + 1e-8).all()
    test = x[(x["t"] >= 20) & (x["t"] < 40)]
    guess = model.intercept + test[features].fillna(dict(zip(features, fill))).to_numpy() @ model.coefficients
    assert model.squared_error(D.filled(sums.over([2]), fill)) == pytest.approx(((test["y"] - guess) ** 2).sum())


@pytest.mark.parametrize("name", ["linear_regression", "lasso"])
def test_folds_equal_walk_forward_on_rows(spark, name):
    x = frame()
    x["t"] = pd.Timestamp("2020-01-01") + pd.to_timedelta(x["t"], unit="D")
    x["t"] = x["t"].dt.date
    df = spark.createDataFrame(x)
    rows = M.regression_metrics(M.walk_forward(df, name, ["a", "b", "c"], "y", "t", 20, 15, 2, alpha=0.05), ["fold"], "y").orderBy("fold").toPandas()
    sums = M.walk_forward_linear(df, name, ["a", "b", "c"], "y", "t", 20, 15, 2, alpha=0.05).orderBy("fold").toPandas()
    assert len(rows) > 1 and sums["fold"].tolist() == rows["fold"].tolist() and sums["n"].tolist() == rows["n"].tolist()
    assert np.allclose(sums["RMSE"], rows["RMSE"], atol=1e-3) and np.allclose(sums["R2"], rows["R2"], atol=1e-3)


def test_least_squares_of_numpy_constants_and_empty(spark):
    x = frame().dropna()
    df = spark.createDataFrame(x)
    sums = D.sums_of_products(df, ["a", "flat", "c"], "y", "t", [])
    got = D.fit(D.filled(sums.over([0]), [0, 0, 0]))
    want = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x["a"], x["c"]]), x["y"], rcond=None)[0]
    assert np.allclose([got.intercept, *got.coefficients[[0, 2]]], want) and got.coefficients[1] == 0
    assert D.fit(D.filled(sums.over([7]), [0, 0, 0])) is None
    assert D.sums_of_products(df.where("false"), ["a"], "y", "t", [(3, False)]).blocks == {}


def test_sampler_beats_even_draws():
    space = {"x": (0.0, 10.0, False), "r": (1e-4, 1.0, True), "n": (1, 50, False)}

    def loss(p):
        return (p["x"] - 7) ** 2 + (np.log10(p["r"]) + 2) ** 2 + ((p["n"] - 20) / 10) ** 2

    wins = 0
    for seed in range(8):
        trials = P.minimise(space, loss, 60, seed)
        assert trials == P.minimise(space, loss, 60, seed)
        assert all(0 <= p["x"] <= 10 and 1e-4 <= p["r"] <= 1 and isinstance(p["n"], int) and 1 <= p["n"] <= 50 for p, _ in trials)
        even = P.minimise(space, loss, 60, seed, startup=60)
        assert even[:10] == trials[:10]
        wins += min(v for _, v in trials) < min(v for _, v in even)
    assert wins >= 7
    assert P.minimise(space, lambda p: float("nan"), 12, 1)[-1][0].keys() == space.keys()
