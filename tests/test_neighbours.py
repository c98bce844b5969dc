"""Nearest-neighbour mutual information against the estimator written out, and against what is known of normal samples."""

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from marketloom.operators.neighbours import digamma, kth_distances, neighbour_information


def psi(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, int(n)))


def brute(x, y, k=3):
    x, y = (v / (v.std() or 1) for v in (np.asarray(x, float), np.asarray(y, float)))
    dx, dy = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    d = np.maximum(dx, dy)
    np.fill_diagonal(d, np.inf)
    r = np.sort(d, axis=1)[:, k - 1 : k]
    n = [np.where(r > 0, a < r, a == 0).sum(axis=1) for a in (dx, dy)]
    return max(0.0, psi(len(x)) + psi(k) - np.mean([psi(a) for a in n[0]]) - np.mean([psi(a) for a in n[1]]))


def test_digamma(spark):
    got = spark.range(1, 400).select("id", digamma(F.col("id")).alias("p")).collect()
    assert all(r.p == pytest.approx(psi(r.id), abs=1e-12) for r in got)


def test_kth_distances():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 60):
        x, y = rng.normal(size=n).round(1), rng.normal(size=n).round(1)
        d = np.maximum(np.abs(x[:, None] - x), np.abs(y[:, None] - y))
        np.fill_diagonal(d, np.inf)
        want = np.full((n, 4), np.inf)
        m = min(4, max(0, n - 1))
        want[:, :m] = np.sort(d, axis=1)[:, :m]
        assert np.array_equal(kth_distances(x, y, 4), want)


@pytest.mark.parametrize("cell", [16, 5000])
def test_against_the_estimator_written_out(spark, cell):
    rng = np.random.default_rng(3)
    n = 900
    t = rng.normal(size=n)
    frame = pd.DataFrame({"g": np.where(np.arange(n) % 3 == 0, "a", "b"), "t": t, "near": t + 0.3 * rng.normal(size=n), "none": rng.normal(size=n), "tied": np.round(t, 1), "flag": (t > 0).astype(float), "one": 1.0, "heavy": rng.standard_cauchy(n)})
    frame.loc[::50, "near"] = np.nan
    frame.loc[7, "heavy"] = np.inf
    features = ["near", "none", "tied", "flag", "one", "heavy"]
    df = spark.createDataFrame(frame)
    got = {(r.g, r.feature): (r.n, r.mutual_information) for r in neighbour_information(df, features, "t", ["g"], cell=cell).collect()}
    for (g, f), (count, mi) in got.items():
        part = frame[(frame["g"] == g) & np.isfinite(frame[f])]
        # On a grid of tenths, equal differences round differently with the last digit of the deviation.
        assert count == len(part) and mi == pytest.approx(brute(part[f], part["t"]), abs=0.02 if f == "tied" else 1e-9), (g, f)
    assert len(got) == 12


def test_known_information(spark):
    """For normal columns with correlation c the information is -ln(1 - c^2) / 2."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=6000)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": 0.8 * x + 0.6 * rng.normal(size=6000), "z": rng.normal(size=6000)}))
    got = {r.feature: r.mutual_information for r in neighbour_information(df, ["x", "z"], "y", cell=200).collect()}
    assert got["x"] == pytest.approx(-0.5 * np.log(1 - 0.64), abs=0.04) and got["z"] < 0.03


def test_few_rows_copies_and_none(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0)] * 3 + [("b", float(i % 2), float(i % 2)) for i in range(40)] + [("c", None, 1.0)], "g string, x double, y double")
    got = {r.g: (r.n, r.mutual_information) for r in neighbour_information(df, ["x"], "y", ["g"]).collect()}
    x = np.arange(40) % 2
    assert got["a"] == (3, None) and got["b"][1] == pytest.approx(brute(x, x)) and "c" not in got
    assert neighbour_information(df.where("false"), ["x"], "y").count() == 0
