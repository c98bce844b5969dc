"""Isotonic fits in ranges against the serial one."""

import numpy as np
import pandas as pd
import pytest

from marketloom.operators import isotonic as I
from marketloom.operators import models as M


def serial(x, y):
    g = pd.DataFrame({"x": x, "y": y}).groupby("x")["y"].agg(["sum", "count"]).reset_index()
    return I.pool(g["x"].to_numpy(), g["x"].to_numpy(), g["sum"].to_numpy(float), g["count"].to_numpy(float))


def test_pool_is_the_least_squares_step_function():
    rng = np.random.default_rng(0)
    for _ in range(50):
        y = rng.integers(0, 5, 8).astype(float)
        blocks = I.pool(np.arange(8.0), np.arange(8.0), y, np.ones(8))
        fit = np.concatenate([[t / w] * int(w) for _, _, t, w in blocks])
        # min-max formula of isotonic regression
        want = [max(min(y[a : b + 1].mean() for b in range(i, 8)) for a in range(i + 1)) for i in range(8)]
        assert np.allclose(fit, want)


@pytest.mark.parametrize("kind", ["rising", "falling", "noise"])
def test_ranges_give_the_serial_fit(spark, kind):
    rng = np.random.default_rng(1)
    x = rng.random(3000).round(3)
    chance = {"rising": x, "falling": 1 - x, "noise": np.full(3000, 0.4)}[kind]
    y = (rng.random(3000) < chance).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"probability": x, "actual": y}))
    model = I.fit(df, "probability", "actual", rows_per_range=60)
    got = sorted((r.lo, r.hi, r.total, r.weight) for r in model.blocks.collect())
    assert np.allclose(got, serial(x, y))
    test = spark.createDataFrame(pd.DataFrame({"probability": [*rng.random(200), -1.0, 2.0, None], "n": range(203)}))
    out = model.predict(test, "probability").toPandas().set_index("n")
    at, v = np.array(got)[:, :2].ravel(), np.repeat(np.array(got)[:, 2] / np.array(got)[:, 3], 2)
    assert len(out) == 203 and np.isnan(out.loc[202, "calibrated"])
    assert np.allclose(out["calibrated"][:202].to_numpy(), np.interp(out["probability"][:202], at, v))


def test_calibrate_without_rows(spark):
    df = spark.createDataFrame([(0.2, 0), (0.7, 1)], "probability double, actual int")
    assert [r.calibrated for r in M.calibrate(df.where("false"), df).collect()] == [None, None]
    assert sorted(r.calibrated for r in M.calibrate(df, df).collect()) == [0.0, 1.0]
