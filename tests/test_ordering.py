"""Order statistics against brute force, with ranges so small that groups are cut many times."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.operators import ordering as O


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    hot = np.round(rng.normal(0, 1, 3000), 2)
    small = np.round(rng.exponential(1, 40), 1)
    pdf = pd.DataFrame({"g": ["hot"] * 3000 + ["small"] * 40 + ["same"] * 25, "x": np.concatenate([hot, small, np.full(25, 7.0)])})
    return pdf, spark.createDataFrame(pdf).repartition(5)


@pytest.mark.parametrize("rows_per_range", [7, 50, 1_000_000])
def test_ranks_match_pandas(data, rows_per_range):
    pdf, df = data
    got = O.positions(df, ["g"], "x", rows_per_range=rows_per_range).toPandas().set_index(["g", "x"])["avg_rank"]
    want = pdf.assign(r=pdf.groupby("g")["x"].rank()).drop_duplicates(["g", "x"]).set_index(["g", "x"])["r"]
    pd.testing.assert_series_equal(got.sort_index(), want.sort_index(), check_names=False)


@pytest.mark.parametrize("kw", [{"rows_per_range": 7}, {"bounded": True}, {}])
def test_quantiles_match_numpy(data, kw):
    pdf, df = data
    got = O.quantiles(df, ["g"], "x", {"a": 0.05, "m": 0.5, "z": 1.0}, **kw).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        assert got.loc[g].tolist() == pytest.approx(np.percentile(part["x"], [5, 50, 100]).tolist())


def test_running_totals_of_several_measures(data):
    pdf, df = data
    counts = df.groupBy("g", "x").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x") > 0).alias("p"))
    a = O.cumulative(counts, ["g"], "x", ["n", "p"], rows_per_range=9).orderBy("g", "x").toPandas()
    b = O.cumulative(counts, ["g"], "x", ["n", "p"], bounded=True).orderBy("g", "x").toPandas()
    pd.testing.assert_frame_equal(a, b)
