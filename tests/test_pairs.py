"""The pair kernel against pandas: gaps, ties, constants, blocks, thresholds, top k, time."""

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PythonException, SparkRuntimeException
from pyspark.sql import functions as F

from marketloom.operators import pairs as P
from marketloom.operators import stats as S


def panel(days=80, names="abcdefg", seed=5):
    rng = np.random.default_rng(seed)
    wide = pd.DataFrame(rng.normal(size=(days, len(names))), columns=list(names), index=pd.date_range("2020-01-01", periods=days).date)
    wide["b"] = wide["a"] * 0.7 + wide["b"]
    wide["c"] = wide["c"].round(0)  # ties
    wide["d"] = 1e8 + wide["d"] * 1e-3  # far from zero
    wide.iloc[::7, 1] = np.nan
    wide.iloc[:30, 4] = np.nan
    wide.iloc[5:70, 5] = 3.25  # constant over the days shared with g
    wide.iloc[:5, 6], wide.iloc[70:, 6] = np.nan, np.nan
    return wide


def long(spark, wide):
    return spark.createDataFrame(wide.reset_index(names="ts").melt("ts", var_name="symbol", value_name="log_return").dropna())


def expected(wide, a, b):
    both = wide[[a, b]].dropna()
    x, y = both[a].to_numpy(), both[b].to_numpy()
    n = len(both)
    if n < 2:
        return n, None, None, None
    cov = float(np.cov(x, y)[0, 1])
    if (x == x[0]).all() or (y == y[0]).all():
        return n, None, None, cov
    return n, float(np.corrcoef(x, y)[0, 1]), float(both.rank().corr().iloc[0, 1]), cov


@pytest.mark.parametrize("blocks", [None, 1, 3, 9])
def test_against_pandas(spark, blocks):
    wide = panel()
    got = {(r.a, r.b): r for r in P.pair_statistics(long(spark, wide), blocks=blocks, diagonal=True).collect()}
    names = sorted(wide.columns)
    assert sorted(got) == [(a, b) for i, a in enumerate(names) for b in names[i:]]
    for (a, b), r in got.items():
        wide_b = wide if a != b else wide.assign(**{"_": wide[a]})
        n, pearson, spearman, cov = expected(wide_b, a, b if a != b else "_")
        assert r.n == n and (r.pearson is None) == (pearson is None) and (r.spearman is None) == (spearman is None)
        if pearson is not None:
            assert r.pearson == pytest.approx(pearson, abs=1e-9) and r.spearman == pytest.approx(spearman, abs=1e-12)
        if cov is not None:
            assert r.cov == pytest.approx(cov, rel=1e-6, abs=1e-12)


def test_missing_values_and_short_overlaps(spark):
    rows = [("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, float("nan")), ("b", 2, 5.0), ("b", 3, float("inf")), ("c", 9, 1.0), ("d", 1, None), ("e", None, 1.0)]
    df = spark.createDataFrame(rows, "symbol string, ts int, log_return double")
    got = {(r.a, r.b): (r.n, r.pearson, r.cov) for r in P.pair_statistics(df).collect()}
    assert got == {("a", "b"): (1, None, None), ("a", "c"): (0, None, None), ("b", "c"): (0, None, None)}
    assert P.pair_statistics(df.where("false")).count() == 0
    with pytest.raises((PythonException, SparkRuntimeException), match="one row"):
        P.pair_statistics(df.unionByName(df)).collect()


def test_threshold_top_and_keys(spark):
    wide = panel(names="abcdefghijkl", seed=2)
    df = long(spark, wide)
    whole = P.pair_statistics(df).toPandas()
    ok = whole[whole["n"] >= 30].dropna(subset=["pearson"])
    some = P.pair_statistics(df, threshold=0.2, enough=30, blocks=3).toPandas()
    assert set(zip(some["a"], some["b"])) == set(zip(*ok[ok["pearson"].abs() >= 0.2][["a", "b"]].to_numpy().T))
    want = set()
    for s in wide.columns:
        mine = ok[(ok["a"] == s) | (ok["b"] == s)].assign(size=lambda d: -d["pearson"].abs(), other=lambda d: np.where(d["a"] == s, d["b"], d["a"]))
        want |= set(map(tuple, mine.sort_values(["size", "other"]).head(2)[["a", "b"]].to_numpy()))
    for blocks in (1, 4):
        best = P.pair_statistics(df, top=2, enough=30, blocks=blocks).toPandas()
        assert len(best) == len(want) and set(zip(best["a"], best["b"])) == want
    keyed = df.withColumn("k", F.lit("one")).unionByName(df.withColumn("k", F.lit("two")).withColumn("log_return", -F.col("log_return")))
    assert dict(P.pair_statistics(keyed, keys=("k",)).groupBy("k").count().collect()) == {"one": len(whole), "two": len(whole)}


def test_plan_runs_no_job_and_loops_over_no_pairs(spark):
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    P.pair_statistics(long(spark, panel()))
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before


def test_marks_pairs_with_few_days(spark):
    wide = panel(days=40)
    got = {(r.a, r.b): r for r in S.pairwise_correlations(long(spark, wide)).collect()}
    assert got["a", "e"].status == "Insufficient Data" and got["a", "e"].n == 10 and got["a", "e"].spearman_rho is None
    assert got["a", "b"].status == "OK"
