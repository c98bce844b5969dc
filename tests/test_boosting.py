"""Leaf-wise boosting against the same algorithm written out row by row, and on data with known structure."""

import heapq

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.operators import boosting as B


def sample(n=1500, seed=1):
    rng = np.random.default_rng(seed)
    x = pd.DataFrame({"a": rng.normal(size=n), "b": rng.integers(0, 5, n).astype(float), "c": rng.normal(size=n)})
    x["y"] = np.where(x["a"] > 0, 3.0, 0.0) + x["b"] * (x["c"] > 0.5) + 0.1 * rng.normal(size=n)
    x.loc[::17, "a"] = np.nan
    x["k"] = (x["y"] > x["y"].median()).astype(float)
    return x


def brute_tree(bins, g, h, p):
    """Best-first tree over arrays; leaf value per row."""

    def split(rows, depth):
        best = (0.0, None)
        if p.max_depth is not None and depth >= p.max_depth:
            return best
        worth = lambda r: g[r].sum() ** 2 / h[r].sum()
        for f in range(bins.shape[1]):
            for b in np.unique(bins[rows, f])[:-1]:
                left, right = rows[bins[rows, f] <= b], rows[bins[rows, f] > b]
                if min(len(left), len(right)) >= p.min_rows and min(h[left].sum(), h[right].sum()) >= p.min_curvature:
                    gain = (worth(left) + worth(right) - worth(rows)) / 2
                    if gain > best[0] + 1e-9:
                        best = (gain, (left, right))
        return best

    heap, count, ends = [], 0, []

    def push(rows, depth):
        nonlocal count
        gain, parts = split(rows, depth)
        if parts:
            heapq.heappush(heap, (-gain, count, rows, parts, depth))
            count += 1
        else:
            ends.append(rows)

    push(np.arange(len(g)), 0)
    while heap and len(heap) + len(ends) < p.num_leaves:
        _, _, _, parts, depth = heapq.heappop(heap)
        for part in parts:
            push(part, depth + 1)
    out = np.empty(len(g))
    for rows in [*ends, *[x[2] for x in heap]]:
        out[rows] = -g[rows].sum() / h[rows].sum()
    return out


@pytest.mark.parametrize(("objective", "label", "depth"), [("squared", "y", None), ("logistic", "k", 3)])
def test_trees_are_those_written_out(spark, objective, label, depth):
    x = sample()
    p = B.Boosting(objective=objective, n_estimators=3, num_leaves=9, max_depth=depth, learning_rate=0.3, bins=16)
    model = B.fit(spark.createDataFrame(x), ["a", "b", "c"], label, p, track=True)
    bins = np.stack([B._bins_of(x[f].to_numpy(), np.array(c)) for f, c in zip("abc", model.cuts)], axis=1)
    y = x[label].to_numpy()
    s = np.full(len(x), model.base)
    for tree in model.trees:
        chance = 1 / (1 + np.exp(-s))
        g, h = (s - y, np.ones(len(y))) if objective == "squared" else (chance - y, chance * (1 - chance))
        want = brute_tree(bins, g, h, p) * 0.3
        assert len(tree.leaves) <= 9
        assert np.allclose(tree.predict(bins), want, atol=1e-9)
        s = s + want
    assert np.allclose(model.scores(x), s)
    assert all(b < a for a, b in zip(model.losses, model.losses[1:])) and len(model.losses) == 4
    out = model.transform(spark.createDataFrame(x)).toPandas()
    assert np.allclose(out["prediction"] if objective == "squared" else np.log(out["probability"] / (1 - out["probability"])), s, atol=1e-6)


def test_subsample_missing_and_empty(spark):
    x = sample(600)
    df = spark.createDataFrame(x)
    p = B.Boosting(n_estimators=10, num_leaves=4, subsample=0.5, learning_rate=0.3)
    one, two = (B.fit(df.coalesce(1), ["a", "b", "c"], "y", p, track=True) for _ in range(2))
    assert [t.leaves for t in one.trees] == [t.leaves for t in two.trees] and one.losses[-1] < 0.3 * one.losses[0]
    assert B.fit(df.where("false"), ["a"], "y").transform(df).agg(F.max("prediction")).first()[0] == 0.0
    flat = B.fit(df.withColumn("y", F.lit(2.0)), ["a"], "y")
    assert flat.trees == [] and flat.base == 2.0
    assert all(not t.inner for t in B.fit(df.withColumn("a", F.lit(None).cast("double")), ["a"], "y", p).trees)


def test_histogram_sums(spark):
    x = sample(400)
    rows, cuts = B.binned(spark.createDataFrame(x), ["a", "b"], "y", 8)
    got = B.histograms(rows.withColumns({"g": F.col("y"), "h": F.lit(1.0)}), F.lit(0), [0]).toPandas()
    for i, f in enumerate("ab"):
        want = x.groupby(B._bins_of(x[f].to_numpy(), np.array(cuts[i])))["y"].agg(["sum", "count"])
        part = got[got["feature"] == i].set_index("bin").sort_index()
        assert np.allclose(part["gradient"], want["sum"]) and part["n"].tolist() == want["count"].tolist()
