"""Mutual information of continuous columns by nearest neighbours (Kraskov, Stoegbauer and Grassberger, first estimator).

With both columns scaled to deviation 1, r is a point's distance (the larger of the two differences) to its k-th neighbour, and
n_x and n_y count the points closer than r in one column alone, itself included. The information is
digamma(n) + digamma(k) - mean(digamma(n_x) + digamma(n_y)), at least 0.

Points are dealt into cells: ranges of x at approximate quantiles, and ranges of y inside each. A cell gives every point its k
nearest there, which bounds r; only points whose bound reaches over the cell's border ask the cells it reaches. For the counts a
column is dealt into sorted ranges: ranges that lie inside (x - r, x + r) enter by a running total, the two at its ends count their
values. Equal points are one with a weight. Cuts only route points: results are exact, and no task sees a whole column.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.session import materialize

#: Cuts per column at most; a cell's size grows beyond (rows / CUTS ** 2).
CUTS = 256
_FUZZ = 1e-9


def digamma(n: Column) -> Column:
    """For whole numbers from 1 on, to about 1e-13."""
    z = n.cast("double") + 12
    tail = 1 / (12 * z**2) - 1 / (120 * z**4) + 1 / (252 * z**6) - 1 / (240 * z**8)
    return F.ln(z) - 1 / (2 * z) - tail - sum(1 / (n + i) for i in range(12))


def kth_distances(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """The k least Chebyshev distances of every point to the others, ascending, inf where there are fewer.

    Along x, neighbours at growing rank distance are looked at until their difference in x alone is not less than the k-th best.
    """
    n = len(x)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    best = np.full((n, k), np.inf)
    for sign in (1, -1):
        live, step = np.arange(n), 0
        while len(live):
            step += 1
            other = live + sign * step
            ok = (other >= 0) & (other < n)
            live, other = live[ok], other[ok]
            dx = np.abs(x[other] - x[live])
            near = dx < best[live, -1]
            live, other, dx = live[near], other[near], dx[near]
            d = np.maximum(dx, np.abs(y[other] - y[live]))
            better = d < best[live, -1]
            at = live[better]
            best[at, -1] = d[better]
            best[at] = np.sort(best[at], axis=1)
    out = np.empty_like(best)
    out[order] = best
    return out


def _least(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, k: int) -> np.ndarray:
    """The k least distances from points (px, py) to those of a cell."""
    out = np.full((len(px), k), np.inf)
    rows = max(1, 4_000_000 // max(1, len(x)))
    for a in range(0, len(px), rows):
        d = np.maximum(np.abs(px[a : a + rows, None] - x), np.abs(py[a : a + rows, None] - y))
        m = min(k, d.shape[1])
        if m:
            out[a : a + rows, :m] = np.sort(np.partition(d, m - 1, axis=1)[:, :m], axis=1)
    return out


def _closer(values: np.ndarray, weights: np.ndarray, at: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Total weight of the sorted values v with |v - at| < r (= at, where r is 0)."""

    def hit(i: np.ndarray) -> np.ndarray:
        gap = np.abs(values[np.clip(i, 0, len(values) - 1)] - at)
        return np.where(r > 0, gap < r, gap == 0)

    slack = _FUZZ * (np.abs(at) + r)
    lo, hi = np.searchsorted(values, at - r - slack, "left"), np.searchsorted(values, at + r + slack, "right")
    while True:
        off = (lo < hi) & ~hit(lo)
        if not off.any():
            break
        lo = lo + off
    while True:
        off = (lo < hi) & ~hit(hi - 1)
        if not off.any():
            break
        hi = hi - off
    total = np.concatenate([[0], np.cumsum(weights)])
    return total[np.maximum(hi, lo)] - total[lo]


def _cuts(rows: DataFrame, by: Sequence[str], value: str, pieces, name: str) -> DataFrame:
    """Per group the ascending values that deal its n rows into about `pieces(n)` ranges, at most CUTS."""
    found = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx(value, [i / CUTS for i in range(1, CUTS)], 20 * CUTS).alias("_grid"))
    found = found.withColumn("_pieces", F.least(F.lit(CUTS), F.ceil(pieces(F.col("_n")))).cast("int"))
    inner = F.filter(F.sequence(F.lit(1), F.col("_pieces")), lambda i: i < F.col("_pieces"))
    place = lambda i: F.greatest(F.floor(i * CUTS / F.col("_pieces")) - 1, F.lit(0)).cast("int")
    return found.select(*by, F.array_distinct(F.transform(inner, lambda i: F.get("_grid", place(i)))).alias(name))


def _at(value: Column, cuts: str) -> Column:
    """Number of the range: how many cuts are not above the value."""
    return F.size(F.filter(cuts, lambda c: c <= value))


def neighbour_information(df: DataFrame, features: Sequence[str], target: str, by: Sequence[str] = (), k: int = 3, cell: int = 1024) -> DataFrame:
    """by, feature, n and the mutual information (nats) of each feature with the target, over rows where both are finite.

    Groups of at most k rows have none (null). Values that tie are counted as they are, without noise.
    """
    keys = [*by, "feature"]
    long = df.select(*by, F.col(target).cast("double").alias("y"), *[F.col(f).cast("double").alias(f) for f in features])
    long = long.unpivot([*by, "y"], list(features), "feature", "x")
    for c in ("x", "y"):
        long = long.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    scale = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.stddev_pop(c).alias(f"_s{c}") for c in "xy"])
    points = long.groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("w")).join(scale, keys)
    points = points.select(*keys, "n", "w", *[(F.col(c) / F.when(F.col(f"_s{c}") > 0, F.col(f"_s{c}")).otherwise(1.0)).alias(c) for c in "xy"])
    points = materialize(points, "points")

    # Cells, each with its borders.
    columns = materialize(_cuts(points, keys, "x", lambda n: F.sqrt(n / cell), "_cx"), "cuts")
    placed = points.join(columns, keys).withColumn("_i", _at(F.col("x"), "_cx"))
    rows = materialize(_cuts(placed, [*keys, "_i"], "y", lambda n: n / cell, "_cy"), "cuts")

    def border(cuts: str, at: Column, other: float) -> Column:
        return F.coalesce(F.get(cuts, at), F.lit(other))

    inf = float("inf")
    cells = placed.join(rows, [*keys, "_i"]).withColumn("_j", _at(F.col("y"), "_cy"))
    cells = cells.withColumns(
        {"_x0": border("_cx", F.col("_i") - 1, -inf), "_x1": border("_cx", F.col("_i"), inf), "_y0": border("_cy", F.col("_j") - 1, -inf), "_y1": border("_cy", F.col("_j"), inf)}
    ).drop("_cx", "_cy")
    cells = materialize(cells, "cells")
    home = [*keys, "_i", "_j"]
    carried = points.columns
    given = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema)

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        copies = np.minimum(pdf["w"].to_numpy(), k + 1)
        x, y = (np.repeat(pdf[c].to_numpy(), copies) for c in "xy")
        best = kth_distances(x, y, k)[np.cumsum(copies) - copies]
        e = best[:, -1]
        out = pdf[[*carried, "_i", "_j"]].assign(near=list(best), e=e)
        with np.errstate(invalid="ignore"):
            crosses = (pdf["x"] - e < pdf["_x0"]) | (pdf["x"] + e >= pdf["_x1"]) | (pdf["y"] - e < pdf["_y0"]) | (pdf["y"] + e >= pdf["_y1"])
        return out.assign(crosses=crosses.to_numpy())

    bounded = cells.groupBy(*home).applyInPandas(inside, f"{given}, _i int, _j int, near array<double>, e double, crosses boolean")
    bounded = materialize(bounded, "bounds")

    # The cells that a point's bound reaches, but its own.
    asked = bounded.where("crosses").select(*keys, "x", "y", "e", F.col("_i").alias("_hi"), F.col("_j").alias("_hj"))
    asked = asked.join(columns, keys).withColumn("_i", F.explode(F.sequence(_at(F.col("x") - F.col("e"), "_cx"), _at(F.col("x") + F.col("e"), "_cx")))).drop("_cx")
    asked = asked.join(rows, [*keys, "_i"]).withColumn("_j", F.explode(F.sequence(_at(F.col("y") - F.col("e"), "_cy"), _at(F.col("y") + F.col("e"), "_cy")))).drop("_cy")
    asked = asked.where((F.col("_i") != F.col("_hi")) | (F.col("_j") != F.col("_hj"))).select(*home, "x", "y")

    def across(own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = asking[[*keys, "x", "y"]]
        copies = np.minimum(own["w"].to_numpy(), k)
        x, y = (np.repeat(own[c].to_numpy(), copies) for c in "xy")
        least = list(_least(x, y, asking["x"].to_numpy(), asking["y"].to_numpy(), k))
        return out.assign(near=pd.Series(least, index=out.index, dtype=object))

    named = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema if f.name in (*keys, "x", "y"))
    found = cells.select(*home, "x", "y", "w").groupBy(*home).cogroup(asked.groupBy(*home)).applyInPandas(across, f"{named}, near array<double>")
    both = bounded.select(*carried, "near").unionByName(found.select(*keys, "x", "y", "near"), allowMissingColumns=True)
    distances = both.groupBy(*keys, "x", "y").agg(F.max("n").alias("n"), F.max("w").alias("w"), F.sort_array(F.flatten(F.collect_list("near"))).alias("near"))
    distances = materialize(distances.select(*keys, "x", "y", "n", "w", F.get("near", F.lit(k - 1)).alias("r")).where(F.col("n") > k), "distances")

    counted = [_count_closer(distances, keys, c, cell * 16) for c in ("x", "y")]
    psi = [c.groupBy(*keys).agg(F.sum(digamma(F.col("near")) * F.col("w")).alias(f"_p{i}")) for i, c in enumerate(counted)]
    made = scale.select(*keys, "n").join(psi[0], keys, "left").join(psi[1], keys, "left")
    mi = digamma(F.col("n")) + digamma(F.lit(k)) - (F.col("_p0") + F.col("_p1")) / F.col("n")
    return made.select(*keys, "n", F.when(mi.isNotNull(), F.greatest(mi, F.lit(0.0))).alias("mutual_information"))


def _count_closer(points: DataFrame, keys: Sequence[str], column: str, size: int) -> DataFrame:
    """keys, w and near: how many rows have |v - x| < r in one column, for every point."""
    rows = points.select(*keys, F.col(column).alias("v"), "r", "w")
    values = rows.groupBy(*keys, "v").agg(F.sum("w").alias("w"))
    cuts = _cuts(values, keys, "v", lambda n: n / size, "_c")
    values = materialize(values.join(cuts, list(keys)).withColumn("_i", _at(F.col("v"), "_c")).drop("_c"), "values")
    below = Window.partitionBy(*keys).orderBy("_i")  # at most CUTS rows a group
    totals = values.groupBy(*keys, "_i").agg(F.sum("w").alias("_t")).withColumn("_t", F.sum("_t").over(below))
    totals = totals.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_i", "_t"))).alias("_totals"))
    # The ends' ranges are read value by value, a rounding error to either side included; those between are whole.
    slack = _FUZZ * (F.abs("v") + F.col("r"))
    ends = {"_a0": F.col("v") - F.col("r") - slack, "_a1": F.col("v") - F.col("r") + slack, "_b0": F.col("v") + F.col("r") - slack, "_b1": F.col("v") + F.col("r") + slack}
    asked = rows.groupBy(*keys, "v", "r").agg(F.sum("w").alias("w"))  # points that ask the same
    asked = asked.join(cuts, list(keys)).withColumns({c: _at(x, "_c") for c, x in ends.items()}).drop("_c")
    parts = F.array_distinct(F.concat(F.sequence("_a0", F.least("_a1", "_b1")), F.sequence(F.greatest("_b0", "_a0"), "_b1")))
    part = asked.select(*keys, "v", "r", F.explode(parts).alias("_i"))

    def count(own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("v")
        near = _closer(own["v"].to_numpy(), own["w"].to_numpy(), asking["v"].to_numpy(), asking["r"].to_numpy()) if len(own) else 0
        return asking[[*keys, "v", "r"]].assign(near=near)

    named = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in part.schema if f.name in (*keys, "v", "r"))
    got = values.groupBy(*keys, "_i").cogroup(part.groupBy(*keys, "_i")).applyInPandas(count, f"{named}, near long")
    ended = got.groupBy(*keys, "v", "r").agg(F.sum("near").alias("_ends"))

    def upto(i: Column) -> Column:
        return F.coalesce(F.get(F.sort_array(F.map_values(F.map_filter("_totals", lambda j, _: j <= i)), False), F.lit(0)), F.lit(0))

    whole = F.when(F.col("_b0") - 1 > F.col("_a1"), upto(F.col("_b0") - 1) - upto(F.col("_a1"))).otherwise(0)
    return asked.join(totals, list(keys)).join(ended, [*keys, "v", "r"]).select(*keys, "w", (whole + F.col("_ends")).alias("near"))
