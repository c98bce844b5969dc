"""Isotonic regression by pooling adjacent violators in score ranges, merged where borders still violate.

Pooling a part of the sequence first does not change the result, so every range of scores is pooled in a task of its own, which
leaves blocks of equal forecast. The blocks are then dealt into ranges whose borders lie half a range further, and pooled again,
until no range begins below the end of the one before. No task sees more than a range of scores or blocks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.session import materialize

MOST_RANGES = 256
_BLOCK = "lo double, hi double, total double, weight double"


def pool(lo: np.ndarray, hi: np.ndarray, total: np.ndarray, weight: np.ndarray) -> list[tuple[float, float, float, float]]:
    """Adjacent blocks in ascending order of score, merged until their means ascend strictly."""
    out: list[list[float]] = []
    for a, b, t, w in zip(lo.tolist(), hi.tolist(), total.tolist(), weight.tolist(), strict=True):
        out.append([a, b, t, w])
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            _, b, t, w = out.pop()
            out[-1][1:] = [b, out[-1][2] + t, out[-1][3] + w]
    return [tuple(x) for x in out]


def _pooled(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("lo")
    rows = pool(*(pdf[c].to_numpy(float) for c in ("lo", "hi", "total", "weight")))
    return pd.DataFrame(rows, columns=["lo", "hi", "total", "weight"]).assign(range=pdf["range"].iat[0])


def range_of(value: Column, cuts: Sequence[float]) -> Column:
    table = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>")
    return F.size(F.filter(table, lambda c: c <= value))


@dataclass(frozen=True)
class Isotonic:
    """blocks: range, lo, hi, total, weight, ascending in score and mean; cuts: where the ranges begin."""

    blocks: DataFrame
    cuts: list[float]

    def predict(self, df: DataFrame, score: str, out: str = "calibrated") -> DataFrame:
        """Rows with the mean of the block that holds their score; between two blocks the straight line, beyond the ends the end.
        Null for null scores and without blocks."""
        means = self.blocks.withColumn("mean", F.col("total") / F.col("weight")).select("range", "lo", "hi", "mean")
        edge = means.groupBy("range").agg(*[f(F.struct("lo", "hi", "mean")).alias(n) for f, n in ((F.min, "first"), (F.max, "last"))])
        # A range also needs its neighbours' nearest blocks: at most two rows a range.
        order = Window.orderBy("range")
        near = edge.select("range", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after"))
        near = near.select("range", F.explode(F.array_compact(F.array("before", "after"))).alias("b")).select("range", "b.*")
        have = means.unionByName(near)
        known = [r[0] for r in edge.select("range").orderBy("range").collect()]
        if not known:
            return df.withColumn(out, F.lit(None).cast("double"))
        # Ranges without blocks are answered by the next one that has some.
        table = F.array(*[F.lit(k) for k in known])
        asked = df.select(F.col(score).cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x)").distinct().withColumn("range", range_of(F.col("x"), self.cuts))
        asked = asked.withColumn("range", F.coalesce(F.get(F.filter(table, lambda k: k >= F.col("range")), F.lit(0)), F.lit(known[-1])))

        def line(blocks: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
            if blocks.empty:
                return points.assign(y=np.nan)[["x", "y"]]
            blocks = blocks.sort_values("lo")
            at = blocks[["lo", "hi"]].to_numpy(float).ravel()
            return points.assign(y=np.interp(points["x"].to_numpy(float), at, np.repeat(blocks["mean"].to_numpy(float), 2)))[["x", "y"]]

        found = have.groupBy("range").cogroup(asked.groupBy("range")).applyInPandas(line, "x double, y double")
        found = found.select(F.col("x").alias("_x"), F.col("y").alias(out))
        return df.join(found, F.col(score).cast("double") == F.col("_x"), "left").drop("_x")


def fit(df: DataFrame, score: str, y: str, rows_per_range: int = 100_000) -> Isotonic:
    """Non-decreasing step function of the score with the least squared error; equal scores are pooled first. Rows without a
    score or outcome do not count."""
    s, v = F.col(score).cast("double"), F.col(y).cast("double")
    rows = df.where(s.isNotNull() & ~F.isnan(s) & v.isNotNull()).groupBy(s.alias("lo")).agg(F.sum(v).alias("total"), F.count(F.lit(1)).cast("double").alias("weight"))
    rows = materialize(rows.select("lo", F.col("lo").alias("hi"), "total", "weight"), "scores")
    turn = 0
    while True:
        parts = min(MOST_RANGES, -(-rows.count() // rows_per_range))
        grid = [x for x in ((i + (turn % 2) / 2) / max(parts, 1) for i in range(parts)) if 0 < x < 1]
        cuts = sorted(set(rows.agg(F.percentile_approx("lo", grid, 100 * MOST_RANGES).alias("q")).first().q or ())) if grid else []
        blocks = rows.withColumn("range", range_of(F.col("lo"), cuts)).groupBy("range").applyInPandas(_pooled, f"{_BLOCK}, range int")
        blocks = materialize(blocks, "isotonic")
        mean = F.col("total") / F.col("weight")
        ends = blocks.groupBy("range").agg(F.min_by(mean, "lo").alias("first"), F.max_by(mean, "lo").alias("last"))
        before = F.lag("last").over(Window.orderBy("range"))  # at most MOST_RANGES rows
        if not ends.withColumn("before", before).where("before >= first").count():
            return Isotonic(blocks, cuts)
        rows, turn = blocks.drop("range"), turn + 1
