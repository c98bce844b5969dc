"""Linear models on any set of time blocks from sums of products, without reading the rows again.

One pass gives, per block of time, the sums of products of (1, x with 0 for missing values, which x are missing, y). Sums of blocks
are sums of rows, so every fold's training and test sums are sums of blocks. Filling missing values by a number is a linear change
of these columns, and so is standardising: the fit of a fold (least squares, ridge, lasso, elastic net) and its squared error need
nothing else. What reaches the driver has blocks x columns^2 numbers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.operators.ordering import quantiles


@dataclass(frozen=True)
class Sums:
    """edges: where blocks begin, ascending (time, after): at that time, or after it; block 0 is before the first. blocks: per
    block the matrix of sums."""

    features: tuple[str, ...]
    edges: tuple[tuple, ...]
    blocks: dict[int, np.ndarray]

    def over(self, blocks: Sequence[int]) -> np.ndarray:
        size = 2 + 2 * len(self.features)
        return sum((self.blocks[b] for b in blocks if b in self.blocks), np.zeros((size, size)))


    def between(self, first: tuple, last: tuple) -> np.ndarray:
        """Sums of the rows from one edge to another."""
        return self.over(range(self.edges.index(first) + 1, self.edges.index(last) + 1))


def block_of(at: str, edges: Sequence[tuple], kind: str) -> Column:
    """How many edges lie before a time."""
    passed = [F.col(at) > F.lit(e).cast(kind) if after else F.col(at) >= F.lit(e).cast(kind) for e, after in edges]
    return sum((F.when(p, 1).otherwise(0) for p in passed), F.lit(0))


def sums_of_products(df: DataFrame, features: Sequence[str], label: str, at: str, edges: Sequence[tuple]) -> Sums:
    """One scan. Rows without a label or time do not count; undefined and infinite features count as missing."""
    kind, edges = df.schema[at].dataType.simpleString(), sorted(set(edges))
    values = []
    for f in features:
        v = F.col(f).cast("double")
        values.append(F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), v))
    named = {f"_x{i}": F.coalesce(v, F.lit(0.0)) for i, v in enumerate(values)} | {f"_d{i}": v.isNull().cast("double") for i, v in enumerate(values)}
    rows = df.where(F.col(label).isNotNull() & F.col(at).isNotNull()).select(block_of(at, edges, kind).alias("_block"), F.lit(1.0).alias("_one"), F.col(label).cast("double").alias("_y"), *[c.alias(n) for n, c in named.items()])
    columns = ["_one", *[f"_x{i}" for i in range(len(features))], *[f"_d{i}" for i in range(len(features))], "_y"]
    cells = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    found = rows.groupBy("_block").agg(*[F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"s{i}_{j}") for i, j in cells]).collect()
    blocks = {}
    for r in found:
        m = np.zeros((len(columns), len(columns)))
        for i, j in cells:
            m[i, j] = m[j, i] = r[f"s{i}_{j}"]
        blocks[r["_block"]] = m
    return Sums(tuple(features), tuple(edges), blocks)


def medians(df: DataFrame, features: Sequence[str], rows: Column) -> np.ndarray:
    """Medians of the features over some rows, for filling; 0 for a feature without values."""
    long = df.where(rows).select(*[F.col(f).cast("double").alias(f) for f in features]).unpivot([], list(features), "feature", "value")
    found = {r.feature: r.m for r in quantiles(long.where(~F.isnan("value") & (F.abs("value") < float("inf"))), ["feature"], "value", {"m": 0.5}).collect()}
    return np.array([found.get(f, 0.0) for f in features])


def filled(total: np.ndarray, fill: Sequence[float]) -> np.ndarray:
    """Sums of products of (1, x filled, y)."""
    k = len(fill)
    change = np.zeros((2 + k, len(total)))
    change[0, 0] = change[-1, -1] = 1
    for i, v in enumerate(fill):
        change[1 + i, 1 + i], change[1 + i, 1 + k + i] = 1, v
    return change @ total @ change.T


@dataclass(frozen=True)
class Linear:
    """y = intercept + coefficients . x over filled, not standardised features."""

    intercept: float
    coefficients: np.ndarray

    def squared_error(self, sums: np.ndarray) -> float:
        """Sum of squared errors over the rows behind sums of (1, x, y)."""
        b = np.append(np.append(self.intercept, self.coefficients), -1.0)
        return float(b @ sums @ b)


def fit(sums: np.ndarray, l1: float = 0.0, l2: float = 0.0, tolerance: float = 1e-12, rounds: int = 10_000) -> Linear | None:
    """The minimum of |y - Xb|^2 / 2n + l1 |b| + l2 |b|^2 / 2 over standardised features (deviation with n - 1), with an intercept;
    None without rows. A constant feature gets 0."""
    n = sums[0, 0]
    if n < 1:
        return None
    mean = sums[0, 1:] / n
    centred = sums[1:, 1:] - n * np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(centred)[:-1], 0) / max(n - 1, 1))
    noise = np.sqrt(np.maximum(np.diag(sums)[1:-1], 0) / n) * 1e-7
    live = spread > noise
    scale = np.where(live, spread, 1.0)
    g, c = centred[:-1, :-1] / np.outer(scale, scale) / n, centred[:-1, -1] / scale / n
    b = np.zeros(len(c))
    index = np.flatnonzero(live)
    if l1 == 0 and len(index):
        b[index] = np.linalg.lstsq(g[np.ix_(index, index)] + l2 * np.eye(len(index)), c[index], rcond=None)[0]
    elif len(index):
        for _ in range(rounds):
            before = b.copy()
            for i in index:
                rest = c[i] - g[i] @ b + g[i, i] * b[i]
                b[i] = np.sign(rest) * max(abs(rest) - l1, 0.0) / (g[i, i] + l2)
            if np.abs(b - before).max() <= tolerance * max(1.0, np.abs(b).max()):
                break
    coefficients = np.where(live, b / scale, 0.0)
    return Linear(float(mean[-1] - coefficients @ mean[:-1]), coefficients)


PENALTIES = {
    "linear_regression": lambda n, alpha: (0.0, 0.0),
    "ridge": lambda n, alpha: (0.0, alpha / max(n, 1)),
    "lasso": lambda n, alpha: (alpha, 0.0),
    "elastic_net": lambda n, alpha: (alpha / 2, alpha / 2),
}


def fit_named(name: str, sums: np.ndarray, alpha: float = 1.0) -> Linear | None:
    l1, l2 = PENALTIES[name](sums[0, 0], alpha)
    return fit(sums, l1, l2)


@dataclass(frozen=True)
class Fold:
    """Sums of (1, x filled, y) over a fold's training and test rows; missing values are filled with the training medians."""

    fold: int
    train: np.ndarray
    test: np.ndarray

    def score(self, name: str, alpha: float) -> dict[str, float]:
        """n, RMSE and R2 on the test rows of a model fitted on the training rows."""
        model, n = fit_named(name, self.train, alpha), self.test[0, 0]
        error = model.squared_error(self.test)
        total = self.test[-1, -1] - self.test[0, -1] ** 2 / n
        return {"n": int(n), "RMSE": float(np.sqrt(max(error, 0.0) / n)), "R2": float(1 - error / total) if total > 0 else float("nan")}


def folds(df: DataFrame, features: Sequence[str], label: str, at: str, ranges: Sequence[tuple]) -> list[Fold]:
    """Folds whose (number, training range, test range) are given, a range as (first edge, last edge); folds without training or
    test rows are left out. One scan for the sums, and one per fold for medians if any feature has missing values."""
    sums = sums_of_products(df, features, label, at, [e for _, *pair in ranges for r in pair for e in r])
    kind, k, out = df.schema[at].dataType.simpleString(), len(features), []
    for number, train, test in ranges:
        learn, judge = sums.between(*train), sums.between(*test)
        if learn[0, 0] and judge[0, 0]:
            fill = np.zeros(k)
            if learn[0, 1 + k : 1 + 2 * k].any() or judge[0, 1 + k : 1 + 2 * k].any():
                begun, over = (block_of(at, [e], kind) == 1 for e in train)
                fill = medians(df.where(F.col(label).isNotNull()), features, begun & ~over)
            out.append(Fold(number, filled(learn, fill), filled(judge, fill)))
    return out
