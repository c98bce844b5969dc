"""Gradient boosting that grows trees leaf by leaf, best gain first, up to `num_leaves`.

Features are cut into bins once. A tree needs only sums of gradients and curvatures per leaf, feature and bin: one aggregation
over the rows, combined in the map tasks, gives them for all leaves that are to be split next; of two children the smaller one is
counted and the other is the difference to the parent. What reaches the driver has at most leaves x features x bins numbers. The
order of splits does not change a leaf's gain, so several leaves are counted in one pass and the tree is still the best-first one.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.session import materialize

#: The rows with their scores are written again after so many trees; between, trees are part of the plan.
STORED_EVERY = 8


@dataclass(frozen=True)
class Boosting:
    """Parameters. `max_depth` of None is unbounded; `subsample` takes that share of rows for each tree, by a hash of row and tree."""

    objective: str = "squared"  # or "logistic"
    n_estimators: int = 50
    num_leaves: int = 31
    max_depth: int | None = None
    learning_rate: float = 0.1
    subsample: float = 1.0
    min_rows: int = 20
    min_curvature: float = 1e-3
    penalty: float = 0.0
    bins: int = 64
    seed: int = 42


@dataclass
class Node:
    gradient: float
    curvature: float
    rows: int
    depth: int
    histogram: np.ndarray | None = None  # features x bins x (gradient, curvature, rows)
    split: tuple[float, int, int] | None = None  # gain, feature, last bin of the left child
    left: int = -1
    right: int = -1


def _table(values: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


@dataclass
class Tree:
    """nodes: inner ones with (feature, last bin to the left, left, right), leaves with their value."""

    inner: dict[int, tuple[int, int, int, int]] = field(default_factory=dict)
    leaves: dict[int, float] = field(default_factory=dict)

    def depth(self, i: int = 0) -> int:
        return 1 + max(self.depth(j) for j in self.inner[i][2:]) if i in self.inner else 0

    def node(self, bins: Column, values: dict[int, float] | None = None) -> Column:
        """The leaf (or its value) that a row with these bins falls into. The tree is data, not code, so that plans of all trees
        are compiled once."""
        size = 1 + max([0, *(j for node in self.inner.values() for j in node[2:])])
        table = [self.inner.get(i, (-1, 0, 0, 0)) for i in range(size)]
        feature, last, left, right = (_table([row[c] for row in table], "int") for c in range(4))

        def step(at: Column, _: Column) -> Column:
            below = F.when(F.get(bins, F.get(feature, at)) <= F.get(last, at), F.get(left, at)).otherwise(F.get(right, at))
            return F.when(F.get(feature, at) < 0, at).otherwise(below)

        leaf = F.aggregate(_table(list(range(self.depth())), "int"), F.lit(0), step)
        return leaf if values is None else F.get(_table([float(values.get(i, 0.0)) for i in range(size)], "double"), leaf)

    def predict(self, bins: np.ndarray) -> np.ndarray:
        out = np.empty(len(bins))
        todo = [(0, np.arange(len(bins)))]
        while todo:
            i, rows = todo.pop()
            if i in self.inner:
                f, b, left, right = self.inner[i]
                go = bins[rows, f] <= b
                todo += [(left, rows[go]), (right, rows[~go])]
            else:
                out[rows] = self.leaves[i]
        return out


@dataclass
class Model:
    """features, the ascending cuts of each, the first score, the trees (values include the learning rate) and the training loss
    before the first and after every tree."""

    objective: str
    features: list[str]
    cuts: list[list[float]]
    base: float
    trees: list[Tree]
    losses: list[float]

    def scores(self, frame: pd.DataFrame) -> np.ndarray:
        bins = np.stack([_bins_of(frame[f].to_numpy(float), np.array(c)) for f, c in zip(self.features, self.cuts, strict=True)], axis=1)
        return self.base + sum((t.predict(bins) for t in self.trees), np.zeros(len(frame)))

    def transform(self, df: DataFrame) -> DataFrame:
        """Rows with `prediction`, and `probability` of class 1 for the logistic objective."""
        trained, logistic = self, self.objective == "logistic"

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            for frame in frames:
                s = trained.scores(frame)
                yield pd.Series(1 / (1 + np.exp(-s)) if logistic else s)

        score = F.pandas_udf(run, "double")(F.struct(*[F.col(c).cast("double").alias(c) for c in self.features]))
        if not logistic:
            return df.withColumn("prediction", score)
        return df.withColumn("probability", score).withColumn("prediction", (F.col("probability") > 0.5).cast("double"))


def _bins_of(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """0 for missing values, else 1 + how many cuts are below."""
    return np.where(np.isnan(values), 0, 1 + np.searchsorted(cuts, values, "left"))


def _bin(value: Column, cuts: Sequence[float]) -> Column:
    v = value.cast("double")
    table = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>")
    return F.when(v.isNull() | F.isnan(v), 0).otherwise(1 + F.size(F.filter(table, lambda c: c < v))).cast("int")


def binned(df: DataFrame, features: Sequence[str], label: str, bins: int = 64) -> tuple[DataFrame, list[list[float]]]:
    """Rows (row, y, bins) and the cuts: approximate quantiles of the finite values, at most bins - 1 of them."""
    clean = [F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in features]
    grid = [i / bins for i in range(1, bins)]
    found = df.agg(*[F.percentile_approx(c, grid, 100 * bins).alias(f"q{i}") for i, c in enumerate(clean)]).first()
    cuts = [sorted(set(found[f"q{i}"] or ())) for i in range(len(features))]
    rows = df.where(F.col(label).isNotNull()).select(
        F.monotonically_increasing_id().alias("row"), F.col(label).cast("double").alias("y"), F.array(*[_bin(F.col(f), c) for f, c in zip(features, cuts, strict=True)]).alias("bins")
    )
    return materialize(rows, "binned"), cuts


def histograms(rows: DataFrame, node: Column, wanted: Sequence[int]) -> DataFrame:
    """node, feature, bin, gradient, curvature, n: sums over the rows (g, h, bins) that stand in the wanted nodes."""
    at = rows.select(node.alias("node"), "g", "h", "bins")
    if list(wanted) != [0]:
        at = at.where(F.array_contains(_table(list(wanted), "int"), F.col("node")))
    at = at.select("node", "g", "h", F.posexplode("bins").alias("feature", "bin"))
    return at.groupBy("node", "feature", "bin").agg(F.sum("g").alias("gradient"), F.sum("h").alias("curvature"), F.count(F.lit(1)).alias("n"))


def best_split(node: Node, p: Boosting) -> tuple[float, int, int] | None:
    """The greatest gain over all features and bins, ties to the first; none if no split is allowed or gains anything."""
    if p.max_depth is not None and node.depth >= p.max_depth:
        return None
    left = np.cumsum(node.histogram, axis=1)[:, :-1]
    total = np.array([node.gradient, node.curvature, node.rows])
    right = total - left

    def worth(s: np.ndarray) -> np.ndarray:
        return s[..., 0] ** 2 / np.maximum(s[..., 1] + p.penalty, 1e-300)

    allowed = np.minimum(left[..., 2], right[..., 2]) >= p.min_rows
    allowed &= np.minimum(left[..., 1], right[..., 1]) >= p.min_curvature
    gain = np.where(allowed, (worth(left) + worth(right) - worth(total)) / 2, -np.inf)
    f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return (float(gain[f, b]), int(f), int(b)) if gain[f, b] > 1e-12 else None


def grow(rows: DataFrame, width: int, p: Boosting) -> tuple[Tree, dict[int, Node]]:
    """One tree over rows (g, h, bins) with features of `width` bins at most."""
    nodes: dict[int, Node] = {}
    tree = Tree()

    def counted(wanted: Sequence[int]) -> dict[int, np.ndarray]:
        out: dict[int, np.ndarray] = {}
        for r in histograms(rows, tree.node(F.col("bins")), wanted).collect():
            h = out.setdefault(r.node, np.zeros((len_features, width, 3)))
            h[r.feature, r.bin] = r.gradient, r.curvature, r.n
        return out

    len_features = rows.select(F.size("bins").alias("n")).first()
    if len_features is None:
        return Tree(leaves={0: 0.0}), {}
    len_features = len_features.n
    first = counted([0])[0]
    g, h, n = first[0].sum(axis=0)
    nodes[0] = Node(float(g), float(h), int(n), 0, first)
    nodes[0].split = best_split(nodes[0], p)

    def split(i: int) -> None:
        node = nodes[i]
        _, f, b = node.split
        part = node.histogram[f, : b + 1].sum(axis=0)
        sums = part, np.array([node.gradient, node.curvature, node.rows]) - part
        node.left, node.right = len(nodes), len(nodes) + 1
        for s in sums:
            nodes[len(nodes)] = Node(float(s[0]), float(s[1]), int(round(s[2])), node.depth + 1)
        tree.inner[i] = (f, b, node.left, node.right)

    def chosen() -> tuple[list[int], list[int]]:
        """Inner nodes of the best-first tree as far as it is known, and the leaves whose own split it waits for."""
        inner: list[int] = []
        heap = [(-nodes[0].split[0], 0)] if nodes[0].split else []
        while heap and len(inner) + 1 < p.num_leaves:
            _, i = heapq.heappop(heap)
            inner.append(i)
            if nodes[i].left < 0:
                return inner, [i, *[j for _, j in heapq.nsmallest(p.num_leaves - 1 - len(inner), heap) if nodes[j].left < 0]]
            for j in (nodes[i].left, nodes[i].right):
                if nodes[j].split:
                    heapq.heappush(heap, (-nodes[j].split[0], j))
        return inner, []

    while True:
        inner, waiting = chosen()
        if not waiting:
            break
        for i in waiting:
            split(i)
        if len(inner) + 1 >= p.num_leaves:
            continue
        small = {i: min((nodes[i].left, nodes[i].right), key=lambda j: nodes[j].rows) for i in waiting}
        seen = counted(sorted(small.values()))
        for i, s in small.items():
            other = nodes[i].left + nodes[i].right - s
            nodes[s].histogram = seen.get(s, np.zeros_like(nodes[i].histogram))
            nodes[other].histogram = nodes[i].histogram - nodes[s].histogram
            for j in (s, other):
                nodes[j].split = best_split(nodes[j], p)
    kept = set(chosen()[0])
    final = Tree({i: v for i, v in tree.inner.items() if i in kept})
    ends = [j for i in kept for j in final.inner[i][2:] if j not in kept] if kept else [0]
    final.leaves = {j: -nodes[j].gradient / max(nodes[j].curvature + p.penalty, 1e-300) for j in ends}
    return final, nodes


def _with_gradients(rows: DataFrame, objective: str) -> DataFrame:
    if objective == "squared":
        return rows.withColumns({"g": F.col("score") - F.col("y"), "h": F.lit(1.0)})
    chance = 1 / (1 + F.exp(-F.col("score")))
    return rows.withColumns({"g": chance - F.col("y"), "h": chance * (1 - chance)})


def _loss(objective: str) -> Column:
    if objective == "squared":
        return F.avg((F.col("score") - F.col("y")) ** 2)
    s = F.col("score")
    return F.avg(F.greatest(s, F.lit(0.0)) - s * F.col("y") + F.log1p(F.exp(-F.abs(s))))


def fit(df: DataFrame, features: Sequence[str], label: str, p: Boosting = Boosting(), track: bool = False) -> Model:
    """Trains on the rows with a label; missing features have a bin of their own, left of all others. `track` keeps the training
    loss of every round, at the price of one pass each. An empty table gives a model without trees that predicts 0."""
    rows, cuts = binned(df, features, label, p.bins)
    share = rows.agg(F.avg("y").alias("m")).first().m
    model = Model(p.objective, list(features), cuts, 0.0, [], [])
    if share is None:
        return model
    model.base = float(share) if p.objective == "squared" else math.log(max(share, 1e-6) / max(1 - share, 1e-6))
    rows = rows.withColumn("score", F.lit(model.base))
    width = max(len(c) for c in cuts) + 2
    for k in range(p.n_estimators):
        if track:
            model.losses.append(rows.agg(_loss(p.objective).alias("l")).first().l)
        drawn = _with_gradients(rows, p.objective).select("row", "g", "h", "bins")
        if p.subsample < 1:
            draw = F.pmod(F.xxhash64("row", F.lit(p.seed), F.lit(k)), F.lit(1 << 30)) / float(1 << 30)
            drawn = drawn.where(draw < p.subsample)
        tree, _ = grow(drawn, width, p)
        if not tree.leaves or (not tree.inner and abs(tree.leaves.get(0, 0.0)) < 1e-12):
            break
        tree.leaves = {i: p.learning_rate * v for i, v in tree.leaves.items()}
        model.trees.append(tree)
        rows = rows.withColumn("score", F.col("score") + tree.node(F.col("bins"), tree.leaves))
        if (k + 1) % STORED_EVERY == 0:
            rows = materialize(rows, "scores")
    if track:
        model.losses.append(rows.agg(_loss(p.objective).alias("l")).first().l)
    return model
