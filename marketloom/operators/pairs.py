"""Statistics of all pairs of series as masked matrix products.

A series is packed into one row (its days and values; the calendar bounds it) and hashed into a block. A task holds two blocks as
matrices over the days: X with zeros where a value is missing, and the mask M. Four products give all pairs at once: M'M the
common days, X'M the sums, (X*X)'M the squares and X'X the cross products. Ranks are taken column by column and multiplied like
values where two series have the same days; elsewhere a series is ranked against all masks of the other block in one pass over
its sorted values. So a block pair costs a few products, and a series is copied once per block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAIR_SCHEMA = "a string, b string, n long, pearson double, spearman double, cov double"
#: Below this share of a sum of squares, what is left around the mean may be rounding: such pairs are computed anew, centred.
_CANCELLED = 1e-9


class Block:
    """Series of one block over the days of the task: values scaled to mean 0 and deviation 1, mask, names."""

    def __init__(self, names: np.ndarray, days: list[np.ndarray], values: list[np.ndarray], calendar: np.ndarray) -> None:
        self.names = names
        size = len(calendar), len(names)
        self.raw, self.mask = np.zeros(size), np.zeros(size, bool)
        for j, (d, v) in enumerate(zip(days, values, strict=True)):
            at = np.searchsorted(calendar, d)
            self.raw[at, j], self.mask[at, j] = v, True
        n = np.maximum(self.mask.sum(axis=0), 1)
        mean = self.raw.sum(axis=0) / n
        self.x = np.where(self.mask, self.raw - mean, 0.0)
        scale = np.sqrt((self.x**2).sum(axis=0) / n)
        self.scale = np.where(scale > 0, scale, 1.0)
        self.x /= self.scale
        self.m = self.mask.astype(float)


def products(p: Block, q: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Common days and, around the means over them, the squares of both series and their cross products (scaled values)."""
    n = p.m.T @ q.m
    sx, sy = p.x.T @ q.m, p.m.T @ q.x
    sxx, syy, sxy = (p.x**2).T @ q.m, p.m.T @ (q.x**2), p.x.T @ q.x
    some = np.maximum(n, 1)
    cxx, cyy, cxy = sxx - sx**2 / some, syy - sy**2 / some, sxy - sx * sy / some
    for i, j in zip(*np.nonzero((n > 1) & ((cxx <= _CANCELLED * sxx) | (cyy <= _CANCELLED * syy))), strict=True):
        both = p.mask[:, i] & q.mask[:, j]
        u, v = p.raw[both, i], q.raw[both, j]
        # Equal values have no deviation at all, whatever their mean rounds to.
        u, v = (np.zeros(len(w)) if (w == w[0]).all() else w - w.mean() for w in (u, v))
        u, v = u / p.scale[i], v / q.scale[j]
        cxx[i, j], cyy[i, j], cxy[i, j] = u @ u, v @ v, u @ v
    return n, cxx, cyy, cxy


class Ranked:
    """Columns of a block in ascending order of value: row numbers, and for each place the first and last place of its ties."""

    def __init__(self, block: Block) -> None:
        t = len(block.raw)
        # Missing values go last; masks hide them.
        self.order = np.argsort(np.where(block.mask, block.raw, np.inf), axis=0, kind="stable")
        v = np.take_along_axis(np.where(block.mask, block.raw, np.inf), self.order, axis=0)
        place = np.arange(t)[:, None]
        new = np.vstack([np.ones((1, v.shape[1]), bool), v[1:] != v[:-1]]) if t else np.zeros(v.shape, bool)
        self.first = np.maximum.accumulate(np.where(new, place, 0), axis=0)
        end = np.vstack([new[1:], np.ones((1, v.shape[1]), bool)]) if t else new
        self.last = np.minimum.accumulate(np.where(end, place, t)[::-1], axis=0)[::-1]

    def under(self, columns, masks: np.ndarray) -> np.ndarray:
        """Average ranks, days x k, of columns (one or k of them) among the days of k masks; 0 outside them."""
        order, first, last = (x[:, columns] for x in (self.order, self.first, self.last))
        if order.ndim == 1:
            order, first, last = (np.broadcast_to(x[:, None], masks.shape) for x in (order, first, last))
        have = np.take_along_axis(masks, order, axis=0)
        upto = np.vstack([np.zeros((1, masks.shape[1])), np.cumsum(have, axis=0)])
        average = (np.take_along_axis(upto, first, axis=0) + 1 + np.take_along_axis(upto, last + 1, axis=0)) / 2
        out = np.zeros(masks.shape)
        np.put_along_axis(out, order, np.where(have, average, 0.0), axis=0)
        return out


def rank_products(p: Block, q: Block, n: np.ndarray) -> np.ndarray:
    """Spearman's rho of all pairs over their common days; nan where a series is constant there."""
    rp, rq = Ranked(p), Ranked(q)
    mean = (n + 1) / 2
    rr, ss, rs = np.zeros(n.shape), np.zeros(n.shape), np.zeros(n.shape)
    # Series with the same days: ranks once per column.
    patterns: dict[bytes, tuple[list[int], list[int]]] = {}
    for side, block in enumerate((p, q)):
        for j, key in enumerate(np.packbits(block.mask, axis=0).T):
            patterns.setdefault(key.tobytes(), ([], []))[side].append(j)
    done = np.zeros(n.shape, bool)
    for i, j in patterns.values():
        if i and j:
            a, b = rp.under(i, p.mask[:, i]), rq.under(j, q.mask[:, j])
            cell = np.ix_(i, j)
            rr[cell], ss[cell], rs[cell] = (a**2).sum(axis=0)[:, None], (b**2).sum(axis=0)[None, :], a.T @ b
            done[cell] = True
    for i in np.flatnonzero(~done.all(axis=1)):
        j = np.flatnonzero(~done[i])
        both = p.mask[:, [i]] & q.mask[:, j]
        a, b = rp.under(i, both), rq.under(j, both)
        rr[i, j], ss[i, j], rs[i, j] = (a**2).sum(axis=0), (b**2).sum(axis=0), (a * b).sum(axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = (rr - n * mean**2) * (ss - n * mean**2)
        return np.where(spread > 0, (rs - n * mean**2) / np.sqrt(spread), np.nan)


def block_pair(
    p: Block, q: Block, same: bool, diagonal: bool = False, rank: bool = True, threshold: float | None = None, top: int | None = None, enough: int = 2
) -> pd.DataFrame:
    """The rows of one pair of blocks; of a block with itself the half above the diagonal."""
    n, cxx, cyy, cxy = products(p, q)
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.where((cxx > 0) & (cyy > 0) & (n > 1), cxy / np.sqrt(cxx * cyy), np.nan)
        cov = np.where(n > 1, cxy * p.scale[:, None] * q.scale[None, :] / (n - 1), np.nan)
    r = np.clip(r, -1.0, 1.0)
    keep = np.ones(n.shape, bool)
    if same:
        keep = p.names[:, None] <= q.names[None, :] if diagonal else p.names[:, None] < q.names[None, :]
    judged = np.where(n >= enough, r, np.nan)
    if threshold is not None:
        keep &= np.nan_to_num(np.abs(judged), nan=-1.0) >= threshold
    if top is not None and same:
        other = keep | keep.T
        np.fill_diagonal(other, False)
        best = _strong(judged, other, top)
        keep &= best | best.T
    elif top is not None:
        keep &= _strong(judged, keep, top) | _strong(judged.T, keep.T, top).T
    rho = np.full(n.shape, np.nan)
    if rank and keep.any():
        rho = rank_products(p, q, n)
    i, j = np.nonzero(keep)
    a, b = p.names[i], q.names[j]
    swap = a > b
    out = pd.DataFrame({"a": np.where(swap, b, a), "b": np.where(swap, a, b), "n": n[i, j].astype(np.int64)})
    return out.assign(pearson=r[i, j], spearman=np.where(np.isnan(r[i, j]), np.nan, rho[i, j]), cov=cov[i, j])


def _strong(r: np.ndarray, keep: np.ndarray, top: int) -> np.ndarray:
    """Per row, the kept columns whose size is among its `top` greatest, ties included."""
    size = np.where(keep & ~np.isnan(r), np.abs(np.nan_to_num(r)), -1.0)
    if size.shape[1] <= top:
        return size >= 0
    least = np.partition(size, -top, axis=1)[:, [-top]]
    return (size >= least) & (size >= 0)


def pair_statistics(
    df: DataFrame, x: str = "log_return", by: str = "symbol", ts: str = "ts", diagonal: bool = False, block: int = 128,
    rank: bool = True, blocks: int | None = None, keys: tuple[str, ...] = (), threshold: float | None = None, top: int | None = None, enough: int = 2,
) -> DataFrame:
    """Pair-complete n, Pearson r, Spearman rho and covariance for all a < b (and a = b with `diagonal`).

    Symbols are hashed into `blocks`, by default one for every `block` of them, counted while the query runs. `threshold` keeps
    pairs of at least that |r|; `top` keeps for every symbol its pairs of greatest |r| (ties by name); both look at pairs with
    `enough` common days only. String columns in `keys` separate the pairs. Null, infinite and undefined values count as missing; a symbol and day must have one row. Statistics are
    null where fewer than two days are common or a series is constant over them.
    """
    value = F.col(x).cast("double")
    rows = df.select(*keys, by, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"), value.alias("_x"))
    rows = rows.where(F.col("_t").isNotNull() & value_is_finite("_x"))
    count = F.lit(blocks) if blocks else F.greatest(F.lit(1), F.ceil(rows.agg(F.approx_count_distinct(by).alias("s")).scalar() / block)).cast("int")
    packed = rows.groupBy(*keys, by).agg(F.sort_array(F.collect_list(F.struct("_t", "_x"))).alias("_s"))
    twice = F.size(F.array_distinct("_s._t")) < F.size("_s")
    packed = packed.withColumn("_s", F.when(twice, F.raise_error(F.concat(F.lit(f"pairs need one row per {by} and {ts}: "), by))).otherwise(F.col("_s")))
    home = packed.withColumn("_n", count).withColumn("_b", F.pmod(F.xxhash64(by), F.col("_n")).cast("int"))
    cells = home.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    cells = cells.select(*keys, by, "_b", F.least("_b", "_o").alias("_p"), F.greatest("_b", "_o").alias("_q"), F.col("_s._t").alias("_t"), F.col("_s._x").alias("_x"))
    schema = "".join(f"{k} string, " for k in keys) + PAIR_SCHEMA

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        calendar = np.unique(np.concatenate(pdf["_t"].to_list()))
        p_at, q_at = pdf["_p"].iat[0], pdf["_q"].iat[0]
        sides = [pdf[pdf["_b"] == at] for at in (p_at, q_at)]
        made = [Block(s[by].to_numpy(object), s["_t"].to_list(), s["_x"].to_list(), calendar) for s in sides]
        out = block_pair(made[0], made[1], p_at == q_at, diagonal, rank, threshold, top, enough)
        for k in keys:
            out[k] = pdf[k].iat[0]
        return out[[*keys, "a", "b", "n", "pearson", "spearman", "cov"]]

    found = cells.groupBy(*keys, "_p", "_q").applyInPandas(cell, schema).replace(float("nan"), None, ["pearson", "spearman", "cov"])
    return found if top is None else strongest(found, top, keys, enough)


def value_is_finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def strongest(pairs: DataFrame, top: int, keys: tuple[str, ...] = (), enough: int = 2) -> DataFrame:
    """The pairs that are among the `top` of greatest |pearson| of either symbol, of those with `enough` common days; ties go by
    the other's name."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("s"), F.col("b").alias("o")), F.struct(F.col("b").alias("s"), F.col("a").alias("o")))).alias("_e")
    each = pairs.where(F.col("pearson").isNotNull() & (F.col("a") != F.col("b")) & (F.col("n") >= enough)).select("*", ends)
    w = Window.partitionBy(*keys, "_e.s").orderBy(F.desc(F.abs("pearson")), "_e.o")
    kept = each.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= top)
    return kept.drop("_e", "_k").dropDuplicates([*keys, "a", "b"])
