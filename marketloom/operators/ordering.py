"""Order statistics that never put one group into one task.

A group may hold a third of all rows, so ranking it with one sorted window is out. Equal values are
counted first (map-side), each large group is cut into value ranges at approximate quantiles, and a
running total over the few range totals turns positions inside a range into positions in the whole
group. The cut points only route rows, so the results are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 256


def value_counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def cumulative(
    counts: DataFrame, by: list[str], value: str, measures: list[str], rows_per_range: int = 1_000_000, bounded: bool = False
) -> DataFrame:
    """Adds `<m>_before` (total of m over smaller values) and `<m>_total` for each measure m.

    `counts` holds one row per group and value. `bounded` says that the key limits the size of a group (a
    symbol's daily bars): one window per group then does the same with fewer stages.
    """
    if bounded:
        below = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return counts.select(
            *counts.columns,
            *[F.coalesce(F.sum(m).over(below), F.lit(0)).alias(f"{m}_before") for m in measures],
            *[F.sum(m).over(Window.partitionBy(*by)).alias(f"{m}_total") for m in measures],
        )
    grid = [i / RANGES for i in range(1, RANGES)]
    pieces = F.least(F.lit(RANGES), F.ceil(F.col("_distinct") / F.lit(rows_per_range))).cast("int")
    sizes = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("_distinct"))
    # at most one row per `rows_per_range` input rows, so this side stays small whatever the input
    large = sizes.where(F.col("_distinct") > rows_per_range).select(*by, pieces.alias("_pieces"))
    cut = F.transform(
        F.sequence(F.lit(1), F.col("_pieces") - 1),
        lambda i: F.element_at("_grid", F.greatest(F.floor(i * RANGES / F.col("_pieces")), F.lit(1)).cast("int")),
    )
    edges = (
        counts.join(F.broadcast(large), by)
        .groupBy(*by, "_pieces")
        .agg(F.percentile_approx(value, grid, 2560).alias("_grid"))
        .select(*by, cut.alias("_cuts"))
    )
    rng = F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(F.size(F.filter("_cuts", lambda e: e < F.col(value))))
    routed = counts.join(edges, by, "left").withColumn("_range", rng).drop("_cuts")
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    totals = routed.groupBy(*by, "_range").agg(*[F.sum(m).alias(f"_{m}") for m in measures])
    totals = totals.select(
        *by,
        "_range",
        *[F.coalesce(F.sum(f"_{m}").over(before), F.lit(0)).alias(f"_{m}_off") for m in measures],
        *[F.sum(f"_{m}").over(whole).alias(f"{m}_total") for m in measures],
    )
    inside = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        routed.join(totals, [*by, "_range"])
        .select(
            *counts.columns,
            *[(F.col(f"_{m}_off") + F.coalesce(F.sum(m).over(inside), F.lit(0))).alias(f"{m}_before") for m in measures],
            *[f"{m}_total" for m in measures],
        )
    )


def positions(df: DataFrame, by: list[str], value: str, bounded: bool = False, rows_per_range: int = 1_000_000) -> DataFrame:
    """One row per group and value: n, n_before, n_total and the average rank of the value."""
    ranked = cumulative(value_counts(df, by, value), by, value, ["n"], rows_per_range, bounded)
    return ranked.withColumn("avg_rank", F.col("n_before") + (F.col("n") + 1) / F.lit(2.0))


def _at(value: str, k: Column) -> Column:
    hit = (F.col("n_before") <= k) & (k < F.col("n_before") + F.col("n"))
    return F.max(F.when(hit, F.col(value)))


def quantiles(
    df: DataFrame, by: list[str], value: str, probs: dict[str, float], bounded: bool = False, rows_per_range: int = 1_000_000
) -> DataFrame:
    """Exact linearly interpolated quantiles per group: column name -> probability."""
    if bounded:
        rows = df.where(F.col(value).isNotNull())
        return rows.groupBy(*by).agg(*[F.percentile(value, p).alias(name) for name, p in probs.items()])
    pos = positions(df, by, value, rows_per_range=rows_per_range)
    aggs, outs = [], []
    for name, p in probs.items():
        at = F.lit(p) * (F.col("n_total") - 1)
        aggs += [_at(value, F.floor(at)).alias(f"_{name}_lo"), _at(value, F.ceil(at)).alias(f"_{name}_hi")]
        frac = F.lit(p) * (F.col("_total") - 1)
        frac = frac - F.floor(frac)
        outs.append((F.col(f"_{name}_lo") + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * frac).alias(name))
    return pos.groupBy(*by).agg(F.max("n_total").alias("_total"), *aggs).select(*by, *outs)
