"""Analytical market columns: windows over one symbol's daily bars.

Bars are unique per symbol and day, so a window partition is bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from marketloom.functions.expr import TRADING_DAYS, div, gated, last_n, series, so_far
from marketloom.operators.ordering import positions


def forward_fill(x: str, w: WindowSpec) -> Column:
    return F.last(x, ignorenulls=True).over(so_far(w))


def add_returns(df: DataFrame, by: str = "symbol", ts: str = "ts", price: str = "close") -> DataFrame:
    """daily_return pads a missing price with the one before; log_return needs two adjacent prices."""
    w = series(by, ts)
    out = df.withColumn("_px", forward_fill(price, w)).withColumn("_prev", F.lag("_px").over(w))
    return out.withColumns(
        {
            "daily_return": div("_px", "_prev") - 1,
            "log_return": F.ln(div(price, F.lag(price).over(w))),
        }
    ).drop("_px", "_prev")


def add_rolling_volume(df: DataFrame, by: str = "symbol", ts: str = "ts") -> DataFrame:
    w = series(by, ts)
    return df.withColumns({f"rolling_{n}d_volume": F.avg("volume").over(last_n(w, n)) for n in (7, 30)})


def add_drawdown(df: DataFrame, by: str = "symbol", ts: str = "ts", price: str = "close") -> DataFrame:
    peak = F.max(price).over(so_far(series(by, ts)))
    return df.withColumn("drawdown", div(F.col(price) - peak, peak))


def add_rolling_volatility(df: DataFrame, windows: list[int], by: str = "symbol", ts: str = "ts", x: str = "log_return") -> DataFrame:
    w = series(by, ts)
    scale = F.sqrt(F.lit(float(TRADING_DAYS)))
    return df.withColumns(
        {f"volatility_{n}d": gated(F.stddev_samp(x).over(last_n(w, n)) * scale, x, last_n(w, n), n) for n in windows}
    )


def add_forward_returns(
    df: DataFrame, horizons: list[int], by: str = "symbol", ts: str = "ts", x: str = "log_return", strict: bool = True
) -> DataFrame:
    """Sum of the next h log returns. `strict` asks for all h of them; otherwise one is enough."""
    w = series(by, ts)
    cols = {}
    for h in horizons:
        ahead = w.rowsBetween(1, h)
        cols[f"fwd_ret_{h}d"] = gated(F.sum(x).over(ahead), x, ahead, h if strict else 1)
        vol = gated(F.stddev_samp(x).over(ahead), x, ahead, h if strict else 2) if h > 1 else F.lit(None).cast("double")
        cols[f"fwd_vol_{h}d"] = vol
    return df.withColumns(cols)


def add_expanding_median(df: DataFrame, cols: dict[str, str], by: str = "symbol", ts: str = "ts") -> DataFrame:
    """Median of everything up to each row, per symbol.

    The framed `percentile` re-sorts the whole past for every row; the pandas skip list needs
    O(log n) per row. A group is one symbol's daily bars, so it is bounded by the calendar.
    """
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name in (by, ts)] + [f"{c} double" for c in cols])
    slim = df.select(by, ts, *[F.col(x).cast("double").alias(c) for c, x in cols.items()])

    def medians(pdf):
        pdf = pdf.sort_values(ts)
        for c in cols:
            pdf[c] = pdf[c].expanding().median()
        return pdf

    return df.join(slim.groupBy(by).applyInPandas(medians, schema), [by, ts])


def percent_rank(df: DataFrame, by: str, x: str, out: str) -> DataFrame:
    """Average-tie percent rank inside each group; works for groups of any size."""
    ranks = positions(df, [by], x).select(by, x, (F.col("avg_rank") / F.col("n_total")).alias(out))
    return df.join(ranks, [by, x], "left").select(*df.columns, out)


def add_leads(df: DataFrame, h: int, cols: list[str], by: str = "symbol", ts: str = "ts") -> DataFrame:
    w = series(by, ts)
    return df.withColumns({f"{c}_lead_{h}": F.lead(c, h).over(w) for c in cols})


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per group; Spark prunes each map task to k rows per group before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
