"""Column helpers shared by the operators. Everything here stays a built-in JVM expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRADING_DAYS = 252


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def div(a: str | Column, b: str | Column) -> Column:
    """a / b, null where b is zero (the session runs in ANSI mode)."""
    return col(a) / F.nullif(col(b), F.lit(0))


def rnd(c: str | Column, digits: int = 6) -> Column:
    return F.round(col(c), digits) + F.lit(0.0)


def finite(c: str | Column) -> Column:
    """NaN and infinities become null."""
    x = col(c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None)).otherwise(x)


def series(by: str | list[str], ts: str) -> WindowSpec:
    keys = [by] if isinstance(by, str) else list(by)
    return Window.partitionBy(*keys).orderBy(ts)


def last_n(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def gated(value: Column, x: str | Column, w: WindowSpec, need: int) -> Column:
    """`value`, but null until the frame holds `need` non-null observations of `x`."""
    return F.when(F.count(col(x)).over(w) >= need, value)


def to_text(df: DataFrame) -> DataFrame:
    """Dates and timestamps as ISO text, so that results compare equal across engines."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)
