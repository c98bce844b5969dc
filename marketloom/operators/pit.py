"""Point-in-time safety, targets, and supervised datasets."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.expr import div, series
from marketloom.session import materialize


class LeakageError(ValueError):
    """A row knows something before it was available."""


def leakage_report(df: DataFrame, prediction: str, available: list[str]) -> DataFrame:
    """Rows per availability column that were published after the prediction: one aggregate for all columns."""
    counts = df.agg(*[F.count_if(F.col(c) > F.col(prediction)).alias(c) for c in available])
    return counts.unpivot([], available, "availability_column", "leaked_rows")


def assert_no_leakage(df: DataFrame, prediction: str, available: list[str]) -> DataFrame:
    bad = [r for r in leakage_report(df, prediction, available).collect() if r.leaked_rows]
    if bad:
        raise LeakageError("; ".join(f"{r.availability_column}: {r.leaked_rows} rows" for r in bad))
    return df


def dataset_violations(df: DataFrame, available: list[str], at: str = "prediction_time", until: str = "target_end_time") -> DataFrame:
    checks = {f"{c}_after_{at}": F.count_if(F.col(c) > F.col(at)) for c in available}
    checks["target_not_after_prediction"] = F.count_if(F.col(until) <= F.col(at))
    counts = df.agg(*[v.alias(k) for k, v in checks.items()])
    return counts.unpivot([], list(checks), "check_name", "violations")


# The time column that decides what was known, per table.
KNOWN_AT = {"market": "ts", "news": "published_at", "prediction": "prediction_time", "filing": "filing_date"}


def known_by(df: DataFrame, table: str, cutoff: Column) -> DataFrame:
    """Rows known at the cutoff. A plain comparison on a stored column, so Parquet prunes row groups.

    Filings and daily bars are dated, hence compared with the cutoff's day.
    """
    at = KNOWN_AT[table]
    limit = F.to_date(cutoff) if dict(df.dtypes)[at] == "date" else cutoff
    return df.where(F.col(at) <= limit).withColumn("data_cutoff_time", cutoff)


def targets(df: DataFrame, h: int, kind: str = "regression_return", by: str = "symbol", ts: str = "ts", price: str = "close") -> DataFrame:
    """target_value over the next h rows, with the time it was realised; rows without a future are dropped."""
    w = series(by, ts)
    ret = div(F.lead(price, h).over(w), price) - 1
    out = df.select(by, F.col(ts).alias("prediction_time"), F.lead(ts, h).over(w).alias("target_end_time"), ret.alias("target_value"))
    out = out.where(F.col("target_value").isNotNull())
    if kind == "classification_direction":
        out = out.withColumn("target_value", F.when(F.col("target_value") > 0, 1.0).otherwise(0.0))
    return out


def assign_partitions(
    df: DataFrame,
    at: str = "prediction_time",
    train_end: str = "2020-12-31",
    validation: tuple[str, str] = ("2021-01-01", "2022-12-31"),
    test_start: str = "2023-01-01",
) -> DataFrame:
    """Chronological partitions; rows between the boundaries are dropped."""
    day = lambda s: F.lit(s).cast("timestamp")
    t = F.col(at).cast("timestamp")
    label = (
        F.when(t <= day(train_end), "TRAIN")
        .when((t >= day(validation[0])) & (t <= day(validation[1])), "VALIDATION")
        .when(t >= day(test_start), "TEST")
    )
    return df.withColumn("partition", label).where(F.col("partition").isNotNull())


def build_dataset(features: DataFrame, target: DataFrame, available: list[str], by: str = "symbol", **boundaries) -> DataFrame:
    """Features joined to targets, checked for leakage, and split by time. The joined rows are written once and read by the check
    and the caller."""
    df = materialize(features.join(target, [by, "prediction_time"]), "dataset")
    bad = [r for r in dataset_violations(df, available).collect() if r.violations]
    if bad:
        raise LeakageError("; ".join(f"{r.check_name}: {r.violations} rows" for r in bad))
    return assign_partitions(df, **boundaries)


def embargo_folds(df: DataFrame, at: str, n_splits: int = 5, gap: int = 0, test_size: int | None = None) -> DataFrame:
    """(time, fold, role) for the last `n_splits` blocks of times; training ends `gap` times earlier.

    Folds count distinct times, so their number is bounded by the calendar, not by the rows; callers join
    rows to the result on the time.
    """
    times = df.select(at).where(F.col(at).isNotNull()).distinct()
    idx = F.row_number().over(Window.orderBy(at)) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy())
    size = F.lit(test_size) if test_size else F.floor(F.col("_n") / (n_splits + 1))
    times = times.withColumn("_i", idx).withColumn("_n", n).withColumn("_size", size.cast("long"))
    fold = F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1)))
    start = F.col("_n") - (F.col("fold") + 1) * F.col("_size")
    role = F.when((F.col("_i") >= start) & (F.col("_i") < start + F.col("_size")), "VALIDATION").when(F.col("_i") < start - gap, "TRAIN")
    return (
        times.withColumn("fold", fold)
        .where((start - gap > 0) & (F.col("_size") > 0))
        .withColumn("role", role)
        .where(F.col("role").isNotNull())
        .select(at, "fold", "role")
    )


def walk_forward_bounds(
    first: date | datetime, last: date | datetime, train_window: int, step: int, gap: int = 0, mode: str = "expanding"
) -> list[tuple]:
    """(fold, train_start, train_end, test_start, test_end), half-open intervals in days."""
    out, start = [], first
    end = first + timedelta(days=train_window)
    fold = 1
    while end + timedelta(days=gap) < last:
        test_start = end + timedelta(days=gap)
        out.append((fold, start, end, test_start, min(test_start + timedelta(days=step), last)))
        start = start + timedelta(days=step) if mode == "rolling" else start
        end += timedelta(days=step)
        fold += 1
    return out


def walk_forward_folds(df: DataFrame, at: str, train_window: int, step: int, gap: int = 0, mode: str = "expanding") -> DataFrame:
    """Rows labelled (fold, role). The fold table is a handful of rows computed from the time range."""
    lo, hi = df.agg(F.min(at), F.max(at)).first()
    bounds = walk_forward_bounds(lo, hi, train_window, step, gap, mode)
    kind = df.schema[at].dataType.simpleString()
    lit = lambda v: F.lit(v).cast(kind)
    t = F.col(at)
    roles = []
    for k, a, b, c, d in bounds:
        roles.append(F.when((t >= lit(a)) & (t < lit(b)), F.struct(F.lit(k).alias("fold"), F.lit("TRAIN").alias("role"))))
        roles.append(F.when((t >= lit(c)) & (t < lit(d)), F.struct(F.lit(k).alias("fold"), F.lit("TEST").alias("role"))))
    return df.withColumn("_f", F.explode(F.array_compact(F.array(*roles)))).select(*df.columns, "_f.fold", "_f.role")
