"""Point-in-time joins.

The left side is reduced to its distinct (key, time) pairs and the right side to one row per pair
before the shuffle, so repeated times of a hot key cost nothing. The running "latest row" is computed
inside time buckets; the latest row of all earlier buckets is carried in from one summary row per
bucket. No task ever holds the whole history of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    left_ts: str,
    right_ts: str,
    cols: list[str],
    direction: str = "backward",
    bucket: str = "month",
    tie: list[str] | None = None,
) -> DataFrame:
    """Left join to the nearest right row at or before (after, if forward) the left time.

    `tie` orders right rows of equal key and time; the highest wins (default: the payload itself).
    """
    backward = direction == "backward"
    payload = F.struct(*cols)
    kind = right.select(payload.alias("p")).schema["p"].dataType
    order = F.struct(*tie, *cols) if tie else payload
    marks = left.where(F.col(left_ts).isNotNull()).select(
        *by, F.col(left_ts).alias("_t"), F.lit(True).alias("_asked"), F.lit(None).cast(kind).alias("_p"), F.lit(None).cast(right.select(order.alias("o")).schema["o"].dataType).alias("_o")
    ).unionByName(
        right.where(F.col(right_ts).isNotNull()).select(
            *by, F.col(right_ts).cast(left.schema[left_ts].dataType).alias("_t"), F.lit(False).alias("_asked"), payload.alias("_p"), order.alias("_o")
        )
    )
    times = (
        marks.groupBy(*by, "_t")
        .agg(F.max("_asked").alias("_asked"), F.max_by("_p", "_o").alias("_p"))
        .withColumn("_bucket", F.date_trunc(bucket, F.col("_t").cast("timestamp")))
    )
    def along(c: str) -> Column:
        return F.col(c).asc() if backward else F.col(c).desc()

    inside = Window.partitionBy(*by, "_bucket").orderBy(along("_t")).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*by).orderBy(along("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    pick = F.max_by if backward else F.min_by
    carry = (
        times.groupBy(*by, "_bucket")
        .agg(pick("_p", F.when(F.col("_p").isNotNull(), F.col("_t"))).alias("_tail"))
        .select(*by, "_bucket", F.last("_tail", ignorenulls=True).over(earlier).alias("_carry"))
    )
    resolved = (
        times.withColumn("_hit", F.last("_p", ignorenulls=True).over(inside))
        .where("_asked")
        .join(carry, [*by, "_bucket"])
        .select(*by, F.col("_t").alias(left_ts), F.coalesce("_hit", "_carry").alias("_hit"))
    )
    return left.join(resolved, [*by, left_ts], "left").select(*[left[c] for c in left.columns], *[F.col(f"_hit.{c}").alias(c) for c in cols])
