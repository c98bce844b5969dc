"""News and market relationships. Everything is aggregated per test before anything is ordered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.distributions import t_two_sided
from marketloom.functions.expr import div
from marketloom.operators.stats import correlation_p


def sentiment_relationship(events: DataFrame) -> DataFrame:
    """Polarity against abnormal return, per horizon."""
    polarity = F.when(F.col("sentiment") == "POSITIVE", 1.0).when(F.col("sentiment") == "NEGATIVE", -1.0).otherwise(0.0)
    rows = events.where(F.col("sentiment").isNotNull() & F.col("abnormal_return").isNotNull()).withColumn("_p", polarity)
    # a constant polarity or return has no correlation
    spread = (F.max("_p") > F.min("_p")) & (F.max("abnormal_return") > F.min("abnormal_return"))
    g = rows.groupBy("horizon").agg(F.count(F.lit(1)).alias("sample_size"), F.when(spread, F.corr("_p", "abnormal_return")).alias("coefficient"))
    return g.where(F.col("sample_size") >= 2).withColumn("p_value", correlation_p("coefficient", "sample_size"))


def topic_relationships(events: DataFrame, min_side: int = 10) -> DataFrame:
    """Welch test of each topic against all other topics, per horizon, from one aggregation.

    The other side is the total minus the topic, so no row is read twice.
    """
    x = F.col("abnormal_return")
    rows = events.where(F.col("topic").isNotNull() & x.isNotNull())
    t = rows.groupBy("horizon", "topic").agg(F.count(x).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("ss"))
    w = Window.partitionBy("horizon")
    total, mean = F.sum("n").over(w), F.sum(F.col("n") * F.col("mean")).over(w) / F.sum("n").over(w)
    t = t.withColumns({"_N": total, "_mean": mean}).withColumn("_ss", F.sum(F.col("ss") + F.col("n") * (F.col("mean") - F.col("_mean")) ** 2).over(w))
    m = F.col("_N") - F.col("n")
    rest = (F.col("_N") * F.col("_mean") - F.col("n") * F.col("mean")) / F.nullif(m, F.lit(0))
    t = t.withColumn("_m", m).withColumn("_rest", rest)
    rest_ss = F.col("_ss") - F.col("ss") - F.col("n") * (F.col("mean") - F.col("_mean")) ** 2 - F.col("_m") * (F.col("_rest") - F.col("_mean")) ** 2
    t = t.where((F.col("n") >= min_side) & (F.col("_m") >= min_side)).withColumn("_rss", F.greatest(rest_ss, F.lit(0.0)))
    a, b = F.col("ss") / (F.col("n") - 1) / F.col("n"), F.col("_rss") / (F.col("_m") - 1) / F.col("_m")
    t = t.withColumns(
        {
            "coefficient": F.col("mean") - F.col("_rest"),
            "t_stat": div(F.col("mean") - F.col("_rest"), F.sqrt(a + b)),
            "_dof": div((a + b) ** 2, a**2 / (F.col("n") - 1) + b**2 / (F.col("_m") - 1)),
        }
    )
    return t.select("horizon", "topic", F.col("n").alias("sample_size"), "coefficient", "t_stat", t_two_sided("t_stat", "_dof").alias("p_value"))


def benjamini_hochberg(tests: DataFrame, family: list[str], p: str = "p_value", out: str = "adjusted_p_value") -> DataFrame:
    """False discovery rate within a family of tests (one row per test, so a family is small)."""
    order = Window.partitionBy(*family).orderBy(p)
    n = F.count(p).over(Window.partitionBy(*family))
    rows = tests.where(F.col(p).isNotNull()).withColumn("_adj", F.col(p) * n / F.row_number().over(order))
    down = Window.partitionBy(*family).orderBy(F.desc(p), F.desc("_adj")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.least(F.min("_adj").over(down), F.lit(1.0))).drop("_adj")


def finding_text(name: Column, p: Column, coef: Column) -> Column:
    """Wording that never claims a cause."""
    direction = F.when(coef > 0, "positive").otherwise("negative")
    strength = F.when(F.abs(coef) > 0.5, "strong").otherwise("weak to moderate")
    none = F.format_string("%s: returns afterwards do not differ beyond chance (p=%.3f)", name, p)
    some = F.format_string(
        "%s goes together with returns afterwards: %s, %s (coefficient %.3f, p=%.3f). An observation, neither a cause nor a forecast.",
        name, direction, strength, coef, p,
    )
    return F.when(p.isNull() | F.isnan(p), "Too little data for a finding").when(p > 0.05, none).otherwise(some)
