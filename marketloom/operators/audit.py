"""Feature audit and selection. Features are unpivoted once; all per-feature statistics come from counts."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.expr import finite
from marketloom.operators.neighbours import neighbour_information
from marketloom.operators.ordering import positions, quantiles
from marketloom.operators.pit import leakage_report
from marketloom.session import materialize


def long_features(df: DataFrame, features: list[str], keep: list[str] = ()) -> DataFrame:
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in features]).unpivot(list(keep), features, "feature", "value")


def quality_audit(df: DataFrame, features: list[str], max_missing: float = 0.3) -> DataFrame:
    """VALIDATED or REJECTED with the first failing rule, per feature.

    Quantile and mode come from value counts, so one feature's column is never sorted by one task.
    """
    long = long_features(df, features)
    missing = F.col("value").isNull() | F.isnan("value")
    clean = F.when(~missing, F.col("value"))
    base = long.groupBy("feature").agg(
        F.avg(missing.cast("double")).alias("missing_rate"), F.count(clean).alias("_n"),
        F.count_if(F.abs(clean) == float("inf")).alias("_inf"), F.stddev_samp(finite("value")).alias("std_dev"), F.max(finite("value")).alias("max_value"),
    )
    pos = positions(long.withColumn("value", finite("value")), ["feature"], "value")
    at = 0.99 * (F.col("n_total") - 1)
    hit = lambda k: F.max(F.when((F.col("n_before") <= k) & (k < F.col("n_before") + F.col("n")), F.col("value")))
    top = pos.groupBy("feature").agg(
        (F.max("n") / F.max("n_total")).alias("top_share"), F.max("n_total").alias("_t"), hit(F.floor(at)).alias("_lo"), hit(F.ceil(at)).alias("_hi")
    )
    frac = 0.99 * (F.col("_t") - 1)
    top = top.withColumn("p99", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (frac - F.floor(frac))).drop("_lo", "_hi", "_t")
    j = base.join(top, "feature", "left")
    pct = lambda c: F.format_string("%.1f%%", F.col(c) * 100)
    limit = f"{max_missing:.1%}"
    # The first two words of four of the reasons.
    reason = (
        F.when(F.col("missing_rate") > max_missing, F.concat(F.lit("Missingness rate "), pct("missing_rate"), F.lit(f", {limit} allowed")))
        .when(F.col("_n") == 0, "No value at all")
        .when(F.col("_inf") > 0, "Holds infinite values")
        .when(F.col("std_dev").isNull() | (F.col("std_dev") == 0), "Constant Variance: one value throughout")
        .when(F.col("top_share") > 0.99, F.concat(F.lit("One value makes up "), pct("top_share"), F.lit(" of the rows")))
        .when((F.col("p99") > 0.01) & (F.col("max_value") > 100 * F.col("p99")), "Extreme Outliers: the maximum is more than a hundred times the 99th percentile")
    )
    out = j.withColumn("rejection_reason", reason)
    status = F.when(F.col("rejection_reason").isNull(), "VALIDATED").otherwise("REJECTED")
    return out.withColumn("status", status).select("feature", "missing_rate", "std_dev", "top_share", "p99", "max_value", "status", "rejection_reason")


def complete_rows(df: DataFrame, features: list[str], target: str) -> DataFrame:
    return df.select("*").na.drop(subset=[*features, target])


def mutual_information(df: DataFrame, features: list[str], target: str, bins: int = 10, by: list[str] = (), corrected: bool = False) -> DataFrame:
    """Mutual information of quantile-binned feature and target, in nats.

    A cheaper estimate than `neighbour_information`: it needs counts only. It is biased upward by about (cells)/(2n);
    `corrected` subtracts that.
    """
    by = list(by)
    probs = {f"_e{i}": i / bins for i in range(1, bins)}
    bin_of = lambda v, e: F.size(F.filter(e, lambda x: x < F.col(v)))
    keys = [*by, "feature"]
    rows = df.select(*by, F.col(target).cast("double").alias("_target"), *features)
    # one pass finds the cut points of all features and of the target
    edges = quantiles(long_features(rows, [*features, "_target"], by), keys, "value", probs).select(*keys, F.array(*probs).alias("_e"))
    edges = materialize(edges, "edges")
    ye = edges.where("feature = '_target'").select(*by, F.lit(1).alias("_one"), F.col("_e").alias("_ye"))
    xe = edges.where("feature <> '_target'").select(*keys, F.col("_e").alias("_xe"))
    rows = rows.withColumn("_one", F.lit(1)).join(ye, [*by, "_one"]).withColumn("_by", bin_of("_target", "_ye"))
    long = long_features(rows, features, [*by, "_by"])
    cells = long.join(xe, keys).withColumn("_bx", bin_of("value", "_xe")).groupBy(*keys, "_bx", "_by").agg(F.count(F.lit(1)).alias("_c"))
    w = lambda *k: Window.partitionBy(*keys, *k)
    n, nx, ny = F.sum("_c").over(w()), F.sum("_c").over(w("_bx")), F.sum("_c").over(w("_by"))
    cells = cells.withColumns({"_n": n, "_nx": nx, "_ny": ny})
    term = F.col("_c") / F.col("_n") * F.ln(F.col("_c") * F.col("_n") / (F.col("_nx") * F.col("_ny")))
    g = cells.groupBy(*keys).agg(
        F.sum(term).alias("_mi"), F.max("_n").alias("n"), F.count_distinct("_bx").alias("_kx"), F.count_distinct("_by").alias("_ky")
    )
    bias = (F.col("_kx") - 1) * (F.col("_ky") - 1) / (2.0 * F.col("n"))
    mi = F.greatest(F.col("_mi") - bias, F.lit(0.0)) if corrected else F.col("_mi")
    return g.select(*keys, "n", mi.alias("mutual_information"))


def feature_correlations(df: DataFrame, features: list[str]) -> DataFrame:
    """Absolute correlation of each pair of feature columns from one aggregate over the rows."""
    pairs = list(combinations(features, 2))
    one = df.agg(*[F.abs(F.corr(a, b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(cells).alias("p")).select("p.*")


def redundant(df: DataFrame, features: list[str], mi: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Features correlated above the threshold with one of higher mutual information."""
    score = mi.select("feature", "mutual_information")
    pairs = feature_correlations(df, features).where(F.col("r") > threshold)
    j = pairs.join(score.select(F.col("feature").alias("a"), F.col("mutual_information").alias("mi_a")), "a").join(
        score.select(F.col("feature").alias("b"), F.col("mutual_information").alias("mi_b")), "b"
    )
    b_wins = F.col("mi_b") > F.col("mi_a")
    losers = j.select(F.when(b_wins, F.col("a")).otherwise(F.col("b")).alias("feature"), F.when(b_wins, F.col("b")).otherwise(F.col("a")).alias("winner"), "r")
    return losers.groupBy("feature").agg(F.min("winner").alias("winner"), F.max("r").alias("max_correlation"))


def temporal_stability(df: DataFrame, features: list[str], target: str, at: str, folds: int = 3, need: int = 2, threshold: float = 1e-4, bins: int = 10) -> DataFrame:
    """Features whose corrected mutual information survives in at least `need` consecutive parts of time."""
    times = positions(df.select(F.lit(1).alias("_one"), at), ["_one"], at)
    part = times.select(at, F.floor(F.col("n_before") * folds / F.col("n_total")).cast("int").alias("fold"))
    mi = mutual_information(df.join(part, at), features, target, bins, ["fold"], corrected=True)
    ok = (F.col("n") > 10) & (F.col("mutual_information") > threshold)
    return mi.groupBy("feature").agg(F.count_if(ok).alias("stable_folds")).withColumn("is_stable", F.col("stable_folds") >= need)


def select_features(df: DataFrame, features: list[str], target: str, at: str, correlation: float = 0.85, estimator: str = "neighbours") -> DataFrame:
    """SELECTED or REJECTED with the reason, per feature. Stability needs more than 100 rows. The information of a feature is
    estimated by nearest neighbours, or with `estimator="bins"` from the counts of quantile bins."""
    clean = materialize(complete_rows(df, features, target), "selection")
    mi = neighbour_information(clean, features, target) if estimator == "neighbours" else mutual_information(clean, features, target)
    lost = redundant(clean, features, mi, correlation)
    stable = temporal_stability(clean, features, target, at)
    j = mi.join(lost, "feature", "left").join(stable, "feature", "left")
    reason = F.when(F.col("winner").isNotNull(), F.concat(F.lit("Redundant: moves with "), "winner", F.lit(", which tells more about the target"))).when(
        (F.col("n") > 100) & ~F.coalesce("is_stable", F.lit(False)), "Unstable: too few parts of the time in which it tells anything about the target"
    )
    out = j.withColumn("rejection_reason", reason)
    status = F.when(F.col("rejection_reason").isNotNull(), "REJECTED").when(F.col("n") > 100, "SELECTED").otherwise("VALIDATED")
    return out.withColumn("status", status).select("feature", "mutual_information", "stable_folds", "status", "rejection_reason")


def build_features(
    calculated: DataFrame, feature_set: str, features: list[str], prediction: str, available: list[str], target: str | None, built_at: Column
) -> tuple[DataFrame, DataFrame]:
    """Leakage, audit and selection over calculated features: (feature statuses, run record).

    The features are written once and read by all checks.
    """
    stored = materialize(calculated, "features")
    leaks = leakage_report(stored, prediction, available)
    audit = quality_audit(stored, features)
    statuses = audit.select("feature", "status", "rejection_reason")
    if target:
        passed = [r.feature for r in audit.where("status = 'VALIDATED'").select("feature").collect()]
        if passed:
            chosen = select_features(stored, sorted(passed), target, prediction)
            statuses = statuses.join(chosen.select("feature", F.col("status").alias("_s"), F.col("rejection_reason").alias("_r")), "feature", "left")
            statuses = statuses.select("feature", F.coalesce("_s", "status").alias("status"), F.coalesce("_r", "rejection_reason").alias("rejection_reason"))
    one = lambda d: d.withColumn("feature_set", F.lit(feature_set))
    record = (
        one(stored.agg(F.count(F.lit(1)).alias("rows")))
        .join(one(leaks.agg(F.sum("leaked_rows").alias("leaked_rows"))), "feature_set")
        .join(one(statuses.agg(F.count(F.lit(1)).alias("features"), F.count_if(F.col("status") == "REJECTED").alias("rejected"), F.count_if(F.col("status") == "SELECTED").alias("selected"))), "feature_set")
        .withColumn("status", F.when(F.col("leaked_rows") > 0, "FAILED").otherwise("SUCCESS"))
        .withColumn("built_at", built_at)
    )
    return statuses, record
