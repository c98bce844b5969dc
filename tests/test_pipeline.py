"""Validation, point-in-time checks, datasets, keyed writes, drift, alerts, text, models."""

import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.operators import audit as A
from marketloom.operators import events as E
from marketloom.operators import models as M
from marketloom.operators import monitor as N
from marketloom.operators import pit
from marketloom.operators import text as T
from marketloom.operators import validate as Q
from marketloom.session import scratch_path
from marketloom.sources import payloads as P
from marketloom.sources import versions as W

D = dt.date


def test_market_rows(spark):
    rows = [("A", D(2020, 1, 1), 1.0, 2.0, 0.5, 1.5, 10), ("A", D(2020, 1, 2), 1.0, 0.4, 0.5, 1.5, -1), ("A", D(2020, 1, 3), 1.0, 2.0, 0.5, 1.5, -5), ("A", D(2020, 1, 4), None, 2.0, 0.5, 1.5, 5)]
    df = Q.check_market(spark.createDataFrame(rows, "symbol string, ts date, open double, high double, low double, close double, volume bigint"))
    assert Q.valid_rows(df).count() == 1
    assert sorted(r.check_name for r in Q.findings(df).collect()) == ["high_less_than_low", "missing_fields", "negative_volume"]
    now = F.lit("2020-02-01").cast("timestamp")
    assert Q.results(df, "m", "suite", now).count() == 3
    assert [r.status for r in Q.results(df.limit(1), "m", "suite", now).collect()] == ["PASSED"]


def test_leakage_raises(spark):
    df = spark.createDataFrame([(D(2020, 3, 31), D(2020, 5, 10)), (D(2020, 6, 30), D(2020, 5, 10))], "prediction_time date, filing_date date")
    with pytest.raises(pit.LeakageError):
        pit.assert_no_leakage(df, "prediction_time", ["filing_date"])
    assert pit.assert_no_leakage(df.where("prediction_time > filing_date"), "prediction_time", ["filing_date"]).count() == 1


def test_cutoff_hides_the_future(spark):
    t = dt.datetime
    news = spark.createDataFrame([(1, t(2020, 1, 1, 9)), (2, t(2020, 1, 1, 13))], "article_id int, published_at timestamp")
    bars = spark.createDataFrame([("A", D(2020, 1, 1)), ("A", D(2020, 1, 2))], "symbol string, ts date")
    cut = F.lit("2020-01-01 12:00:00").cast("timestamp")
    assert [r.article_id for r in pit.known_by(news, "news", cut).collect()] == [1]
    assert [r.ts for r in pit.known_by(bars, "market", cut).collect()] == [D(2020, 1, 1)]


def test_partition_boundaries(spark):
    days = ["2020-12-31", "2021-01-01", "2022-12-31", "2023-01-01"]
    df = spark.createDataFrame([(D.fromisoformat(d),) for d in days], "prediction_time date")
    assert [r.partition for r in pit.assign_partitions(df).orderBy("prediction_time").collect()] == ["TRAIN", "VALIDATION", "VALIDATION", "TEST"]


def test_embargo_folds(spark):
    df = spark.createDataFrame([(D(2020, 1, 1) + dt.timedelta(days=i), i) for i in range(20)], "t date, i int")
    rows = pit.embargo_folds(df, "t", n_splits=2, gap=2, test_size=4).join(df, "t").toPandas()
    got = {(f, r): sorted(g["i"]) for (f, r), g in rows.groupby(["fold", "role"])}
    assert got == {(0, "VALIDATION"): list(range(16, 20)), (0, "TRAIN"): list(range(14)), (1, "VALIDATION"): list(range(12, 16)), (1, "TRAIN"): list(range(10))}


def test_walk_forward_bounds():
    first = D(2020, 1, 1)
    b = pit.walk_forward_bounds(first, first + dt.timedelta(days=99), 10, 10, 2)
    assert b[0] == (1, first, first + dt.timedelta(days=10), first + dt.timedelta(days=12), first + dt.timedelta(days=22))
    assert all(x[1] == first for x in b) and b[-1][4] <= first + dt.timedelta(days=99)
    assert pit.walk_forward_bounds(first, first + dt.timedelta(days=99), 10, 10, 2, "rolling")[1][1] == first + dt.timedelta(days=10)


def test_targets(spark):
    df = spark.createDataFrame([("A", D(2020, 1, i + 1), float(c)) for i, c in enumerate([100, 110, 121, 100, 90])], "symbol string, ts date, close double")
    out = pit.targets(df, 2).orderBy("prediction_time").toPandas()
    assert out["target_value"].tolist() == pytest.approx([0.21, 100 / 110 - 1, 90 / 121 - 1])
    assert pit.targets(df, 2, "classification_direction").orderBy("prediction_time").toPandas()["target_value"].tolist() == [1.0, 0.0, 0.0]


def test_upsert_is_idempotent_and_last_wins(spark):
    schema = "symbol string, ts date, year int, close double, note string, seq int"
    one = spark.createDataFrame([("A", D(2020, 1, 1), 2020, 100.0, "first", 1), ("B", D(2021, 1, 1), 2021, 5.0, "first", 1)], schema)
    two = spark.createDataFrame([("A", D(2020, 1, 1), 2020, 101.0, "second", 1), ("A", D(2020, 1, 1), 2020, 102.0, "third", 2), ("A", D(2020, 1, 2), 2020, 7.0, "new", 1)], schema)
    path = scratch_path(spark, "t")
    args = (["symbol", "ts", "year"], ["close"], "year", ["seq"])
    W.upsert_table(spark, path, one.drop("seq").withColumn("seq", F.lit(0)), *args)
    for _ in range(2):
        out = W.upsert_table(spark, path, two, *args)
        assert {(r.symbol, r.ts): (r.close, r.note) for r in out.collect()} == {("A", D(2020, 1, 1)): (102.0, "first"), ("A", D(2020, 1, 2)): (7.0, "new"), ("B", D(2021, 1, 1)): (5.0, "first")}


def test_payloads(spark):
    daily = {"Time Series (Daily)": {"2020-01-02": {"1. open": "1", "2. high": "2", "3. low": "0.5", "4. close": "1.5", "5. volume": "10"}}}
    df = spark.createDataFrame([("A", json.dumps(daily))], "symbol string, payload string")
    assert P.daily_bars(df).first().close == 1.5
    daily["Time Series (Daily)"]["2020-01-03"] = {"1. open": "x", "2. high": "2", "3. low": "0.5", "4. close": "1.5", "5. volume": "10"}
    bad = spark.createDataFrame([("A", json.dumps(daily))], "symbol string, payload string")
    with pytest.raises(Exception, match="Failed to parse"):
        P.daily_bars(bad).collect()
    macro = {"observations": [{"date": "2020-01-01", "value": ".", "realtime_start": "2020-02-01", "realtime_end": "9999-12-31"}, {"date": "2020-02-01", "value": "5.33", "realtime_start": "2020-03-01", "realtime_end": "9999-12-31"}, {"date": "oops", "value": "1", "realtime_start": "2020-03-01", "realtime_end": "9999-12-31"}]}
    out = P.macro_observations(spark.createDataFrame([("S", json.dumps(macro))], "series_id string, payload string")).orderBy("observation_date").collect()
    assert [r.value for r in out] == [None, 5.33]
    facts = {"facts": {"us-gaap": {"Revenues": {"units": {"USD": [{"end": "2020-03-31", "val": 7, "accn": "a", "fy": 2020, "fp": "Q1"}, {"val": 1, "accn": "b"}]}}, "Odd": {"units": {"USD": [{"end": "2020-03-31", "val": 1, "accn": "a"}]}}}}}
    rows = P.company_facts(spark.createDataFrame([(320193, json.dumps(facts))], "cik bigint, payload string"))
    one = P.mapped_facts(rows).collect()
    assert len(one) == 1 and one[0].cik == "0000320193" and one[0].value == 7.0 and one[0].metric == "Revenue" and rows.count() == 2


def test_audit_reasons(spark):
    rng = np.random.default_rng(0)
    n = 100
    good = rng.normal(size=n)
    ext = np.r_[np.full(n - 1, 0.02) + rng.uniform(0, 0.01, n - 1), 1e6]
    miss = np.where(np.arange(n) < 40, np.nan, good)
    inf = np.where(np.arange(n) == 3, np.inf, good)
    df = spark.createDataFrame(pd.DataFrame({"good": good, "constant": 1.0, "missing": miss, "inf": inf, "ext": ext}))
    out = {r.feature: r.rejection_reason for r in A.quality_audit(df, ["good", "constant", "missing", "inf", "ext"]).collect()}
    assert out["good"] is None and "Constant" in out["constant"] and "Missingness" in out["missing"] and "infinite" in out["inf"]


def test_selection_rejects_the_copy_and_the_noise(spark):
    rng = np.random.default_rng(1)
    n = 3000
    a = rng.normal(size=n)
    pdf = pd.DataFrame({"t": pd.date_range("2000-01-01", periods=n).date, "a": a, "copy": a + rng.normal(0, 0.05, n), "y": a * 2 + rng.normal(0, 0.1, n)})
    out = {r.feature: r.status for r in A.select_features(spark.createDataFrame(pdf), ["a", "copy"], "y", "t").collect()}
    assert out == {"a": "SELECTED", "copy": "REJECTED"}


def test_drift_and_alerts(spark):
    rng = np.random.default_rng(2)
    pdf = pd.concat([pd.DataFrame({"feature": f, "sample": s, "value": rng.normal(m, 1, 1000)}) for f, s, m in (("same", "REF", 0), ("same", "CUR", 0), ("moved", "REF", 0), ("moved", "CUR", 2))])
    out = {r.feature: (r.status, r.severity) for r in N.drift(spark.createDataFrame(pdf)).collect()}
    assert out == {"same": ("OK", None), "moved": ("DRIFTED", "CRITICAL")}
    ref, cur = (pdf[(pdf.feature == "moved") & (pdf["sample"] == s)]["value"].to_numpy() for s in ("REF", "CUR"))
    e = np.percentile(ref, np.linspace(0, 100, 11))
    p, q = np.histogram(ref, e)[0] / 1000, np.histogram(cur, e)[0] / 1000
    p, q = np.where(p == 0, 1e-4, p), np.where(q == 0, 1e-4, q)
    got = {r.feature: r.value for r in N.psi(spark.createDataFrame(pdf)).collect()}
    assert got["moved"] == pytest.approx(((q - p) * np.log(q / p)).sum())
    empty = spark.createDataFrame([], "alert_id string, metric string, source string, observed_value double, threshold double, severity string, message string, timestamp timestamp, status string")
    sig = N.drift_signals(N.drift(spark.createDataFrame(pdf)), F.lit("2020-01-01").cast("timestamp"))
    first = N.update_alerts(empty, sig)
    assert [(r.metric, r.status) for r in first.collect()] == [("drift_moved", "ACTIVE")]
    calm = sig.withColumn("is_firing", F.lit(False))
    assert [(r.metric, r.status) for r in N.update_alerts(first, calm).collect()] == [("drift_moved", "RESOLVED")]
    assert N.update_alerts(first, sig).count() == 1


def test_text(spark):
    df = spark.createDataFrame([(1, "<p>Profits &amp; growth ﬁrst</p>\n\n\n\nApple  beat [+120 chars]"), (2, "Zoom warning: shares down, plunge"), (3, None)], "article_id int, t string")
    clean = [r.c for r in df.select(T.normalize("t").alias("c"), "article_id").orderBy("article_id").collect()]
    assert clean[0] == "Profits & growth first \n\nApple beat" and clean[2] == ""
    assert [r.sentiment_label for r in T.sentiment(df, "t").orderBy("article_id").collect()] == ["POSITIVE", "NEGATIVE", "NEUTRAL"]
    kb = spark.createDataFrame(T.KNOWLEDGE_BASE, "name string, canonical_name string, ticker string")
    names = spark.createDataFrame([("Apple", "ORG"), ("Zoom", "ORG")], "term string, label string")
    res = {r.article_id: (r.resolution_method, r.canonical_entity_id) for r in T.resolve(T.entities(df, "article_id", "t", names), "article_id", kb).collect()}
    assert res == {1: ("exact_match_kb", "AAPL"), 2: ("unresolved_ambiguous", None)}
    tops = {(r.article_id, r.topic_name): r.topic_score for r in T.topics(df, "article_id", "t").collect()}
    assert tops == {(2, "Market Movement"): 0.33}


def test_sessions(spark):
    cal = E.trading_calendar(spark, "2021-01-01", "2021-12-31")
    utc = dt.datetime
    rows = [(1, utc(2021, 7, 1, 13, 0)), (2, utc(2021, 7, 1, 15, 0)), (3, utc(2021, 7, 2, 21, 0)), (4, utc(2021, 7, 4, 12, 0))]
    out = {r.article_id: (r.market_session_relation, r.target_observation_date) for r in E.align(spark.createDataFrame(rows, "article_id int, published_at timestamp"), cal).collect()}
    # 5 July 2021 is the observed holiday
    assert out == {1: ("PRE_MARKET", D(2021, 7, 1)), 2: ("INTRADAY", D(2021, 7, 1)), 3: ("POST_MARKET", D(2021, 7, 6)), 4: ("WEEKEND_HOLIDAY", D(2021, 7, 6))}


def test_metrics(spark):
    df = spark.createDataFrame([("m", 1, 1, 0.9), ("m", 1, 1, 0.6), ("m", 0, 1, 0.6), ("m", 0, 0, 0.2)], "model string, actual int, prediction int, probability double")
    c = M.classification_metrics(df, ["model"]).first()
    assert (c.TP, c.FP, c.TN, c.FN) == (2, 1, 1, 0) and c.Precision == pytest.approx(2 / 3)
    p = M.probability_metrics(df, ["model"]).first()
    assert p.ROC_AUC == pytest.approx(0.875) and p.PR_AUC == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)
    with pytest.raises(M.HoldoutLocked):
        M.evaluate_holdout(df, ["model"], False, True)


def test_shuffle_is_a_permutation(spark):
    df = spark.range(500).withColumn("x", F.col("id") * 2).repartition(4)
    out = M.shuffled(df, "x", ["id"], 1).toPandas()
    assert sorted(out["x"]) == [2 * i for i in range(500)] and (out["x"] != out["id"] * 2).mean() > 0.9


def test_linear_attributions_add_up(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"id": range(200), "a": rng.normal(size=200), "b": rng.normal(3, 2, 200)})
    pdf["y"] = 1.5 * pdf["a"] - pdf["b"] + 4
    df = spark.createDataFrame(pdf)
    model = M.pipeline("linear_regression", ["a", "b"], "y").fit(df)
    local = M.linear_attributions(model, df, ["a", "b"], ["id"]).join(df, "id").toPandas()
    assert np.allclose(local["prediction"], local["y"]) and np.allclose(local["base_value"] + local["attributions"].map(lambda m: sum(m.values())), local["y"])
