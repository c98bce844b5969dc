import datetime as dt

from pyspark.sql import functions as F

from marketloom.operators import joins as J
from marketloom.operators.asof import asof_join

D = lambda s: dt.datetime.fromisoformat(s)


def frames(spark):
    left = spark.createDataFrame([("a", D("2020-01-05"), 1), ("a", D("2020-03-31"), 2), ("a", D("2020-03-31"), 3), ("a", D("2020-06-01"), 4), ("b", D("2020-06-01"), 5)], "k string, t timestamp, id int")
    right = spark.createDataFrame([("a", D("2020-02-10"), 10.0), ("a", D("2020-03-31"), 20.0), ("a", D("2020-06-02"), 30.0), ("a", None, 99.0)], "k string, at timestamp, v double")
    return left, right


def test_backward_carries_over_empty_buckets(spark):
    left, right = frames(spark)
    out = {r.id: r.v for r in asof_join(left, right, ["k"], "t", "at", ["v"], bucket="month").collect()}
    assert out == {1: None, 2: 20.0, 3: 20.0, 4: 20.0, 5: None}


def test_bucket_size_does_not_change_the_result(spark):
    left, right = frames(spark)
    res = [sorted((r.id, r.v) for r in asof_join(left, right, ["k"], "t", "at", ["v"], bucket=b).select("id", "v").na.fill(-1.0).collect()) for b in ("day", "month", "year")]
    assert res[0] == res[1] == res[2]


def test_forward(spark):
    left, right = frames(spark)
    out = {r.id: r.v for r in asof_join(left, right, ["k"], "t", "at", ["v"], direction="forward").collect()}
    assert out == {1: 10.0, 2: 20.0, 3: 20.0, 4: 30.0, 5: None}


def test_nothing_from_the_future(spark):
    left, right = frames(spark)
    right = right.withColumn("seen", F.col("at"))
    bad = asof_join(left, right, ["k"], "t", "at", ["seen"]).where("seen > t").count()
    assert bad == 0


def test_macro_vintages(spark):
    d = dt.date
    macro = spark.createDataFrame(
        [("cpi", d(2020, 1, 1), 290.0, d(2020, 2, 15)), ("cpi", d(2020, 1, 1), 295.0, d(2020, 3, 15)), ("cpi", d(2020, 2, 1), 296.0, d(2020, 3, 10))],
        "series_id string, observation_date date, value double, realtime_start date",
    )
    days = spark.createDataFrame([(d(2020, 2, 1),), (d(2020, 2, 20),), (d(2020, 3, 12),), (d(2020, 3, 20),)], "ts date")
    by_release = [r.value for r in J.vintage_asof(days, macro, "ts", ["cpi"]).orderBy("ts").collect()]
    assert by_release == [None, 290.0, 296.0, 295.0]
    newest = [r.value for r in J.vintage_asof(days, macro, "ts", ["cpi"], latest_observation=True).orderBy("ts").collect()]
    assert newest == [None, 290.0, 296.0, 296.0]
