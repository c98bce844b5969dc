"""Keyed state: the same result however events are dealt to micro-batches, expiry, late rows, restarts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketloom.session import scratch_path
from marketloom.sources.versions import read_table, versions
from marketloom.streaming import keyed, live


def play(spark, turns, schema, build, keys, order, partition):
    """Runs the stream once per turn from the checkpoint before; the table, and how many rows came too late."""
    src, path, ck = (scratch_path(spark, n) for n in ("in", "table", "ck"))
    queries = []
    for rows in turns:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = live.read_files(spark, src, spark.createDataFrame([], schema).schema)
        queries.append(keyed.run(spark, build(stream), path, ck, keys, order, partition))
        live.drain(queries[-1])
    return read_table(spark, path), sum(r[3] for r in keyed.late_rows(queries)), len(versions(spark, path))


def day(n, hour=0):
    return dt.datetime(2020, 1, 1) + dt.timedelta(days=n, hours=hour)


ARTICLES = [("h", 1, day(0)), ("h", 2, day(5)), ("h", 3, day(20)), ("g", 4, day(3)), ("h", 5, day(40)), ("h", 6, day(41)), ("g", 7, day(3)), (None, 8, day(4)), ("z", 9, day(100)), (None, 11, day(6))]
DECIDED = {(1, "NEW", 1), (2, "DUPLICATE", 1), (3, "DUPLICATE", 1), (4, "NEW", 4), (7, "DUPLICATE", 4), (5, "NEW", 5), (6, "DUPLICATE", 5), (8, "NEW", 8), (11, "DUPLICATE", 8)}


@pytest.mark.parametrize("turns", [[ARTICLES[::-1]], [[ARTICLES[i] for i in (0, 3, 6, 7, 9)], [ARTICLES[i] for i in (5, 1, 2)] + [("g", 10, day(-90))], [ARTICLES[4], ARTICLES[8]]]])
def test_first_articles(spark, turns):
    """A hash is kept for 30 days; the last article waits for the watermark. One row of the second turn is far too late."""

    def build(stream):
        return keyed.first_articles(stream, ttl_days=30, delay="40 days").withColumn("part", F.lit(0))

    table, late, _ = play(spark, turns, "content_hash string, article_id long, published_at timestamp", build, ["article_id", "part"], ["published_at"], "part")
    assert {(r.article_id, r.decision, r.canonical_article_id) for r in table.collect()} == DECIDED
    assert late == (len(turns) > 1)


def signal(n, at, firing, value, metric="m"):
    return metric, "s", firing, value, 1.0, "WARNING" if value < 5 else "CRITICAL", f"v {value}", at, n


SIGNALS = [signal(1, day(0, 1), True, 2.0), signal(2, day(0, 5), True, 7.0), signal(3, day(0, 9), False, 0.0), signal(4, day(0, 10), False, 0.1), signal(5, day(0, 12), True, 3.0), signal(6, day(3), True, 4.0),
           signal(7, day(0, 2), False, 0.0, "quiet"), signal(8, day(5), True, 9.0), signal(9, day(6, 22), False, 0.0, "quiet")]


@pytest.mark.parametrize("cuts", [[0, 9], [0, 2, 5, 9]])
def test_alert_states(spark, cuts):
    """Opened, refreshed, resolved by a signal or by two days of silence; every state is kept once per alert."""
    turns = [SIGNALS[a:b][::-1] for a, b in zip(cuts, cuts[1:])]

    def build(stream):
        return keyed.alert_changes(stream, silence_days=2, delay="1 day").withColumn("part", F.lit("p"))

    schema = "metric string, source string, is_firing boolean, observed_value double, threshold double, severity string, message string, signal_time timestamp, signal_id long"
    table, late, commits = play(spark, turns, schema, build, ["alert_id", "part"], ["changes"], "part")
    got = sorted((r.opened_at, r.observed_value, r.severity, r.message, r.timestamp, r.status, r.changes) for r in table.collect())
    assert got == [
        (day(0, 1), 7.0, "CRITICAL", "v 7.0", day(0, 9), "RESOLVED", 3),
        (day(0, 12), 3.0, "WARNING", "v 3.0", day(2, 12), "RESOLVED", 2),
        (day(3), 9.0, "CRITICAL", "v 9.0", day(5), "ACTIVE", 2),
    ]
    assert late == 0 and commits <= len(turns)


class Handle:
    """State in memory that counts the calls."""

    def __init__(self):
        self.calls, self.lists, self.one, self.timers = 0, {}, [], set()

    def getListState(self, name, schema):
        return State(self, self.lists.setdefault(name, []))

    def getValueState(self, name, schema):
        return State(self, self.one)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


class State:
    def __init__(self, handle, rows):
        self.handle, self.rows = handle, rows

    def exists(self):
        self.handle.calls += 1
        return bool(self.rows)

    def get(self):
        self.handle.calls += 1
        return list(self.rows) if self.rows is not self.handle.one else self.rows[0]

    def appendList(self, rows):
        self.handle.calls += 1
        self.rows += rows

    def update(self, row):
        self.handle.calls += 1
        self.rows[:] = [row]

    def clear(self):
        self.handle.calls += 1
        self.rows.clear()


class Watermark:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def test_state_calls_do_not_grow_with_keys():
    """A thousand hashes of one bucket, each with two articles: a few calls to the state store and one timer."""
    import pandas as pd

    p, h = keyed.FirstArticles(ttl_days=1), Handle()
    p.init(h)
    n = 1000
    frame = pd.DataFrame({"content_hash": [f"h{i % n}" for i in range(2 * n)], "at": [(i // n) * 3_600_000_000 + i for i in range(2 * n)], "number": range(2 * n), "unnumbered": False})
    assert list(p.handleInputRows((0,), iter([frame]), Watermark(0))) == []
    assert len(h.timers) == 1 and not h.lists["held"]
    h.timers.clear()  # it fires
    out = pd.concat(p.handleExpiredTimer((0,), Watermark(4_000_000), None))
    assert h.calls <= 25 and len(h.timers) == 1 and not h.lists["waiting"]
    assert list(out.decision.value_counts()[["NEW", "DUPLICATE"]]) == [n, n] and set(out.canonical_article_id) == set(range(n))
    h.timers.clear()
    assert list(p.handleExpiredTimer((0,), Watermark(400_000_000), None)) == []
    assert not h.lists["held"] and not h.timers
