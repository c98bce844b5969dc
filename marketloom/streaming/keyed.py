"""Keyed state with event-time timers: article dedup that expires, and alerts as a state machine.

Both processors buffer a key's events until the watermark has passed them and then take them in event order, so the result does
not depend on how events are dealt to files and micro-batches. A key holds the events of one watermark delay and one value; a timer
removes both, so state is bounded by what is alive. Events behind the watermark never reach a processor: Spark drops and counts
them, and `late_rows` gives the counts as rows for a side table.

Every call to the state store is a round trip between Python and the JVM, so state is kept by buckets of keys and not by single
keys: a bucket's events and values are stored as Arrow batches, with one timer, and a micro-batch makes a few calls per bucket.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from marketloom.session import materialize
from marketloom.sources.versions import last_per_key, upsert_table

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"

#: Of a stream; part of its state, so it stays the same over restarts.
BUCKETS = 1024
#: Events in one stored batch, rows in one emitted frame.
CHUNK = 10_000

_ARROW = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


def millis(days: float) -> int:
    return int(days * 86_400_000)


def _schema(text: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in text.split(", "))])


class _Ordered(StatefulProcessor):
    """Takes the events of each key in event order once the watermark has passed them. Events are (at in microseconds, number, …)."""

    keys = "key string"
    event = "at long, number long"
    value = "at long"
    emitted: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "events binary")
        self.held = handle.getListState("held", "held binary")
        self.timer = handle.getValueState("timer", "at long")
        self.n_keys = len(_schema(self.keys))
        self.events = _schema(f"{self.keys}, {self.event}")
        self.values = _schema(f"{self.keys}, {self.value}")

    def take(self, key: tuple, held: tuple | None, event: tuple) -> tuple[tuple | None, list[tuple]]:
        """The value after an event, and the rows to emit."""
        raise NotImplementedError

    def until(self, held: tuple) -> int | None:
        """When the value ends (milliseconds), if it does."""
        raise NotImplementedError

    def ended(self, key: tuple, held: tuple) -> tuple[tuple | None, list[tuple]]:
        """What is left of a value that has ended, and the rows to emit."""
        return None, []

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        soonest = None
        for frame in rows:
            numbers = pa.array(frame["number"], pa.int64(), mask=frame["unnumbered"].to_numpy(bool))
            columns = [numbers if f.name == "number" else pa.array(frame[f.name], f.type, from_pandas=True) for f in self.events]
            self._store(self.waiting, pa.table(columns, schema=self.events))
            first = int(frame["at"].min())
            soonest = first if soonest is None else min(soonest, first)
        if soonest is not None:
            self._wake(-(-soonest // 1000))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        waiting = self._stored(self.waiting, self.events)
        is_due = pc.less_equal(waiting["at"], passed * 1000)
        due, later = waiting.filter(is_due), waiting.filter(pc.invert(is_due))
        del waiting
        due = due.sort_by([(c, "ascending") for c in self.events.names])
        n, out = self.n_keys, []
        held = {row[:n]: row[n:] for row in _rows(self._stored(self.held, self.values))}
        for row in _rows(due):
            k, event = row[:n], row[n:]
            now, emitted = self._expired(k, held.get(k), event[0] // 1000)
            out += emitted
            held[k], emitted = self.take(k, now, event)
            out += emitted
            if len(out) >= CHUNK:
                yield self._frame(out)
                out = []
        left = []
        for k, value in held.items():
            value, emitted = self._expired(k, value, passed)
            out += emitted
            if value is not None:
                left.append((*k, *value))
            if len(out) >= CHUNK:
                yield self._frame(out)
                out = []
        if out:
            yield self._frame(out)
        if len(due):
            self.waiting.clear()
            self._store(self.waiting, later)
        self.held.clear()
        ends = []
        for start in range(0, len(left), CHUNK):
            some = left[start : start + CHUNK]
            self._store(self.held, pa.table([pa.array(c, f.type) for c, f in zip(zip(*some), self.values)], schema=self.values))
            ends += [end + 1 for row in some if (end := self.until(row[n:])) is not None]
        if len(later):
            ends.append(-(-pc.min(later["at"]).as_py() // 1000))
        if ends:
            self._wake(min(ends))

    def _wake(self, at: int) -> None:
        """One timer a bucket: the soonest."""
        known = self.timer.get() if self.timer.exists() else None
        if known is not None and known[0] <= at:
            return
        if known is not None:
            self.handle.deleteTimer(known[0])
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def _store(self, state: Any, rows: pa.Table) -> None:
        batches = [(b.serialize().to_pybytes(),) for b in rows.combine_chunks().to_batches(CHUNK) if b.num_rows]
        if batches:
            state.appendList(batches)

    def _stored(self, state: Any, schema: pa.Schema) -> pa.Table:
        batches = [pa.ipc.read_record_batch(pa.py_buffer(bytes(b)), schema) for (b,) in state.get()] if state.exists() else []
        return pa.Table.from_batches(batches, schema)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(self.emitted, map(list, zip(*rows)))))

    def _expired(self, key: tuple, held: tuple | None, now: int) -> tuple[tuple | None, list[tuple]]:
        end = None if held is None else self.until(held)
        return self.ended(key, held) if end is not None and end < now else (held, [])

    def close(self) -> None:
        pass


def _rows(table: pa.Table) -> Iterator[tuple]:
    for batch in table.to_batches(CHUNK):
        yield from zip(*(c.to_pylist() for c in batch.columns))


DECISIONS = "content_hash string, article_id long, published_at timestamp, decision string, canonical_article_id long"


class FirstArticles(_Ordered):
    """The first article of a content hash is new; those published within `ttl_days` after it are duplicates of it."""

    keys = "content_hash string"
    event = "at long, number long"
    value = "at long, article_id long"
    emitted = ["content_hash", "article_id", "at", "decision", "canonical_article_id"]
    output = "content_hash string, article_id long, at long, decision string, canonical_article_id long"

    def __init__(self, ttl_days: float) -> None:
        self.ttl = millis(ttl_days)

    def until(self, held: tuple) -> int:
        return held[0] // 1000 + self.ttl

    def take(self, key: tuple, held: tuple | None, event: tuple) -> tuple[tuple, list[tuple]]:
        at, article = event
        new = held is None
        held = held or (at, article)
        return held, [(key[0], article, at, "NEW" if new else "DUPLICATE", held[1])]


CHANGES = (
    "alert_id string, metric string, source string, opened_at timestamp, observed_value double, threshold double, severity string, message string, "
    "timestamp timestamp, status string, changes long"
)


class AlertStates(_Ordered):
    """One alert per (metric, source) while its signal fires: opened by the first firing signal, refreshed by the next ones,
    resolved by the first that does not fire, or when none came for `silence_days`. Every change emits the alert as it is then."""

    keys = "metric string, source string"
    event = "at long, number long, is_firing boolean, observed_value double, threshold double, severity string, message string"
    value = "at long, opened long, observed_value double, threshold double, severity string, message string, changes long"
    emitted = ["alert_id", "metric", "source", "opened", "observed_value", "threshold", "severity", "message", "at", "status", "changes"]
    output = (
        "alert_id string, metric string, source string, opened long, observed_value double, threshold double, severity string, message string, "
        "at long, status string, changes long"
    )

    def __init__(self, silence_days: float | None) -> None:
        self.silence = None if silence_days is None else millis(silence_days)
        self.named: tuple[tuple, int, str] | None = None  # the last alert and its id

    def until(self, held: tuple) -> int | None:
        return None if self.silence is None else held[0] // 1000 + self.silence

    def _row(self, key: tuple, held: tuple, status: str, at: int) -> tuple:
        if self.named is None or self.named[:2] != (key, held[1]):
            self.named = key, held[1], f"{key[0]}|{key[1]}|{pd.Timestamp(held[1], unit='us').isoformat()}"
        return (self.named[2], key[0], key[1], held[1], *held[2:6], at, status, held[6])

    def ended(self, key: tuple, held: tuple) -> tuple[None, list[tuple]]:
        closed = (*held[:6], held[6] + 1)
        return None, [self._row(key, closed, "RESOLVED", (self.until(held)) * 1000)]

    def take(self, key: tuple, held: tuple | None, event: tuple) -> tuple[tuple | None, list[tuple]]:
        at, _, firing, *seen = event
        if firing:
            held = (at, held[1], seen[0], held[3], seen[2], seen[3], held[6] + 1) if held else (at, at, *seen, 1)
            return held, [self._row(key, held, "ACTIVE", at)]
        if held is None:
            return None, []
        return None, [self._row(key, (*held[:6], held[6] + 1), "RESOLVED", at)]


def _processed(stream: DataFrame, at: str, number: str, delay: str, processor: _Ordered, buckets: int) -> DataFrame:
    keys, event = _schema(processor.keys).names, _schema(processor.event).names
    carried = [c for c in event if c not in ("at", "number")]
    n = F.col(number).cast("long")
    rows = stream.where(F.col(at).isNotNull()).select(
        F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("bucket"), *keys, F.col(at).alias("event_time"), F.unix_micros(at).alias("at"),
        F.coalesce(n, F.lit(0)).alias("number"), n.isNull().alias("unnumbered"), *carried,
    )
    return rows.withWatermark("event_time", delay).groupBy("bucket").transformWithStateInPandas(processor, processor.output, "append", "eventTime")


def _named(rows: DataFrame, times: dict[str, str], schema: str) -> DataFrame:
    """Columns of the schema; `times` names those that are given in microseconds."""
    return rows.select(*[F.timestamp_micros(times[c]).alias(c) if c in times else F.col(c) for c in (f.split()[0] for f in schema.split(", "))])


def first_articles(stream: DataFrame, ttl_days: float = 365, delay: str = "7 days", at: str = "published_at", buckets: int = BUCKETS) -> DataFrame:
    """A decision (NEW, DUPLICATE) per article of a stream with content_hash, article_id and `at`, as the watermark passes it."""
    rows = _processed(stream, at, "article_id", delay, FirstArticles(ttl_days), buckets)
    return _named(rows, {"published_at": "at"}, DECISIONS)


def alert_changes(
    signals: DataFrame, silence_days: float | None = None, delay: str = "1 day", at: str = "signal_time", number: str = "signal_id", buckets: int = BUCKETS
) -> DataFrame:
    """Changes of alerts from a stream of signals (metric, source, is_firing, observed_value, threshold, severity, message)."""
    rows = _processed(signals, at, number, delay, AlertStates(silence_days), buckets)
    return _named(rows, {"opened_at": "opened", "timestamp": "at"}, CHANGES)


def run(spark: SparkSession, changes: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str], partition: str) -> StreamingQuery:
    """Starts (and with the files at hand ends) a query that upserts every micro-batch into a versioned table. The batch's number
    is part of the commit, so a batch that is repeated after a restart changes nothing."""

    def apply(batch: DataFrame, epoch: int) -> None:
        last = materialize(last_per_key(batch, keys, order), "changes")  # the processor runs once a micro-batch
        if not last.isEmpty():
            update = [c for c in last.columns if c not in keys]
            upsert_table(spark, path, last, keys, update, partition, order, (checkpoint, epoch))

    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before)


def late_rows(queries: Iterable[StreamingQuery]) -> list[tuple[str, int, str, int]]:
    """(query, micro-batch, watermark, rows dropped as late) of finished or running queries, from the progress that Spark keeps of
    each (the last 100 micro-batches by default)."""
    out = []
    for q in queries:
        for p in q.recentProgress:
            dropped = sum(s["numRowsDroppedByWatermark"] for s in p["stateOperators"])
            out.append((str(q.id), int(p["batchId"]), p["eventTime"].get("watermark", ""), int(dropped)))
    return out


LATE = "query string, batch long, watermark string, late_rows long"
