"""Versioned tables: last record wins, whole commits, readers pinned to a version, lost and competing writers."""

import os

import pytest
from pyspark.sql import functions as F

from marketloom.session import scratch_path
from marketloom.sources import versions as W

SCHEMA = "k string, part int, a long, b string, seq int"
KEYS, UPDATE = ["k", "part"], ["a"]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def upsert(spark, path, rows, mark=None):
    return W.upsert_table(spark, path, frame(spark, rows), KEYS, UPDATE, "part", ["seq"], mark)


def content(df):
    return sorted((tuple(r) for r in df.select("k", "part", "a", "b").collect()), key=repr)


def test_last_record_wins(spark):
    old = spark.createDataFrame([("x", 1, 10, "old"), (None, 1, 1, "old"), ("z", None, 5, "old")], "k string, part int, a long, b string")
    batch = frame(spark, [("x", 1, 99, "p", 1), ("x", 1, 3, "q", 2), (None, 1, None, "r", 1), ("n", 2, 9, "first", 1), ("n", 2, 1, "second", 2), ("z", None, 7, "s", 1)])
    out = W.keyed_upsert(old, batch, KEYS, UPDATE, ["seq"])
    want = sorted([("x", 1, 3, "old"), (None, 1, None, "old"), ("z", None, 7, "old"), ("n", 2, 1, "second")], key=repr)
    assert content(out) == want
    assert content(W.keyed_upsert(out, batch, KEYS, UPDATE, ["seq"])) == want
    # Records that agree in the order too: the same one wins each time, whatever their place.
    tie = [("x", 1, a, "t", 1) for a in (4, 8, 6)]
    assert {tuple(content(W.keyed_upsert(old, frame(spark, t), KEYS, UPDATE, ["seq"]))) for t in (tie, tie[::-1])} == {tuple(sorted([("x", 1, 8, "old"), (None, 1, 1, "old"), ("z", None, 5, "old")], key=repr))}
    with pytest.raises(ValueError):
        W.keyed_upsert(old, batch, KEYS, UPDATE, [])


def test_readers_keep_their_version(spark):
    path = scratch_path(spark, "versions")
    with pytest.raises(FileNotFoundError):
        W.read_table(spark, path)
    one = upsert(spark, path, [("x", 1, 1, "m", 1), ("y", 2, 2, "m", 1), ("z", None, 3, "m", 1), ("q", 4, 4, "a b/c=d", 1)])
    first = W.read_table(spark, path)
    two = upsert(spark, path, [("x", 1, 5, "n", 1), ("z", None, 6, "n", 1), ("w", 3, 7, "n", 1)])
    before = sorted([("x", 1, 1, "m"), ("y", 2, 2, "m"), ("z", None, 3, "m"), ("q", 4, 4, "a b/c=d")], key=repr)
    after = sorted([("x", 1, 5, "m"), ("y", 2, 2, "m"), ("z", None, 6, "m"), ("w", 3, 7, "n"), ("q", 4, 4, "a b/c=d")], key=repr)
    assert content(one) == content(first) == content(W.read_table(spark, path, 1)) == before
    assert content(two) == content(W.read_table(spark, path)) == after
    assert W.versions(spark, path) == [1, 2]
    # Partitions that the batch does not name stay where they were; a filter reads the folders it needs.
    assert W.version_of(spark, path).folders["part=2"] == W.version_of(spark, path, 1).folders["part=2"]
    assert len(W.read_table(spark, path).where("part = 2").inputFiles()) >= 1
    assert content(W.read_table(spark, path, only=["part=2"])) == [("y", 2, 2, "m")]
    assert W.vacuum(spark, path) == []
    upsert(spark, path, [(r[0], r[1], r[2], r[3], 1) for r in after])
    assert len(W.vacuum(spark, path)) == 2 and W.versions(spark, path) == [3]
    assert content(W.read_table(spark, path)) == after


def test_writer_lost_before_the_commit(spark, monkeypatch):
    path, batch = scratch_path(spark, "lost"), [("x", 1, 5, "n", 1), ("x", 1, 6, "n", 2), ("y", 2, 7, "n", 1)]
    upsert(spark, path, [("x", 1, 1, "m", 1)])
    publish = W.Files.publish

    def lost(self, *_):
        raise ConnectionError("driver lost")

    monkeypatch.setattr(W.Files, "publish", lost)
    with pytest.raises(ConnectionError):
        upsert(spark, path, batch)
    monkeypatch.setattr(W.Files, "publish", publish)
    assert content(W.read_table(spark, path)) == [("x", 1, 1, "m")] and W.versions(spark, path) == [1]
    want = sorted([("x", 1, 6, "m"), ("y", 2, 7, "n")], key=repr)
    assert content(upsert(spark, path, batch)) == want
    assert content(upsert(spark, path, batch)) == want
    left = [n for n in os.listdir(path) if n.startswith("c=")]
    assert len(left) == 4 and len(W.vacuum(spark, path)) == 3 and content(W.read_table(spark, path)) == want


@pytest.mark.parametrize("same", [False, True])
def test_two_writers(spark, monkeypatch, same):
    """A second writer commits between this one's write and its commit, in another partition or in the same one."""
    path, write = scratch_path(spark, "two"), W._write
    upsert(spark, path, [("x", 1, 1, "m", 1)])
    calls = []

    def slow(*args):
        done = write(*args)
        calls.append(1)
        if len(calls) == 1:
            upsert(spark, path, [("o", 1 if same else 2, 8, "other", 1)])
        return done

    monkeypatch.setattr(W, "_write", slow)
    out = upsert(spark, path, [("x", 1, 5, "n", 1)])
    assert content(out) == sorted([("x", 1, 5, "m"), ("o", 1 if same else 2, 8, "other")], key=repr)
    assert W.versions(spark, path) == [1, 2, 3] and len(calls) == (3 if same else 2)


def test_repeated_step_of_a_writer(spark):
    path = scratch_path(spark, "marks")
    upsert(spark, path, [("x", 1, 1, "m", 1)], ("stream", 0))
    upsert(spark, path, [("x", 1, 2, "m", 1)], ("stream", 1))
    assert content(upsert(spark, path, [("x", 1, 99, "m", 1)], ("stream", 1))) == [("x", 1, 2, "m")]
    assert content(upsert(spark, path, [("x", 1, 3, "m", 1)], ("another", 0))) == [("x", 1, 3, "m")]
    assert W.version_of(spark, path).marks == {"stream": 1, "another": 0}


def test_many_rows_of_a_partition_are_several_files(spark):
    path = scratch_path(spark, "wide")
    rows = spark.range(40_000).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("part"), F.col("id").alias("a"), F.lit("b").alias("b"))
    W.commit_partitions(spark, path, lambda base: rows, "part", rows_per_file=1000)
    assert len(W.read_table(spark, path).inputFiles()) >= 40 and W.read_table(spark, path).agg(F.sum("a")).first()[0] == 40_000 * 39_999 // 2
