"""Parquet tables with versions: readers are pinned to one, and a write is seen as a whole or not at all.

A table is a folder. Every commit writes the partitions it replaces into a folder of its own, `c=<commit>/<partition>=<value>/`,
and then publishes a manifest, `_versions/<number>.json`: for each partition the commit that holds its rows, and the schema. The
manifest is written under another name and renamed, which fails if that version exists; so a lost executor, driver or writer
leaves at most a folder that no manifest names, and of two writers that start from the same version one has to look again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.session import materialize


class CommitConflict(RuntimeError):
    """Another writer has published the version first."""


@dataclass(frozen=True)
class Version:
    """number (0: nothing written yet), the schema, the partition column, partition folder -> commit, and the marks of writers."""

    number: int = 0
    schema: str = ""
    partition: str = ""
    folders: dict[str, str] = field(default_factory=dict)
    marks: dict[str, int] = field(default_factory=dict)


class Files:
    """The few file operations needed, on whatever store holds the path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._jvm, self._gateway = spark._jvm, spark.sparkContext._gateway
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._at(path).getFileSystem(self._conf)

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._at(path))

    def names(self, path: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._at(path))] if self.exists(path) else []

    def read(self, path: str) -> str:
        stream = self._fs.open(self._at(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> None:
        """Writes a file that appears whole under its name; CommitConflict if there is one already."""
        draft = f"{path}.{uuid.uuid4().hex}"
        stream = self._fs.create(self._at(draft), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at(path).toUri(), self._conf)
        options = self._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(self._at(draft), self._at(path), options)
        except Py4JJavaError as e:
            self._fs.delete(self._at(draft), False)
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                raise CommitConflict(path) from None
            raise

    def remove(self, path: str) -> None:
        self._fs.delete(self._at(path), True)


def _manifest(path: str, number: int) -> str:
    return f"{path}/_versions/{number:012d}.json"


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the published versions, ascending."""
    names = Files(spark, path).names(f"{path}/_versions")
    return sorted(int(n[:-5]) for n in names if n.endswith(".json"))


def version_of(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """The manifest of a version, by default the latest; an empty one for a table that was never written."""
    if number is None:
        number = max(versions(spark, path), default=0)
    return Version(**json.loads(Files(spark, path).read(_manifest(path, number)))) if number else Version()


def read_table(spark: SparkSession, path: str, number: int | None = None, only: Sequence[str] | None = None) -> DataFrame:
    """Rows of a version, by default the latest; later commits do not change the frame. `only` names partition folders."""
    v = version_of(spark, path, number)
    if not v.number:
        raise FileNotFoundError(f"{path} has no version")
    return _rows(spark, path, v, v.folders if only is None else [f for f in only if f in v.folders])


def _rows(spark: SparkSession, path: str, v: Version, folders: Sequence[str]) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(v.schema))
    stored = T.StructType([*schema.fields, T.StructField("c", T.StringType())])
    paths = [f"{path}/c={v.folders[f]}/{f}" for f in folders]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(stored).option("basePath", path).parquet(*paths).select(*schema.names)


def _write(rows: DataFrame, path: str, commit: str, partition: str, rows_per_file: int) -> list[str]:
    """The partitions' folders, written with files of about the advisory partition size."""
    spark = rows.sparkSession
    root = f"{path}/c={commit}"
    rows.hint("rebalance", partition).write.option("maxRecordsPerFile", rows_per_file).partitionBy(partition).parquet(root)
    return [n for n in Files(spark, path).names(root) if "=" in n]


def commit_partitions(
    spark: SparkSession, path: str, merge: Callable[[Version], DataFrame], partition: str, mark: tuple[str, int] | None = None, rows_per_file: int = 5_000_000
) -> Version:
    """Publishes the next version, in which the partitions of `merge(version)` replace those of the version they started from.

    `merge` gets the version to start from and returns all rows of the partitions it touches; it is asked again if another writer
    has changed one of those partitions in between (a change elsewhere is only taken over). `mark` = (writer, step) makes a
    repeated step of that writer do nothing.
    """
    files = Files(spark, path)
    base = version_of(spark, path)
    written: tuple[Version, str, list[str], str] | None = None
    while True:
        if mark and base.marks.get(mark[0], -1) >= mark[1]:
            return base
        if written is None or any(base.folders.get(f) != written[0].folders.get(f) for f in written[2]):
            rows, commit = merge(base), uuid.uuid4().hex
            schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields])
            written = (base, commit, _write(rows, path, commit, partition, rows_per_file), schema.json())
        folders = base.folders | {f: written[1] for f in written[2]}
        marks = base.marks | ({mark[0]: mark[1]} if mark else {})
        new = replace(base, number=base.number + 1, schema=written[3], partition=partition, folders=folders, marks=marks)
        try:
            files.publish(_manifest(path, new.number), json.dumps(new.__dict__))
            return new
        except CommitConflict:
            base = version_of(spark, path)


def last_per_key(batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by `order`; rows that agree in it too go by their values. Combined before the shuffle."""
    values = [c for c in batch.columns if c not in keys]
    at = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *values)
    return batch.groupBy(*keys).agg(F.max(at).alias("_last")).select(*[c if c in keys else F.col(f"_last.{c}").alias(c) for c in batch.columns])


def keyed_upsert(existing: DataFrame, batch: DataFrame, keys: Sequence[str], update: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Existing rows with the `update` columns of the batch where the key is there, and rows for new keys.

    The batch's last row of a key by `order` (columns of the batch) wins, whatever its values; a known key keeps its other
    columns. Applying the same batch twice changes nothing. One aggregation, combined before the shuffle. A null in a key is a
    value like others; nulls of the batch's last row are taken.
    """
    if not order:
        raise ValueError("a batch needs an order: the last record of a key wins")
    cols = existing.columns
    values = [c for c in cols if c not in keys]
    row = F.struct(*values)
    last = last_per_key(batch, keys, order)
    # Two rows a key at most from here on.
    old = existing.select(*keys, row.alias("_old"), F.lit(None).cast(existing.select(row.alias("r")).schema["r"].dataType).alias("_new"))
    new = last.select(*[F.col(c).cast(existing.schema[c].dataType).alias(c) if c in cols else F.col(c) for c in last.columns])
    new = new.select(*keys, F.lit(None).cast(old.schema["_old"].dataType).alias("_old"), row.alias("_new"))
    both = old.unionByName(new).groupBy(*keys).agg(F.first("_old", True).alias("_old"), F.first("_new", True).alias("_new"))

    def value(c: str):
        taken, kept = F.col(f"_new.{c}"), F.col(f"_old.{c}")
        fresh = F.col("_new").isNotNull() if c in update else F.col("_old").isNull()
        return F.when(fresh, taken).otherwise(kept).alias(c)

    return both.select(*[c if c in keys else value(c) for c in cols])


def upsert_table(
    spark: SparkSession, path: str, batch: DataFrame, keys: Sequence[str], update: Sequence[str], partition: str, order: Sequence[str], mark: tuple[str, int] | None = None
) -> DataFrame:
    """Upsert into a versioned table partitioned by `partition` (one of the keys); returns the new version's rows.

    The batch is read once: its last row per key is stored in the shared folder. Only partitions that it names are read and
    written again. Columns of `order` that are neither keys nor updated are not part of the table.
    """
    if partition not in keys:
        raise ValueError("the partition column must be one of the keys")
    if not order:
        raise ValueError("a batch needs an order: the last record of a key wins")
    table = [c for c in batch.columns if c not in order or c in keys or c in update]
    last = materialize(last_per_key(batch, keys, order).select(*table), "upsert")
    touched = [r[0] for r in last.select(partition).distinct().collect()]  # one value per partition

    def merge(base: Version) -> DataFrame:
        if not base.number:
            return last
        stored = _rows(spark, path, base, list(base.folders))
        named = F.col(partition).isin([t for t in touched if t is not None])
        stored = stored.where(named | F.col(partition).isNull() if None in touched else named)
        return keyed_upsert(stored, last, keys, update, [c for c in table if c not in keys] or keys)

    v = commit_partitions(spark, path, merge, partition, mark)
    return _rows(spark, path, v, list(v.folders))


def vacuum(spark: SparkSession, path: str, keep: int = 1, writing: Sequence[str] = ()) -> list[str]:
    """Removes folders that none of the last `keep` versions names (nor `writing`, commits under way) and older manifests;
    returns the removed folders. Readers pinned to an older version lose their files."""
    files, numbers = Files(spark, path), versions(spark, path)
    kept = {c for n in numbers[-keep:] for c in version_of(spark, path, n).folders.values()} | set(writing)
    gone = [n for n in files.names(path) if n.startswith("c=") and n[2:] not in kept]
    for n in gone:
        files.remove(f"{path}/{n}")
    for n in numbers[:-keep]:
        files.remove(_manifest(path, n))
    return gone
