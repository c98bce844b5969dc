"""Reversible line dedup: exact reference-count tables behind sharded cuckoo filters.

A line's key is two 64-bit hashes of its normalised text. `holders` says which document holds which key, `counts` how many
documents hold it and the largest id among them, `filters` has one cuckoo filter per shard over the keys that are held by
enough documents to be dropped. Documents are added and taken out without looking at the texts of the others; after a
removal, lines that are no longer repeated come back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.llm.common import BLANKS, store, whole
from marketloom.llm.cuckoo import CuckooFilter

MIN_CHARS, MIN_DOCS = 20, 3
KEYS_PER_SHARD = 50_000
#: Filters of up to so many keys (about 3 bytes each) are sent to all executors; beyond, lines go to the exact table unfiltered.
BROADCAST_KEYS = 20_000_000
KEY = ["h1", "h2"]


_LINES = "doc_id bigint, text_hash bigint, n_lines int, keys array<struct<h1:bigint,h2:bigint,at:int>>"


def line_keys(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, text_hash, n_lines, keys for every row of `docs`: a key is the 128-bit hash of a line's text, stripped and with
    A-Z in lower case, and its place; lines whose key has fewer than `min_chars` code points have none."""
    blanks = BLANKS.encode()
    kind = pa.list_(pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("at", pa.int32())]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for rows in it:
            digests, places, sizes, n_lines = [], [], [], []
            for t in rows.column(2):
                lines = t.as_buffer().to_pybytes().lower().split(b"\n")
                n_lines.append(len(lines))
                before = len(places)
                for i, line in enumerate(lines):
                    key = line.strip(blanks)
                    if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
                        digests.append(xxhash.xxh3_128_digest(key))
                        places.append(i)
                sizes.append(len(places) - before)
            pairs = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            keys = pa.StructArray.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(places, pa.int32())], fields=list(kind.value_type))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            yield pa.record_batch({"doc_id": rows.column(0), "text_hash": rows.column(1), "n_lines": pa.array(n_lines, pa.int32()), "keys": pa.ListArray.from_arrays(offsets, keys)})

    t = whole(text)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(t).alias("text_hash"), t.alias("text")).mapInArrow(run, _LINES)


def holders(keyed: DataFrame) -> DataFrame:
    """h1, h2, doc_id: once for each key and row of `keyed`."""
    keys = F.array_distinct(F.transform("keys", lambda x: F.struct(x.h1.alias("h1"), x.h2.alias("h2"))))
    return keyed.select("doc_id", F.explode(keys).alias("k")).select("k.h1", "k.h2", "doc_id")


def counts(held: DataFrame) -> DataFrame:
    """h1, h2, n_docs, keeper: hot keys are added up where they are read."""
    return held.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))


def _shard(shards: int) -> Column:
    return F.pmod(F.col("h1"), F.lit(shards)).cast("int")


def filters(repeated: DataFrame, shards: int) -> DataFrame:
    """shard, filter: a cuckoo filter over the keys of each shard of `repeated`."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        f = CuckooFilter.sized(len(rows))
        f.insert(rows["h1"].to_numpy())
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "filter": [f.to_bytes()]})

    return repeated.select(_shard(shards).alias("shard"), "h1").distinct().groupBy("shard").applyInPandas(build, "shard int, filter binary")


def _probe(blobs: dict[int, bytes], shards: int, context):
    shared = context.broadcast(blobs)

    @F.pandas_udf(T.BooleanType())
    def probe(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = {k: CuckooFilter.from_bytes(v) for k, v in shared.value.items()}
        for h1 in batches:
            keys = h1.to_numpy(np.int64)
            home, out = np.mod(keys, shards), np.zeros(len(keys), bool)
            for k in np.unique(home).tolist():
                if k in own:
                    out[home == k] = own[k].contains(keys[home == k])
            yield pd.Series(out)

    return probe


@F.pandas_udf(T.StringType())
def _without(text: pd.Series, at: pd.Series) -> pd.Series:
    def strip(t, drop):
        if t is None or drop is None:
            return None
        lines, gone = t.split("\n"), set(drop)
        return "\n".join([x for i, x in enumerate(lines) if i not in gone])

    return pd.Series([strip(t, d) for t, d in zip(text, at, strict=True)], dtype=object)


def dropped_lines(keyed: DataFrame, repeated: DataFrame, blobs: dict[int, bytes] | None, shards: int) -> DataFrame:
    """doc_id, text_hash, at: the lines that are to go, by the exact table `repeated` (h1, h2, keeper).

    The filters keep lines that cannot be in the table out of the shuffle.
    """
    lines = keyed.select("doc_id", "text_hash", F.explode("keys").alias("k")).select("doc_id", "text_hash", "k.h1", "k.h2", "k.at")
    if blobs is not None:
        lines = lines.where(_probe(blobs, shards, keyed.sparkSession.sparkContext)("h1"))
    found = lines.join(repeated.select(*KEY, "keeper"), KEY)
    return found.where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).select("doc_id", "text_hash", "at")


def apply_drops(docs: DataFrame, dropped: DataFrame, doc_id: str = "doc_id", text: str = "text", out: str = "line_dedup") -> DataFrame:
    """`docs` without the lines of `dropped`, with a struct `out` (n_lines, n_dropped)."""
    per_doc = dropped.groupBy("doc_id", "text_hash").agg(F.collect_set("at").alias("__at")).select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h"), "__at")
    t = whole(text)
    # The side that is hashed has the places of dropped lines only; the texts need no sort.
    joined = docs.withColumn("__t", t).join(per_doc.hint("shuffle_hash"), F.col(doc_id).cast("long").eqNullSafe(F.col("__d")) & (F.xxhash64(t) == F.col("__h")), "left")
    # Only texts that lose lines go through Python.
    stripped = F.when(F.col("__at").isNotNull(), _without(F.when(F.col("__at").isNotNull(), F.col("__t")), F.col("__at"))).otherwise(F.col("__t"))
    info = F.struct(F.size(F.split("__t", "\n", -1)).cast("long").alias("n_lines"), F.coalesce(F.size("__at"), F.lit(0)).cast("long").alias("n_dropped"))
    return joined.select(*[stripped.alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns if c != out], info.alias(out))


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without repeated lines: a key held by at least `min_docs` rows stays only in the largest doc_id that holds it.

    Null and empty texts are one empty line. Rows with equal ids count as so many documents and are treated alike; a null id
    ranks below all others. Every row comes back once, with the struct column line_dedup (n_lines, n_dropped).
    """
    keyed = store(line_keys(docs, doc_id, text, min_chars), "line-keys")
    repeated = store(counts(holders(keyed)).where(F.col("n_docs") >= min_docs), "repeated-lines")
    n = repeated.count()
    shards = max(1, -(-n // KEYS_PER_SHARD))
    blobs = {r.shard: bytes(r.filter) for r in filters(repeated, shards).collect()} if n <= BROADCAST_KEYS else None
    return apply_drops(docs, dropped_lines(keyed, repeated, blobs, shards), doc_id, text)


@dataclass(frozen=True)
class LineStore:
    """The state of incremental dedup; every change gives a new one, written to the shared folder, so a failed step can be rerun."""

    holders: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int = MIN_DOCS

    @classmethod
    def of(cls, docs: DataFrame, min_docs: int = MIN_DOCS, keys_per_shard: int = KEYS_PER_SHARD) -> LineStore:
        held = store(holders(line_keys(docs)), "line-holders")
        table = store(counts(held), "line-counts")
        repeated = table.where(F.col("n_docs") >= min_docs)
        shards = max(1, -(-repeated.count() // keys_per_shard))
        return cls(held, table, store(filters(repeated, shards), "line-filters"), shards, min_docs)

    def _changed(self, held: DataFrame, table: DataFrame) -> LineStore:
        """Filters take in the keys that became repeated and give up those that no longer are."""
        was, now = (t.where(F.col("n_docs") >= self.min_docs).select("h1").distinct() for t in (self.counts, table))
        moves = now.join(was, "h1", "left_anti").withColumn("add", F.lit(True)).unionByName(was.join(now, "h1", "left_anti").withColumn("add", F.lit(False)))

        def change(old: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            f = CuckooFilter.from_bytes(old["filter"].iloc[0]) if len(old) else CuckooFilter.sized(2 * len(rows))
            f.delete(rows.loc[~rows["add"], "h1"].to_numpy(np.int64))
            f.insert(rows.loc[rows["add"], "h1"].to_numpy(np.int64))
            return pd.DataFrame({"shard": [(old if len(old) else rows)["shard"].iloc[0]], "filter": [f.to_bytes()]})

        moved = self.filters.groupBy("shard").cogroup(moves.withColumn("shard", _shard(self.shards)).groupBy("shard")).applyInPandas(change, "shard int, filter binary")
        return LineStore(held, table, store(moved, "line-filters"), self.shards, self.min_docs)

    def insert(self, docs: DataFrame) -> LineStore:
        new = store(holders(line_keys(docs)), "line-holders")
        held = store(self.holders.unionByName(new), "line-holders")
        both = self.counts.unionByName(counts(new)).groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))
        return self._changed(held, store(both, "line-counts"))

    def delete(self, ids: DataFrame) -> LineStore:
        """Takes out the documents in the column doc_id of `ids`. Only keys that they hold are counted again."""
        gone = ids.select("doc_id").distinct()
        touched = self.holders.join(gone, "doc_id", "left_semi").select(*KEY).distinct()
        held = store(self.holders.join(gone, "doc_id", "left_anti").select(*KEY, "doc_id"), "line-holders")
        again = counts(held.join(touched, KEY, "left_semi"))
        table = self.counts.join(touched, KEY, "left_anti").unionByName(again)
        return self._changed(held, store(table, "line-counts"))

    def dedup(self, docs: DataFrame) -> DataFrame:
        repeated = self.counts.where(F.col("n_docs") >= self.min_docs)
        blobs = {r.shard: bytes(r.filter) for r in self.filters.collect()} if repeated.count() <= BROADCAST_KEYS else None
        return apply_drops(docs, dropped_lines(line_keys(docs), repeated, blobs, self.shards))
