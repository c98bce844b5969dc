"""Near duplicates: universal hash minima, banding, verification on full shingle sets, connected components.

Documents with equal shingle sets form a class, and only classes are compared. Two classes that agree on all minima of a
band meet in a bucket. Candidates are found in two rounds:

* In each bucket every class is compared with one star, the class that shares most buckets with others. Copies of one
  document, however many, are tied together by so many comparisons as there are copies.
* Buckets that still hold several components are searched in full for links between these, block against block inside tasks
  that give out links alone. A pair is looked at in the first band that it shares.

So every pair that meets in a bucket is either compared or already connected. With 32 bands of 4 minima, a pair of similarity
0.8 meets in none with a probability of (1 - 0.8 ** 4) ** 32, below 1e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.llm.common import store, whole
from marketloom.llm.components import components
from marketloom.llm.tokens import NOT_BLANK, mix, terms_of

BANDS, ROWS = 32, 4
MINIMA = BANDS * ROWS
#: Estimated similarities have a deviation of at most 0.045; in fewer than 1e-7 of the pairs at 0.8 are they lower by this.
MARGIN = 0.21
BLOCK = 1000


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of so many words; a shorter text that has words is one shingle."""
    h, starts = terms_of(texts, NOT_BLANK)
    n = max(0, len(h) - words + 1)
    joined = np.zeros(n, np.uint64)
    for j in range(words):
        joined = joined * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    joined = mix(joined)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(joined[a : b - words + 1]))
        else:
            out.append(mix(np.array([sum(int(x) * 3**i for i, x in enumerate(h[a:b])) + (b - a) & (2**64 - 1)], np.uint64)) if b > a else np.empty(0, np.uint64))
    return out


def minima_of(sets: list[np.ndarray]) -> np.ndarray:
    """MINIMA x len(sets) universal hash minima; sets must not be empty."""
    rng = np.random.default_rng(20)
    factor, shift = rng.integers(0, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, MINIMA, dtype=np.uint64)
    out = np.empty((MINIMA, len(sets)), np.uint32)
    sizes = np.array([len(s) for s in sets], np.int64)
    ends = np.cumsum(sizes)
    i = 0
    while i < len(sets):  # stretches that stay in the processor's cache
        j = max(i + 1, int(np.searchsorted(ends, ends[i] - sizes[i] + 50_000)))
        x, first = np.concatenate(sets[i:j]), (ends - sizes)[i:j] - (ends[i] - sizes[i])
        for k in range(MINIMA):
            out[k, i:j] = np.minimum.reduceat((x * factor[k] + shift[k]) >> np.uint64(32), first)
        i = j
    return out


_NODE = pa.struct([("c1", pa.int64()), ("c2", pa.int64())])
_SIGNED = "doc_id bigint, text_hash bigint, n_shingles bigint, node struct<c1:bigint,c2:bigint>, bands array<bigint>, sig binary"


def _digest(sets: list[np.ndarray]) -> pa.StructArray:
    import xxhash

    pairs = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
    return pa.StructArray.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], fields=list(_NODE), mask=pa.array([len(s) == 0 for s in sets], pa.bool_()))


def _texts(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Stretches of the column of a few million bytes."""
    part, size, at = [], 0, 0
    for t in column:
        part.append(t.as_buffer().to_pybytes())
        size += len(part[-1])
        if size > 4_000_000:
            yield at, part
            at, part, size = at + len(part), [], 0
    if part:
        yield at, part


def signatures(docs: DataFrame, words: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in it:
            for at, texts in _texts(rows.column(2)):
                sets = shingle_sets(texts, words)
                full = [i for i, s in enumerate(sets) if len(s)]
                sig = np.zeros((MINIMA, len(sets)), np.uint32)
                if full:
                    sig[:, full] = minima_of([sets[i] for i in full])
                keys = np.zeros((BANDS, len(sets)), np.uint64)
                for r in range(ROWS):
                    keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + sig[r::ROWS] + np.uint64(r + 1))
                offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS)
                low = np.ascontiguousarray(sig.astype(np.uint16).T)
                yield pa.record_batch(
                    {
                        "doc_id": rows.column(0).slice(at, len(texts)),
                        "text_hash": rows.column(1).slice(at, len(texts)),
                        "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                        "node": _digest(sets),
                        "bands": pa.ListArray.from_arrays(offsets, pa.array(keys.T.reshape(-1).view(np.int64))),
                        "sig": pa.array([x.tobytes() for x in low], pa.binary()),
                    }
                )

    t = whole(text)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(t).alias("text_hash"), t.alias("text")).mapInArrow(run, _SIGNED)


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """node, set (sorted 64-bit hashes) of the texts in `docs`."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in it:
            for _, texts in _texts(rows.column(0)):
                sets = shingle_sets(texts, words)
                yield pa.record_batch({"node": _digest(sets), "set": pa.array([s.tobytes() for s in sets], pa.binary())})

    return docs.mapInArrow(run, "node struct<c1:bigint,c2:bigint>, set binary")


@F.pandas_udf(T.IntegerType())
def _agreeing(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([int((np.frombuffer(x, np.uint16) == np.frombuffer(y, np.uint16)).sum()) for x, y in zip(a, b, strict=True)], dtype="int32")


@F.pandas_udf(T.LongType())
def _shared(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(a, b, strict=True)], dtype="int64")


def _with(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """`pairs` (a, b) with that column of `table` (node, …) for both ends."""
    for end in "ab":
        pairs = pairs.join(table.select(F.col("node").alias(end), F.col(column).alias(f"{column}_{end}")), end)
    return pairs


def _linked(shared: Column, size_a: Column, size_b: Column, percent: int) -> Column:
    return 100 * shared >= percent * (size_a + size_b - shared)


_MEET = ["band", "key", "i", "j"]
_TYPES = {"band": pa.int32(), "key": pa.int64(), "i": pa.int32(), "j": pa.int32(), "own": pa.int32(), "node": _NODE, "root": _NODE, "bands": pa.list_(pa.int64()), "sig": pa.binary()}


def _blocks(mixed: DataFrame) -> DataFrame:
    """Rows of a bucket dealt into blocks of about BLOCK, once for each pair of blocks that they are in."""
    home = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1))
    dealt = mixed.withColumn("own", home).withColumn("other", other)
    return dealt.select("band", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", *[c for c in mixed.columns if c not in ("band", "key", "blocks")])


def _meetings(rows: DataFrame, percent: int, schema: str) -> DataFrame:
    """Runs of rows of one pair of blocks. Without a column `set` it gives the rows that may be in a link; with it, the links."""
    names = rows.columns
    exact = "set" in names

    def pairs_of(run: dict[str, list]) -> tuple[np.ndarray, np.ndarray]:
        n = len(run["node"])
        sig = np.frombuffer(b"".join(run["sig"]), np.uint16).reshape(n, MINIMA)
        bands = np.array(run["bands"], np.int64)
        root = np.unique([f"{r['c1']},{r['c2']}" for r in run["root"]], return_inverse=True)[1]
        own, band, i, j = np.array(run["own"]), run["band"][0], run["i"][0], run["j"][0]
        left, right = [], []
        for a in range(n):
            b = np.arange(a + 1, n)
            b = b[root[b] != root[a]]
            if i != j:
                b = b[own[b] != own[a]]
            b = b[~(bands[b, :band] == bands[a, :band]).any(axis=1)]
            b = b[(sig[b] == sig[a]).sum(axis=1) >= (percent / 100 - MARGIN) * MINIMA]
            left.append(np.full(len(b), a))
            right.append(b)
        return np.concatenate(left), np.concatenate(right)

    def one(run: dict[str, list]) -> pa.RecordBatch | None:
        left, right = pairs_of(run)
        if not len(left):
            return None
        if not exact:
            keep = np.unique(np.concatenate([left, right])).tolist()
            return pa.record_batch([pa.array([run[c][k] for k in keep], _TYPES[c]) for c in names], names=names)
        sets = [np.frombuffer(s, np.uint64) for s in run["set"]]
        a_out, b_out = [], []
        for a in np.unique(left).tolist():
            partners = right[left == a]
            sizes = np.array([len(sets[b]) for b in partners])
            inside = np.isin(np.concatenate([sets[b] for b in partners]), sets[a])
            shared = np.add.reduceat(inside.astype(np.int64), np.cumsum(sizes) - sizes)
            hit = partners[100 * shared >= percent * (len(sets[a]) + sizes - shared)]
            a_out += [run["node"][a]] * len(hit)
            b_out += [run["node"][b] for b in hit]
        return pa.record_batch({"a": pa.array(a_out, _NODE), "b": pa.array(b_out, _NODE)})

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: dict[str, list] = {c: [] for c in names}
        now = None
        for batch in it:
            rows = {c: batch.column(c).to_pylist() for c in names}
            for k, meet in enumerate(zip(*(rows[c] for c in _MEET), strict=True)):
                if meet != now and run["node"]:
                    if (out := one(run)) is not None:
                        yield out
                    run = {c: [] for c in names}
                now = meet
                for c in names:
                    run[c].append(rows[c][k])
        if run["node"] and (out := one(run)) is not None:
            yield out

    return rows.repartition(*_MEET).sortWithinPartitions(*_MEET).mapInArrow(search, schema)


def near_duplicates(docs: DataFrame, words: int = 2, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept for every row of `docs`.

    Null texts and texts without words have an empty set and are linked with nothing. Rows with equal texts or equal sets are
    one class. A null doc_id counts for nothing in component_id, which is null where a component has no id. An empty table
    gives no rows. Repeated rows come back as often as they are there; each with the smallest id is kept.
    """
    signed = store(signatures(docs, words, doc_id, text), "minhash-signatures")
    classes = signed.where("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "text_hash")).alias("sample"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sig").alias("sig")
    )
    classes = store(classes, "minhash-classes")
    banded = classes.select("node", F.posexplode("bands").alias("band", "key"))
    full = banded.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = store(banded.join(full, ["band", "key"]), "minhash-buckets")

    weights = members.groupBy("node").agg(F.sum("n").alias("weight"))
    stars = members.join(weights, "node").groupBy("band", "key").agg(F.max(F.struct("weight", "node"))["node"].alias("star"))
    edges = members.join(stars, ["band", "key"]).where("node <> star").select(F.least("node", "star").alias("a"), F.greatest("node", "star").alias("b")).distinct()
    likely = _with(edges, classes, "sig").where(_agreeing("sig_a", "sig_b") >= int((percent / 100 - MARGIN) * MINIMA)).select("a", "b")
    likely = store(likely, "minhash-edges")

    in_bucket = members.select("node").distinct()
    wanted = classes.join(in_bucket, "node").select(F.col("sample.doc_id").alias("__d"), F.col("sample.text_hash").alias("__h"))
    t = whole(text)
    chosen = docs.select(F.col(doc_id).cast("long").alias("__id"), t.alias("text")).join(
        wanted.hint("shuffle_hash"), F.col("__id").eqNullSafe(F.col("__d")) & (F.xxhash64("text") == F.col("__h")), "left_semi"
    )
    sets = store(_sets(chosen.select("text"), words).dropDuplicates(["node"]), "minhash-sets")

    checked = _with(likely, sets, "set").withColumn("shared", _shared("set_a", "set_b"))
    links = store(checked.where(_linked(F.col("shared"), F.octet_length("set_a") / 8, F.octet_length("set_b") / 8, percent)).select("a", "b"), "minhash-links")
    roots = components(links)

    # Second round: buckets with more than one component.
    rooted = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = store(rooted.select("band", "key", "node", "root"), "minhash-roots")
    split = rooted.groupBy("band", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    split = split.select("band", "key", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    mixed = rooted.join(split, ["band", "key"]).join(classes.select("node", "bands", "sig"), "node")
    node = "struct<c1:bigint,c2:bigint>"
    kind = f"band int, key bigint, i int, j int, own int, node {node}, root {node}, bands array<bigint>, sig binary"
    maybe = store(_meetings(_blocks(mixed).select(*_MEET, "own", "node", "root", "bands", "sig"), percent, kind), "minhash-maybe")
    more = store(_meetings(maybe.join(sets, "node").select(*_MEET, "own", "node", "root", "bands", "sig", "set"), percent, f"a {node}, b {node}"), "minhash-links")
    if more.limit(1).count():
        roots = components(links.unionByName(more))

    labelled = classes.select("node", "least_id").join(roots, "node", "left").select("node", "least_id", F.coalesce("root", "node").alias("root"))
    least = labelled.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = labelled.join(least, "root").select("node", "component_id")
    out = signed.select("doc_id", "text_hash", "n_shingles", "node").join(named, "node", "left")
    out = out.withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "text_hash", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
