"""Benchmark decontamination with a positional inverted index of the training tokens.

The index is cut by documents: one row per segment holds the sorted terms of its documents and their positions. A phrase is
looked up by taking its rarest term's positions, less the term's offset, and intersecting them with the lists of the next
rarest terms until none is left or all agree. Test items go to the segments in blocks of bounded size, each block a pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import store, whole
from marketloom.llm.tokens import ALPHANUMERIC, terms_of

WINDOW = 13
SEGMENT_BYTES = 8_000_000
BLOCK_WORDS = 250_000


_INDEX = "segment string, doc_id array<bigint>, text_hash array<bigint>, starts binary, terms binary, sizes binary, positions binary"


def _segments(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard
    from pyspark import TaskContext

    pack, part, n = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId(), 0

    def close(ids: list, hashes: list, texts: list[bytes]) -> pa.RecordBatch:
        h, starts = terms_of(texts, ALPHANUMERIC)
        order = np.argsort(h, kind="stable").astype(np.int32)
        h = h[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
        steps = np.diff(order, prepend=np.int32(0))
        steps[first] = order[first]
        row = {
            "segment": [f"{part}-{n}"],
            "doc_id": pa.array([ids], pa.list_(pa.int64())),
            "text_hash": pa.array([hashes], pa.list_(pa.int64())),
            "starts": [starts.astype(np.int32).tobytes()],
            "terms": [h[first].tobytes()],
            "sizes": [pack.compress(np.diff(np.append(first, len(h))).astype(np.int32).tobytes())],
            "positions": [pack.compress(steps.tobytes())],
        }
        return pa.record_batch(row)

    ids, hashes, texts, size = [], [], [], 0
    for rows in it:
        for i, h, t in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2), strict=True):
            data = t.as_buffer().to_pybytes()
            ids.append(i)
            hashes.append(h)
            texts.append(data)
            size += len(data)
            if size >= SEGMENT_BYTES:
                yield close(ids, hashes, texts)
                ids, hashes, texts, size, n = [], [], [], 0, n + 1
    if ids:
        yield close(ids, hashes, texts)


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored index of all rows of `docs`: postings of every term, no term left out."""
    t = whole(text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(t).alias("text_hash"), t.alias("text"))
    return store(rows.mapInArrow(_segments, _INDEX), "positional-index")


class Segment:
    """One row of the index, unpacked."""

    def __init__(self, row: dict):
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        self.name, self.ids, self.hashes = row["segment"], row["doc_id"], row["text_hash"]
        self.starts = np.frombuffer(row["starts"], np.int32)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.sizes = np.frombuffer(unpack.decompress(row["sizes"]), np.int32)
        steps = np.frombuffer(unpack.decompress(row["positions"]), np.int32)
        self.ends = np.cumsum(self.sizes, dtype=np.int64)
        self.first = self.ends - self.sizes
        # Positions are differences inside each list: a running sum, less what the lists before have added.
        run = np.cumsum(steps, dtype=np.int64)
        self.positions = run - np.repeat(run[self.first] - steps[self.first], self.sizes) if len(steps) else run

    def locate(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each term, its list number and its number of postings, 0 if absent."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(0, len(self.terms) - 1))
        if not len(self.terms):
            return at, np.zeros(len(terms), np.int64)
        return at, np.where(self.terms[at] == terms, self.sizes[at], 0).astype(np.int64)

    def list_of(self, k: int) -> np.ndarray:
        return self.positions[self.first[k] : self.ends[k]]

    def phrase(self, lists: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Where the words begin one after the other inside one document."""
        order = np.argsort(counts, kind="stable")
        at = self.list_of(lists[order[0]]) - order[0]
        for j in order[1:]:
            if not len(at):
                return at
            other = self.list_of(lists[j])
            k = np.minimum(np.searchsorted(other, at + j), len(other) - 1)
            at = at[other[k] == at + j]
        at = at[at >= 0]
        return at[np.searchsorted(self.starts, at, "right") == np.searchsorted(self.starts, at + len(lists) - 1, "right")]

    def near(self, lists: np.ndarray, counts: np.ndarray, within: int) -> np.ndarray:
        """Occurrences of the rarest word that have every other word at most `within` words away in the same document."""
        order = np.argsort(counts, kind="stable")
        at = self.list_of(lists[order[0]])
        for j in order[1:]:
            doc = np.searchsorted(self.starts, at, "right")
            lo, hi = np.maximum(at - within, self.starts[doc - 1]), np.minimum(at + within, self.starts[doc] - 1)
            other = self.list_of(lists[j])
            at = at[np.searchsorted(other, hi, "right") > np.searchsorted(other, lo, "left")]
        return at


def _windows(items: list[tuple[int, bytes]], length: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of the items; windows as rows of term numbers (-1 beyond a short item), their lengths, and whose they are."""
    h, starts = terms_of([t for _, t in items], ALPHANUMERIC)
    terms, number = np.unique(h, return_inverse=True)
    longest = int(np.diff(starts).max(initial=0))
    width = max(1, longest if length is None else min(length, longest))
    rows, lengths, owner = [], [], []
    for k, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
        n = min(width, b - a)
        for s in range(a, b - n + 1 if n else a):
            rows.append(np.pad(number[s : s + n], (0, width - n), constant_values=-1))
            lengths.append(n)
            owner.append(k)
    return terms, np.array(rows, np.int64).reshape(-1, width), np.array(lengths, np.int64), np.array(owner, np.int64)


_HITS = "segment string, row int, doc_id bigint, text_hash bigint, n_words int, spans array<struct<a:int,b:int>>, items array<bigint>"


def _search(block, within: int | None):
    """Per document of each segment: the stretches of words inside a match, and the items that matched."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, terms, windows, lengths, owner = block.value
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        for batch in it:
            for k in range(batch.num_rows):
                seg = Segment({c: batch.column(c)[k].as_py() for c in batch.schema.names})
                n_docs = len(seg.ids)
                lists, counts = seg.locate(terms)
                of_window = np.where(windows < 0, np.iinfo(np.int64).max, counts[windows])
                cover, items = np.zeros(int(seg.starts[-1]) + 1, np.int64), [set() for _ in range(n_docs)]
                for w in np.flatnonzero(of_window.min(axis=1, initial=np.iinfo(np.int64).max) > 0).tolist():
                    n = int(lengths[w])
                    own = windows[w, :n]
                    at = seg.phrase(lists[own], counts[own]) if within is None else seg.near(lists[own], counts[own], within)
                    if not len(at):
                        continue
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + (n if within is None else 1), -1)
                    for d in np.unique(np.searchsorted(seg.starts, at, "right") - 1).tolist():
                        items[d].add(ids[owner[w]])
                inside = np.cumsum(cover)[:-1] > 0
                # A hit stretch ends with its document even where the next document's first word is hit as well.
                edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]])))
                a, b = edges[::2], edges[1::2]
                spans: list[list[dict]] = [[] for _ in range(n_docs)]
                for s, e in zip(a.tolist(), b.tolist(), strict=True):
                    while s < e:
                        d = int(np.searchsorted(seg.starts, s, "right")) - 1
                        stop = min(e, int(seg.starts[d + 1]))
                        spans[d].append({"a": s - int(seg.starts[d]), "b": stop - int(seg.starts[d])})
                        s = stop
                yield pa.record_batch(
                    {
                        "segment": pa.array([seg.name] * n_docs, pa.string()),
                        "row": pa.array(range(n_docs), pa.int32()),
                        "doc_id": pa.array(seg.ids, pa.int64()),
                        "text_hash": pa.array(seg.hashes, pa.int64()),
                        "n_words": pa.array(np.diff(seg.starts), pa.int32()),
                        "spans": pa.array(spans, kind),
                        "items": pa.array([sorted(i for i in s if i is not None) for s in items], pa.list_(pa.int64())),
                    }
                )

    return run


def matches(index: DataFrame, items: DataFrame, window: int | None = WINDOW, within: int | None = None, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, spans (word stretches in a match), items, for every indexed document.

    With `within`, an item matches where all its words (all of the item, `window` is not used) stand at most so many words from
    an occurrence of its rarest word. Null and empty documents have no words; items without words match nothing, and an item
    with a null id marks words but is not listed. Equal item ids count once.
    """
    spark = index.sparkSession
    t = whole(text)
    tests = items.select(F.col(item_id).cast("long").alias("item_id"), t.alias("text"))
    words = tests.agg(F.sum(F.size(F.split("text", "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+")))).first()[0] or 0
    blocks = max(1, -(-words // BLOCK_WORDS))
    parts = None
    for b in range(blocks):
        own = tests if blocks == 1 else tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = [(r.item_id, r.text.encode()) for r in own.collect()]
        # One block of about BLOCK_WORDS words of the stated query set; its windows are sent to all executors.
        block = spark.sparkContext.broadcast(([i for i, _ in rows], *_windows(rows, window if within is None else None)))
        found = index.mapInArrow(_search(block, within), _HITS)
        parts = found if parts is None else parts.unionByName(found)
    merged = parts.groupBy("segment", "row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("text_hash").alias("text_hash"),
        F.first("n_words").cast("long").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(F.greatest(acc.end, s.b).alias("end"), (acc.n + F.greatest(F.lit(0), s.b - F.greatest(acc.end, s.a))).alias("n")),
        lambda acc: acc.n,
    )
    return merged.select("doc_id", "text_hash", "n_words", covered.alias("n_hit"), "spans", "items")


def contaminated():
    """The contract's rule: words are hit, and they are at least a twentieth of the document."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
