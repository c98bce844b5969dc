"""Removal of repeated byte strings by suffix arrays.

A byte goes if it lies in a string of LENGTH bytes that also starts elsewhere, in the same or another text.

1. Texts are marked at content-defined positions: any LENGTH bytes hold a mark of their own. Marks of one kind that follow each
   other closely, as in periodic texts, are kept as one stretch. Only the surroundings of marks that occur twice can hold a
   repeat; these regions are cut out of the texts, and nothing is lost by that. Long regions are cut into pieces that overlap
   by LENGTH - 1 bytes, so that every string lies in one piece and starts there only.
2. Regions are sorted by their marks, so that similar ones are neighbours, and gathered into blocks of bounded size. Each
   block gets its suffix array and common prefixes, which give the repeats inside it.
3. Across blocks: where a mark occurs in several, the strings around it are given out as sorted fingerprints (96 bits),
   dealt by value, and the sorted lists of the blocks are merged by binary search.

Equal texts are one text with a count. A text of at least LENGTH bytes that occurs twice goes as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.anchors import gram_hashes_at, marks, runs
from marketloom.llm.common import store, whole
from marketloom.llm.suffixes import common_prefixes, suffix_array

LENGTH = 400
BLOCK_BYTES = 2_500_000

_TEXT = ["th1", "th2"]
#: Hash, first and last place of a stretch of equal marks.
_MARK = pa.struct([("h", pa.int64()), ("p", pa.int32()), ("q", pa.int32())])
_MARKS = "array<struct<h:bigint,p:int,q:int>>"
_MARKED = f"doc_id bigint, th1 bigint, th2 bigint, n_bytes bigint, sha256 string, marks {_MARKS}"


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    t = whole(text)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(t).alias("th1"), F.xxhash64(F.lit("text"), t).alias("th2"), F.encode(t, "UTF-8").alias("bytes"))


def _mark(length: int):
    gram = length // 2
    window = length - gram + 1

    def found_in(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return marks(data, gram, window)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in it:
            n_bytes, sha, sizes = [], [], []
            found = [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))]
            for t in rows.column("bytes"):
                data = t.as_buffer()
                n_bytes.append(len(data))
                sha.append(hashlib.sha256(data).hexdigest())
                found.append(runs(*found_in(np.frombuffer(data, np.uint8) if len(data) >= length else np.empty(0, np.uint8)), window))
                sizes.append(len(found[-1][0]))
            h, p, q = (np.concatenate(x) for x in zip(*found, strict=True))
            stretches = pa.StructArray.from_arrays([pa.array(h.view(np.int64)), pa.array(p, pa.int32()), pa.array(q, pa.int32())], fields=list(_MARK))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            yield pa.record_batch(
                {
                    **{c: rows.column(c) for c in ("doc_id", *_TEXT)},
                    "n_bytes": pa.array(n_bytes, pa.int64()),
                    "sha256": pa.array(sha, pa.string()),
                    "marks": pa.ListArray.from_arrays(offsets, stretches),
                }
            )

    return run


_REGION = f"struct<start:int,stop:int,key:bigint,marks:{_MARKS}>"


def pieces(stretches: list[dict], n: int, length: int, most: int) -> list[dict]:
    """The surroundings of marks in a text of n bytes, cut into pieces of at most `most` bytes: start, stop, the marks of each
    (places counted from its start) and the least of their hashes. Pieces of a region overlap by `length - 1` bytes."""
    gram = length // 2
    regions: list[dict] = []
    for m in sorted(stretches, key=lambda m: m["p"]):
        start, stop = max(0, m["p"] + gram - length), min(n, m["q"] + length)
        if regions and start <= regions[-1]["stop"]:
            regions[-1]["stop"] = max(regions[-1]["stop"], stop)
        else:
            regions.append({"start": start, "stop": stop, "marks": []})
        regions[-1]["marks"].append(m)
    out = []
    for r in regions:
        own, first = r["marks"], 0
        for start in range(r["start"], max(r["start"] + 1, r["stop"] - length + 1), most - length + 1):
            stop = min(r["stop"], start + most)
            while first < len(own) and own[first]["q"] < start and own[first]["p"] < start:
                first += 1
            here = []
            for m in own[first:]:
                if m["p"] > stop - gram:
                    break
                p, q = max(m["p"], start), min(m["q"], stop - gram)
                if p <= q:
                    here.append({"h": m["h"], "p": p - start, "q": q - start})
            if here and stop - start >= length:
                out.append({"start": start, "stop": stop, "key": min(m["h"] for m in here), "marks": here})
    return out


def _regions(length: int, most: int):
    """Texts with their repeated marks: the pieces around these."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("key", pa.int64()), ("marks", pa.list_(_MARK))]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in it:
            out = [pieces(m, len(t.as_buffer()), length, most) for m, t in zip(rows.column("marks").to_pylist(), rows.column("bytes"), strict=True)]
            yield pa.record_batch({"th1": rows.column("th1"), "th2": rows.column("th2"), "bytes": rows.column("bytes"), "regions": pa.array(out, kind)})

    return run


def _number_blocks(block_bytes: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, size = TaskContext.get().partitionId(), 0, 0
        for rows in it:
            names = []
            for length in (rows.column("stop").to_numpy() - rows.column("start").to_numpy()).tolist():
                if size and size + length > block_bytes:
                    n, size = n + 1, 0
                size += length
                names.append(f"{part}-{n}")
            yield pa.record_batch([pa.array(names, pa.string()), *rows.columns], names=["block", *rows.schema.names])

    return run


_SORTED = "block string, slice int, prints binary, checks binary, places binary, th1 array<bigint>, th2 array<bigint>, starts array<int>, lengths array<int>"
_SORTED_TYPES = pa.schema(
    [("block", pa.string()), ("slice", pa.int32())]
    + [(c, pa.binary()) for c in ("prints", "checks", "places")]
    + [(c, pa.list_(pa.int64())) for c in _TEXT]
    + [(c, pa.list_(pa.int32())) for c in ("starts", "lengths")]
)


def _sort_block(length: int, slices: int):
    """One row (slice -1) with the regions and the starts that are repeated inside the block, and one per slice of fingerprints."""
    gram = length // 2
    step = -(-(1 << 64) // slices)

    def run(rows: pa.Table, crossing: pa.Table) -> pa.Table:
        rows = rows.sort_by([("key", "ascending"), ("th1", "ascending"), ("th2", "ascending"), ("start", "ascending")])
        block = rows.column("block")[0].as_py()
        parts = [np.frombuffer(b.as_buffer(), np.uint8) for b in rows.column("bytes")]
        lengths = np.array([len(p) for p in parts], np.int64)
        data = np.concatenate(parts)
        del parts
        texts = rows.select([*_TEXT, "start", "marks"]).to_pydict()
        del rows
        n, ends = len(data), np.cumsum(lengths)
        order = suffix_array(data)
        group = np.cumsum(common_prefixes(data, order) < length, dtype=np.int32) - 1
        # A start counts if its string ends inside its region.
        whole_ = np.ones(n, bool)
        for end, size in zip(ends.tolist(), lengths.tolist(), strict=True):
            whole_[max(end - size, end - length + 1) : end] = False
        inside = whole_[order]
        order, group = order[inside], group[inside]
        del inside, whole_
        repeated = order[np.bincount(group, minlength=1)[group] > 1]
        first = np.zeros(n, bool)  # one start of each distinct string
        first[order[np.append(True, group[1:] != group[:-1])[: len(order)]]] = True
        del order, group
        known = {m for h in crossing.column("hs").to_pylist() for m in h}
        near = np.zeros(n + 1, np.int32)
        for end, size, stretches in zip(ends.tolist(), lengths.tolist(), texts["marks"], strict=True):
            for m in stretches:
                if m["h"] in known:
                    near[max(end - size, end - size + m["p"] + gram - length)] += 1
                    near[min(end - size + m["q"], n - 1) + 1] -= 1
        given = np.flatnonzero(first & (np.cumsum(near)[:-1] > 0))
        del first, near
        prints, checks = _prints(data, length, given)
        del data
        by = np.argsort(prints, kind="stable")
        prints, checks, given = prints[by], checks[by], given[by]
        # Members of a group stand together in the order; the start that is given out speaks for all of them.
        cuts = np.searchsorted(prints, np.array([min(step * s, (1 << 64) - 1) for s in range(slices)], np.uint64)) if len(prints) else np.zeros(slices, np.int64)
        cuts = np.append(cuts, len(prints))
        lists = [(s, int(a), int(b)) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        info = {"th1": texts["th1"], "th2": texts["th2"], "starts": texts["start"], "lengths": lengths.tolist()}
        out = [{"block": block, "slice": -1, "prints": None, "checks": None, "places": repeated.astype(np.int32).tobytes(), **info}]
        for s, a, b in lists:
            out.append({"block": block, "slice": s, "prints": prints[a:b].tobytes(), "checks": checks[a:b].tobytes(), "places": given[a:b].astype(np.int32).tobytes()})
        return pa.Table.from_pylist(out, schema=_SORTED_TYPES)

    return run


def _prints(data: np.ndarray, length: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits, by two polynomials, of the strings that start at `at`."""
    if not len(at):
        return np.empty(0, np.uint64), np.empty(0, np.uint32)
    return gram_hashes_at(data, length, at), (gram_hashes_at(data[::-1], length, len(data) - length - at) >> np.uint64(32)).astype(np.uint32)


def _merge(rows: pa.Table) -> pa.Table:
    """The lists of one slice from all blocks: which of their strings another block has as well."""
    lists = [np.frombuffer(p.as_buffer(), np.uint64) for p in rows.column("prints")]
    checks = [np.frombuffer(p.as_buffer(), np.uint32) for p in rows.column("checks")]
    places = [np.frombuffer(p.as_buffer(), np.int32) for p in rows.column("places")]
    every, check = np.concatenate(lists), np.concatenate(checks)
    by = np.lexsort((check, every))
    every, check = every[by], check[by]
    new = np.concatenate([[True], (every[1:] != every[:-1]) | (check[1:] != check[:-1])])
    several = every[new][np.diff(np.append(np.flatnonzero(new), len(every))) > 1]
    several_checks = check[new][np.diff(np.append(np.flatnonzero(new), len(every))) > 1]
    found = []
    for own, c, at in zip(lists, checks, places, strict=True):
        a = np.minimum(np.searchsorted(several, own), max(0, len(several) - 1))
        hit = np.zeros(len(own), bool)
        while len(several):  # equal prints with different checks stand in a row
            hit |= (several[a] == own) & (several_checks[a] == c)
            nxt = np.minimum(a + 1, len(several) - 1)
            if not ((several[nxt] == own) & ~hit & (nxt > a)).any():
                break
            a = np.where((several[nxt] == own) & ~hit, nxt, a)
        found.append(at[hit].tobytes())
    out = pa.table({"block": rows.column("block"), "found": pa.array(found, pa.binary())})
    return out.filter(pa.array([len(f) > 0 for f in found], pa.bool_()))


_SPANS = "th1 bigint, th2 bigint, spans array<struct<a:int,b:int>>"


def _spans(length: int):
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in it:
            for k in range(rows.num_rows):
                row = {c: rows.column(c)[k].as_py() for c in rows.schema.names}
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                starts = np.concatenate([np.frombuffer(b, np.int32) for b in [row["places"], *(row["found"] or [])]]).astype(np.int64)
                cover = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int64)
                np.add.at(cover, starts, 1)
                np.add.at(cover, starts + length, -1)
                gone = np.cumsum(cover)[:-1] > 0
                out = {c: [] for c in (*_TEXT, "spans")}
                for e, n, th1, th2, start in zip(ends.tolist(), lengths.tolist(), row["th1"], row["th2"], row["starts"], strict=True):
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone[e - n : e].astype(np.int8), [0]]))) + start
                    if len(edges):
                        out["th1"].append(th1)
                        out["th2"].append(th2)
                        out["spans"].append([{"a": a, "b": b} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)])
                yield pa.record_batch([pa.array(out["th1"], pa.int64()), pa.array(out["th2"], pa.int64()), pa.array(out["spans"], kind)], names=[*_TEXT, "spans"])

    return run


def _cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the spans to go: what is left of them."""
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    for rows in it:
        spans, kept, sha = [], [], []
        for text, lists in zip(rows.column("bytes"), rows.column("spans").to_pylist(), strict=True):
            data, own = text.as_buffer().to_pybytes(), []
            for s in sorted((s for part in lists for s in part), key=lambda s: s["a"]):
                if own and s["a"] <= own[-1]["b"]:
                    own[-1]["b"] = max(own[-1]["b"], s["b"])
                else:
                    own.append(dict(s))
            edges = [0, *(x for s in own for x in (s["a"], s["b"])), len(data)]
            left = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            spans.append(own)
            kept.append(left)
            sha.append(hashlib.sha256(left).hexdigest())
        yield pa.record_batch({"th1": rows.column("th1"), "th2": rows.column("th2"), "spans": pa.array(spans, kind), "kept": pa.array(kept, pa.binary()), "kept_sha256": pa.array(sha, pa.string())})


def remove_repeats(docs: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (byte ranges that go), kept (bytes left, null where nothing went), kept_sha256 for every row.

    Texts are taken as UTF-8; null texts are empty. Texts shorter than `length` stay. Rows that repeat a text of at least
    `length` bytes lose it whole, rows with a null or repeated id like all others. An empty table gives no rows.
    """
    keyed = _keyed(docs, doc_id, text)
    marked = store(keyed.mapInArrow(_mark(length), _MARKED), "marked-texts")
    texts = marked.where(F.col("n_bytes") >= length).groupBy(*_TEXT).agg(F.count("*").alias("copies"), F.min("doc_id").alias("sample"), F.first("marks").alias("marks"))
    texts = store(texts, "distinct-texts")
    marked_at = texts.select("th1", F.explode("marks").alias("m")).select("th1", "m.h", "m.p", "m.q")
    twice = marked_at.groupBy("h").agg(F.sum(F.when(F.col("q") > F.col("p"), 2).otherwise(1)).alias("n")).where("n > 1").select("h")
    repeated = marked_at.join(twice, "h").groupBy("th1").agg(F.collect_set(F.struct("h", "p", "q")).alias("marks"))
    wanted = texts.select(*_TEXT, "sample").join(repeated, "th1").select(F.col("th1").alias("w1"), F.col("th2").alias("w2"), "sample", "marks")
    # The hashed side holds marks; the texts need no sort.
    chosen = keyed.join(wanted.hint("shuffle_hash"), (F.col("th1") == F.col("w1")) & (F.col("th2") == F.col("w2")) & F.col("doc_id").eqNullSafe(F.col("sample")))
    cut_out = store(chosen.select(*_TEXT, "bytes", "marks").mapInArrow(_regions(length, max(2 * length, block_bytes // 2)), f"th1 bigint, th2 bigint, bytes binary, regions array<{_REGION}>"), "repeat-texts")

    r = F.col("r")
    regions = cut_out.select(*_TEXT, "bytes", F.explode("regions").alias("r")).select(
        *_TEXT, r["start"].alias("start"), r["stop"].alias("stop"), r["key"].alias("key"), r["marks"].alias("marks"), F.expr("substring(bytes, r.start + 1, r.stop - r.start)").alias("bytes")
    )
    regions = regions.repartitionByRange("key", "th1").sortWithinPartitions("key", "th1", "th2", "start")
    blocks = store(regions.mapInArrow(_number_blocks(block_bytes), f"block string, th1 bigint, th2 bigint, start int, stop int, key bigint, marks {_MARKS}, bytes binary"), "repeat-blocks")
    homes = blocks.select(F.col("block").alias("home"), F.explode("marks.h").alias("h")).distinct()
    shared = homes.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    crossing = homes.join(shared, "h").groupBy("home").agg(F.collect_list("h").alias("hs"))
    size = blocks.agg(F.sum(F.col("stop") - F.col("start"))).first()[0] or 0
    arrays = blocks.groupBy("block").cogroup(crossing.groupBy("home")).applyInArrow(_sort_block(length, max(16, size // (block_bytes // 2))), _SORTED)
    arrays = store(arrays, "suffix-arrays")
    found = arrays.where("slice >= 0").select("block", "slice", "prints", "checks", "places").groupBy("slice").applyInArrow(_merge, "block string, found binary")
    found = found.groupBy("block").agg(F.collect_list("found").alias("found"))
    inside = arrays.where("slice < 0").select("block", "places", *_TEXT, "starts", "lengths").join(found, "block", "left")
    spans = inside.select("places", "found", *_TEXT, "starts", "lengths").mapInArrow(_spans(length), _SPANS)
    spans = spans.groupBy(*_TEXT).agg(F.collect_list("spans").alias("spans"))
    left = cut_out.select(*_TEXT, "bytes").join(spans, _TEXT).select(*_TEXT, "bytes", "spans").mapInArrow(_cut, f"{_SPANS}, kept binary, kept_sha256 string")

    state = texts.select(*_TEXT, "copies").join(left, _TEXT, "left").where("copies > 1 OR spans IS NOT NULL")
    out = marked.select("doc_id", *_TEXT, "n_bytes", "sha256").join(state, _TEXT, "left")
    several = F.col("copies") > 1
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(several, F.array(F.struct(F.lit(0).alias("a"), F.col("n_bytes").cast("int").alias("b")))).otherwise(F.coalesce("spans", F.array().cast("array<struct<a:int,b:int>>"))).alias("spans"),
        F.when(several, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
        F.when(several, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    )
