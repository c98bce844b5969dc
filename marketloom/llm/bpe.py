"""BPE encoding and decoding by a distinct-word table.

1. Documents are split into words partition by partition. A batch (the documents of a stretch of one input partition) keeps
   its distinct words once, dealt into hash buckets, and each document becomes a list of word numbers. More frequent classes
   of words have lower numbers, which pack well; inside a class numbers follow the order of the words, so a batch keeps one
   class a word instead of a permutation.
2. The words of all batches meet by bucket; there every distinct word is encoded once.
3. The ids go back to their batch by bucket, and word numbers turn into ids by position. Decoding joins ids to pieces
   through the vocabulary, which has a fixed size.

Nothing larger than one batch or one bucket is held by a task; the number of buckets follows the bytes of text, so a bucket
keeps its size at any input size, and a word costs one row a batch however often it occurs.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import store, whole

#: Texts of these characters alone are not changed by the normaliser but for lower case, and every engine classes them alike.
_PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e\\xa1-\\xac\\xae-\\u017f]*")
_NORMAL = ["NFC", "Replace", "Lowercase"]
BATCH_CHARS = 20_000_000
STRETCH = 150_000  # words
LEVEL = 9  # of compression; what is packed is stored once and shuffled once


class Words:
    """Splits texts at white space as the tokenizer's rules allow, and encodes single words."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        d = json.loads(spec)
        steps = d["pre_tokenizer"]["pretokenizers"]
        self.special = {a["content"]: a["id"] for a in d["added_tokens"]}
        self._marks = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self._normal = Tokenizer.from_str(json.dumps(d | {"added_tokens": []})).normalizer
        self._merge = Tokenizer.from_str(json.dumps(d | {"added_tokens": [], "normalizer": None}))
        if [n["type"] for n in d["normalizer"]["normalizers"]] != _NORMAL or [s["type"] for s in steps] != ["Split", "ByteLevel"] or steps[0]["behavior"] != "Removed":
            raise ValueError("words can be encoded apart only where the tokenizer drops white space and works in lower case")

    def of(self, text: str) -> list[str]:
        if self._marks and "<" in text:
            parts = self._marks.split(text)
            if len(parts) > 1:
                return [w for p in parts for w in ([p] if p in self.special else self._plain(p))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        # The pre-tokenizer's pieces never hold white space and depend on nothing beyond it, so a stretch between blanks is a word.
        # The normaliser leaves blanks as the only white space; the plain characters have no other.
        if _PLAIN.fullmatch(text):
            return text.lower().split()
        return [w for w in self._normal.normalize_str(text).split(" ") if w]

    def ids(self, words: list[str]) -> list[list[int]]:
        own = [w for w in words if w not in self.special]
        it = iter(self._merge.encode_batch_fast(own, add_special_tokens=False))
        return [[self.special[w]] if w in self.special else next(it).ids for w in words]


@lru_cache(maxsize=2)
def words_of(spec: str) -> Words:
    """Kept by the worker process: building the tables takes longer than encoding a bucket."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Words(spec)


class Numbers(dict):
    """Numbers words in the order of their first use."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


_BATCHES = "batch string, bucket int, words binary, doc_id array<bigint>, lengths binary, classes binary, codes binary"


def _by_class(classes: np.ndarray) -> np.ndarray:
    """Positions in the order of the words' numbers: more frequent classes first, and by position inside a class."""
    return np.argsort(-classes.astype(np.int16), kind="stable").astype(np.int32)


def _batches(buckets: int, spec) -> object:
    """Documents to batches: one row with the documents' word numbers, and one per bucket with its distinct words."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        words = words_of(spec.value)
        pack = zstandard.ZstdCompressor(level=LEVEL)
        part, n = TaskContext.get().partitionId(), 0
        schema = pa.schema([("batch", pa.string()), ("bucket", pa.int32()), ("words", pa.binary()), ("doc_id", pa.list_(pa.int64())), ("lengths", pa.binary()), ("classes", pa.binary()), ("codes", pa.binary())])
        number = Numbers()
        ids: list[int | None] = []
        lengths: list[int] = []
        codes: list[np.ndarray] = []
        chars = 0

        def close() -> pa.RecordBatch:
            nonlocal n
            home = [zlib.crc32(w.encode()) % buckets for w in number]
            names = list(number)
            order = np.array(sorted(range(len(names)), key=lambda i: (home[i], names[i])), np.int64)  # like words together pack well
            flat = np.concatenate(codes)
            classes = np.log2(np.bincount(flat, minlength=len(names)))[order].astype(np.uint8)
            place = np.empty(len(order), np.int32)
            place[order[_by_class(classes)]] = np.arange(len(order), dtype=np.int32)
            flat = place[flat]
            used, first = np.unique(np.array(home, np.int64)[order], return_index=True)
            ends = np.append(first, len(order))[1:]
            lists = [pack.compress("\n".join([names[i] for i in order[a:b]]).encode()) for a, b in zip(first, ends, strict=True)]
            k = len(used)
            out = pa.record_batch(
                [
                    pa.array([f"{part}-{n}"] * (k + 1), pa.string()),
                    pa.array([-1, *used.tolist()], pa.int32()),
                    pa.array([None, *lists], pa.binary()),
                    pa.array([ids, *[None] * k], pa.list_(pa.int64())),
                    pa.array([np.array(lengths, np.int32).tobytes(), *[None] * k], pa.binary()),
                    pa.array([pack.compress(classes.tobytes()), *[None] * k], pa.binary()),
                    pa.array([pack.compress(flat.view(np.uint8).reshape(-1, 4).T.tobytes()), *[None] * k], pa.binary()),
                ],
                schema=schema,
            )
            n += 1
            return out

        for rows in it:
            for doc_id, text in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
                text = text.as_py()
                own = words.of(text)
                codes.append(np.array(list(map(number.__getitem__, own)), np.int32))
                ids.append(doc_id)
                lengths.append(len(own))
                chars += len(text)
                if chars >= BATCH_CHARS:
                    yield close()
                    number, ids, lengths, codes, chars = Numbers(), [], [], [], 0
        if ids:
            yield close()

    return run


def _encode(spec):
    """The rows of one bucket, from all batches: each distinct word is encoded once."""

    def run(rows: pa.Table) -> pa.Table:
        import zstandard

        pack, unpack = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
        lists = [unpack.decompress(w.as_py()).decode().split("\n") for w in rows.column("words")]
        distinct = list(dict.fromkeys(w for ws in lists for w in ws))
        ids = dict(zip(distinct, (" ".join(map(str, i)) for i in words_of(spec.value).ids(distinct)), strict=True))
        coded = [pack.compress("\n".join([ids[w] for w in ws]).encode()) for ws in lists]
        return pa.table({"batch": rows.column("batch"), "bucket": rows.column("bucket"), "ids": pa.array(coded, pa.binary())})

    return run


def _rebuild(pieces):
    """A batch and the ids of its words: ids and decoded text of each document."""

    def run(docs: pa.Table, coded: pa.Table) -> pa.Table:
        import zstandard

        if docs.num_rows != 1:
            raise ValueError("a batch has one row of documents")
        piece, unpack = pieces.value, zstandard.ZstdDecompressor()
        texts = [unpack.decompress(x.as_py()).decode() for x in coded.sort_by("bucket").column("ids")]
        flat = np.fromstring(" ".join(texts), np.int32, sep=" ")
        sizes = np.array([w.count(" ") + 1 for s in texts for w in s.split("\n")], np.int64)
        if sizes.sum() != len(flat):
            raise ValueError("a word without ids")
        starts = np.cumsum(sizes) - sizes
        pieces_of = list(map(piece.__getitem__, flat.tolist()))
        decoded = [" ".join(pieces_of[a:b]) for a, b in zip(starts.tolist(), (starts + sizes).tolist(), strict=True)]
        del texts, pieces_of
        ids = docs.column("doc_id")[0].as_py()
        ends = np.cumsum(np.frombuffer(docs.column("lengths")[0].as_py(), np.int32), dtype=np.int64)
        place = _by_class(np.frombuffer(unpack.decompress(docs.column("classes")[0].as_py()), np.uint8))
        planes = np.frombuffer(unpack.decompress(docs.column("codes")[0].as_py()), np.uint8).reshape(4, -1)
        codes = np.ascontiguousarray(planes.T).view(np.int32).reshape(-1)
        parts, i, word = [], 0, 0
        while i < len(ids):  # stretches of documents, so that what is unfolded stays small
            j = max(i + 1, int(np.searchsorted(ends, word + STRETCH)))
            own = place[codes[word : int(ends[j - 1])]]
            n = sizes[own]
            at = np.cumsum(n)
            tokens = flat[np.repeat(starts[own] - (at - n), n) + np.arange(int(at[-1]) if len(at) else 0)]
            cuts = np.concatenate([[0], ends[i:j] - word])
            strings = list(map(decoded.__getitem__, own.tolist()))
            parts.append(
                pa.record_batch(
                    {
                        "doc_id": pa.array(ids[i:j], pa.int64()),
                        "ids": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], at])[cuts], pa.int32()), pa.array(tokens, pa.int32())),
                        "decoded": pa.array([" ".join(strings[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.string()),
                    }
                )
            )
            i, word = j, int(ends[j - 1])
        return pa.Table.from_batches(parts)

    return run


def encode_decode(docs: DataFrame, spec: str, bucket_bytes: int = 16_000_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array of int), decoded (string) of every row of `docs`.

    `spec` is the JSON of a tokenizer whose pre-tokenizer is a split followed by byte levels, without a decoder: pieces are
    joined by blanks. Null and empty texts have no ids and decode to ''. Repeated rows and null ids are kept as they are.
    Strings of special tokens inside a text become those tokens, as in the tokenizers library.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    d = json.loads(spec)
    piece = {i: p for p, i in d["model"]["vocab"].items()} | {a["id"]: a["content"] for a in d["added_tokens"]}
    # Both are of the size of the vocabulary file.
    spec_b, piece_b = context.broadcast(spec), context.broadcast(piece)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = store(rows.mapInArrow(_batches(max(16, size // bucket_bytes), spec_b), _BATCHES), "bpe-batches")
    coded = batches.where("bucket >= 0").select("batch", "bucket", "words").groupBy("bucket").applyInArrow(_encode(spec_b), "batch string, bucket int, ids binary")
    held = batches.where("bucket < 0").select("batch", "doc_id", "lengths", "classes", "codes")
    return held.groupBy("batch").cogroup(coded.groupBy("batch")).applyInArrow(_rebuild(piece_b), "doc_id bigint, ids array<int>, decoded string")
