"""Token counts by section: each document is encoded once and as a whole, and its tokens are dealt to sections by their place."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import whole

RULES = ("start", "most")


@lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    size = np.zeros(max(table.values()) + 1, np.int64)
    for piece, i in table.items():
        size[i] = len(piece)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={}), size


def tokens_per_section(sizes: np.ndarray, starts: np.ndarray, stops: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them reach beyond it. `sizes` are the tokens' bytes in order; sections are
    byte ranges, sorted and apart from each other.

    A token belongs to the section that holds its first byte; by the rule `most`, to the one that holds most of its bytes,
    the earlier one of two that hold as many. Tokens that touch no section belong to none.
    """
    end = np.cumsum(sizes)
    begin = end - sizes
    first = np.searchsorted(stops, begin, "right")  # the first section that ends after the token's first byte
    last = np.searchsorted(starts, end - 1, "right") - 1  # the last section that begins at or before its last byte
    touched = first <= last
    k = np.minimum(first, max(0, len(starts) - 1))
    if rule == "start":
        inside = touched & (starts[k] <= begin)
        own = k
    else:
        own, inside = k.copy(), touched
        best = np.minimum(end, stops[k]) - np.maximum(begin, starts[k])
        for t in np.flatnonzero(touched & (last > first)).tolist():
            held = np.minimum(end[t], stops[first[t] : last[t] + 1]) - np.maximum(begin[t], starts[first[t] : last[t] + 1])
            own[t] = first[t] + int(held.argmax())
            best[t] = held.max()
    own, b, e = own[inside], begin[inside], end[inside]
    beyond = (b < starts[own]) | (e > stops[own])
    return np.bincount(own, minlength=len(starts)), np.bincount(own[beyond], minlength=len(starts))


_COUNTS = "doc_id bigint, n_tokens bigint, sections array<struct<section:int,start:bigint,stop:bigint,n_tokens:bigint,n_crossing:bigint>>"


def section_tokens(docs: DataFrame, ranks: bytes, pattern: str, rule: str = "start", sections: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens (of the whole text), sections (section, start, stop, n_tokens, n_crossing) for every row of `docs`.

    `sections` names a column with an array of structs (start, stop) in code points, sorted and apart; by default the lines
    are the sections, each with its line end, so that every token has one. Null and empty texts have no tokens and, by
    default, one empty section. Null section arrays have none.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))  # of the size of the vocabulary file
    kind = pa.list_(pa.struct([("section", pa.int32())] + [(c, pa.int64()) for c in ("start", "stop", "n_tokens", "n_crossing")]))

    def bounds(data: np.ndarray, given: list | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sections in code points and in bytes."""
        heads = (data & 0xC0) != 0x80
        if sections is None:
            cut = np.flatnonzero(data == 10) + 1
            byte = np.concatenate([[0], cut, [len(data)]])
            chars = np.concatenate([[0], np.cumsum(heads)])[byte]
            return chars[:-1], chars[1:], byte[:-1], byte[1:]
        at = np.append(np.flatnonzero(heads), len(data))
        a, b = (np.array([s[f] for s in given or []], np.int64) for f in ("start", "stop"))
        return a, b, at[np.minimum(a, len(at) - 1)], at[np.minimum(b, len(at) - 1)]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, size = _encoding(*shared.value)
        for rows in it:
            totals, lists = [], []
            own = rows.column(2).to_pylist() if sections is not None else [None] * rows.num_rows
            for t, given in zip(rows.column(1), own, strict=True):
                sizes = size[np.array(encoding.encode_ordinary(t.as_py()), np.int64)]
                start, stop, a, b = bounds(np.frombuffer(t.as_buffer(), np.uint8), given)
                n, crossing = tokens_per_section(sizes, a, b, rule) if len(a) else (a, a)
                totals.append(len(sizes))
                lists.append([{"section": i, "start": s, "stop": e, "n_tokens": c, "n_crossing": x} for i, (s, e, c, x) in enumerate(zip(start.tolist(), stop.tolist(), n.tolist(), crossing.tolist(), strict=True))])
            yield pa.record_batch({"doc_id": rows.column(0), "n_tokens": pa.array(totals, pa.int64()), "sections": pa.array(lists, kind)})

    extra = [F.col(sections).alias("__sections")] if sections else []
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole(text).alias("text"), *extra).mapInArrow(run, _COUNTS)
