"""Repeated byte strings in long, near-copied and periodic texts: blocks stay bounded and the result is that of brute force."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

from marketloom.llm import repeats
from marketloom.llm.anchors import gram_hashes, gram_hashes_at, marks, runs, winnow
from marketloom.llm.suffixes import common_prefixes, suffix_array


def test_marks_by_chunks_and_places():
    rng = np.random.default_rng(4)
    d = np.concatenate([rng.integers(0, 3, 5000), np.tile([1, 2, 0], 700), rng.integers(0, 3, 900)]).astype(np.uint8)
    every = winnow(gram_hashes(d, 40), 21)
    for chunk in (1, 7, 64, 10_000):
        h, p = marks(d, 40, 21, chunk)
        assert p.tolist() == every.tolist() and h.tolist() == gram_hashes(d, 40)[every].tolist()
    assert gram_hashes_at(d, 40, every).tolist() == gram_hashes(d, 40)[every].tolist()
    assert all(len(x) == 0 for x in marks(d[:39], 40, 21))
    h, p, q = runs(gram_hashes(d, 40)[every], every, 21)
    again = [x for a, b in zip(p, q) for x in every[(every >= a) & (every <= b)]]
    assert again == every.tolist() and len(p) < len(every) - 150


@pytest.mark.parametrize("most", [800, 1300, 5000])
def test_pieces_hold_every_string_once(most):
    n, length = 20_000, 400
    stretches = [{"h": 9, "p": 100, "q": 100}, {"h": 5, "p": 700, "q": 9000}, {"h": 7, "p": 9100, "q": 9100}, {"h": 1, "p": 19_700, "q": 19_700}]
    got = repeats.pieces(stretches, n, length, most)
    assert all(length <= g["stop"] - g["start"] <= most for g in got)
    starts = Counter(s for g in got for s in range(g["start"], g["stop"] - length + 1))
    wanted = {s for m in stretches for s in range(max(0, m["p"] - 200), min(m["q"], n - length) + 1)}
    assert wanted <= set(starts) and set(starts.values()) == {1}
    # A string keeps the marks whose gram it holds.
    for g in got:
        for s in range(g["start"], g["stop"] - length + 1, 37):
            inside = {m["h"] for m in stretches if m["p"] <= s + 200 and m["q"] >= s}
            assert inside <= {m["h"] for m in g["marks"]}


def test_long_repeats_are_compared_in_stretches():
    rng = np.random.default_rng(6)
    a = rng.integers(97, 123, 300_000, dtype=np.uint8)
    d = np.concatenate([a, [65], a, [66], a[:1000]]).astype(np.uint8)
    order = suffix_array(d)
    prefix = common_prefixes(d, order)
    assert prefix.max() == 300_000 and (prefix >= 400).sum() == 300_000 - 399 + 1000 - 399
    assert np.array_equal(np.sort(order), np.arange(len(d)))
    text = d.tobytes()
    for i in range(1, len(d), 9973):
        x, y = int(order[i - 1]), int(order[i])
        assert text[x : x + 400_000] < text[y : y + 400_000]


def removed(texts):
    """Brute force by hashed windows: the bytes left of every text."""
    count = Counter()
    keyed = []
    for t in texts:
        d = np.frombuffer(t, np.uint8)
        h = gram_hashes(d, 400)
        keyed.append(h)
        count.update(dict(zip(*np.unique(h, return_counts=True))))
    out = []
    for t, h in zip(texts, keyed):
        several = np.array([count[x] > 1 for x in h], bool)
        cover = np.zeros(len(t) + 1, np.int64)
        np.add.at(cover, np.flatnonzero(several), 1)
        np.add.at(cover, np.flatnonzero(several) + 400, -1)
        out.append(np.frombuffer(t, np.uint8)[np.cumsum(cover)[:-1] == 0].tobytes())
    return out


@pytest.mark.parametrize("block", [3000, 100_000])
def test_near_copies_and_periods(spark, block):
    """Two near copies and a periodic text far longer than a block."""
    rng = np.random.default_rng(7)
    base = "".join(map(chr, rng.integers(97, 123, 200_000)))
    near = base[:90_000] + "XYZ" + base[90_010:]
    texts = [base, near, "ab" * 60_000, "unlike " + "".join(map(chr, rng.integers(97, 123, 3000))), "ab" * 300 + "end", base[5000:5600]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.kept_sha256, sum(s.b - s.a for s in r.spans)) for r in repeats.remove_repeats(df, block_bytes=block).collect()}
    left = removed([t.encode() for t in texts])
    assert got == {i: (hashlib.sha256(x).hexdigest(), len(texts[i]) - len(x)) for i, x in enumerate(left)}
    assert len(left[0]) < 500 and len(left[2]) == 0
