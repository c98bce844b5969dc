"""Content-defined sampling of byte strings: which positions of a text are marked depends on the bytes around them alone."""

from __future__ import annotations

import numpy as np

from marketloom.llm.tokens import mix

_R = 0x9E3779B97F4A7C15
_R_INVERSE = pow(_R, -1, 1 << 64)


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k-byte strings of `data`, by differences of one running polynomial."""
    n = len(data)
    if n < k:
        return np.empty(0, np.uint64)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _geometric(_R, n), dtype=np.uint64)])
    return mix((run[k:] - run[:-k]) * _geometric(_R_INVERSE, n - k + 1))


def gram_hashes_at(data: np.ndarray, k: int, at: np.ndarray) -> np.ndarray:
    """The same hashes for the strings that start at `at` only."""
    run = data.astype(np.uint64)
    run += np.uint64(1)
    run *= _geometric(_R, len(data))
    np.cumsum(run, out=run)
    last = np.asarray(at, np.int64) + k - 1
    out = run[last]
    out -= np.where(at > 0, run[np.maximum(at, 1) - 1], np.uint64(0))
    del run
    return mix(out * _geometric(_R_INVERSE, len(data) - k + 1)[at])


def _sliding(x: np.ndarray, w: int, op, rest) -> np.ndarray:
    """op over x[i : i + w] for all i, from running values to the left and right of block borders."""
    n = len(x) - w + 1
    padded = np.concatenate([x, np.full(-len(x) % w, rest, x.dtype)]).reshape(-1, w)
    ahead = op.accumulate(padded, axis=1).reshape(-1)
    back = op.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return op(back[:n], ahead[w - 1 : w - 1 + n])


def winnow(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions that hold the least hash of some stretch of w positions; every stretch has one."""
    if len(hashes) < w:
        return np.empty(0, np.int64)
    least = _sliding(hashes, w, np.minimum, np.iinfo(np.uint64).max)
    edge = np.zeros(w - 1, np.uint64)
    return np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), w, np.maximum, np.uint64(0)) == hashes)


def marks(data: np.ndarray, gram: int, window: int, chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the marked `gram`-byte strings of a text of any length, `chunk` positions at a time."""
    hashes, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    total = len(data) - gram + 1
    for a in range(0, max(total, 0), chunk):
        b = min(a + chunk, total)
        # All windows of the chunk's positions.
        lo, hi = max(0, a - window + 1), min(total, b + window - 1)
        h = gram_hashes(data[lo : hi + gram - 1], gram)
        p = winnow(h, window) + lo
        p = p[(p >= a) & (p < b)]
        hashes.append(h[p - lo])
        places.append(p)
    return np.concatenate(hashes), np.concatenate(places)


def runs(hashes: np.ndarray, places: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and last place of stretches of equal marks that follow each other at most `reach` apart."""
    if not len(places):
        return hashes, places, places
    new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (np.diff(places) > reach)])
    starts = np.flatnonzero(new)
    return hashes[starts], places[starts], places[np.append(starts[1:], len(places)) - 1]
