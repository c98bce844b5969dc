"""Words of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)

#: Bytes of words: digits, letters and everything beyond ASCII; or everything but blanks.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[48:58] = ALPHANUMERIC[97:123] = ALPHANUMERIC[128:] = True
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[9:14] = NOT_BLANK[32] = False


def mix(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def terms_of(texts: list[bytes], inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, A-Z lowered, and where each text begins among them (one more entry than texts)."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    raw = _LOWER[np.frombuffer(b"\0".join([*texts, b""]), np.uint8)]
    word = inside[raw]
    word[bounds[1:] - 1] = False
    edge = np.flatnonzero(np.diff(word, prepend=False))
    starts, lengths = edge[::2], edge[1::2] - edge[::2]
    text_starts = np.searchsorted(starts, bounds)
    if not len(starts):
        return np.empty(0, np.uint64), text_starts
    first = np.cumsum(lengths) - lengths
    nth = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(first, lengths)
    powers = np.full(int(lengths.max()), _BASE, np.uint64)
    powers[0] = 1
    h = np.add.reduceat((raw[word].astype(np.uint64) + np.uint64(1)) * np.multiply.accumulate(powers)[nth], first)
    return mix(h ^ (lengths.astype(np.uint64) << np.uint64(48))), text_starts
