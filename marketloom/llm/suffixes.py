"""Suffix arrays by Larsson-Sadakane refinement and common prefixes by Kasai's rule, as whole-array steps."""

from __future__ import annotations

import numpy as np


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one big-endian number; zeros beyond the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | padded[j : j + len(data)]
    return out


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Positions (int32) of `data`, which has less than 2^31 bytes, in the order of their suffixes.

    Suffixes start out grouped by eight bytes; each round sorts the groups that are not single yet by the group of the suffix
    as far ahead as the order is known, which doubles that length. A group's number is the place of its first member.
    """
    n = len(data)
    if n == 0:
        return np.empty(0, np.int32)
    key = _words(data)
    # Suffixes shorter than eight bytes are padded: from the back, they come before longer ones with the same key.
    order = (n - 1 - np.argsort(key[::-1], kind="stable")).astype(np.int32)
    key = key[order]
    new = np.empty(n, bool)
    new[0], new[1:] = True, key[1:] != key[:-1]
    del key
    end = order > n - 8  # each of these is a group of its own
    new |= end
    new[1:] |= end[:-1]
    rank = np.empty(n + 1, np.int32)
    rank[order], rank[n] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0)), -1
    at = np.flatnonzero(~(new & np.append(new[1:], True))).astype(np.int32)  # places that are still in a group of several
    known = 8
    while len(at):
        pos = order[at]
        by = rank[np.minimum(pos.astype(np.int64) + known, n)].astype(np.int64) + 1
        by |= rank[pos].astype(np.int64) << 32
        sort = np.argsort(by, kind="stable")
        pos, by = pos[sort], by[sort]
        del sort
        order[at] = pos
        new = np.empty(len(at), bool)
        new[0], new[1:] = True, by[1:] != by[:-1]
        del by
        rank[pos] = at[np.maximum.accumulate(np.where(new, np.arange(len(at), dtype=np.int32), 0))]
        at = at[~(new & np.append(new[1:], True))]
        known *= 2
    return order


#: So few open comparisons are ended one by one, in growing stretches.
_FEW = 256


def _prefix(data: np.ndarray, a: int, b: int) -> int:
    """Length of the common prefix of two suffixes."""
    done, step, most = 0, 256, len(data) - max(a, b)
    while done < most:
        size = min(step, most - done)
        other = data[a + done : a + done + size] != data[b + done : b + done + size]
        if other.any():
            return done + int(other.argmax())
        done, step = done + size, min(2 * step, 1 << 16)
    return done


def common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length (int32) of the common prefix of each suffix in `order` with the one before it; 0 for the first.

    By Kasai's rule the common prefix of a text position with its predecessor is one shorter than that of the position to the
    left, if the bytes to the left of both are equal. Only positions where they differ are compared.
    """
    n = len(data)
    if n == 0:
        return np.empty(0, np.int32)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    left = np.append(data[:1], data[:-1])
    compared = (before <= 0) | (left != left[np.maximum(before, 0)])
    compared[0] = True
    del left
    todo = np.flatnonzero(compared & (before >= 0)).astype(np.int32)
    other = before[todo]
    del before
    key = np.append(_words(data), np.uint64(0))
    done = np.zeros(len(todo), np.int32)
    live = np.arange(len(todo), dtype=np.int32)
    while len(live) > _FEW:
        a, b = todo[live] + done[live], other[live] + done[live]
        different = key[np.minimum(a, n)] ^ key[np.minimum(b, n)]
        # Equal leading bytes of two big-endian numbers.
        same, open_ = np.zeros(len(live), np.int32), np.ones(len(live), bool)
        for j in range(7, -1, -1):
            open_ &= ((different >> np.uint64(8 * j)) & np.uint64(255)) == 0
            same += open_
        same = np.minimum(same, n - np.maximum(a, b))
        done[live] += same
        live = live[same == 8]
    del key
    for i in live.tolist():
        done[i] += _prefix(data, int(todo[i] + done[i]), int(other[i] + done[i]))
    out = np.zeros(n, np.int32)
    out[todo] = done
    # Between two compared positions the length falls by one a step.
    here = np.arange(n, dtype=np.int32)
    source = np.maximum.accumulate(np.where(compared, here, 0))
    fallen = np.maximum(out[source] - (here - source), 0)
    return np.where(compared, out, fallen)[order]
