"""Winnowed anchors of byte strings: a sample of positions that any two equal strings of a given length share."""

from __future__ import annotations

import numpy as np

from threadloom.llm.shingles import _power, mix

#: Bytes that an anchor's hash covers.
GRAM = 32
_Q = 0x9E3779B97F4A7C15 | 1


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position on; empty if there are fewer."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_Q, len(data)), out=sums[1:])
    return mix((sums[GRAM:] - sums[:n]) * _power(pow(_Q, -1, 1 << 64), len(data) + 1)[:n])


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum over x[i : i + w] for each i up to len(x) - w."""
    n = 1
    while 2 * n <= w:  # of n numbers each, then of twice as many
        x, n = np.minimum(x[:-n], x[n:]), 2 * n
    return np.minimum(x[: len(x) - w + n], x[w - n :])


def anchors(data: np.ndarray, bounds: np.ndarray, length: int, h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(positions, hashes, first, last) of the anchors of the texts that lie in data between bounds.

    The anchor of a string of length bytes is the first position with the least hash within it, so equal
    strings have theirs at equal offsets. The strings that start from first to last, and no others, have the
    anchor at the position. Every string that lies within one text is in one such range. h is gram_hashes(data), if known.
    """
    h = gram_hashes(data) if h is None else h
    w = length - GRAM + 1
    none = np.zeros(0, np.int64)
    if len(h) < w:
        return none, none.astype(np.uint64), none, none
    least = _least(h, w)
    marks = np.zeros(len(least) + 1, np.int8)
    long = bounds[1:] - bounds[:-1] >= length
    marks[bounds[:-1][long]] += 1
    marks[bounds[1:][long] - length + 1] -= 1
    inside = np.cumsum(marks[:-1], dtype=np.int8) > 0
    change = np.flatnonzero(least[1:] != least[:-1]) + 1
    edge = np.flatnonzero(marks[1:-1]) + 1
    first = np.unique(np.concatenate(([0], change, edge, bounds[bounds < len(least)])))
    last = np.concatenate((first[1:], [len(least)])) - 1
    first, last = first[inside[first]], last[inside[first]]
    if not len(first):
        return none, none.astype(np.uint64), none, none
    names, name = np.unique(least[first], return_inverse=True)
    # few windows have a least hash above this; near those, more positions are looked at
    low = np.uint64(min(2**64 - 1, 12 * 2**64 // w))
    near = h <= low
    for f, t in zip(first[least[first] > low].tolist(), last[least[first] > low].tolist(), strict=True):
        near[f : t + w] = True
    at = np.flatnonzero(near)
    at = at[h[at] <= names[-1]]
    spot = np.searchsorted(names, h[at])
    met = names[spot] == h[at]  # the least of some string
    keys = spot[met] * len(data) + at[met]
    keys.sort()
    out = []
    while len(first):  # a run of one least hash goes on past its first anchor where that hash stands again
        pos = keys[np.searchsorted(keys, name * len(data) + first)] - name * len(data)
        out.append((pos, first, np.minimum(last, pos)))
        more = last > pos
        first, last, name = pos[more] + 1, last[more], name[more]
    pos, first, last = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(first)
    pos, first, last = pos[order], first[order], last[order]
    return pos, h[pos], first, last
