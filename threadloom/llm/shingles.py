"""Word shingles of whole texts as sorted 64-bit hashes, computed over Arrow buffers with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed together.
BLOCK = 1 << 20
_Q = 0x9E3779B97F4A7C15 | 1
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def blocks(column: pa.Array, size: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, bounds) of runs of texts of about size (BLOCK) bytes; null is empty."""
    size = size or BLOCK
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return
    _, offsets, body = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(body, np.uint8) if body else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + size, "right")) - 1)
        yield data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
        lo = hi


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+, A-Z lower-cased, and the index of each text's first word (and the end)."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)  # texts begin here
    first[bounds] = True
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | first[:-1]))
    ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | first[1:])) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_FOLD[data].astype(np.uint64) + np.uint64(1)) * _power(_Q, len(data)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power(pow(_Q, -1, 1 << 64), len(data) + 1)[starts]
    return mix(h ^ (ends - starts).astype(np.uint64) * np.uint64(_Q)), np.searchsorted(starts, bounds)


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in pieces of about BLOCK bytes, cut after a white space, so no word is cut; one without white space stays whole."""
    lo = 0
    while lo < len(data):
        hi = min(lo + BLOCK, len(data))
        while hi < len(data):
            space = np.flatnonzero(_SPACE[data[hi : hi + BLOCK]])
            if len(space):
                hi += int(space[0]) + 1
                break
            hi = min(hi + BLOCK, len(data))
        yield data[lo:hi]
        lo = hi


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct k-word shingles of each text; with fewer words the whole sequence is one; without words none."""
    base = np.uint64(0xD6E8FEB86659FD93)
    for data, bounds in blocks(column):
        if len(data) > 2 * BLOCK:  # one long text
            h = np.concatenate([word_hashes(p, np.array([0, len(p)]))[0] for p in _pieces(data)])
            at = np.array([0, len(h)])
        else:
            h, at = word_hashes(data, bounds)
        runs = h.copy()
        for i in range(1, k):
            n = max(len(h) - i, 0)
            runs[:n] = runs[:n] * base + h[i:]
        runs = mix(runs)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(runs[a : b - k + 1])
            elif b > a:
                one = np.zeros(1, np.uint64)
                for x in h[a:b]:
                    one = one * base + x
                yield mix(one)
            else:
                yield runs[:0]
