"""Anchors of a byte text: positions chosen by content, at least one in each window of a given length."""

from __future__ import annotations

import numpy as np

#: Odd multipliers of the 64-bit mixer (fixed values, any odd numbers would do).
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))

#: Positions that are looked at together.
SLICE = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def words_at(text: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
    """The 8 bytes from each position as a big-endian number, so that numbers order as the bytes do."""
    return np.ndarray(len(text) - 7, ">u8", text, strides=(1,))[at].astype(np.uint64)


def gram_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes (16 to 24) from every position that has as many."""
    n = len(text) - gram + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = words_at(text, slice(0, n)) * MIX[0]
    h ^= h >> np.uint64(29)
    h += words_at(text, slice(8, n + 8))
    h *= MIX[1]
    h ^= h >> np.uint64(32)
    if gram > 16:
        h += words_at(text, slice(gram - 8, n + gram - 8))
        h *= MIX[2]
        h ^= h >> np.uint64(29)
    return h


def _slid(x: np.ndarray, width: int, of: np.ufunc) -> np.ndarray:
    """``of`` (minimum or maximum) over each ``width`` neighbours, by doubling."""
    span = 1
    while 2 * span <= width:
        x = of(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return of(x[:-rest], x[rest:]) if rest else x


def _anchors_of_slice(text: np.ndarray, breaks: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    h = gram_hashes(text, gram)
    none = np.uint64(2**64 - 1)
    h[h == none] = np.uint64(0)
    for b in breaks.tolist():
        h[max(0, b - gram + 1) : b] = none
    width = window - gram + 1
    padded = np.concatenate((np.full(width - 1, none), h, np.full(width - 1, none)))
    least = _slid(padded, width, np.minimum)
    most = _slid(np.where(least == none, np.uint64(0), least), width, np.maximum)
    at = np.flatnonzero((h == most) & (h != none))
    return at, h[at]


def anchors(text: np.ndarray, starts: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes): in each ``window`` bytes of a document the grams with the least hash.

    ``text`` holds the documents one after the other, ``starts`` where each begins. Whether a gram is chosen depends on
    no more than the windows around it, so equal windows have equal anchors at equal places.
    Slices are looked at one after the other, each with the windows around it, so that memory follows SLICE and not the text.
    """
    n, reach, breaks = len(text) - gram + 1, 2 * window, starts[1:]
    found = [(np.empty(0, np.int64), np.empty(0, np.uint64))]
    for a in range(0, n, SLICE):
        low, high = max(0, a - reach), min(n, a + SLICE + reach)
        inside = breaks[(breaks > low) & (breaks < high + gram - 1)] - low
        at, h = _anchors_of_slice(text[low : high + gram - 1], inside, window, gram)
        at += low
        core = (at >= a) & (at < a + SLICE)
        found.append((at[core], h[core]))
    return np.concatenate([f[0] for f in found]), mixed(np.concatenate([f[1] for f in found]))
