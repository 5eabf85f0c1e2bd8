"""Content-chosen positions of sequences (numpy, inside tasks).

A window is `size` consecutive items. Each window names one of its `size - gram + 1` grams as its anchor: the
one of least hash, leftmost among equals. The choice depends on the window's items alone, so equal windows name
the anchor at the same offset, wherever they stand. Windows that share an anchor start at consecutive positions.
"""

from __future__ import annotations

import numpy as np

# odd multipliers of the rolling gram hash (fixed values)
ROLL = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
# low bits of a packed hash that hold its place
PLACE_BITS = 22
PLACE = np.uint64((1 << PLACE_BITS) - 1)


def gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """Hash of codes[i:i + gram] for each i; `gram` is a power of two, built by doubling."""
    with np.errstate(over="ignore"):
        h = codes.astype(np.uint64) * MIX + ROLL
        power = ROLL
        step = 1
        while step < gram:
            h = h[:-step] * power + h[step:]
            power = power * power
            step *= 2
        h ^= h >> np.uint64(32)
        h *= MIX
        h ^= h >> np.uint64(29)
    return h


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values."""
    m, span = values, 1
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    rest = width - span
    return np.minimum(m[:-rest], m[rest:]) if rest else m


def anchors(codes: np.ndarray, size: int, gram: int, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, last start, gram hash) of all windows that stay inside one sequence.

    `ends` are the ends of several sequences laid one behind the other (default: one sequence).
    """
    ends = np.array([len(codes)]) if ends is None else ends
    if len(codes) < size:
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0, np.uint64)
    width = size - gram + 1
    starts = np.arange(len(codes) - size + 1)
    end_of = np.repeat(ends, np.diff(ends, prepend=0))[: len(starts)]
    valid = starts + size <= end_of
    out: list[tuple[np.ndarray, ...]] = []
    piece = (1 << PLACE_BITS) - size
    for begin in range(0, len(starts), piece):
        end = min(begin + piece, len(starts))
        h = gram_hashes(codes[begin : end + size - 1], gram)
        packed = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
        least = (window_minima(packed, width) & PLACE).astype(np.int64)
        keep = np.flatnonzero(valid[begin:end])
        if not len(keep):
            continue
        least = least[keep]
        cut = np.flatnonzero((np.diff(least) != 0) | (np.diff(keep) != 1)) + 1
        first = np.concatenate(([0], cut))
        last = np.concatenate((cut - 1, [len(least) - 1]))
        a = least[first]
        out.append((a + begin, keep[first] + begin, keep[last] + begin, h[a]))
    if not out:
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))
