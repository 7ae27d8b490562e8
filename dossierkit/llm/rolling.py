"""Rolling hash over UTF-8 bytes, vectorised, for content-defined cuts."""

from __future__ import annotations

import numpy as np

#: The hash of a position covers this many bytes before it.
WINDOW = 32

_i = np.arange(256, dtype=np.uint64)
_GEAR = (((_i + 1) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """h[i]: hash of the WINDOW bytes that end with byte i (fewer at the start).

    The window sum of shifted byte values is built by doubling, in log2(WINDOW)
    vector steps instead of one step a byte.
    """
    h = _GEAR[data]
    width = 1
    while width < WINDOW:
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint32(width) if len(h) > width else 0
        h = longer
        width *= 2
    h ^= h >> np.uint32(15)
    return h * np.uint32(0x2C1B3C6D)


def starts_character(data: np.ndarray) -> np.ndarray:
    """True at each byte that begins a UTF-8 character."""
    return (data & 0xC0) != 0x80


def content_cuts(data: np.ndarray, least: int, average: int, most: int) -> list[int]:
    """Ends of content-defined chunks of ``data``, the last one being its length.

    A cut follows a byte whose hash is a landmark (one in ``average``); chunks
    have at least ``least`` bytes, at most about ``most``, and never part a character.
    """
    n = len(data)
    if n <= least:
        return [n]
    h = rolling_hash(data)
    marks = np.flatnonzero(h[:-1] < np.uint32((1 << 32) // average - 1)) + 1
    marks = marks[starts_character(data[marks])] if len(marks) else marks
    cuts, at, k = [], 0, 0
    while n - at > least:
        k += int(np.searchsorted(marks[k:], at + least))
        if k < len(marks) and marks[k] <= at + most:
            at = int(marks[k])
        elif n - at > most:
            end = at + most
            while end > at + least and (data[end] & 0xC0) == 0x80:
                end -= 1
            at = end
        else:
            break
        cuts.append(at)
    if not cuts or cuts[-1] < n:
        cuts.append(n)
    return cuts
