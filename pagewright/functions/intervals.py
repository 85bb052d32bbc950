"""Intervals against sorted pieces."""

from __future__ import annotations


def touched(starts, ends, first, last):
    """For each interval [first, last) the range [low, high) of the pieces [start, end) that it meets.

    Pieces are sorted and don't overlap, so that all intervals are placed by binary search, whatever the number of pieces; an empty interval or piece meets nothing.
    """
    import numpy as np

    low = np.searchsorted(ends, first, side="right")
    high = np.maximum(low, np.searchsorted(starts, last, side="left"))
    return low, np.where(np.asarray(last) > np.asarray(first), high, low)


def overlaps(starts, ends, first, last):
    """(interval, piece, start, end): every meeting of an interval with a piece, and what they share, in order; linear in what it returns."""
    import numpy as np

    low, high = touched(starts, ends, first, last)
    size = high - low
    interval = np.repeat(np.arange(len(size)), size)
    piece = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
    start, end = np.maximum(starts[piece], np.asarray(first)[interval]), np.minimum(ends[piece], np.asarray(last)[interval])
    some = end > start  # an empty piece inside an interval shares nothing
    return interval[some], piece[some], start[some], end[some]
