"""States over a bounded buffer in order: ranks, values at a place and quantiles of the latest rows.

A step costs a search and one insertion in a buffer of the frame's length, where a window expression would sort or scan the
whole frame for every row.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections import deque

import numpy as np


class Buffer:
    """The latest ``size`` values, in the order of arrival and in order of size. Nulls and NaN take a place but have no order."""

    def __init__(self, size: int):
        self.size, self.arrived, self.ordered = size, deque(), []

    @property
    def full(self) -> bool:
        """As many values as the frame is long, none of them missing."""
        return len(self.ordered) == self.size

    def push(self, x: float | None) -> None:
        if len(self.arrived) == self.size:
            old = self.arrived.popleft()
            if old is not None:
                del self.ordered[bisect_left(self.ordered, old)]
        x = None if x is None or x != x else x
        self.arrived.append(x)
        if x is not None:
            insort(self.ordered, x)


class RankBefore:
    """Where a value stands among the ``window`` values before it, as ``below * (window + 1) + equal``; -1 before there are
    as many."""

    def __init__(self, window: int):
        self.buffer = Buffer(window)

    def step(self, x: float | None) -> float:
        found, b = -1.0, self.buffer
        if b.full and x is not None and x == x:
            below = bisect_left(b.ordered, x)
            found = float(below * (b.size + 1) + bisect_right(b.ordered, x, below) - below)
        b.push(x)
        return found


class ValueAt:
    """The value at a place, from 0, of the ``window`` values before the row in order of size; NaN before there are as many."""

    def __init__(self, window: int):
        self.buffer = Buffer(window)

    def step(self, place: float | None, x: float | None) -> float:
        b = self.buffer
        found = b.ordered[int(place)] if b.full and place is not None else math.nan
        b.push(x)
        return found


class FrameQuantile:
    """The interpolated quantile of the latest ``window`` values, this one included; NaN before there are as many."""

    def __init__(self, window: int, q: float):
        self.buffer, self.place = Buffer(window), q * (window - 1)

    def step(self, x: float | None) -> float:
        b = self.buffer
        b.push(x)
        if not b.full:
            return math.nan
        low, high = math.floor(self.place), math.ceil(self.place)
        a, z = b.ordered[low], b.ordered[high]
        return a if a == z or low == high else (high - self.place) * a + (self.place - low) * z


class Uniform:
    """NumPy's legacy stream of a seed, one number for each row of a series."""

    def __init__(self, seed: int):
        self.random = np.random.RandomState(seed)

    def step(self, _: float | None) -> float:
        return float(self.random.random_sample())
