"""Recursive operators in a form that starts anywhere: runs of rows as affine maps of the state before them.

Each operator here keeps a state of a few numbers s, and a row takes it to a * s + b, where a depends on the row's number in its
series alone and b on the row's values and those of the row before. So what a run of rows does to any state is one small
matrix and one vector: runs can be worked through apart from each other, their maps put together in order, and the values
computed in a second pass from the state that is due at each run's start. Within a run the recurrence is solved by NumPy for
many short stretches at once.

Operators whose state changes by comparisons (KAMA, SAR, directional indices that hold their last value, Hilbert cycles) have no such
form.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .registry import lookup

Row = np.ndarray


def recur(a: np.ndarray, b: np.ndarray, state: float) -> np.ndarray:
    """s[i] = a[i] * s[i - 1] + b[i] for all i, with ``state`` before the first.

    The rows are cut into about as many stretches as each has rows; a step goes through all stretches at once.
    """
    n = len(b)
    if not n:
        return np.zeros(0)
    width = max(int(np.sqrt(n)), 1)
    height = -(-n // width)
    full = lambda v, fill: np.concatenate([v, np.full(height * width - n, fill)]).reshape(height, width)
    a, s = full(np.broadcast_to(a, n), 1.0), full(b, 0.0)
    weight = np.empty_like(a)
    weight[:, 0] = a[:, 0]
    for k in range(1, width):
        s[:, k] += a[:, k] * s[:, k - 1]
        weight[:, k] = weight[:, k - 1] * a[:, k]
    start = np.empty(height)
    for k in range(height):
        start[k] = state
        state = weight[k, -1] * state + s[k, -1]
    return (s + weight * start[:, None]).ravel()[:n]


def smoothed(x: np.ndarray, q: np.ndarray, t: int, k: float, state: float) -> np.ndarray:
    """Exponential mean of pace ``k``, seeded by the mean of its first ``t`` values; ``q`` numbers the values from 1, and values
    numbered less than 1 don't count. It has a value where q >= t; before that it is the sum so far."""
    keep = np.where(q < t, 1.0, np.where(q == t, 1.0 / t, 1.0 - k))
    take = np.where(q < 1, 0.0, np.where(q < t, 1.0, np.where(q == t, 1.0 / t, k)))
    return recur(keep, np.where(q < 1, 0.0, x) * take, state)


class Scan:
    """``run(state, rows, before, *x)`` gives the values (NaN while there is none) of the rows numbered ``rows`` and the state after
    them. ``x`` are the arguments' values, ``before`` those of the row before, zeros at the beginning of a series."""

    size = 1

    def run(self, state: np.ndarray, rows: Row, before: list[float], *x: Row) -> tuple[Row, np.ndarray]:
        raise NotImplementedError

    def effect(self, rows: Row, before: list[float], *x: Row) -> np.ndarray:
        """(size, size + 1): the matrix of the run's map of states, and its vector as the last column."""
        none, zeros = [0.0] * len(before), [np.zeros(len(rows)) for _ in x]
        with np.errstate(all="ignore"):
            parts = [self.run(unit, rows, none, *zeros)[1] for unit in np.eye(self.size)]
            return np.column_stack([*parts, self.run(np.zeros(self.size), rows, before, *x)[1]])

    def values(self, state: np.ndarray, rows: Row, before: list[float], *x: Row) -> Row:
        with np.errstate(all="ignore"):
            return self.run(state, rows, before, *x)[0]


def _shifted(x: Row, first: float) -> Row:
    return np.concatenate([[first], x[:-1]])


class Chain(Scan):
    """Means of means of ...; ``give`` makes the value of the levels' values."""

    def __init__(self, t: int, depth: int, give: Callable[..., Row]):
        self.t, self.size, self.give = t, depth, give

    def run(self, state: np.ndarray, rows: Row, before: list[float], *x: Row) -> tuple[Row, np.ndarray]:
        levels, now = [], x[0]
        for k in range(self.size):
            now = smoothed(now, rows - k * (self.t - 1), self.t, 2.0 / (self.t + 1), state[k])
            levels.append(now)
        first = self.size * (self.t - 1) + 1
        return np.where(rows >= first, self.give(levels, state, rows > first), np.nan), np.array([v[-1] for v in levels])


def _change(levels: list[Row], state: np.ndarray, later: Row) -> Row:
    before = _shifted(levels[-1], state[-1])
    return np.where(later, np.where(before != 0, 100.0 * (levels[-1] / before - 1.0), 0.0), np.nan)


class Moves(Scan):
    """Wilder means of rises and falls."""

    size = 2

    def __init__(self, t: int, top: Callable[[Row, Row], Row]):
        self.t, self.top = t, top

    def run(self, state: np.ndarray, rows: Row, before: list[float], *x: Row) -> tuple[Row, np.ndarray]:
        move = x[0] - _shifted(x[0], before[0])
        up, down = (smoothed(np.maximum(m, 0.0), rows - 1, self.t, 1.0 / self.t, s) for m, s in zip((move, -move), state))
        value = np.where(up + down == 0, 0.0, 100.0 * self.top(up, down) / (up + down))
        return np.where(rows > self.t, value, np.nan), np.array([up[-1], down[-1]])


def _reach(h: Row, low: Row, before: Row) -> Row:
    return np.maximum(h - low, np.maximum(np.abs(h - before), np.abs(low - before)))


class Range(Scan):
    """Wilder mean of the true range, in per cent of the close if wanted."""

    def __init__(self, t: int, relative: bool):
        self.t, self.relative = t, relative

    def run(self, state: np.ndarray, rows: Row, before: list[float], *x: Row) -> tuple[Row, np.ndarray]:
        h, low, c = x
        mean = smoothed(_reach(h, low, _shifted(c, before[2])), rows - 1, self.t, 1.0 / self.t, state[0])
        value = np.where(c != 0, 100.0 * mean / c, 0.0) if self.relative else mean
        return np.where(rows > self.t, value, np.nan), mean[-1:]


class Falls(Scan):
    """Wilder's running sum of downward movement; over that of the true range, in per cent, where a close is given."""

    def __init__(self, t: int, relative: bool):
        self.t, self.size = t, 2 if relative else 1

    def _sum(self, x: Row, q: Row, state: float) -> Row:
        return recur(np.where(q < self.t, 1.0, 1.0 - 1.0 / self.t), np.where(q < 1, 0.0, x), state)

    def run(self, state: np.ndarray, rows: Row, before: list[float], *x: Row) -> tuple[Row, np.ndarray]:
        h, low = x[:2]
        up, down = h - _shifted(h, before[0]), _shifted(low, before[1]) - low
        falls = self._sum(np.where((down > 0) & (up < down), down, 0.0), rows - 1, state[0])
        if self.size == 1:
            return np.where(rows >= self.t, falls, np.nan), falls[-1:]
        reach = self._sum(_reach(h, low, _shifted(x[2], before[2])), rows - 1, state[1])
        return np.where(rows > self.t, np.where(reach != 0, 100.0 * falls / reach, 0.0), np.nan), np.array([falls[-1], reach[-1]])


class Gap(Scan):
    """MACD minus its signal; all three means begin with the slow one's first value."""

    size = 3
    FAST, SLOW, SIGNAL = 12, 26, 9

    def run(self, state: np.ndarray, rows: Row, before: list[float], *x: Row) -> tuple[Row, np.ndarray]:
        fast = smoothed(x[0], rows - (self.SLOW - self.FAST), self.FAST, 2.0 / (self.FAST + 1), state[0])
        slow = smoothed(x[0], rows, self.SLOW, 2.0 / (self.SLOW + 1), state[1])
        signal = smoothed(fast - slow, rows - (self.SLOW - 1), self.SIGNAL, 2.0 / (self.SIGNAL + 1), state[2])
        value = np.where(rows >= self.SLOW + self.SIGNAL - 1, fast - slow - signal, np.nan)
        return value, np.array([fast[-1], slow[-1], signal[-1]])


def _flow(h: Row, low: Row, c: Row, v: Row) -> Row:
    return np.where(h - low > 0, ((c - low) - (h - c)) / np.where(h - low > 0, h - low, 1.0), 0.0) * v


class Line(Scan):
    """The accumulation line; with means, the fast one of it minus the slow one, both seeded by its first value."""

    def __init__(self, means: bool):
        self.size = 3 if means else 1

    def run(self, state: np.ndarray, rows: Row, before: list[float], *x: Row) -> tuple[Row, np.ndarray]:
        line = recur(np.ones(len(rows)), _flow(*x), state[0])
        if self.size == 1:
            return line, line[-1:]
        paces = (np.where(rows == 1, 1.0, k) for k in (0.5, 2.0 / 11.0))
        fast, slow = (recur(1.0 - k, k * line, s) for k, s in zip(paces, state[1:]))
        return np.where(rows >= 10, fast - slow, np.nan), np.array([line[-1], fast[-1], slow[-1]])


class Balance(Scan):
    """Volume added on rises and taken off on falls."""

    def run(self, state: np.ndarray, rows: Row, before: list[float], *x: Row) -> tuple[Row, np.ndarray]:
        step = x[0] - _shifted(x[0], before[0])
        line = recur(np.ones(len(rows)), np.where((rows == 1) | (step > 0), x[1], np.where(step < 0, -x[1], 0.0)), state[0])
        return line, line[-1:]


FORMS: dict[str, Callable[[int], Scan]] = {
    "ta_ema": lambda t: Chain(t, 1, lambda v, s, later: v[0]),
    "ta_dema": lambda t: Chain(t, 2, lambda v, s, later: 2 * v[0] - v[1]),
    "ta_tema": lambda t: Chain(t, 3, lambda v, s, later: 3 * v[0] - 3 * v[1] + v[2]),
    "ta_trix": lambda t: Chain(t, 3, _change),
    "ta_rsi": lambda t: Moves(t, lambda up, down: up),
    "ta_cmo": lambda t: Moves(t, lambda up, down: up - down),
    "ta_atr": lambda t: Range(t, False),
    "ta_natr": lambda t: Range(t, True),
    "ta_minus_dm": lambda t: Falls(t, False),
    "ta_minus_di": lambda t: Falls(t, True),
    "macd_gap": lambda t: Gap(),
    "ad_oscillator": lambda t: Line(True),
    "TA_AD": lambda t: Line(False),
    "TA_OBV": lambda t: Balance(),
}


def scan_of(name: str) -> Scan | None:
    """The operator as a scan, or None if it has no such form."""
    lookup(name)
    prefix, _, t = name.rpartition("_")
    if name in FORMS:
        return FORMS[name](0)
    return FORMS[prefix](int(t)) if prefix in FORMS and t.isdigit() else None
