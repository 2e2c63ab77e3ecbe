"""Operators whose state depends on their own past: one ``step`` for each bar, in order.

The same classes run in batch jobs (rows sorted within partitions, one Arrow batch at a time) and in streams (their
state is kept between micro-batches), so they hold plain numbers and can be pickled. A step returns NaN while the
operator has no value yet.
"""

from __future__ import annotations

import math
from collections import deque

from .registry import recursive

NAN = math.nan


class Ema:
    """Exponential mean, seeded by the plain mean of the first ``t`` values."""

    def __init__(self, t: int, k: float | None = None):
        self.t, self.k, self.n, self.total, self.value = t, 2.0 / (t + 1) if k is None else k, 0, 0.0, NAN

    def step(self, x: float) -> float:
        if self.n < self.t:
            self.n += 1
            self.total += x
            if self.n == self.t:
                self.value = self.total / self.t
        else:
            self.value += self.k * (x - self.value)
        return self.value


recursive("ta_ema", 1, (8, 21, 55))(Ema)


class _Chain:
    """EMA of EMA of ...: values of every level, NaN where a level has none."""

    def __init__(self, t: int, depth: int):
        self.levels = [Ema(t) for _ in range(depth)]

    def step(self, x: float) -> list[float]:
        out = []
        for level in self.levels:
            if x == x:
                x = level.step(x)
            out.append(x)
        return out


@recursive("ta_dema", 1, (8, 21, 55))
class Dema:
    def __init__(self, t: int):
        self.chain = _Chain(t, 2)

    def step(self, x: float) -> float:
        a, b = self.chain.step(x)
        return 2 * a - b


@recursive("ta_tema", 1, (8, 21, 55))
class Tema:
    def __init__(self, t: int):
        self.chain = _Chain(t, 3)

    def step(self, x: float) -> float:
        a, b, c = self.chain.step(x)
        return 3 * a - 3 * b + c


@recursive("ta_trix", 1, (8, 21, 55))
class Trix:
    """One-bar change of the triple EMA, in per cent."""

    def __init__(self, t: int):
        self.chain, self.last = _Chain(t, 3), NAN

    def step(self, x: float) -> float:
        now, before = self.chain.step(x)[2], self.last
        self.last = now
        if before != before:
            return NAN
        return 100.0 * (now / before - 1.0) if before else 0.0


@recursive("ta_kama", 1, (8, 21, 55))
class Kama:
    """Kaufman's adaptive mean, between the speeds of 2 and 30 bars."""

    FAST, SLOW = 2.0 / 3.0, 2.0 / 31.0

    def __init__(self, t: int):
        self.t, self.past, self.value = t, deque(maxlen=t + 1), NAN

    def step(self, x: float) -> float:
        past = self.past
        if len(past) < self.t:
            past.append(x)
            return NAN
        if self.value != self.value:
            self.value = past[-1]
        past.append(x)
        walked = 0.0
        before = past[0]
        for v in past:
            walked += abs(v - before)
            before = v
        straight = abs(x - past[0])
        ratio = 1.0 if walked == 0.0 or straight >= walked else straight / walked
        speed = (ratio * (self.FAST - self.SLOW) + self.SLOW) ** 2
        self.value += speed * (x - self.value)
        return self.value


class Wilder:
    """Wilder's smoothing, seeded by the mean of the first ``t`` values."""

    def __init__(self, t: int):
        self.mean = Ema(t, 1.0 / t)

    def step(self, x: float) -> float:
        return self.mean.step(x)


class _Moves:
    def __init__(self, t: int):
        self.last, self.up, self.down = NAN, Wilder(t), Wilder(t)

    def step(self, x: float) -> tuple[float, float]:
        move, self.last = x - self.last, x
        if move != move:
            return NAN, NAN
        return self.up.step(max(move, 0.0)), self.down.step(max(-move, 0.0))


@recursive("ta_rsi", 1, (6, 12, 24))
class Rsi:
    def __init__(self, t: int):
        self.moves = _Moves(t)

    def step(self, x: float) -> float:
        up, down = self.moves.step(x)
        both = up + down
        return 0.0 if both == 0.0 else 100.0 * up / both


@recursive("ta_cmo", 1, (14, 25))
class Cmo:
    def __init__(self, t: int):
        self.moves = _Moves(t)

    def step(self, x: float) -> float:
        up, down = self.moves.step(x)
        both = up + down
        return 0.0 if both == 0.0 else 100.0 * (up - down) / both


class _TrueRange:
    def __init__(self) -> None:
        self.close = NAN

    def step(self, h: float, low: float, c: float) -> float:
        before, self.close = self.close, c
        if before != before:
            return NAN
        return max(h - low, abs(h - before), abs(low - before))


@recursive("ta_atr", 3, (14, 25))
class Atr:
    def __init__(self, t: int):
        self.range, self.mean = _TrueRange(), Wilder(t)

    def step(self, h: float, low: float, c: float) -> float:
        x = self.range.step(h, low, c)
        return NAN if x != x else self.mean.step(x)


@recursive("ta_natr", 3, (14, 25), active=False)
class Natr:
    """ATR in per cent of the close."""

    def __init__(self, t: int):
        self.atr = Atr(t)

    def step(self, h: float, low: float, c: float) -> float:
        x = self.atr.step(h, low, c)
        return 100.0 * x / c if c else (0.0 if x == x else NAN)


class _Sum:
    """Wilder's running sum: ``t - 1`` values added up, then a ``t``-th part leaves for each that comes."""

    def __init__(self, t: int):
        self.t, self.n, self.value = t, 0, 0.0

    def step(self, x: float) -> float:
        self.n += 1
        self.value = self.value + x if self.n < self.t else self.value - self.value / self.t + x
        return self.value if self.n >= self.t - 1 else NAN


class _Direction:
    """Sums of plus and minus directional movement, and of the true range."""

    def __init__(self, t: int):
        self.h = self.low = NAN
        self.range, self.plus, self.minus, self.ranges = _TrueRange(), _Sum(t), _Sum(t), _Sum(t)

    def step(self, h: float, low: float, c: float) -> tuple[float, float, float]:
        up, down = h - self.h, self.low - low
        self.h, self.low = h, low
        reach = self.range.step(h, low, c)
        if up != up:
            return NAN, NAN, NAN
        plus = self.plus.step(up if up > 0 and up > down else 0.0)
        minus = self.minus.step(down if down > 0 and up < down else 0.0)
        return plus, minus, self.ranges.step(reach)


@recursive("ta_minus_dm", 2, (14, 25))
class MinusDm:
    def __init__(self, t: int):
        self.direction = _Direction(t)

    def step(self, h: float, low: float) -> float:
        return self.direction.step(h, low, low)[1]


class _Late:
    """Indicators begin one bar after the sums."""

    def __init__(self, t: int):
        self.direction, self.t, self.n = _Direction(t), t, -1

    def both(self, h: float, low: float, c: float) -> tuple[float, float]:
        """Plus and minus indicators, in per cent."""
        plus, minus, reach = self.direction.step(h, low, c)
        self.n += 1
        if self.n < self.t:
            return NAN, NAN
        return (100.0 * plus / reach, 100.0 * minus / reach) if reach else (0.0, 0.0)


@recursive("ta_minus_di", 3, (14, 25))
class MinusDi(_Late):
    def step(self, h: float, low: float, c: float) -> float:
        return self.both(h, low, c)[1]


@recursive("ta_dx", 3, (14, 25))
class Dx(_Late):
    """The last value is kept where neither direction has moved."""

    last = 0.0

    def step(self, h: float, low: float, c: float) -> float:
        plus, minus = self.both(h, low, c)
        if plus != plus:
            return NAN
        if plus + minus:
            self.last = 100.0 * abs(plus - minus) / (plus + minus)
        return self.last


@recursive("ta_adx", 3, (14, 25), active=False)
class Adx:
    def __init__(self, t: int):
        self.dx, self.mean = Dx(t), Wilder(t)

    def step(self, h: float, low: float, c: float) -> float:
        x = self.dx.step(h, low, c)
        return NAN if x != x else self.mean.step(x)


@recursive("ta_adxr", 3, (14, 25), active=False)
class Adxr:
    """Mean of the ADX and the ADX of t-1 bars ago."""

    def __init__(self, t: int):
        self.adx, self.past = Adx(t), deque(maxlen=t)

    def step(self, h: float, low: float, c: float) -> float:
        x = self.adx.step(h, low, c)
        if x != x:
            return NAN
        self.past.append(x)
        return (x + self.past[0]) / 2 if len(self.past) == self.past.maxlen else NAN


@recursive("TA_SAR", 2)
class Sar:
    """Parabolic stop and reverse: it trails the extreme price, faster with every new extreme, and turns when crossed."""

    def __init__(self, start: float = 0.02, more: float = 0.02, most: float = 0.2):
        self.start, self.more, self.most = start, more, most
        self.h = self.low = NAN
        self.rising: bool | None = None
        self.stop = self.extreme = 0.0
        self.speed = start

    def step(self, h: float, low: float) -> float:
        h0, low0, self.h, self.low = self.h, self.low, h, low
        if h0 != h0:
            return NAN
        if self.rising is None:
            up, down = h - h0, low0 - low
            self.rising = not (down > 0 and up < down)
            self.extreme, self.stop = (h, low0) if self.rising else (low, h0)
            h0, low0 = h, low
        crossed = low <= self.stop if self.rising else h >= self.stop
        if crossed:
            self.rising = not self.rising
            self.stop = self._outside(self.extreme, h0, low0)
            out, self.speed = self.stop, self.start
            self.extreme = h if self.rising else low
        else:
            out = self.stop
            if (h > self.extreme) if self.rising else (low < self.extreme):
                self.extreme, self.speed = (h if self.rising else low), min(self.speed + self.more, self.most)
        self.stop = self._outside(self.stop + self.speed * (self.extreme - self.stop), h0, low0)
        return out

    def _outside(self, stop: float, h0: float, low0: float) -> float:
        """The stop never lies within the last two bars."""
        return min(stop, low0, self.low) if self.rising else max(stop, h0, self.h)


class _Hilbert:
    """Ehlers' dominant cycle: smoothed period of a price, from the phase between its in-phase and quadrature parts."""

    TAPS = ((0, 0.0962), (2, 0.5769), (4, -0.5769), (6, -0.0962))

    def __init__(self, first: int):
        self.first, self.n = first, -1
        self.prices: deque[float] = deque(maxlen=4)
        self.series = {k: deque([0.0] * 7, maxlen=7) for k in ("smooth", "detrended", "i1", "q1")}
        self.i2 = self.q2 = self.re = self.im = self.period = self.smooth_period = 0.0
        self.smooth: deque[float] = deque(maxlen=50)

    def _turned(self, name: str, x: float, pace: float) -> float:
        past = self.series[name]
        past.append(x)
        return sum(w * past[-1 - k] for k, w in self.TAPS) * pace

    def step(self, x: float) -> bool:
        """Whether the cycle has begun."""
        self.n += 1
        self.prices.append(x)
        if self.n < self.first:
            return False
        p = self.prices
        smooth = (4 * p[3] + 3 * p[2] + 2 * p[1] + p[0]) / 10
        self.smooth.append(smooth)
        pace = 0.075 * self.period + 0.54
        detrended = self._turned("smooth", smooth, pace)
        q1 = self._turned("detrended", detrended, pace)
        i1 = self.series["detrended"][-4]
        ji, jq = self._turned("i1", i1, pace), self._turned("q1", q1, pace)
        i2, q2 = 0.2 * (i1 - jq) + 0.8 * self.i2, 0.2 * (q1 + ji) + 0.8 * self.q2
        self.re = 0.2 * (i2 * self.i2 + q2 * self.q2) + 0.8 * self.re
        self.im = 0.2 * (i2 * self.q2 - q2 * self.i2) + 0.8 * self.im
        self.i2, self.q2, before = i2, q2, self.period
        period = before
        if self.im and self.re:
            period = 360.0 / math.degrees(math.atan(self.im / self.re))
        period = max(min(period, 1.5 * before), 0.67 * before)
        self.period = 0.2 * max(6.0, min(50.0, period)) + 0.8 * before
        self.smooth_period = 0.33 * self.period + 0.67 * self.smooth_period
        return True


@recursive("TA_HT_DCPERIOD", 1)
class CyclePeriod:
    LOOKBACK, FIRST = 32, 12

    def __init__(self) -> None:
        self.cycle = _Hilbert(self.FIRST)

    def step(self, x: float) -> float:
        self.cycle.step(x)
        return self.cycle.smooth_period if self.cycle.n >= self.LOOKBACK else NAN


@recursive("TA_HT_DCPHASE", 1)
class CyclePhase:
    LOOKBACK, FIRST = 63, 37

    def __init__(self) -> None:
        self.cycle, self.phase = _Hilbert(self.FIRST), 0.0

    def step(self, x: float) -> float:
        if not self.cycle.step(x):
            return NAN
        n = int(self.cycle.smooth_period + 0.5)
        past = self.cycle.smooth
        real = imag = 0.0
        for i in range(n):
            angle = math.radians(i * 360.0 / n)
            v = past[-1 - i] if i < len(past) else 0.0
            real += math.sin(angle) * v
            imag += math.cos(angle) * v
        if abs(imag) > 0.0:
            self.phase = math.degrees(math.atan(real / imag))
        elif real < 0.0:
            self.phase -= 90.0
        elif real > 0.0:
            self.phase += 90.0
        self.phase += 90.0
        if self.cycle.smooth_period:
            self.phase += 360.0 / self.cycle.smooth_period
        if imag < 0.0:
            self.phase += 180.0
        if self.phase > 315.0:
            self.phase -= 360.0
        return self.phase if self.cycle.n >= self.LOOKBACK else NAN


@recursive("TA_HT_TRENDLINE", 1, active=False)
class Trendline:
    """Mean of the price over the dominant cycle, smoothed over four bars."""

    LOOKBACK, FIRST = 63, 37

    def __init__(self) -> None:
        self.cycle = _Hilbert(self.FIRST)
        self.past: deque[float] = deque(maxlen=50)
        self.means = deque([0.0] * 4, maxlen=4)

    def step(self, x: float) -> float:
        self.past.append(x)
        if not self.cycle.step(x):
            return NAN
        n = int(self.cycle.smooth_period + 0.5)
        values = [self.past[-1 - i] for i in range(min(n, len(self.past)))]
        self.means.append(sum(values) / n if n else 0.0)
        m = self.means
        return (4 * m[3] + 3 * m[2] + 2 * m[1] + m[0]) / 10 if self.cycle.n >= self.LOOKBACK else NAN


class SuperSmoother:
    """Two-pole smoother of the clipped bar body (close minus open), of period ``p``."""

    def __init__(self, p: int):
        a = math.exp(-1.414 * math.pi / p)
        # The angle is in degrees and the cosine takes radians; kept so, as results depend on it.
        self.b = 2 * a * math.cos(1.414 * 180 / p)
        self.c3 = -a * a
        self.c1 = 1 - self.b - self.c3
        self.n, self.body, self.s1, self.s2 = 0, 0.0, 0.0, 0.0

    def step(self, c: float, o: float) -> float:
        body = max(-1.0, min(1.0, 10.0 * (c - o)))
        self.n += 1
        out = body if self.n <= 2 else self.c1 * (body + self.body) / 2 + self.b * self.s1 + self.c3 * self.s2
        self.body, self.s2, self.s1 = body, self.s1, out
        return out


recursive("fm", 2, (20, 30, 40, 60), active=False)(SuperSmoother)


@recursive("macd_gap", 1, active=False)
class MacdGap:
    """MACD(12, 26) minus its 9-bar signal. Both means begin with the slow one's first value."""

    FAST, SLOW, SIGNAL = 12, 26, 9

    def __init__(self) -> None:
        self.n, self.fast, self.slow, self.signal = 0, Ema(self.FAST), Ema(self.SLOW), Ema(self.SIGNAL)

    def step(self, x: float) -> float:
        self.n += 1
        slow = self.slow.step(x)
        fast = self.fast.step(x) if self.n > self.SLOW - self.FAST else NAN
        if slow != slow:
            return NAN
        gap = fast - slow
        signal = self.signal.step(gap)
        return gap - signal


@recursive("ad_oscillator", 4, active=False)
class AdOscillator:
    """Fast minus slow exponential mean (3 and 10) of the accumulation line, both seeded by its first value."""

    def __init__(self) -> None:
        self.n, self.line, self.fast, self.slow = 0, 0.0, 0.0, 0.0

    def step(self, h: float, low: float, c: float, v: float) -> float:
        if h - low > 0:
            self.line += ((c - low) - (h - c)) / (h - low) * v
        self.n += 1
        if self.n == 1:
            self.fast = self.slow = self.line
        else:
            self.fast += 0.5 * (self.line - self.fast)
            self.slow += 2.0 / 11.0 * (self.line - self.slow)
        return self.fast - self.slow if self.n >= 10 else NAN


@recursive("frozen_sar", 2, active=False)
class FrozenSar:
    """Extended SAR with all accelerations zero: the stop stays where each turn put it, negative while falling."""

    def __init__(self) -> None:
        self.sar = Sar(0.0, 0.0, 0.0)

    def step(self, h: float, low: float) -> float:
        out = self.sar.step(h, low)
        if out != out:
            return NAN
        return out if self.sar.rising else -out


@recursive("ewm_std", 1, (10, 60, 120, 240, 360), active=False)
class EwmStd:
    """Bias-corrected exponentially weighted deviation of span ``t``, with weights adjusted for the start."""

    def __init__(self, t: int):
        self.keep = 1.0 - 2.0 / (t + 1)
        self.n, self.w, self.w2, self.mean, self.var = 0, 0.0, 0.0, 0.0, 0.0

    def step(self, x: float) -> float:
        self.n += 1
        old = self.w * self.keep
        self.w, self.w2 = old + 1.0, self.w2 * self.keep * self.keep + 1.0
        gap = x - self.mean
        self.mean += gap / self.w
        # var holds the weighted sum of squares about the mean.
        self.var = self.var * self.keep + gap * (x - self.mean)
        bias = self.w - self.w2 / self.w
        return math.sqrt(max(self.var, 0.0) / bias) if self.n > 1 and bias > 0 else NAN
