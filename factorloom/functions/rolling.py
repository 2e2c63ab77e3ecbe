"""Operators over bounded frames. Frames shorter than asked for give 0, as each builder says."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .frames import Series, ratio
from .registry import family, operator

#: Prices nearer to zero than this have no return.
NO_PRICE = 1e-14


@operator("TA_TRANGE", 3)
def true_range(s: Series, h: Column, low: Column, c: Column) -> Column:
    prev = F.lag(c).over(s.plain)
    return F.when(prev.isNull(), F.lit(0.0)).otherwise(F.greatest(h - low, F.abs(h - prev), F.abs(low - prev)))


@family("TS_COV", 2, (20, 40))
def covariance(s: Series, t: int, a: Column, b: Column) -> Column:
    return s.enough(F.covar_samp(a, b).over(s.last(t)), t // 2)


@family("TS_CORR", 2, (20, 40))
def correlation(s: Series, t: int, a: Column, b: Column) -> Column:
    w = s.last(t)
    spread = F.stddev_samp(a).over(w) * F.stddev_samp(b).over(w)
    return s.enough(ratio(F.covar_samp(a, b).over(w), spread), t // 2)


def _first_lowest(s: Series, x: Column, frame) -> Column:
    """Row number of the first minimum of a frame."""
    return F.min(F.struct(x.alias("x"), s.row.alias("r"))).over(frame)["r"]


def _first_highest(s: Series, x: Column, frame) -> Column:
    return -F.max(F.struct(x.alias("x"), (-s.row).alias("r"))).over(frame)["r"]


@family("TS_DAY_MIN", 1, (10, 20, 40), active=False)
def bars_since_min(s: Series, t: int, x: Column) -> Column:
    """Bars since the minimum of the ``t`` bars before this one."""
    return s.enough((s.row - _first_lowest(s, x, s.before(t))).cast("double"), t + 1)


@family("TS_DAY_MAX", 1, (10, 20, 40), active=False)
def bars_since_max(s: Series, t: int, x: Column) -> Column:
    return s.enough((s.row - _first_highest(s, x, s.before(t))).cast("double"), t + 1)


@family("ts_sma", 1, (8, 21, 55))
def mean(s: Series, t: int, x: Column) -> Column:
    return s.enough(F.avg(x).over(s.last(t)), t // 2)


@family("ts_wma", 1, (8, 21, 55))
def weighted_mean(s: Series, t: int, x: Column) -> Column:
    """Weights 1 to t, the latest bar heaviest."""
    total = t * (t + 1) / 2
    weighted = F.transform(F.collect_list(x).over(s.last(t)), lambda v, k: v * ((k + 1) / F.lit(total)))
    return s.enough(F.aggregate(weighted, F.lit(0.0), lambda acc, v: acc + v), t)


@family("ts_lag", 1, (3, 8, 17))
def lag(s: Series, t: int, x: Column) -> Column:
    return F.coalesce(F.lag(x, t).over(s.plain), F.lit(0.0))


@family("ts_delta", 1, (3, 8, 17))
def delta(s: Series, t: int, x: Column) -> Column:
    """Change over ``t`` bars; the first ``t`` bars are compared with 0."""
    return x - F.coalesce(F.lag(x, t).over(s.plain), F.lit(0.0))


@family("ts_sum", 1, (3, 8, 17))
def total(s: Series, t: int, x: Column) -> Column:
    return s.enough(F.sum(x).over(s.last(t)), t)


@family("ts_prod", 1, (3, 8, 17))
def product(s: Series, t: int, x: Column) -> Column:
    return s.enough(F.aggregate(F.collect_list(x).over(s.last(t)), F.lit(1.0), lambda acc, v: acc * v), t)


@family("ts_std", 1, (10, 20, 40))
def deviation(s: Series, t: int, x: Column) -> Column:
    return s.enough(F.stddev_samp(x).over(s.last(t)), t // 2)


def _constant(s: Series, t: int, x: Column) -> Column:
    return F.max(x).over(s.last(t)) == F.min(x).over(s.last(t))


@family("ts_skew", 1, (10, 20, 40))
def skewness(s: Series, t: int, x: Column) -> Column:
    """Bias-corrected; a constant frame has none."""
    n = F.least(s.row, F.lit(t)).cast("double")
    value = F.skewness(x).over(s.last(t)) * F.sqrt(n * (n - 1)) / (n - 2)
    return s.enough(F.when(_constant(s, t, x), F.lit(0.0)).otherwise(value), max(t // 2, 3))


@family("ts_kurt", 1, (10, 20, 40))
def kurtosis(s: Series, t: int, x: Column) -> Column:
    """Bias-corrected excess kurtosis; -3 for a constant frame."""
    n = F.least(s.row, F.lit(t)).cast("double")
    value = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x).over(s.last(t)) + 6)
    return s.enough(F.when(_constant(s, t, x), F.lit(-3.0)).otherwise(value), max(t // 2, 4))


@family("ts_min", 1, (5, 10, 20))
def minimum(s: Series, t: int, x: Column) -> Column:
    return s.enough(F.min(x).over(s.last(t)), t // 2)


@family("ts_max", 1, (5, 10, 20))
def maximum(s: Series, t: int, x: Column) -> Column:
    return s.enough(F.max(x).over(s.last(t)), t // 2)


@family("ts_range", 1, (5, 10, 20))
def spread(s: Series, t: int, x: Column) -> Column:
    return s.enough(F.max(x).over(s.last(t)) - F.min(x).over(s.last(t)), t // 2)


@family("ts_argmin", 1, (5, 10, 20))
def place_of_min(s: Series, t: int, x: Column) -> Column:
    """Place of the first minimum in a full frame, counted from 1."""
    return s.enough((_first_lowest(s, x, s.last(t)) - s.row + t).cast("double"), t)


@family("ts_argmax", 1, (5, 10, 20))
def place_of_max(s: Series, t: int, x: Column) -> Column:
    return s.enough((_first_highest(s, x, s.last(t)) - s.row + t).cast("double"), t)


@family("ts_argrange", 1, (5, 10, 20))
def place_of_max_after_min(s: Series, t: int, x: Column) -> Column:
    w = s.last(t)
    return s.enough((_first_highest(s, x, w) - _first_lowest(s, x, w)).cast("double"), t)


@family("ts_rank", 1, (5, 10, 20))
def percentile_rank(s: Series, t: int, x: Column) -> Column:
    """Mean percentile of the latest value within a full frame, times 100."""
    values = F.collect_list(x).over(s.last(t))
    below = F.size(F.filter(values, lambda v: v < x))
    upto = F.size(F.filter(values, lambda v: v <= x))
    return s.enough((below + upto + 1) * F.lit(100.0 * 50.0 / t), t)


@family("ts_mean_return", 1, (5, 10, 20))
def mean_return(s: Series, t: int, x: Column) -> Column:
    """Mean of the t-1 one-bar returns of a full frame; after a price near 0 a return counts as -1."""
    prev = F.coalesce(F.lag(x).over(s.plain), F.lit(0.0))
    change = F.when(F.abs(prev) > 1e-5, x / prev).otherwise(F.lit(0.0)) - 1.0
    return s.enough(F.avg(change).over(s.last(t - 1)), t)


def one_bar_return(s: Series, x: Column) -> Column:
    prev = F.lag(x).over(s.plain)
    return F.when(F.abs(prev) > NO_PRICE, (x - prev) / prev).otherwise(F.lit(0.0))


@family("ta_beta", 2, (5, 10, 20))
def beta(s: Series, t: int, a: Column, b: Column) -> Column:
    """Slope of the returns of ``b`` on those of ``a``."""
    x, y, w = one_bar_return(s, a), one_bar_return(s, b), s.last(t)
    return s.enough(F.coalesce(ratio(F.covar_pop(x, y).over(w), F.var_pop(x).over(w)), F.lit(0.0)), t + 1)


def slope_of(s: Series, t: int, x: Column) -> Column:
    """Least-squares slope against time over a full frame of ``t`` rows."""
    return F.covar_pop(x, s.row.cast("double")).over(s.last(t)) * F.lit(12.0 / (t * t - 1))


@family("ta_lr_slope", 1, (5, 10, 20))
def regression_slope(s: Series, t: int, x: Column) -> Column:
    return s.enough(slope_of(s, t, x), t)


@family("ta_lr_intercept", 1, (5, 10, 20))
def regression_intercept(s: Series, t: int, x: Column) -> Column:
    return s.enough(F.avg(x).over(s.last(t)) - slope_of(s, t, x) * F.lit((t - 1) / 2), t)


@family("ta_lr_angle", 1, (5, 10, 20))
def regression_angle(s: Series, t: int, x: Column) -> Column:
    return s.enough(F.degrees(F.atan(slope_of(s, t, x))), t)


@family("ta_tsf", 1, (5, 10, 20))
def forecast(s: Series, t: int, x: Column) -> Column:
    """The regression line one step ahead."""
    return s.enough(F.avg(x).over(s.last(t)) + slope_of(s, t, x) * F.lit((t + 1) / 2), t)


@family("ta_trima", 1, (8, 21, 55))
def triangular_mean(s: Series, t: int, x: Column) -> Column:
    inner, outer = ((t + 1) // 2, (t + 1) // 2) if t % 2 else (t // 2, t // 2 + 1)
    return s.enough(F.avg(F.avg(x).over(s.last(inner))).over(s.last(outer)), t)


@family("ta_mom", 1, (12, 25))
def momentum(s: Series, t: int, x: Column) -> Column:
    return s.enough(x - F.lag(x, t).over(s.plain), t + 1)


@family("ta_roc", 1, (14, 25), active=False)
def rate_of_change(s: Series, t: int, x: Column) -> Column:
    """In per cent."""
    return s.enough((ratio(x, F.lag(x, t).over(s.plain)) - 1) * 100, t + 1)


@family("ta_rocp", 1, (14, 25))
def relative_change(s: Series, t: int, x: Column) -> Column:
    prev = F.lag(x, t).over(s.plain)
    return s.enough(ratio(x - prev, prev), t + 1)


@family("ta_rocr", 1, (14, 25))
def change_ratio(s: Series, t: int, x: Column) -> Column:
    return s.enough(ratio(x, F.lag(x, t).over(s.plain)), t + 1)


@family("ta_aroonosc", 2, (14, 25))
def aroon_oscillator(s: Series, t: int, h: Column, low: Column) -> Column:
    """Of t+1 bars: how much later the latest maximum came than the latest minimum, in per cent of t."""
    w = s.last(t + 1)
    highest = F.max(F.struct(h.alias("x"), s.row.alias("r"))).over(w)["r"]
    lowest = -F.min(F.struct(low.alias("x"), (-s.row).alias("r"))).over(w)["r"]
    return s.enough((highest - lowest) * F.lit(100.0 / t), t + 1)


@family("ta_cci", 3, (14, 25))
def commodity_channel(s: Series, t: int, h: Column, low: Column, c: Column) -> Column:
    price, w = (h + low + c) / 3, s.last(t)
    centre, values = F.avg(price).over(w), F.collect_list(price).over(w)
    away = F.aggregate(F.transform(values, lambda v: F.abs(v - centre)), F.lit(0.0), lambda acc, v: acc + v) / t
    return s.enough(ratio(price - centre, away * 0.015), t)


@family("ta_mfi", 4, (14, 25))
def money_flow(s: Series, t: int, h: Column, low: Column, c: Column, v: Column) -> Column:
    price = (h + low + c) / 3
    step = price - F.lag(price).over(s.plain)
    rise = F.sum(F.when(step > 0, price * v).otherwise(F.lit(0.0))).over(s.last(t))
    fall = F.sum(F.when(step < 0, price * v).otherwise(F.lit(0.0))).over(s.last(t))
    return s.enough(F.when(rise + fall < 1.0, F.lit(0.0)).otherwise(100.0 * ratio(rise, rise + fall)), t + 1)


@family("ta_willr", 3, (14, 25))
def williams(s: Series, t: int, h: Column, low: Column, c: Column) -> Column:
    top, bottom = F.max(h).over(s.last(t)), F.min(low).over(s.last(t))
    return s.enough(ratio(top - c, top - bottom) * -100.0, t)
