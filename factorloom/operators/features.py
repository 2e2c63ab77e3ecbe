"""Base features of bars, each normalised by its rolling deviation.

Most are expressions of the factor language under another gate: features take frames of at least half their length (or
the exact lengths below) and are divided by a deviation of at least 1e-6.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cumulative, recursive, rolling, scalar
from ..functions.frames import ROW, Series, clean, ratio
from ..plans.compile import _run_recursive
from .normalise import feature_norm

ACTIVE = ("h_ts_std_10",)


def _half(s: Series, value: Column, t: int) -> Column:
    return s.enough(value, -(-t // 2))


def _mean(s: Series, t: int, x: Column) -> Column:
    return s.enough(F.avg(x).over(s.last(t)), t)


def _place(s: Series, t: int, x: Column, highest: bool) -> Column:
    """Place from 1 of the extreme in a frame of at least half the length."""
    w = s.last(t)
    found = rolling._first_highest(s, x, w) if highest else rolling._first_lowest(s, x, w)
    return _half(s, (found - s.row + F.least(s.row, F.lit(t))).cast("double"), t)


def _bands(s: Series, c: Column, side: int) -> Column:
    return s.enough(F.avg(c).over(s.last(20)) + 2.0 * side * F.stddev_pop(c).over(s.last(20)), 20)


def _stochastic(s: Series, h: Column, low: Column, c: Column, smooth: int) -> Column:
    """Smoothed %K (1) or %D (2) of 9 bars by means of 3."""
    top, bottom = F.max(h).over(s.last(9)), F.min(low).over(s.last(9))
    x, have = F.coalesce(ratio(c - bottom, top - bottom) * 100.0, F.lit(0.0)), 9
    for _ in range(smooth):
        x, have = F.avg(x).over(s.last(3)), have + 2
    return s.enough(x, 13)


Builder = Callable[[Series, dict[str, Column]], Column]


def _x(name: str) -> Callable:
    return lambda b: b[name]


o, h, low, c, v = (_x(k) for k in ("o", "h", "l", "c", "vol"))

#: Row-local and framed features: name -> Column before normalisation.
FEATURES: dict[str, Builder] = {
    "lgp_shortcut_illiq_6": lambda s, b: F.avg(2 * (h(b) - low(b)) - F.abs(c(b) - o(b))).over(s.last(6)),
    "h_ts_std_10": lambda s, b: _half(s, F.stddev_samp(h(b)).over(s.last(10)), 10),
    "v_ts_argrange_10": lambda s, b: _place(s, 10, v(b), True) - _place(s, 10, v(b), False),
    "c_ts_argrange_10": lambda s, b: _place(s, 10, c(b), True) - _place(s, 10, c(b), False),
    "c_ts_day_min_40": lambda s, b: rolling.bars_since_min(s, 40, c(b)),
    "l_ts_prod_8": lambda s, b: _half(s, F.aggregate(F.collect_list(low(b)).over(s.last(8)), F.lit(1.0), lambda a, x: a * x), 8),
    "v_ts_std_20": lambda s, b: _half(s, F.stddev_samp(v(b)).over(s.last(20)), 20),
    "h_ta_lr_angle_10": lambda s, b: rolling.regression_angle(s, 10, h(b)),
    "v_ts_sma_21": lambda s, b: _half(s, F.avg(v(b)).over(s.last(21)), 21),
    "h_ts_kurt_20": lambda s, b: rolling.kurtosis(s, 20, h(b)),
    "v_ts_range_5": lambda s, b: _half(s, F.max(v(b)).over(s.last(5)) - F.min(v(b)).over(s.last(5)), 5),
    "c_ts_sma_21": lambda s, b: _half(s, F.avg(c(b)).over(s.last(21)), 21),
    "o_ts_argmin_10": lambda s, b: _place(s, 10, o(b), False),
    "o_ta_lr_slope_10": lambda s, b: rolling.regression_slope(s, 10, o(b)),
    "l_ts_argmax_20": lambda s, b: _place(s, 20, low(b), True),
    "o_ts_range_10": lambda s, b: _half(s, F.max(o(b)).over(s.last(10)) - F.min(o(b)).over(s.last(10)), 10),
    "h_ts_argmax_5": lambda s, b: _place(s, 5, h(b), True),
    "l_ts_day_min_40": lambda s, b: rolling.bars_since_min(s, 40, low(b)),
    "v_ts_day_max_20": lambda s, b: rolling.bars_since_max(s, 20, v(b)),
    "c_ta_tsf_5": lambda s, b: rolling.forecast(s, 5, c(b)),
    "c_power_c": lambda s, b: c(b) * c(b) * c(b),
    "l_ts_argrange_5": lambda s, b: _place(s, 5, low(b), True) - _place(s, 5, low(b), False),
    "v_power_a": lambda s, b: v(b) * v(b) * v(b),
    "ori_ta_bop": lambda s, b: scalar.balance_of_power(s, o(b), h(b), low(b), c(b)),
    "ori_ta_obv": lambda s, b: cumulative.on_balance_volume(s, c(b), v(b)),
    "ori_ta_ad": lambda s, b: cumulative.accumulation(s, h(b), low(b), c(b), v(b)),
    **{f"ma{t}_c": (lambda s, b, t=t: ratio(_mean(s, t, c(b)), c(b))) for t in (8, 15, 25, 35, 55)},
    "h_line": lambda s, b: _bands(s, c(b), 1),
    "m_line": lambda s, b: _bands(s, c(b), 0),
    "l_line": lambda s, b: _bands(s, c(b), -1),
    "stdevrate": lambda s, b: ratio(_bands(s, c(b), 1) - _bands(s, c(b), -1), c(b) * 4),
    "mfi_index": lambda s, b: rolling.money_flow(s, 14, h(b), low(b), c(b), v(b)),
    "mfi_30": lambda s, b: rolling.money_flow(s, 30, h(b), low(b), c(b), v(b)),
    "ppo": lambda s, b: s.enough(ratio(F.avg(c(b)).over(s.last(12)) - F.avg(c(b)).over(s.last(26)), F.avg(c(b)).over(s.last(26))) * 100.0, 26),
    "ad_index": lambda s, b: cumulative.accumulation(s, h(b), low(b), c(b), v(b)),
    "tr_index": lambda s, b: rolling.true_range(s, h(b), low(b), c(b)),
    "kdj_d": lambda s, b: _stochastic(s, h(b), low(b), c(b), 2),
    "kdj_k": lambda s, b: _stochastic(s, h(b), low(b), c(b), 1),
    "obv_v": lambda s, b: cumulative.on_balance_volume(s, c(b), v(b)),
    # Close, low and high in this order.
    **{f"cci_{t}": (lambda s, b, t=t: rolling.commodity_channel(s, t, c(b), low(b), h(b))) for t in (14, 25, 55)},
}

#: Recursive features: name -> (state, input columns).
RECURSIVE: dict[str, tuple[Callable, list[str]]] = {
    "v_ta_cmo_25": (lambda: recursive.Cmo(25), ["vol"]),
    **{f"ori_trix_{t}": (lambda t=t: recursive.Trix(t), ["c"]) for t in (8, 21, 55)},
    **{f"ori_rsi_{t}": (lambda t=t: recursive.Rsi(t), ["c"]) for t in (6, 12, 24)},
    **{f"ori_cmo_{t}": (lambda t=t: recursive.Cmo(t), ["c"]) for t in (14, 25)},
    **{f"fm{p}": (lambda p=p: recursive.SuperSmoother(p), ["c", "o"]) for p in (20, 30, 40, 60)},
    "ori_ta_macd": (recursive.MacdGap, ["c"]),
    "sar_index": (recursive.Sar, ["h", "l"]),
    "ad_real": (recursive.AdOscillator, ["h", "l", "c", "vol"]),
    "sarext": (recursive.FrozenSar, ["h", "l"]),
    "volume_macd": (recursive.MacdGap, ["vol"]),
    "close_macd": (recursive.MacdGap, ["c"]),
}

#: Features of a normalised feature: name -> (that feature, how).
SECOND: dict[str, tuple[str, str]] = {
    "v_cci_25_obv": ("cci_25_hlc", "obv"),
    "v_cci_25_sum": ("cci_25_hlc", "sum"),
    "v_trix_8_obv": ("ori_trix_8", "obv"),
    "v_sar_obv": ("sar_index", "obv"),
    "v_bop_sum": ("ori_ta_bop", "sum"),
    **{f"v_rsi_{t}_{how}": (f"ori_rsi_{t}", how) for t in (6, 12, 24) for how in ("obv", "sum")},
    "v_cmo_14_obv": ("ori_cmo_14", "obv"),
    "sar_close": ("sar_index", "to_close"),
}
_INNER: dict[str, Builder] = {"cci_25_hlc": lambda s, b: rolling.commodity_channel(s, 25, h(b), low(b), c(b))}

ALL = (*FEATURES, *RECURSIVE, *SECOND)
_NOT_NORMALISED = ("kdj_d", "kdj_k")
_TWICE = ("ori_ta_macd",)


def base_features(bars: DataFrame, names: tuple[str, ...] = ACTIVE, series: Series = Series(), window: int = 2000) -> DataFrame:
    """``bars`` with a column for each feature; nulls, NaN and infinities are 0, in the bars' own columns too."""
    unknown = [n for n in names if n not in ALL]
    if unknown:
        raise ValueError(f"no features named {unknown}")
    data = [x for x in ("o", "h", "l", "c", "vol", "vol_ccy", "trades") if x in bars.columns]
    now = bars.withColumns({x: clean(F.col(x)) for x in data}).withColumn(ROW, F.row_number().over(series.plain))
    b = {x: F.col(x) for x in data}
    inner = {SECOND[n][0] for n in names if n in SECOND}
    needed = [*names, *[x for x in inner if x not in names]]
    jobs = {f"__r_{n}": RECURSIVE[n] for n in needed if n in RECURSIVE}
    if jobs:
        now = _run_recursive(now, series, jobs)
    framed = {n: clean((FEATURES | _INNER)[n](series, b)) for n in needed if n in FEATURES or n in _INNER}
    framed |= {n: clean(F.col(f"__r_{n}")) for n in needed if n in RECURSIVE}
    raw = {f"__r_{n}" for n in needed if n in RECURSIVE}
    if framed:
        now = now.withColumns(framed)
    if "sar_close" in needed:
        now = now.withColumn("sar_close", clean(ratio(F.col("sar_index") - F.col("c"), F.col("c"))))
    scaled = [n for n in [*framed, *(["sar_close"] if "sar_close" in needed else [])] if n not in _NOT_NORMALISED]
    for again in (scaled, [n for n in scaled if n in _TWICE]):
        if again:
            now = now.withColumns({n: feature_norm(F.col(n), series, window) for n in again})
    second = {}
    for n in names:
        if n in SECOND and SECOND[n][1] != "to_close":
            of, how = SECOND[n]
            second[n] = cumulative.on_balance_volume(series, F.col(of), F.col("vol")) if how == "obv" else cumulative.running_sum(series, F.col(of) * F.col("vol"))
    if second:
        now = now.withColumns({n: clean(x) for n, x in second.items()})
        now = now.withColumns({n: feature_norm(F.col(n), series, window) for n in second})
    return now.drop(ROW, *raw, *[x for x in inner if x not in names])


def latest_features(bars: DataFrame, names: tuple[str, ...] = ACTIVE, series: Series = Series(), window: int = 2000) -> DataFrame:
    """The newest row of each series, computed from its last ``window`` bars alone, as a live run does."""
    from pyspark.sql import Window

    newest = Window.partitionBy(*series.keys).orderBy(*[F.desc(x) for x in series.order])
    tail = bars.withColumn("__back", F.row_number().over(newest)).where(F.col("__back") <= window)
    return base_features(tail, names, series, window).where("__back = 1").drop("__back")
