"""Operators of the factor language against pandas and plain Python."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.functions import OPERATORS, active_operators, register_operator
from factorloom.functions import recursive as R
from factorloom.plans import compile_factors

WINDOW = 40


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.RandomState(0)
    rows = []
    for symbol, n in (("a", 150), ("b", 90), ("one", 1)):
        walk = 100 + np.cumsum(rng.standard_t(4, n))
        for i in range(n):
            o, c = walk[i - 1] if i else walk[0], walk[i]
            if 30 <= i < 45:
                c = o = walk[30]
            rows.append((symbol, i, float(o), float(max(o, c) + abs(rng.randn())), float(min(o, c) - abs(rng.randn())), float(c), float(rng.randint(0, 50))))
    pdf = pd.DataFrame(rows, columns=["symbol", "ts", "o", "h", "l", "c", "v"])
    return pdf, spark.createDataFrame(pdf.sample(frac=1, random_state=1)).repartition(5)


def norm(x: pd.Series, window: int = WINDOW) -> pd.Series:
    x = x.replace([np.inf, -np.inf, np.nan], 0.0)
    return (x / x.rolling(window, min_periods=1).std()).replace([np.inf, -np.inf, np.nan], 0.0)


def windowed(x: pd.Series, t: int, f) -> pd.Series:
    return x.rolling(t).apply(f, raw=True).fillna(0.0)


def slope(v):
    return np.polyfit(np.arange(len(v)), v, 1)[0]


REFERENCE = {
    "ts_sma_8(c)": lambda d: d.c.rolling(8, min_periods=4).mean(),
    "ts_std_10(c)": lambda d: d.c.rolling(10, min_periods=5).std(),
    "ts_skew_10(c)": lambda d: d.c.rolling(10, min_periods=5).skew(),
    "ts_kurt_10(c)": lambda d: d.c.rolling(10, min_periods=5).kurt(),
    "ts_min_5(c)": lambda d: d.c.rolling(5, min_periods=2).min(),
    "ts_range_5(c)": lambda d: d.c.rolling(5, min_periods=2).max() - d.c.rolling(5, min_periods=2).min(),
    "TS_COV_20(c, v)": lambda d: d.c.rolling(20, min_periods=10).cov(d.v),
    "TS_CORR_20(c, v)": lambda d: d.c.rolling(20, min_periods=10).corr(d.v),
    "ts_wma_8(c)": lambda d: windowed(d.c, 8, lambda v: v @ np.arange(1, 9) / 36),
    "ts_prod_3(c)": lambda d: windowed(d.c, 3, np.prod),
    "ts_argmin_5(c)": lambda d: windowed(d.c, 5, lambda v: np.argmin(v) + 1),
    "ts_argmax_5(c)": lambda d: windowed(d.c, 5, lambda v: np.argmax(v) + 1),
    "ts_argrange_5(v)": lambda d: windowed(d.v, 5, lambda v: np.argmax(v) - np.argmin(v)),
    "TS_DAY_MIN_10(c)": lambda d: windowed(d.c, 11, lambda v: 10 - np.argmin(v[:-1])),
    "TS_DAY_MAX_10(v)": lambda d: windowed(d.v, 11, lambda v: 10 - np.argmax(v[:-1])),
    "ts_rank_5(v)": lambda d: windowed(d.v, 5, lambda v: (v < v[-1]).sum() + (v <= v[-1]).sum() + 1),
    "ts_lag_3(c)": lambda d: d.c.shift(3).fillna(0),
    "ts_delta_3(c)": lambda d: d.c - d.c.shift(3).fillna(0),
    "ts_sum_3(c)": lambda d: d.c.rolling(3).sum().fillna(0),
    "ts_mean_return_5(c)": lambda d: windowed(d.c, 5, lambda v: np.mean(v[1:] / v[:-1] - 1)),
    "ta_lr_slope_5(c)": lambda d: windowed(d.c, 5, slope),
    "ta_lr_angle_5(c)": lambda d: windowed(d.c, 5, lambda v: math.degrees(math.atan(slope(v)))),
    "ta_lr_intercept_5(c)": lambda d: windowed(d.c, 5, lambda v: np.polyfit(np.arange(5), v, 1)[1]),
    "ta_tsf_5(c)": lambda d: windowed(d.c, 5, lambda v: np.polyval(np.polyfit(np.arange(5), v, 1), 5)),
    "ta_trima_8(c)": lambda d: d.c.rolling(4).mean().rolling(5).mean().fillna(0),
    "ta_trima_21(c)": lambda d: d.c.rolling(11).mean().rolling(11).mean().fillna(0),
    "ta_mom_12(c)": lambda d: (d.c - d.c.shift(12)).fillna(0),
    "ta_rocp_14(c)": lambda d: (d.c / d.c.shift(14) - 1).fillna(0),
    "ta_aroonosc_14(h, l)": lambda d: (
        d.h.rolling(15).apply(lambda v: 14 - np.argmax(v[::-1]), raw=True) - d.l.rolling(15).apply(lambda v: 14 - np.argmin(v[::-1]), raw=True)
    ).fillna(0),
    "ta_willr_14(h, l, c)": lambda d: ((d.h.rolling(14).max() - d.c) / (d.h.rolling(14).max() - d.l.rolling(14).min()) * -100).fillna(0),
    "TA_OBV(c, v)": lambda d: (np.sign(d.c.diff().fillna(1)) * d.v).cumsum(),
}


def by_symbol(pdf, f):
    return pd.concat([norm(f(d.reset_index(drop=True))) for _, d in pdf.groupby("symbol")], ignore_index=True)


@pytest.mark.parametrize("chosen", [list(REFERENCE)[k::3] for k in range(3)])
def test_framed_operators_match_pandas(frame, chosen):
    pdf, df = frame
    got = compile_factors(df, {f"f{k}": e for k, e in enumerate(chosen)}, norm_window=WINDOW).toPandas().sort_values(["symbol", "ts"], ignore_index=True)
    for k, e in enumerate(chosen):
        want = by_symbol(pdf, REFERENCE[e])
        # pandas updates higher moments row by row and drifts after a constant run.
        loose = 1e-3 if "skew" in e or "kurt" in e else 1e-7
        np.testing.assert_allclose(got[f"f{k}"], want, rtol=1e-6, atol=loose, err_msg=e)


def ema(x, t, k=None):
    """Straight from the definition, NaN before the seed."""
    k, out = k or 2 / (t + 1), [math.nan] * len(x)
    known = [i for i, v in enumerate(x) if v == v]
    for n, i in enumerate(known):
        if n == t - 1:
            out[i] = sum(x[j] for j in known[:t]) / t
        elif n >= t:
            out[i] = out[known[n - 1]] + k * (x[i] - out[known[n - 1]])
    return out


def folded(state, *columns):
    return [state.step(*row) for row in zip(*columns)]


def test_averages_of_averages():
    x = list(100 + np.cumsum(np.random.RandomState(3).randn(200)))
    e1 = ema(x, 8)
    e2 = ema(e1, 8)
    e3 = ema(e2, 8)
    close = lambda a, b: np.testing.assert_allclose(a, b, rtol=1e-12)
    close(folded(R.Ema(8), x), e1)
    close(folded(R.Dema(8), x), 2 * np.array(e1) - e2)
    close(folded(R.Tema(8), x), 3 * np.array(e1) - 3 * np.array(e2) + e3)
    close(folded(R.Trix(8), x)[23:], [100 * (b / a - 1) for a, b in zip(e3[22:], e3[23:])])
    assert sum(v != v for v in folded(R.Tema(55), x + x)) == 3 * 54


def test_wilder_indicators():
    rng = np.random.RandomState(4)
    c = list(100 + np.cumsum(rng.randn(120)))
    h, low = [v + abs(rng.randn()) for v in c], [v - abs(rng.randn()) for v in c]
    moves = [math.nan, *np.diff(c)]
    up, down = ema([max(m, 0) if m == m else m for m in moves], 6, 1 / 6), ema([max(-m, 0) if m == m else m for m in moves], 6, 1 / 6)
    np.testing.assert_allclose(folded(R.Rsi(6), c), [100 * u / (u + d) for u, d in zip(up, down)])
    tr = [math.nan, *[max(h[i] - low[i], abs(h[i] - c[i - 1]), abs(low[i] - c[i - 1])) for i in range(1, 120)]]
    np.testing.assert_allclose(folded(R.Atr(14), h, low, c), ema(tr, 14, 1 / 14))
    for state, lead in ((R.MinusDm(14), 13), (R.MinusDi(14), 14), (R.Dx(14), 14), (R.Adx(14), 27), (R.Adxr(14), 40)):
        args = (h, low) if isinstance(state, R.MinusDm) else (h, low, c)
        out = folded(state, *args)
        assert sum(v != v for v in out) == lead, type(state)


def cycle_arrays(x, first):
    """The dominant cycle over whole arrays, index by index, as it is published: (smoothed prices, smoothed period)."""
    n, pad = len(x), 8
    at = lambda: np.zeros(n + pad)
    smooth, detrended, i1, q1, i2, q2, re, im, period, smoothed = (at() for _ in range(10))
    for k in range(first, n):
        i = k + pad
        pace = 0.075 * period[i - 1] + 0.54
        turn = lambda a, i=i, pace=pace: (0.0962 * (a[i] - a[i - 6]) + 0.5769 * (a[i - 2] - a[i - 4])) * pace
        smooth[i] = (4 * x[k] + 3 * x[k - 1] + 2 * x[k - 2] + x[k - 3]) / 10
        detrended[i] = turn(smooth)
        q1[i], i1[i] = turn(detrended), detrended[i - 3]
        i2[i] = 0.2 * (i1[i] - turn(q1)) + 0.8 * i2[i - 1]
        q2[i] = 0.2 * (q1[i] + turn(i1)) + 0.8 * q2[i - 1]
        re[i] = 0.2 * (i2[i] * i2[i - 1] + q2[i] * q2[i - 1]) + 0.8 * re[i - 1]
        im[i] = 0.2 * (i2[i] * q2[i - 1] - q2[i] * i2[i - 1]) + 0.8 * im[i - 1]
        raw = 2 * math.pi / math.atan(im[i] / re[i]) if re[i] and im[i] else period[i - 1]
        raw = float(np.clip(np.clip(raw, 0.67 * period[i - 1], 1.5 * period[i - 1]), 6, 50))
        period[i] = 0.2 * raw + 0.8 * period[i - 1]
        smoothed[i] = 0.33 * period[i] + 0.67 * smoothed[i - 1]
    return smooth[pad:], smoothed[pad:]


@pytest.mark.parametrize("seed", [0, 1])
def test_cycles_equal_whole_arrays(seed):
    rng = np.random.RandomState(seed)
    x = 100 + 5 * np.sin(np.arange(220) * 2 * math.pi / (18 + 6 * seed)) + np.cumsum(0.3 * rng.randn(220))
    np.testing.assert_allclose(folded(R.CyclePeriod(), x)[32:], cycle_arrays(x, 12)[1][32:], rtol=1e-9)
    smooth, period = cycle_arrays(x, 37)
    width = (period + 0.5).astype(int)
    means = np.array([x[k - width[k] + 1 : k + 1].mean() if k >= 37 and width[k] else 0.0 for k in range(len(x))])
    line = [(4 * means[k] + 3 * means[k - 1] + 2 * means[k - 2] + means[k - 3]) / 10 for k in range(63, len(x))]
    np.testing.assert_allclose(folded(R.Trendline(), x)[63:], line, rtol=1e-9)
    phases = folded(R.CyclePhase(), x)
    for k in range(100, len(x)):
        # The angle of the price's component at the period of the cycle; the lag of the smoothing is one bar.
        angles = 2 * math.pi * np.arange(width[k]) / width[k]
        past = np.array([smooth[k - i] for i in range(width[k])])
        real, imag = (np.sin(angles) * past).sum(), (np.cos(angles) * past).sum()
        want = math.degrees(math.atan(real / imag)) + 90 + 360 / period[k] + (180 if imag < 0 else 0)
        assert phases[k] == pytest.approx(want - 360 if want > 315 else want, rel=1e-7), k


def test_sar_turns_and_stays_outside():
    h = [10, 11, 12, 13, 14, 13, 11, 9, 8, 7.5, 8, 9, 10, 11]
    low = [9, 10, 11, 12, 13, 11, 9, 7, 6, 6.5, 7, 8, 9, 10]
    out = folded(R.Sar(), h, low)
    assert math.isnan(out[0]) and out[1] == 9
    assert all(s <= x for s, x in zip(out[1:6], low[1:6]))
    assert any(s >= x for s, x in zip(out[6:], h[6:]))


def test_hilbert_period_finds_a_cycle():
    x = [100 + 5 * math.sin(2 * math.pi * i / 20) for i in range(400)]
    assert abs(folded(R.CyclePeriod(), x)[-1] - 20) < 1.5
    assert all(v != v for v in folded(R.CyclePeriod(), x)[:32])
    assert abs(folded(R.Trendline(), x)[-1] - 100) < 1.0
    phase = folded(R.CyclePhase(), x)[-40:]
    assert max(phase) <= 315 and min(phase) >= -46


def test_ewm_std_matches_pandas():
    x = np.random.RandomState(1).randn(80)
    np.testing.assert_allclose(folded(R.EwmStd(10), x)[1:], pd.Series(x).ewm(span=10).std().to_numpy()[1:], rtol=1e-10)


def test_macd_matches_its_averages():
    x = list(100 + np.cumsum(np.random.RandomState(2).randn(90)))
    fast = [math.nan] * 14 + ema(x[14:], 12)
    gap = [a - b for a, b in zip(fast, ema(x, 26))]
    want = [a - b for a, b in zip(gap, ema(gap, 9))]
    np.testing.assert_allclose(folded(R.MacdGap(), x), want)


def test_recursive_operators_agree_with_folds_across_batches(spark, frame):
    pdf, df = frame
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = compile_factors(df, {"f": "ta_kama_8(c)", "g": "TA_SAR(h, l)"}, norm_window=WINDOW).toPandas().sort_values(["symbol", "ts"], ignore_index=True)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for name, f in (("f", lambda d: pd.Series(folded(R.Kama(8), d.c))), ("g", lambda d: pd.Series(folded(R.Sar(), d.h, d.l)))):
        np.testing.assert_allclose(got[name], by_symbol(pdf, f), rtol=1e-9, atol=1e-9)


def test_registry_counts():
    active_operators()
    own = [o for o in OPERATORS.values() if not o.name.startswith(("fm_", "ewm_std", "macd_gap", "ad_oscillator", "frozen_sar", "ta_roc_"))]
    assert len(own) == 152 and sum(o.active for o in own) == 136


def test_all_outputs_are_finite_and_start_at_zero(frame):
    _, df = frame
    args = {1: "c", 2: "h, l", 3: "h, l, c", 4: "h, l, c, v"}
    names = [o.name for o in active_operators() if o.normalised][::7]
    got = compile_factors(df, {n: f"{n}({args[OPERATORS[n].arity]})" for n in names}, norm_window=WINDOW).toPandas()
    assert np.isfinite(got[names].to_numpy()).all()
    assert (got.loc[got.ts == 0, names].to_numpy() == 0).all()


def test_normalisation_ignores_scale_and_row_order(spark, frame):
    _, df = frame
    wide = df.withColumn("c9", F.col("c") * 1000)
    got = compile_factors(wide, {"a": "ts_sma_8(c)", "b": "ts_sma_8(c9)"}, norm_window=WINDOW).toPandas().sort_values(["symbol", "ts"], ignore_index=True)
    np.testing.assert_allclose(got.a, got.b, rtol=1e-9)
    again = compile_factors(wide.orderBy(F.rand(1)).repartition(3), {"a": "ts_sma_8(c)"}, norm_window=WINDOW).toPandas().sort_values(["symbol", "ts"], ignore_index=True)
    assert (again.a == got.a).all()


def test_long_frames_equal_sliding_frames(frame):
    _, df = frame
    calls = {"a": "ts_sma_8(c)", "b": "ts_argmax_5(v)", "z": "mul(ts_lag_3(c), 0)", "k": "ts_argmin_5(mul(c, 0))"}
    for window in (WINDOW, 7, 1):
        want = compile_factors(df, calls, norm_window=window, long_frames=False).toPandas().sort_values(["symbol", "ts"], ignore_index=True)
        got = compile_factors(df, calls, norm_window=window, long_frames=True).toPandas().sort_values(["symbol", "ts"], ignore_index=True)
        np.testing.assert_allclose(got[list(calls)], want[list(calls)], rtol=1e-7, atol=1e-9)


def test_known_length_chooses_the_form_of_frames(frame):
    """Frames no shorter than the series take the plain form, with fewer sorts, and give equal results."""
    _, df = frame
    calls = {"a": "ts_sma_8(c)", "b": "div(ts_std_10(c), ta_ema_8(v))"}
    most = df.groupBy("symbol").count().agg(F.max("count")).first()[0]
    sorts = lambda x: x._jdf.queryExecution().executedPlan().toString().count("Sort [")
    for window in (most, most - 1):
        known = compile_factors(df, calls, norm_window=window, longest=most)
        unknown = compile_factors(df, calls, norm_window=window)
        assert (sorts(known) < sorts(unknown)) == (window == most)
        got, want = (x.toPandas().sort_values(["symbol", "ts"], ignore_index=True) for x in (known, unknown))
        np.testing.assert_allclose(got[list(calls)], want[list(calls)], rtol=1e-7, atol=1e-9)


def test_bad_numbers_count_as_zero(spark):
    rows = [("s", i, v) for i, v in enumerate([1.0, None, float("nan"), float("inf"), -2.0, 0.0, 5.0])]
    df = spark.createDataFrame(rows, "symbol string, ts int, x double")
    got = compile_factors(df, {"y": "add(x, 0)", "z": "div(x, x)"}).toPandas().sort_values("ts")
    assert got.y.tolist() == [1, 0, 0, 0, -2, 0, 5] and got.z.tolist() == [1, 1, 1, 1, 1, 1, 1]


def test_user_operators_are_checked(spark):
    op = register_operator(spark, "double_it", 1, lambda s, x: x * 2, normalised=False)
    assert op.arity == 1
    with pytest.raises(ValueError, match="closed"):
        register_operator(spark, "broken", 1, lambda s, x: F.lit(1.0) / F.when(x == 0, F.lit(None)).otherwise(x), normalised=False)
    with pytest.raises(ValueError, match="arity"):
        register_operator(spark, "broken", 0, lambda s: F.lit(1.0))
    with pytest.raises(ValueError, match="evaluated"):
        register_operator(spark, "broken", 1, lambda s, x: F.col("absent"))
    assert "broken" not in OPERATORS
    OPERATORS.pop("double_it")


def test_empty_frame(spark):
    df = spark.createDataFrame([], "symbol string, ts int, c double")
    assert compile_factors(df, {"a": "ts_sma_8(c)", "b": "ta_ema_8(c)"}).count() == 0
