"""Normalisers of features and labels beside the one that operators apply."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import ROW, Series, clean, ratio
from ..functions.ordered import RankBefore, Uniform, ValueAt
from ..plans.compile import _run_recursive, with_long_deviation
from .ordered import exact_quantiles


def _numbered(df: DataFrame, series: Series) -> DataFrame:
    return df.withColumn(ROW, F.row_number().over(series.plain))


def norm(df: DataFrame, column: str, out: str, window: int = 2000, series: Series = Series(), long_frames: bool = False) -> DataFrame:
    """x over its rolling sample deviation; the mean stays."""
    now = _numbered(df, series).withColumn("__x", clean(F.col(column)))
    if long_frames:
        now = with_long_deviation(now, series, {"__x": "__s"}, window)
    else:
        now = now.withColumn("__s", F.stddev_samp("__x").over(series.last(window)))
    return now.withColumn(out, clean(ratio(F.col("__x"), F.col("__s")))).drop("__x", "__s", ROW)


def feature_norm(x: Column, series: Series, window: int = 2000) -> Column:
    """As ``norm``, but the deviation is never taken smaller than 1e-6."""
    x0 = clean(x)
    return clean(x0 / F.greatest(F.coalesce(F.stddev_samp(x0).over(series.last(window)), F.lit(0.0)), F.lit(1e-6)))


def log_norm(df: DataFrame, column: str, out: str, window: int = 2000, series: Series = Series()) -> DataFrame:
    """sign(x) log1p|x| over log1p|mean|, then over its rolling deviation. The mean is of the whole series, later rows
    included, so this suits studies and not live use."""
    x = F.col(column)
    scale = F.log1p(F.abs(F.avg(x).over(series.whole)) + 1e-8)
    now = df.withColumn("__y", clean(ratio(F.signum(x) * F.log1p(F.abs(x)), scale)))
    return now.withColumn(out, clean(ratio(F.col("__y"), F.stddev_samp("__y").over(series.last(window))))).drop("__y")


def expanding_zscore(x: Column, series: Series) -> Column:
    return clean(ratio(x - F.avg(x).over(series.upto), F.stddev_samp(x).over(series.upto)))


def return_norm(df: DataFrame, column: str, out: str, window: int = 2000, series: Series = Series()) -> DataFrame:
    """log1p(x) over its rolling deviation."""
    now = df.withColumn("__y", clean(F.log1p(column)))
    return now.withColumn(out, clean(ratio(F.col("__y"), F.stddev_samp("__y").over(series.last(window))))).drop("__y")


def label_zscore(x: Column, window: int, series: Series) -> Column:
    """Causal z-score with the population deviation over a full window; null before that and where nothing varies."""
    w = series.last(window)
    full = F.count(x).over(w) == window
    return F.when(full, ratio(x - F.avg(x).over(w), F.stddev_pop(x).over(w)))


def protected_ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def rolling_scale(x: Column, window: int, series: Series) -> Column:
    """x over its population deviation of a full window, 0 before that."""
    w = series.last(window)
    deviation = F.when(F.count(x).over(w) == window, F.stddev_pop(x).over(w)).otherwise(F.lit(0.0))
    return protected_ratio(x, deviation)


# The rational approximation of the inverse normal distribution (Abramowitz and Stegun 26.2.23).
TOP = (2.515517, 0.802853, 0.010328)
BOTTOM = (1.0, 1.432788, 0.189269, 0.001308)


def inverse_normal(q: Column) -> Column:
    r = F.sqrt(-2.0 * F.log(F.least(q, 1.0 - q)))
    top = TOP[0] + TOP[1] * r + TOP[2] * r * r
    bottom = BOTTOM[0] + BOTTOM[1] * r + BOTTOM[2] * r * r + BOTTOM[3] * r * r * r
    return F.when(q < 0.5, -1.0).otherwise(1.0) * (r - top / bottom)


def normal_cdf(x: Column) -> Column:
    """Abramowitz and Stegun 7.1.26 for the error function, within 1.5e-7."""
    z = F.abs(x) / math.sqrt(2)
    t = 1.0 / (1.0 + 0.3275911 * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1.0 - poly * F.exp(-z * z)
    return 0.5 * (1.0 + F.signum(x) * erf)


def gauss_rank(df: DataFrame, column: str, out: str, window: int = 500, clip: float = 6.0, seed: int | None = None, series: Series = Series()) -> DataFrame:
    """Normal score of each value's rank among the ``window`` values before it; 0 for the first ``window`` rows.

    Ties and the place between neighbours are settled by the middle, so equal inputs give equal outputs; with ``seed``
    a uniform number takes the middle's place: NumPy's legacy stream of that seed, by row number, drawn in the tasks.
    """
    return gauss_ranks(df, {out: (column, window)}, clip, seed, series)


def gauss_ranks(df: DataFrame, scores: dict[str, tuple[str, int]], clip: float = 6.0, seed: int | None = None, series: Series = Series()) -> DataFrame:
    """``gauss_rank`` for several results (name -> (column, window)) in one pass."""
    # States take numbers, so that a null is what stands for nothing.
    jobs = {f"__q_{name}": ((lambda w=w: RankBefore(w)), [column]) for name, (column, w) in scores.items()}
    if seed is not None:
        jobs["__u"] = (lambda: Uniform(seed), [next(iter(scores.values()))[0]])
    now = _run_recursive(df, series, jobs)
    place = F.lit(0.5) if seed is None else F.col("__u")
    out = {}
    for name, (_, window) in scores.items():
        code = F.col(f"__q_{name}")
        below, ties = F.floor(code / (window + 1)), code % (window + 1)
        q = (below + place * F.when(ties > 0, ties + 1).otherwise(F.lit(1))) / (window + 1)
        score = F.greatest(F.lit(-clip), F.least(F.lit(clip), inverse_normal(q)))
        out[name] = F.when(code >= 0, score).otherwise(F.lit(0.0))
    return now.withColumns(out).drop(*jobs)


def inverse_gauss_rank(df: DataFrame, scored: str, column: str, out: str, window: int = 500, series: Series = Series()) -> DataFrame:
    """The value that stands at the score's quantile among the ``window`` values before the row; 0 for the first rows."""
    place = F.floor(normal_cdf(F.col(scored)) * window)
    now = df.withColumn("__p", F.greatest(F.lit(0), F.least(place, F.lit(window - 1))).cast("double"))
    now = _run_recursive(now, series, {"__v": (lambda: ValueAt(window), ["__p", column])})
    return now.withColumn(out, clean(F.col("__v"))).drop("__v", "__p")


QUANTILES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def quantile_consistency(df: DataFrame, column: str, scored: str, series: Series = Series(), longest: int | None = None) -> DataFrame:
    """(keys, part, quantile, original, normalised, rank_correlation): the quantiles of both series, over all rows and
    over the rows above and below zero, and how well their sorted values correlate."""
    keys = list(series.keys)
    parts = F.array(F.lit("all"), F.when(F.col(column) > 0, "positive").when(F.col(column) < 0, "negative"))
    long = df.select(*keys, F.col(column).alias("x"), F.col(scored).alias("y"), F.explode(parts).alias("part")).where("part is not null")
    grid = F.array(*[F.lit(q) for q in QUANTILES])
    quantiles = exact_quantiles(long, {"x": "a", "y": "b"}, list(QUANTILES), (*keys, "part"), longest)
    flat = quantiles.select(*keys, "part", F.explode(F.arrays_zip(grid.alias("q"), "a", "b")).alias("z")).select(
        *keys, "part", F.col("z.q").alias("quantile"), F.col("z.a").alias("original"), F.col("z.b").alias("normalised")
    )
    rank = lambda c: df.select(*keys, F.col(c).alias(c), F.row_number().over(Window.partitionBy(*keys).orderBy(c)).alias("r"))
    both = rank(column).join(rank(scored), [*keys, "r"]).groupBy(*keys).agg(_pearson(column, scored).alias("rank_correlation"))
    return flat.join(both, keys)


def _pearson(a: str, b: str) -> Column:
    return ratio(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def inverse_check(df: DataFrame, column: str, restored: str, series: Series = Series()) -> DataFrame:
    """(keys, n, mean_relative_error, pearson, spearman) of a series and its restored form."""
    from .resample import average_rank

    keys = series.keys
    ranked = df.select(*keys, F.col(column).alias("x"), F.col(restored).alias("y")).select(
        "*", average_rank("x", keys).alias("rx"), average_rank("y", keys).alias("ry")
    )
    error = F.avg(F.when(F.abs("x") > 1e-12, F.abs((F.col("y") - F.col("x")) / F.col("x"))))
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), error.alias("mean_relative_error"), _pearson("x", "y").alias("pearson"), _pearson("rx", "ry").alias("spearman"))


def position_performance(df: DataFrame, label: str, ret: str, skip: int | str = 0, fee: float = 0.0004, periods: int = 24 * 365, series: Series = Series()) -> DataFrame:
    """Twelve figures of holding +1 where ``label`` is positive and -1 elsewhere, fees on changes, from row ``skip`` (a number
    or a column) on."""
    w = series.plain
    keys = list(series.keys)
    now = df.withColumn("__pos", F.when(F.coalesce(F.col(label), F.lit(0.0)) > 0, 1.0).otherwise(-1.0)).withColumn(ROW, F.row_number().over(w))
    now = now.withColumn("__turn", F.abs(F.col("__pos") - F.lag("__pos").over(w)))
    now = now.withColumn("__net", F.col("__pos") * F.col(ret) - F.col("__turn") * fee).where(F.col(ROW) > (F.col(skip) if isinstance(skip, str) else skip))
    # The first row of all has no change and no net result, as there is nothing to compare with.
    now = now.withColumn("__value", 1.0 + F.sum("__net").over(series.upto))
    now = now.withColumn("__drop", ratio(F.col("__value"), F.max("__value").over(series.upto)) - 1.0)
    # Flips inside the evaluated rows only: the first of them has none.
    now = now.withColumn("__flip", F.abs(F.col("__pos") - F.lag("__pos").over(w)) > 1)
    total, cost, years, worst = F.sum("__net"), F.sum(F.col("__turn") * fee), F.count("*") / F.lit(float(periods)), F.min("__drop")
    return now.groupBy(*keys).agg(
        F.sum(F.abs(ret)).alias("gross_return"),
        total.alias("total_return"),
        ratio(total, years).alias("annual_return"),
        (ratio(F.avg("__net"), F.stddev_samp("__net")) * math.sqrt(periods)).alias("sharpe"),
        worst.alias("max_drawdown"),
        F.avg(F.when(F.col("__net") > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        cost.alias("fees"),
        F.avg(F.when(F.signum("__pos") == F.signum(ret), 1.0).otherwise(0.0)).alias("direction_accuracy"),
        F.stddev_samp("__pos").alias("position_volatility"),
        F.avg(F.when(F.col("__flip"), 1.0).otherwise(0.0)).alias("flip_rate"),
        ratio(ratio(total, years), F.abs(worst)).alias("return_over_drawdown"),
        ratio(total, cost).alias("return_over_fees"),
    )


def label_sweep(df: DataFrame, price: str, windows: tuple[int, ...], horizons: tuple[int, ...], series: Series = Series()) -> DataFrame:
    """Position figures for Gauss-rank labels of every window and forward horizon: (window, horizon, ...).

    A horizon is a series of its own; all windows of all horizons are ranked in one pass and held in one.
    """
    change = lambda n: ratio(F.lead(price, n).over(series.plain), F.col(price)) - 1.0
    wide = df.select(*series.keys, *series.order, change(1).alias("ret"), *[change(h).alias(f"__{h}") for h in horizons])
    ahead = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"__{h}").alias("fwd")) for h in horizons])).alias("a")
    rows = wide.select(*series.keys, *series.order, "ret", ahead).select(*series.keys, *series.order, "ret", "a.horizon", "a.fwd")
    by_horizon = Series((*series.keys, "horizon"), series.order)
    scored = gauss_ranks(rows.dropna(subset=["fwd", "ret"]), {f"__{w}": ("fwd", w) for w in windows}, series=by_horizon)
    labels = F.explode(F.array(*[F.struct(F.lit(w).alias("window"), F.col(f"__{w}").alias("label")) for w in windows])).alias("x")
    long = scored.select(*by_horizon.keys, *series.order, "ret", labels).select(*by_horizon.keys, *series.order, "ret", "x.window", "x.label")
    found = position_performance(long, "label", "ret", skip="window", series=Series((*by_horizon.keys, "window"), series.order))
    return found.select("window", "horizon", *[c for c in found.columns if c not in ("window", "horizon")])
