"""Scores of factors against returns.

All factors of a frame are scored in one plan: the frame is unpivoted to (factor, keys, order, y, y_pred, w), partitioned
by factor and series, and each group of metrics is an aggregate over it. Windows run inside one factor's series; only
one row for each factor and series leaves the cluster.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import ROW, Series, clean, ratio
from ..functions.ordered import FrameQuantile
from ..plans.compile import _run_recursive, with_long_deviation
from .ordered import exact_quantiles
from .resample import average_rank

Y_CLIP, X_CLIP = 0.2, 20.0
CHUNKS, BINS, LEAST_ROWS = 5, 16, 20
EXTREME = 0.02


@dataclass(frozen=True)
class Scoring:
    """What metrics depend on beside the data. ``periods``: bars in a year. ``longest``: a known bound on the rows of a series that
    one executor can hold, see ``exact_quantiles``."""

    keys: tuple[str, ...] = ("symbol",)
    order: str = "ts"
    periods: int = 17_520
    window: int = 2000
    chunks: int = CHUNKS
    bins: int = BINS
    longest: int | None = None

    @property
    def group(self) -> tuple[str, ...]:
        return ("factor", *self.keys)

    @property
    def series(self) -> Series:
        return Series(self.group, (self.order,))

    @property
    def upto(self):
        return Window.partitionBy(*self.group).orderBy(self.order).rowsBetween(Window.unboundedPreceding, 0)

    def last(self, t: int):
        return Window.partitionBy(*self.group).orderBy(self.order).rowsBetween(-(t - 1), 0)


def long_form(df: DataFrame, factors: list[str], y: str, s: Scoring, w: str | None = None) -> DataFrame:
    """(factor, keys, order, y, y_pred, w) with bad numbers as 0 and weights of 1 unless given."""
    rows = df.select(*s.keys, s.order, clean(F.col(y)).alias("y"), (clean(F.col(w)) if w else F.lit(1.0)).alias("w"), *factors)
    long = rows.unpivot([*s.keys, s.order, "y", "w"], factors, "factor", "y_pred")
    return long.withColumn("y_pred", clean(F.col("y_pred")))


def _corr(a: str | Column, b: str | Column) -> Column:
    return ratio(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def _weighted_corr(a: str, b: str) -> Column:
    """Absolute weighted correlation from sums, 0 where it is undefined."""
    w, x, y = F.col("w"), F.col(a), F.col(b)
    n = F.sum(w)
    mx, my = ratio(F.sum(w * x), n), ratio(F.sum(w * y), n)
    cov = ratio(F.sum(w * x * y), n) - mx * my
    var = (ratio(F.sum(w * x * x), n) - mx * mx) * (ratio(F.sum(w * y * y), n) - my * my)
    return F.when(var > 0, F.abs(cov / F.sqrt(F.greatest(var, F.lit(0.0))))).otherwise(F.lit(0.0))


def _average(x: Column) -> Column:
    return ratio(F.sum(x * F.col("w")), F.sum("w"))


def _clipped(x: str, bound: float) -> Column:
    return F.greatest(F.lit(-bound), F.least(F.lit(bound), F.col(x)))


def result(y_pred: Column | None = None) -> Column:
    """What holding the factor earns at a row, both sides clipped."""
    p = _clipped("y_pred", X_CLIP) if y_pred is None else y_pred
    return _clipped("y", Y_CLIP) * p * F.col("w")


# Groups of metrics: (long, scoring) -> one row for each factor and series.


def fit_metrics(long: DataFrame, s: Scoring) -> DataFrame:
    gap = F.col("y_pred") - F.col("y")
    # Weighted correlations are taken about the means first, so that sums don't cancel.
    means = long.groupBy(*s.group).agg(_average(F.col("y_pred")).alias("mp"), _average(F.col("y")).alias("my"))
    eps = 1e-15
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col("y_pred")))
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), 1.0 - F.col("y_pred")))
    dp, dy, w = F.col("y_pred") - F.col("mp"), F.col("y") - F.col("my"), F.col("w")
    var = F.sum(w * dp * dp) * F.sum(w * dy * dy)
    return long.join(means, list(s.group)).groupBy(*s.group).agg(
        F.when(var > 0, F.abs(F.sum(w * dp * dy) / F.sqrt(F.greatest(var, F.lit(0.0))))).otherwise(F.lit(0.0)).alias("weighted_pearson"),
        _average(F.abs(gap)).alias("mean_absolute_error"),
        _average(gap * gap).alias("mean_square_error"),
        F.sqrt(_average(gap * gap)).alias("root_mean_square_error"),
        _average(-(F.col("y") * F.log(p) + (1.0 - F.col("y")) * F.log(q))).alias("log_loss"),
    )


def rank_metrics(long: DataFrame, s: Scoring) -> DataFrame:
    ranked = long.select(*s.group, "w", average_rank("y", s.group).alias("ry"), average_rank("y_pred", s.group).alias("rp"))
    return ranked.groupBy(*s.group).agg(_weighted_corr("rp", "ry").alias("weighted_spearman"))


def _by_chunk(long: DataFrame, s: Scoring, order: list[str]) -> DataFrame:
    return long.withColumn("chunk", F.ntile(s.chunks).over(Window.partitionBy(*s.group).orderBy(*order)))


def chunk_metrics(long: DataFrame, s: Scoring) -> DataFrame:
    """Mean correlations over consecutive chunks; null if a chunk has none."""
    inner = (*s.group, "chunk")
    ranked = _by_chunk(long, s, [s.order]).select("*", average_rank("y", inner).alias("ry"), average_rank("y_pred", inner).alias("rp"))
    parts = ranked.groupBy(*inner).agg(_corr("y_pred", "y").alias("pic"), _corr("rp", "ry").alias("sic"))
    whole = lambda c: F.when(F.count(c) == F.count("*"), F.avg(c))
    return parts.groupBy(*s.group).agg(whole("pic").alias("avg_pic"), whole("sic").alias("avg_sic"))


def range_metrics(long: DataFrame, s: Scoring) -> DataFrame:
    """Rows in order of the factor, in equal groups: the best rank correlation, its group, that group's bounds, and
    whether the second best lies opposite. Ties of the factor are ordered by time."""
    inner = (*s.group, "chunk")
    ranked = _by_chunk(long, s, ["y_pred", s.order]).select("*", average_rank("y", inner).alias("ry"), average_rank("y_pred", inner).alias("rp"))
    parts = ranked.groupBy(*inner).agg(_corr("rp", "ry").alias("ic"), F.max("y_pred").alias("up"), F.min("y_pred").alias("dn"))
    best = F.sort_array(F.collect_list(F.when(F.col("ic").isNotNull(), F.struct("ic", (-F.col("chunk")).alias("k"), "up", "dn"))), asc=False)
    top, second = F.get("best", F.lit(0)), F.get("best", F.lit(1))
    both, middle = -top["k"] - 1 - second["k"] - 1, s.chunks // 2
    return (
        parts.groupBy(*s.group)
        .agg(best.alias("best"))
        .select(
            *s.group,
            top["ic"].alias("max_ic_value"),
            (-top["k"]).alias("max_ic_group"),
            both.between(2 * middle - 1, 2 * middle + 1).alias("max_ic_symmetric"),
            top["up"].alias("max_ic_up"),
            top["dn"].alias("max_ic_dn"),
        )
    )


def packed_max_ic(value: Column, group: Column, symmetric: Column, chunks: int = CHUNKS) -> Column:
    """The one number that holds the score, the group, the number of groups and the symmetry in its digits."""
    return F.round(value, 4) + group * 1e-6 + F.when(symmetric, 1e-8).otherwise(0.0) + chunks * 1e-7


def path_metrics(long: DataFrame, s: Scoring) -> DataFrame:
    rows = long.withColumn("r", result()).withColumn("chunk", F.ntile(s.chunks).over(Window.partitionBy(*s.group).orderBy(s.order)))
    rows = rows.withColumn("pnl", F.sum("r").over(s.upto))
    in_chunk = Window.partitionBy(*s.group, "chunk").orderBy(s.order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("drop", F.col("pnl") - F.max("pnl").over(s.upto)).withColumn("chunk_drop", F.col("pnl") - F.max("pnl").over(in_chunk))
    parts = rows.groupBy(*s.group, "chunk").agg(
        F.min("drop").alias("drop"), F.min("chunk_drop").alias("chunk_drop"), F.sum("r").alias("sum"), F.sum(F.col("r") * F.col("r")).alias("square"), F.count("*").alias("n")
    )
    whole = parts.groupBy(*s.group).agg(F.min("drop").alias("max_dd"), F.avg("chunk_drop").alias("avg_mdd"))
    sharp = rows.groupBy(*s.group).agg(F.avg("r").alias("mean"), F.stddev_pop("r").alias("std"))
    mean = F.col("mean")
    return whole.join(sharp, list(s.group)).select(
        *s.group,
        "max_dd",
        "avg_mdd",
        F.when(F.col("max_dd") != 0, mean * s.periods / -F.col("max_dd")).otherwise(F.lit(float("inf"))).alias("calmar"),
        (ratio(mean, F.col("std")) * math.sqrt(s.periods)).alias("sharp"),
    )


def position_metrics(long: DataFrame, s: Scoring, up: float = 0.9, down: float = 0.1, n_std: float = 2.0) -> DataFrame:
    """Sharpe ratios of holding by rolling quantiles and by rolling mean and deviation, over full windows."""
    p = F.col("y_pred")
    quantile = lambda q: (lambda: FrameQuantile(s.window, q), ["y_pred"])
    bounds = _run_recursive(long.select(*s.group, s.order, "y", "w", "y_pred"), s.series, {"low": quantile(down), "high": quantile(up)})
    bounds = bounds.withColumn(ROW, F.row_number().over(s.series.plain))
    bounds = with_long_deviation(bounds, s.series, {"y_pred": "d"}, s.window, {"y_pred": "m"})
    full = F.col(ROW) >= s.window
    side = lambda high, low: F.when(full & (p > high), 1.0).when(full & (p < low), -1.0).otherwise(0.0)
    fixed = side(F.col("high"), F.col("low"))
    wide = side(F.col("m") + n_std * F.col("d"), F.col("m") - n_std * F.col("d"))
    held = bounds.select(*s.group, result(fixed).alias("a"), result(wide).alias("b"))
    sharp = lambda x: ratio(F.avg(x), F.stddev_pop(x)) * math.sqrt(s.periods)
    return held.groupBy(*s.group).agg(sharp("a").alias("sharpe_fixed_threshold"), sharp("b").alias("sharpe_std_threshold"))


def margin_metrics(long: DataFrame, s: Scoring, lam: float = 1.0, extreme: float = 0.95, hard: float = 3.0, soft: float = 0.3, near: float = 0.2) -> DataFrame:
    """Reward for the right direction less penalties on margins; extreme returns weigh more."""
    group = list(s.group)
    weight = F.greatest(F.col("w"), F.lit(0.0))
    total = long.groupBy(*group).agg(F.sum(weight).alias("tw")).join(exact_quantiles(long, {"y": "b"}, [0.01, 0.99], s.group, s.longest), group)
    rows = long.join(total, group).withColumn("w", F.when(F.col("tw") > 0, weight).otherwise(F.lit(1.0)))
    rows = rows.withColumn("yc", F.greatest(F.get("b", F.lit(0)), F.least(F.get("b", F.lit(1)), F.col("y"))))
    limit = exact_quantiles(rows.withColumn("size", F.abs("yc")), {"size": "limit"}, [extreme], s.group, s.longest)
    rows = rows.join(limit.withColumn("limit", F.get("limit", F.lit(0))), group)
    margin, size = F.col("y_pred") * F.col("yc"), F.abs("yc")
    is_extreme = size >= F.col("limit")
    heavy = F.when(is_extreme, 1.0 + size / (F.col("limit") + 1e-12)).otherwise(F.lit(1.0))
    wrong = F.greatest(F.lit(0.0), -margin)
    reward = _average(F.col("y") * F.signum("y_pred"))
    return rows.groupBy(*group).agg(
        (reward - lam * _average(F.when((margin < 0) & is_extreme, heavy).otherwise(F.lit(0.0)))).alias("extreme_wrong_sign_penalty"),
        (reward - lam * _average(heavy * wrong)).alias("weighted_margin_score"),
        (reward - lam * _average(heavy * (hard * wrong + soft * F.greatest(F.lit(0.0), near - margin)))).alias("asym_extreme_direction_score"),
    )


def quantile_bin(x: Column, edges: Column) -> Column:
    """Interior edges below ``x``; all values are in bin 0 if there are fewer than three distinct edges. An edge that
    differs from ``x`` in its last digits alone is equal to it, as interpolation leaves such digits."""
    distinct = F.array_distinct(edges)
    interior = F.slice(distinct, 2, F.greatest(F.size(distinct) - 2, F.lit(0)))
    return F.when(F.size(distinct) <= 2, F.lit(0)).otherwise(F.size(F.filter(interior, lambda e: e < x - F.abs(x) * 1e-12)))


def information_metrics(long: DataFrame, s: Scoring) -> DataFrame:
    """Mutual information of quantile bins, over the root of both entropies and over the return's entropy."""
    group, eps = list(s.group), 1e-12
    grid = [k / s.bins for k in range(s.bins + 1)]
    edges = exact_quantiles(long, {"y_pred": "ep", "y": "ey"}, grid, s.group, s.longest).join(long.groupBy(*group).agg(F.count("*").alias("n")), group)
    binned = long.join(edges, group).select(*group, "n", quantile_bin(F.col("y_pred"), F.col("ep")).alias("bp"), quantile_bin(F.col("y"), F.col("ey")).alias("by"))
    # At most bins x bins rows for each factor and series from here on.
    cells = binned.groupBy(*group, "bp", "by").agg((F.count("*") / F.first("n")).alias("p"), F.first("n").alias("n"))
    of = lambda c: F.sum("p").over(Window.partitionBy(*group, c))
    cells = cells.withColumn("pp", of("bp")).withColumn("py", of("by"))
    # Each marginal is spread over its cells, so entropies are sums over cells too.
    term = lambda m: -F.sum(F.col("p") * F.log(F.col(m) + eps))
    sums = cells.groupBy(*group).agg(
        F.sum(F.col("p") * F.log((F.col("p") + eps) / (F.col("pp") * F.col("py") + eps))).alias("mi"), term("pp").alias("hp"), term("py").alias("hy"), F.first("n").alias("n")
    )
    root = F.sqrt(F.greatest(F.col("hp"), F.lit(0.0)) * F.greatest(F.col("hy"), F.lit(0.0)))
    score = lambda base: F.when((F.col("n") < LEAST_ROWS) | (base <= 1e-12), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio(F.col("mi"), base))))
    return sums.select(*group, score(root).alias("mi_score"), score(F.col("hy")).alias("entropy_gain_score"))


def constrained_metrics(long: DataFrame, s: Scoring) -> DataFrame:
    """Direction and correlation less penalties for unlike distributions, wrong extremes and drawdown; minus infinity
    where nothing is left."""
    group = list(s.group)
    right = F.when((F.col("y_pred") > 0) == (F.col("y") > 0), 1.0).otherwise(0.0)
    wild = F.abs("y") > EXTREME
    base = long.groupBy(*group).agg(
        F.avg(right).alias("hit"),
        F.coalesce(_corr("y_pred", "y"), F.lit(0.0)).alias("corr"),
        (F.max("y_pred") - F.min("y_pred")).alias("reach"),
        F.max(F.abs("y_pred")).alias("top"),
        F.count_if(wild).alias("wild"),
        F.avg(F.when(wild, right)).alias("wild_hit"),
    )
    # Distance of two equally large samples: mean gap of their sorted values.
    inner = [*group, "chunk"]
    chunked = _by_chunk(long, s, [s.order])
    placed = lambda c: chunked.select(*inner, F.col(c).alias(f"v_{c}"), F.row_number().over(Window.partitionBy(*inner).orderBy(c)).alias("r"))
    distance = placed("y").join(placed("y_pred"), [*inner, "r"]).groupBy(*inner).agg(F.avg(F.abs(F.col("v_y") - F.col("v_y_pred"))).alias("d"))
    distance = distance.groupBy(*group).agg(F.avg("d").alias("emd"))
    # Sums of logarithms make the product; a loss of everything or more ends in -inf or null and full penalty.
    grown = long.join(base.select(*group, "top"), group).withColumn("g", 1.0 + F.coalesce(ratio(F.col("y_pred"), F.col("top")), F.lit(0.0)) * F.col("y"))
    grown = grown.withColumn("value", F.exp(F.sum(F.log("g")).over(s.upto)))
    fall = grown.withColumn("peak", F.max("value").over(s.upto)).groupBy(*group).agg(
        F.max(ratio(F.col("peak") - F.col("value"), F.col("peak"))).alias("fall"), F.min("g").alias("least")
    )
    emd = F.when(F.col("reach") > 1e-8, F.col("emd") / F.col("reach")).otherwise(F.lit(1.0))
    tail = F.when(F.col("wild") < 5, F.lit(0.0)).otherwise((1 - F.col("wild_hit")) * (1 - F.col("wild_hit")))
    worst = F.when((F.col("least") <= 0) | (F.col("top") == 0), F.lit(1.0)).otherwise(F.least(F.col("fall"), F.lit(1.0)))
    score = F.col("hit") * (1 + F.abs("corr")) / 2 - (0.25 * emd + 0.25 * tail + 0.2 * worst)
    whole = base.join(distance, group).join(fall, group)
    return whole.select(*group, F.when(score > 0, score).otherwise(F.lit(float("-inf"))).alias("risk_constrained_chunk"))


@dataclass(frozen=True)
class Metric:
    """``group`` computes it along with others; ``greater_is_better``: which end a selection prefers; ``raw``: wants the
    plain return, not the normalised label; ``objective``: may steer an evolution."""

    name: str
    group: Callable[[DataFrame, Scoring], DataFrame]
    greater_is_better: bool = True
    raw: bool = False
    objective: bool = False

    @property
    def sign(self) -> int:
        return 1 if self.greater_is_better else -1


METRICS: dict[str, Metric] = {
    m.name: m
    for m in (
        Metric("weighted_pearson", fit_metrics, objective=True),
        Metric("weighted_spearman", rank_metrics, objective=True),
        Metric("mean_absolute_error", fit_metrics, greater_is_better=False, objective=True),
        Metric("mean_square_error", fit_metrics, greater_is_better=False, objective=True),
        Metric("root_mean_square_error", fit_metrics, greater_is_better=False, objective=True),
        Metric("log_loss", fit_metrics, greater_is_better=False, objective=True),
        Metric("avg_pic", chunk_metrics, objective=True),
        Metric("avg_sic", chunk_metrics, objective=True),
        Metric("max_ic_value", range_metrics, objective=True),
        Metric("risk_constrained_chunk", constrained_metrics, objective=True),
        # Drawdowns are 0 or less, so the greater one is the better.
        Metric("max_dd", path_metrics, raw=True, objective=True),
        Metric("avg_mdd", path_metrics, raw=True, objective=True),
        Metric("calmar", path_metrics, raw=True, objective=True),
        Metric("sharp", path_metrics, raw=True, objective=True),
        Metric("sharpe_fixed_threshold", position_metrics, raw=True, objective=True),
        Metric("sharpe_std_threshold", position_metrics, raw=True, objective=True),
        Metric("extreme_wrong_sign_penalty", margin_metrics, raw=True),
        Metric("weighted_margin_score", margin_metrics, raw=True),
        Metric("asym_extreme_direction_score", margin_metrics, raw=True),
        Metric("mi_score", information_metrics),
        Metric("entropy_gain_score", information_metrics),
    )
}


def register_metric(name: str, aggregate: Callable[[Column, Column, Column], Column], greater_is_better: bool = True) -> Metric:
    """Adds a user's metric: ``aggregate`` gets the columns y, y_pred and w and returns an aggregate, which may be a
    grouped pandas UDF."""
    if not name.isidentifier():
        raise ValueError(f"{name!r} is no name for a metric")
    if not isinstance(greater_is_better, bool):
        raise ValueError("greater_is_better must be True or False")
    column = aggregate(F.col("y"), F.col("y_pred"), F.col("w"))
    if not isinstance(column, Column):
        raise ValueError("a metric must return a Column")

    def group(long: DataFrame, s: Scoring) -> DataFrame:
        return long.groupBy(*s.group).agg(aggregate(F.col("y"), F.col("y_pred"), F.col("w")).cast("double").alias(name))

    METRICS[name] = Metric(name, group, greater_is_better, objective=True)
    return METRICS[name]


def evaluate(df: DataFrame, factors: list[str], metrics: list[str], y: str, raw_y: str | None = None, scoring: Scoring = Scoring(), w: str | None = None) -> DataFrame:
    """(factor, keys, metrics): each group of metrics is computed once, on the label or the plain return as it wants."""
    unknown = [m for m in metrics if m not in METRICS]
    if unknown:
        raise ValueError(f"no metrics named {unknown}")
    out = None
    groups = list(dict.fromkeys((METRICS[m].group, METRICS[m].raw and raw_y is not None) for m in metrics))
    longs = {raw: long_form(df, factors, raw_y if raw else y, scoring, w) for raw in {r for _, r in groups}}
    for group, raw in groups:
        names = [m for m in metrics if METRICS[m].group is group]
        part = group(longs[raw], scoring).select(*scoring.group, *names)
        out = part if out is None else out.join(part, list(scoring.group), "full")
    return out.select(*scoring.group, *metrics)


def given_range_ic(long: DataFrame, bounds: DataFrame, s: Scoring, method: str = "spearman") -> DataFrame:
    """Correlation over the rows whose factor lies in [dn, up] of ``bounds`` (factor, keys, up, dn); null for 20 or fewer."""
    inside = long.join(bounds, list(s.group)).where((F.col("y_pred") >= F.col("dn")) & (F.col("y_pred") <= F.col("up")))
    if method == "spearman":
        inside = inside.select(*s.group, average_rank("y", s.group).alias("y"), average_rank("y_pred", s.group).alias("y_pred"))
    elif method != "pearson":
        raise ValueError(f"no method {method!r}")
    return inside.groupBy(*s.group).agg(F.when(F.count("*") > LEAST_ROWS, _corr("y_pred", "y")).alias("given_ic"), F.count("*").alias("rows"))


def paths(long: DataFrame, s: Scoring) -> DataFrame:
    """Row by row: result, running sum, and the rolling Sharpe ratio of a full window (0 before)."""
    rows = long.withColumn("rts", result()).withColumn(ROW, F.row_number().over(s.series.plain))
    rows = with_long_deviation(rows, s.series, {"rts": "__d"}, s.window, {"rts": "__m"})
    sharp = ratio(F.col("__m"), F.col("__d")) * math.sqrt(s.periods)
    return rows.select(
        *s.group, s.order, "rts", F.sum("rts").over(s.upto).alias("pnl"),
        F.when(F.col(ROW) >= s.window, F.coalesce(sharp, F.lit(0.0))).otherwise(F.lit(0.0)).alias("rolling_sharp"),
    )
