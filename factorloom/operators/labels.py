"""Forward-return labels, training samples at every shift of a coarse bar, and their split by time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import Series, ratio
from .features import base_features
from .normalise import gauss_rank, label_zscore, return_norm, rolling_scale
from .ordered import exact_quantiles
from .resample import offset_buckets


@dataclass(frozen=True)
class SampleConfig:
    """Periods in seconds; ``horizon_steps`` steps ahead is where the label's price is taken."""

    coarse: int
    step: int
    horizon_steps: int
    window: int
    kind: str = "zscore"
    #: Take prices one bar before the decision, that is only bars that have closed by then.
    closed_prices: bool = False


def forward_return(price: str, n: int, series: Series = Series()) -> Column:
    """Log return over the next ``n`` bars; null at the end."""
    return F.log(F.lead(price, n).over(series.plain)) - F.log(F.col(price))


def scaled_forward_return(df: DataFrame, price: str, n: int, out: str, series: Series = Series()) -> DataFrame:
    """The forward return and, as ``out``, that return over its ``n``-bar population deviation."""
    now = df.withColumn("ret", forward_return(price, n, series)).dropna(subset=["ret"])
    return now.withColumn(out, rolling_scale(F.col("ret"), n, series))


def samples(bars: DataFrame, config: SampleConfig) -> DataFrame:
    """One row for each coarse bucket at each shift: base features, times, prices, returns and the label.

    A decision is taken when a bucket ends. Prices come from the fine bar that opens at the decision (that is its close,
    known one step later) or, with ``closed_prices``, from the bar before. Each shift has its own feature series; the
    label's series runs over all shifts in time order.
    """
    coarse = offset_buckets(bars, config.coarse, config.step)
    feature_window = max(1, -(-config.window // max(1, config.coarse // config.step)))
    rows = base_features(coarse, series=Series(("symbol", "feature_offset")), window=feature_window)
    back = config.step if config.closed_prices else 0
    seconds = lambda n: F.make_dt_interval(secs=F.lit(n))
    horizon = config.step * config.horizon_steps
    rows = (
        rows.withColumn("decision_timestamps", F.col("ts") + seconds(config.coarse))
        .withColumn("current_data_timestamps", F.col("decision_timestamps") - seconds(back))
        .withColumn("prediction_timestamps", F.col("decision_timestamps") + seconds(horizon))
        .withColumn("prediction_data_timestamps", F.col("prediction_timestamps") - seconds(back))
    )
    now = bars.select("symbol", F.col("ts").alias("current_data_timestamps"), F.col("c").alias("t_price"), F.col("o").alias("o_price"))
    later = bars.select("symbol", F.col("ts").alias("prediction_data_timestamps"), F.col("c").alias("t_future_price"))
    priced = (
        rows.join(now, ["symbol", "current_data_timestamps"])
        .join(later, ["symbol", "prediction_data_timestamps"])
        .withColumn("return_p", ratio(F.col("t_future_price"), F.col("t_price")))
        .withColumn("return_f", F.log("return_p"))
        .where("return_f is not null and not isnan(return_f)")
    )
    return labelled(priced, config.kind, config.window)


def labelled(rows: DataFrame, kind: str, window: int, series: Series = Series()) -> DataFrame:
    """``ret_rolling_zscore`` by the kind of label; rows without one go."""
    if kind == "zscore":
        return rows.withColumn("ret_rolling_zscore", label_zscore(F.col("return_f"), window, series)).dropna(subset=["ret_rolling_zscore"])
    if kind == "gauss_rank":
        return gauss_rank(rows, "return_f", "ret_rolling_zscore", window, series=series)
    if kind == "log_norm":
        return return_norm(rows.withColumn("__r", F.col("return_p") - 1.0), "__r", "ret_rolling_zscore", window, series).drop("__r")
    if kind == "raw":
        return rows.withColumn("ret_rolling_zscore", F.col("return_f"))
    raise ValueError(f"no label kind {kind!r}")


def with_split(rows: DataFrame, train: tuple[str, str], test: tuple[str, str], horizon_seconds: int, at: str = "ts") -> DataFrame:
    """Column ``split``: "train" up to the horizon before the training end, "test" in the closed test range, else null.

    The rows between are in neither, so nothing is split by position.
    """
    start, end = (F.lit(x).cast("timestamp") for x in train)
    first, last = (F.lit(x).cast("timestamp") for x in test)
    in_train = F.col(at).between(start, end - F.make_dt_interval(secs=F.lit(horizon_seconds)))
    return rows.withColumn("split", F.when(in_train, "train").when(F.col(at).between(first, last), "test"))


FEATURE_EXCLUDES = (
    "symbol", "ts", "feature_offset", "decision_timestamps", "current_data_timestamps", "prediction_timestamps",
    "prediction_data_timestamps", "t_price", "t_future_price", "o_price", "return_f", "return_p", "ret_rolling_zscore", "split",
)


def feature_columns(rows: DataFrame, excludes: tuple[str, ...] = FEATURE_EXCLUDES) -> list[str]:
    return [c for c in rows.columns if c not in excludes]


def label_shapes(rows: DataFrame, column: str, windows: tuple[int, ...], series: Series = Series(), longest: int | None = None) -> DataFrame:
    """(keys, form, n, mean, std, skew, kurtosis) of a label as it is, as log1p, winsorised at 5 % and z-scored."""
    keys = list(series.keys)
    bounds = exact_quantiles(rows, {column: "__b"}, [0.05, 0.95], series.keys, longest)
    now = rows.join(bounds, keys)
    x = F.col(column)
    forms = {"raw": x, "log1p": F.signum(x) * F.log1p(F.abs(x)), "winsorised": F.greatest(F.get("__b", F.lit(0)), F.least(F.get("__b", F.lit(1)), x))}
    forms |= {f"zscore_{w}": label_zscore(x, w, series) for w in windows}
    wide = now.select(*keys, *[v.alias(k) for k, v in forms.items()])
    long = wide.unpivot(keys, list(forms), "form", "v").where("v is not null and not isnan(v)")
    return long.groupBy(*keys, "form").agg(
        F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.skewness("v").alias("skew"), F.kurtosis("v").alias("kurtosis")
    )
