"""Bars of coarser periods: tumbling, shifted, and all shifts at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUMS = ("vol", "vol_ccy", "trades")
LAST = ("oi", "oi_ccy", "toptrader_count_lsr", "toptrader_oi_lsr", "count_lsr", "taker_vol_lsr")
DAY = 86_400


def bucket_start(ts: str | Column, seconds: int, offset: int = 0) -> Column:
    """Start of the left-closed bucket of ``seconds``, shifted by ``offset`` seconds."""
    at = F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)
    return F.timestamp_seconds(F.floor((at - offset * 1_000_000) / (seconds * 1_000_000)) * seconds + offset)


def _bar_aggregates(columns: list[str]) -> list[Column]:
    prices = [F.min_by("o", "ts").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "ts").alias("c")]
    return (
        prices
        + [F.sum(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in SUMS if c in columns]
        + [F.max_by(c, "ts").alias(c) for c in LAST if c in columns]
    )


def resample(
    bars: DataFrame, seconds: int, offset: int = 0, fill_gaps: bool = False, drop_zero_volume: bool | None = None
) -> DataFrame:
    """Bars of ``seconds``: first open, highest, lowest, last close, summed volumes, last of the rest.

    ``fill_gaps`` adds the buckets without bars and carries all columns forward into them. ``drop_zero_volume`` leaves
    out bars without volume, by default for periods over five minutes when gaps are filled.
    """
    out = bars.groupBy("symbol", bucket_start("ts", seconds, offset).alias("bar")).agg(*_bar_aggregates(bars.columns))
    out = out.withColumnRenamed("bar", "ts")
    if fill_gaps:
        step = F.expr(f"interval {seconds} seconds")
        # One row for each symbol, exploded into its own buckets.
        grid = out.groupBy("symbol").agg(F.explode(F.sequence(F.min("ts"), F.max("ts"), step)).alias("ts"))
        upto = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
        values = [c for c in out.columns if c not in ("symbol", "ts")]
        joined = grid.join(out, ["symbol", "ts"], "left")
        empty = F.col("c").isNull()
        zero = {c: F.when(empty, F.lit(0.0)).otherwise(F.col(c)) for c in SUMS if c in values}
        out = joined.select("symbol", "ts", *[zero[c].alias(c) if c in zero else F.last(c, ignorenulls=True).over(upto).alias(c) for c in values])
    if drop_zero_volume if drop_zero_volume is not None else fill_gaps and seconds > 300:
        out = without_volume_gaps(out)
    return out


def without_volume_gaps(bars: DataFrame) -> DataFrame:
    """Bars that traded."""
    return bars.where("vol != 0")


def volume_report(bars: DataFrame) -> DataFrame:
    """(symbol, bars, without_volume, least_volume): what the filter above would drop."""
    return bars.groupBy("symbol").agg(
        F.count("*").alias("bars"), F.count_if(F.col("vol") == 0).alias("without_volume"), F.min("vol").alias("least_volume")
    )


def offset_buckets(bars: DataFrame, coarse: int, step: int) -> DataFrame:
    """Buckets of ``coarse`` seconds at every shift by ``step`` seconds, in one pass.

    (symbol, feature_offset in minutes, ts, o, h, l, c, volumes): each shift is a series of its own. Buckets that begin
    before the first bar are left out.
    """
    if coarse <= 0 or step <= 0 or coarse % step:
        raise ValueError("the coarse period must be a positive multiple of the step")
    slid = bars.withColumn("w", F.window("ts", f"{coarse} seconds", f"{step} seconds"))
    out = slid.groupBy("symbol", F.col("w.start").alias("bar")).agg(*_bar_aggregates(bars.columns)).withColumnRenamed("bar", "ts")
    first = bars.groupBy("symbol").agg(F.min("ts").alias("first_ts"))
    return (
        out.join(first, "symbol")
        .where("ts >= first_ts")
        .drop("first_ts")
        .withColumn("feature_offset", (F.unix_timestamp("ts") % coarse) / 60.0)
        .dropna(subset=["o", "h", "l", "c"])
    )


def chunk_id(order: Column | list[Column | str], parts: int, keys: tuple[str, ...] = ("symbol",)) -> Column:
    """Equal consecutive chunks 1 to ``parts``; the first ones are a row longer if the rows don't divide."""
    order = order if isinstance(order, list) else [order]
    return F.ntile(parts).over(Window.partitionBy(*keys).orderBy(*order))


def average_rank(x: str, keys: tuple[str, ...]) -> Column:
    """Rank from 1 with ties sharing their mean rank."""
    by_value = Window.partitionBy(*keys).orderBy(x)
    return F.rank().over(by_value) + (F.count("*").over(Window.partitionBy(*keys, x)) - 1) / 2.0


def percent_rank(x: str, keys: tuple[str, ...] = ()) -> Column:
    """Average rank over the number of values; null stays null."""
    filled = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    by_value = (Window.partitionBy(*keys, F.col(x).isNull()) if keys else Window.partitionBy(F.col(x).isNull())).orderBy(x)
    ties = Window.partitionBy(*keys, x) if keys else Window.partitionBy(x)
    value = (F.rank().over(by_value) + (F.count("*").over(ties) - 1) / 2.0) / F.count(x).over(filled)
    return F.when(F.col(x).isNotNull(), value)


def annual_bars(seconds: int) -> int:
    """Bars in a year of 365 days that trades round the clock."""
    return 365 * (DAY // seconds)
