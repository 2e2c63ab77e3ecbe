"""Bars from a stream of ticks: event-time windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, seconds: int, slide_seconds: int | None = None, late_seconds: int = 60) -> DataFrame:
    """(symbol, ts, o, h, l, c, vol, vol_ccy, trades) from ticks (symbol, ts, value), tumbling or sliding.

    In append mode a bar is sent once, when the watermark has passed its end; later ticks are dropped. Batch frames
    give the same bars.
    """
    size = f"{seconds} seconds"
    window = F.window("ts", size, f"{slide_seconds} seconds") if slide_seconds else F.window("ts", size)
    timed = ticks.withWatermark("ts", f"{late_seconds} seconds") if ticks.isStreaming else ticks
    return (
        timed.groupBy("symbol", window.alias("w"))
        .agg(
            F.min_by("value", "ts").alias("o"), F.max("value").alias("h"), F.min("value").alias("l"), F.max_by("value", "ts").alias("c"),
            F.count("*").cast("double").alias("vol"), F.sum("value").alias("vol_ccy"), F.count("*").cast("double").alias("trades"),
        )
        .select("symbol", F.col("w.start").alias("ts"), "o", "h", "l", "c", "vol", "vol_ccy", "trades")
    )
