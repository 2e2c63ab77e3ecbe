"""Bars made of tables that hold no prices: events, order lines and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = 3600


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def event_bars(events: DataFrame, seconds: int = 6 * HOUR) -> DataFrame:
    """(symbol, ts, o, h, l, c, vol, vol_ccy, trades) from events, one symbol for each event type.

    ``ts`` is the bar's start. Buckets are aggregated on the map side first; a type with most of the events costs no more
    than its bars.
    """
    start = F.timestamp_seconds(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (seconds * 1_000_000)) * seconds)
    return (
        events.select(F.col("event_type").alias("symbol"), start.alias("bar"), F.col("ts").alias("at"), "value")
        .groupBy("symbol", "bar")
        .agg(
            F.min_by("value", "at").alias("o"),
            F.max("value").alias("h"),
            F.min("value").alias("l"),
            F.max_by("value", "at").alias("c"),
            F.count("*").cast("double").alias("vol"),
            F.sum("value").alias("vol_ccy"),
            F.count("*").cast("double").alias("trades"),
        )
        .withColumnRenamed("bar", "ts")
    )


def daily_bars(lineitem: DataFrame) -> DataFrame:
    """(symbol, ts, h, l, c, vol): unit prices of each day; aggregates that depend on no order."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return lineitem.groupBy(F.date_trunc("day", F.col("l_shipdate")).alias("ts")).agg(
        F.lit("all").alias("symbol"), F.max(price).alias("h"), F.min(price).alias("l"), F.avg(price).alias("c"), F.sum("l_quantity").alias("vol")
    )


def daily_orders(orders: DataFrame) -> DataFrame:
    """(symbol, ts, total, mean, n) of the orders of each day."""
    return orders.groupBy(F.date_trunc("day", F.col("o_orderdate")).alias("ts")).agg(
        F.lit("all").alias("symbol"), F.sum("o_totalprice").alias("total"), F.avg("o_totalprice").alias("mean"), F.count("*").cast("double").alias("n")
    )
