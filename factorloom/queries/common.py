"""What queries and their SQL share: six-hour bars of events, rounding, and SQL idioms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import daily_bars, event_bars, load

SIX_HOURS = 21_600


def bars(spark: SparkSession, sf_dir: str, seconds: int = SIX_HOURS) -> DataFrame:
    return event_bars(load(spark, sf_dir, "events"), seconds)


def most_bars(spark: SparkSession, sf_dir: str, seconds: int = SIX_HOURS) -> int:
    """A bound on the bars of a symbol: the spans between the first and the last event. Two numbers of one column are read."""
    span = load(spark, sf_dir, "events").agg((F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("s")).first()["s"]
    return (span or 0) // seconds + 2


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_bars(load(spark, sf_dir, "lineitem"))


def rounded(x: str | Column, digits: int = 6) -> Column:
    """Rounded, without negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def epoch(ts: str = "ts") -> Column:
    return F.unix_timestamp(ts)


def presented(df: DataFrame, numbers: list[str], others: list[str] = (), digits: int = 6) -> DataFrame:
    """(symbol, bar, ...): times as seconds, numbers rounded."""
    return df.select("symbol", epoch("ts").alias("bar"), *others, *[rounded(c, digits).alias(c) for c in numbers])


def bars_cte(seconds: int = SIX_HOURS, name: str = "bars") -> str:
    return (
        f"{name} AS (SELECT event_type AS symbol, epoch_us(ts) // {seconds * 1_000_000} * {seconds} AS bar, arg_min(value, ts) AS o, max(value) AS h, "
        f"min(value) AS l, arg_max(value, ts) AS c, CAST(count(*) AS DOUBLE) AS vol, sum(value) AS vol_ccy, CAST(count(*) AS DOUBLE) AS trades FROM events GROUP BY 1, 2)"
    )


def base_cte(seconds: int = SIX_HOURS) -> str:
    return f"{bars_cte(seconds)}, base AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar) AS rn FROM bars)"


BASE = base_cte()
DAYS = (
    "days AS (SELECT 'all' AS symbol, CAST(epoch(date_trunc('day', l_shipdate)) AS BIGINT) AS bar, max(l_extendedprice / l_quantity) AS h, "
    "min(l_extendedprice / l_quantity) AS l, avg(l_extendedprice / l_quantity) AS c, sum(l_quantity) AS vol FROM lineitem GROUP BY 2)"
)


def frame(t: int, end: str = "CURRENT ROW", keys: str = "symbol", order: str = "bar") -> str:
    return f"(PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN {t} PRECEDING AND {end})"


def over(aggregate: str, t: int, keys: str = "symbol", order: str = "bar") -> str:
    """An aggregate of the last ``t`` rows."""
    return f"{aggregate} OVER {frame(t - 1, keys=keys, order=order)}"


def running(aggregate: str, keys: str = "symbol", order: str = "bar") -> str:
    return f"{aggregate} OVER (PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def lagged(x: str, n: int = 1, keys: str = "symbol", order: str = "bar") -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY {keys} ORDER BY {order})"


def tidy(x: str) -> str:
    return f"CASE WHEN ({x}) IS NULL OR isnan({x}) OR isinf({x}) THEN 0.0 ELSE ({x}) + 0.0 END"


def sql_round(x: str, digits: int = 6) -> str:
    """Rounded as a double; DuckDB's decimal literals would make some results decimals."""
    return f"round(CAST({x} AS DOUBLE), {digits}) + 0.0"
