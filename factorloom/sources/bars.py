"""Exchange bar files: names by period, reading, cleaning, and a Parquet copy of zipped CSV files."""

from __future__ import annotations

import datetime as dt
import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Frequency(Enum):
    MONTHLY = "monthly"
    DAILY = "daily"


# The columns of a raw file, in its order, and their names here.
RAW_COLUMNS = (
    "open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "count",
    "taker_buy_volume", "taker_buy_quote_volume", "ignore",
)
RENAMED = {"open": "o", "high": "h", "low": "l", "close": "c", "volume": "vol", "quote_volume": "vol_ccy", "count": "trades"}
LEGACY_COLUMNS = (
    "ts", "o", "h", "l", "c", "vol", "vol_ccy", "trades", "oi", "oi_ccy",
    "toptrader_count_lsr", "toptrader_oi_lsr", "count_lsr", "taker_vol_lsr",
)
RAW_SCHEMA = T.StructType([T.StructField(c, T.LongType() if c in ("open_time", "close_time", "count") else T.DoubleType()) for c in RAW_COLUMNS])
LEGACY_SCHEMA = T.StructType([T.StructField(c, T.TimestampType() if c == "ts" else T.DoubleType()) for c in LEGACY_COLUMNS])
STANDARD = ("o", "h", "l", "c", "vol", "vol_ccy", "trades", "close_time", "taker_buy_volume", "taker_buy_quote_volume")


def periods(start: str, end: str, frequency: Frequency = Frequency.MONTHLY) -> list[str]:
    """Months (YYYY-MM) or days (YYYY-MM-DD) from start to end, both included; days are cut to months where asked for months."""
    if frequency is Frequency.MONTHLY:
        (y, m), (y1, m1) = ([int(x) for x in s[:7].split("-")] for s in (start, end))
        count = (y1 - y) * 12 + m1 - m
        return [f"{y + (m - 1 + k) // 12:04d}-{(m - 1 + k) % 12 + 1:02d}" for k in range(count + 1)]
    first, last = (dt.date.fromisoformat(s if len(s) > 7 else f"{s}-01") for s in (start, end))
    return [str(first + dt.timedelta(days=k)) for k in range((last - first).days + 1)]


@dataclass(frozen=True)
class BarStore:
    """Files at ``{folder}/{year}/{symbol}-{timeframe}-{period}.{suffix}``."""

    folder: str
    symbol: str
    timeframe: str

    def path(self, period: str, suffix: str = "parquet") -> str:
        return f"{self.folder.rstrip('/')}/{period[:4]}/{self.symbol}-{self.timeframe}-{period}.{suffix}"


def _existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those paths that Hadoop's file systems find, so that any store works."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            out.append(p)
    return out


def read_bars(spark: SparkSession, store: BarStore, start: str, end: str, frequency: Frequency = Frequency.MONTHLY, suffix: str = "parquet") -> DataFrame:
    """Standard bars of the periods whose files exist; missing ones are skipped, none at all is an error."""
    wanted = [store.path(p, suffix) for p in periods(start, end, frequency)]
    found = _existing(spark, wanted)
    if not found:
        raise FileNotFoundError(f"none of {wanted[0]} to {wanted[-1]}")
    if suffix == "parquet":
        raw = spark.read.parquet(*found)
    elif suffix == "csv":
        raw = spark.read.schema(RAW_SCHEMA).option("header", True).csv(found)
    elif suffix == "zip":
        raw = unzipped(spark, found)
    else:
        raise ValueError(f"no reader for {suffix!r}")
    return standard_bars(raw, store.symbol)


def unzipped(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Raw rows of zipped CSV files, with or without a header; one task for each file, which is a month at most."""

    def rows(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    table = pd.read_csv(z.open(z.namelist()[0]), header=None, names=list(RAW_COLUMNS), dtype=str)
                table = table[table["open_time"] != "open_time"].apply(pd.to_numeric, errors="coerce")
                yield table.astype({f.name: "int64" if f.dataType == T.LongType() else "float64" for f in RAW_SCHEMA})

    return spark.read.format("binaryFile").load(paths).select("content").mapInPandas(rows, RAW_SCHEMA)


def ingest(spark: SparkSession, store: BarStore, start: str, end: str, target: str, frequency: Frequency = Frequency.MONTHLY) -> None:
    """Writes zipped files as Parquet, partitioned by symbol, year and month, so that later reads prune both."""
    bars = read_bars(spark, store, start, end, frequency, "zip")
    dated = bars.withColumns({"year": F.year("ts"), "month": F.month("ts")})
    dated.repartition("symbol", "year", "month").sortWithinPartitions("ts").write.mode("append").partitionBy("symbol", "year", "month").parquet(target)


def standard_bars(raw: DataFrame, symbol: str | None = None) -> DataFrame:
    """(symbol, ts, o, h, l, c, vol, vol_ccy, trades, close_time, taker volumes): names and types of raw bars made
    standard; ``open_time`` in milliseconds becomes ``ts``; columns that are absent are 0."""
    now = raw.withColumnsRenamed({k: v for k, v in RENAMED.items() if k in raw.columns})
    if "ts" not in now.columns:
        when = F.col("open_time")
        now = now.withColumn("ts", when if isinstance(now.schema["open_time"].dataType, T.TimestampType) else F.timestamp_millis(when))
    have = lambda c: F.col(c).cast("double") if c in now.columns else F.lit(0.0)
    name = F.col("symbol") if symbol is None and "symbol" in now.columns else F.lit(symbol or "")
    return now.select(name.alias("symbol"), "ts", *[have(c).alias(c) for c in STANDARD])


def legacy_bars(spark: SparkSession, path: str, symbol: str = "") -> DataFrame:
    """One-minute bars with open interest and ratios, from a CSV file with a header."""
    return spark.read.schema(LEGACY_SCHEMA).option("header", True).csv(path).select(F.lit(symbol).alias("symbol"), "*")


def between(bars: DataFrame, start: str, end: str) -> DataFrame:
    """Bars in a closed range of times, a filter that reaches the scan."""
    return bars.where(F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def snapshot(bars: DataFrame, ratios: dict[str, float], shift_hours: int = 4) -> DataFrame:
    """A polled set of recent bars: each row once, a shifted time, and the ratios as constant columns."""
    now = bars.dropDuplicates().withColumn("shifted", F.col("ts") + F.make_dt_interval(hours=F.lit(shift_hours)))
    return now.withColumns({k: F.lit(float(v)) for k, v in ratios.items()})


def write_table(df: DataFrame, path: str, form: str = "parquet", mode: str = "overwrite") -> None:
    """Factor tables and sweeps: Parquet, or gzipped CSV with a header."""
    if form == "csv.gz":
        df.write.mode(mode).option("compression", "gzip").option("header", True).csv(path)
    elif form == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"no writer for {form!r}")


def read_table(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    return spark.read.parquet(path) if form == "parquet" else spark.read.option("header", True).option("inferSchema", True).csv(path)


def interval(ts: str | Column, seconds: int) -> Column:
    return (F.col(ts) if isinstance(ts, str) else ts) + F.make_dt_interval(secs=F.lit(seconds))
