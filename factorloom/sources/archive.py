"""Bar archives and polled snapshots as data sources of Spark.

``bar_archive`` reads files ``{folder}/{year}/{symbol}-{timeframe}-{period}.{feather|zip}``. Filters on ``symbol`` and
``ts`` reach it and choose among files by name, and every file left is a partition, read in Arrow batches; the filters are
applied to the rows by Spark once more. Feather goes before zip where both have a period.

``bar_snapshots`` is a stream of snapshots, folders ``{folder}/poll={n}`` of Parquet files, in the order of their
numbers. The offset of the stream is the number of the last snapshot, so what a checkpoint holds doesn't grow with the
snapshots. ``stream_polled`` makes bars of the overlapping snapshots, each once.

Folders are paths or URLs that Arrow's file systems read; driver and executors must both reach them. Archive files that
appear after planning are not seen; a snapshot must be complete when its folder gets its name, and one that appears under a
number below the last offset is not read. A missing or empty folder has no rows. A null in a number is null.
"""

from __future__ import annotations

import datetime as dt
import re
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)
from pyspark.sql.pandas.types import to_arrow_schema

from .bars import RAW_COLUMNS, RAW_SCHEMA, RENAMED, STANDARD

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
BARS = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampType()), *[T.StructField(c, T.DoubleType()) for c in STANDARD]])
#: Bytes of a CSV file parsed at once.
BLOCK = 1 << 20
MONTHS, DAYS = 7, 10
FILE = re.compile(r"(?P<symbol>[^/]+)-(?P<timeframe>[^-/]+)-(?P<period>\d{4}-\d{2}(-\d{2})?)\.(?P<form>feather|zip)$")


def opened(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pyarrow.fs.LocalFileSystem(), folder)


@dataclass
class BarFile(InputPartition):
    """One period of one symbol."""

    path: str
    symbol: str
    form: str
    first: dt.datetime
    end: dt.datetime


def listed(folder: str, timeframe: str) -> list[BarFile]:
    """The files of an archive, one for each symbol and period."""
    system, root = opened(folder)
    found = {}
    for info in system.get_file_info(pyarrow.fs.FileSelector(root, recursive=True, allow_not_found=True)):
        name = FILE.match(info.base_name)
        if info.type != pyarrow.fs.FileType.File or not name or name["timeframe"] != timeframe:
            continue
        period = name["period"]
        first = dt.datetime.fromisoformat(period if len(period) == DAYS else f"{period}-01").replace(tzinfo=dt.timezone.utc)
        end = first + dt.timedelta(days=1) if len(period) == DAYS else (first + dt.timedelta(days=32)).replace(day=1)
        key = (name["symbol"], period)
        if key not in found or name["form"] == "feather":
            found[key] = BarFile(info.path, name["symbol"], name["form"], first, end)
    return [found[k] for k in sorted(found)]


def may_hold(file: BarFile, rule: Filter) -> bool:
    """Whether rows of ``file`` can meet the filter; of a filter it doesn't know it says yes."""
    column = getattr(rule, "attribute", None)
    if column == ("symbol",) and isinstance(rule, (EqualTo, In)):
        return file.symbol == rule.value if isinstance(rule, EqualTo) else file.symbol in rule.value
    if column == ("ts",):
        if isinstance(rule, In):
            return any(file.first <= _utc(v) < file.end for v in rule.value)
        at = _utc(rule.value) if isinstance(rule, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) else None
        match rule:
            case EqualTo():
                return file.first <= at < file.end
            case GreaterThan() | GreaterThanOrEqual():
                return at < file.end
            case LessThan():
                return file.first < at
            case LessThanOrEqual():
                return file.first <= at
    return True


def _utc(value: dt.datetime) -> dt.datetime:
    return value.astimezone(dt.timezone.utc) if value.tzinfo else value.replace(tzinfo=dt.timezone.utc)


def _standard(batch: pa.RecordBatch, symbol: str) -> pa.RecordBatch:
    """Columns of a raw file under their standard names; those it lacks are 0."""
    have = {RENAMED.get(n, n): c for n, c in zip(batch.schema.names, batch.columns)}
    when = have["ts"] if "ts" in have else have["open_time"]
    if pa.types.is_integer(when.type):
        when = pc.multiply(when.cast(pa.int64()), 1000)
    when = when.cast(pa.timestamp("us")) if pa.types.is_integer(when.type) else when.cast(pa.timestamp("us", getattr(when.type, "tz", None)), safe=False)
    numbers = [have[c].cast(pa.float64()) if c in have else pa.array([0.0] * len(batch)) for c in STANDARD]
    when = when.cast(pa.timestamp("us", "UTC"))
    names = pa.array([symbol] * len(batch), pa.string())
    fields = [pa.field("symbol", pa.string()), pa.field("ts", pa.timestamp("us", "UTC")), *[pa.field(c, pa.float64()) for c in STANDARD]]
    return pa.RecordBatch.from_arrays([names, when, *numbers], schema=pa.schema(fields))


def _zipped(source) -> Iterator[pa.RecordBatch]:
    """Batches of the CSV file in an archive, which may have a header."""
    types = {f.name: pa.int64() if f.dataType == T.LongType() else pa.float64() for f in RAW_SCHEMA}
    with zipfile.ZipFile(source) as z:
        name = z.namelist()[0]
        with z.open(name) as lines:
            first = lines.readline().strip()
        if not first:
            return
        read = pyarrow.csv.ReadOptions(column_names=list(RAW_COLUMNS), skip_rows=int(first.startswith(b"open_time")), block_size=BLOCK)
        with z.open(name) as lines:
            yield from pyarrow.csv.open_csv(lines, read_options=read, convert_options=pyarrow.csv.ConvertOptions(column_types=types))


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str, timeframe: str):
        self.folder, self.timeframe, self.rules = folder, timeframe, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters choose files; Spark applies all of them to the rows as well."""
        self.rules = filters
        return filters

    def partitions(self) -> Sequence[BarFile]:
        return [f for f in listed(self.folder, self.timeframe) if all(may_hold(f, r) for r in self.rules)]

    def read(self, partition: BarFile) -> Iterator[pa.RecordBatch]:
        # Spark asks for one partition, None, where there is no file.
        if partition is None:
            return
        system, _ = opened(self.folder)
        with system.open_input_file(partition.path) as source:
            if partition.form == "zip":
                batches = _zipped(source)
            else:
                file = pa.ipc.open_file(source)
                batches = (file.get_batch(k) for k in range(file.num_record_batches))
            for batch in batches:
                yield _standard(batch, partition.symbol)


class BarArchive(DataSource):
    """Options: ``path``, ``timeframe``."""

    @classmethod
    def name(cls) -> str:
        return "bar_archive"

    def schema(self) -> T.StructType:
        return BARS

    def reader(self, schema: T.StructType) -> ArchiveReader:
        return ArchiveReader(self.options["path"], self.options["timeframe"])


def read_archive(spark: SparkSession, folder: str, timeframe: str) -> DataFrame:
    """Standard bars of all symbols of an archive. Turns on the session's setting that hands filters to Python sources."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(BarArchive)
    return spark.read.format("bar_archive").option("timeframe", timeframe).load(folder)


def write_archive(bars: DataFrame, folder: str, timeframe: str, length: int = MONTHS) -> DataFrame:
    """Writes (symbol, ts, numbers) as feather files by month (or day, with ``DAYS``), and gives (path, rows).

    A symbol's month is one task, at most 44,640 bars of a minute; take days for finer bars. Files get their names when they
    are whole, so a task that runs twice writes the same file. Rows without a symbol or a time have no file: they raise.
    """
    columns = [c for c in STANDARD if c in bars.columns]
    at = F.unix_micros("ts")
    name = F.assert_true(F.col("symbol").isNotNull() & F.col("ts").isNotNull(), "a bar of an archive needs a symbol and a time")
    dated = bars.select(F.coalesce("symbol", name.cast("string")).alias("symbol"), at.alias("at"), F.substring(F.timestamp_micros(at).cast("string"), 1, length).alias("period"), *columns)

    def written(key: tuple, table: pa.Table) -> pa.Table:
        symbol, period = (k.as_py() for k in key)
        system, root = opened(folder)
        place = f"{root.rstrip('/')}/{period[:4]}"
        system.create_dir(place, recursive=True)
        table = table.sort_by("at")
        out = pa.table({"ts": table["at"].cast(pa.timestamp("us", "UTC")), **{c: table[c].cast(pa.float64()) for c in columns}})
        path = f"{place}/{symbol}-{timeframe}-{period}.feather"
        draft = f"{place}/.{symbol}-{timeframe}-{period}.{pd.Timestamp.now().value}"
        with system.open_output_stream(draft) as sink, pa.ipc.new_file(sink, out.schema) as writer:
            writer.write_table(out, max_chunksize=10_000)
        system.move(draft, path)
        return pa.table({"path": [path], "rows": pa.array([len(out)], pa.int64())})

    return dated.groupBy("symbol", "period").applyInArrow(written, "path string, rows long")


@dataclass
class Snapshot(InputPartition):
    path: str


class SnapshotReader(DataSourceStreamReader):
    def __init__(self, folder: str, schema: T.StructType):
        self.folder, self.columns = folder, to_arrow_schema(schema)

    def _numbers(self) -> dict[int, str]:
        system, root = opened(self.folder)
        infos = system.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True))
        return {int(i.base_name[5:]): i.path for i in infos if re.fullmatch(r"poll=\d+", i.base_name)}

    def initialOffset(self) -> dict:
        return {"poll": -1}

    def latestOffset(self) -> dict:
        return {"poll": max(self._numbers(), default=-1)}

    def partitions(self, start: dict, end: dict) -> Sequence[Snapshot]:
        return [Snapshot(path) for n, path in sorted(self._numbers().items()) if start["poll"] < n <= end["poll"]]

    def read(self, partition: Snapshot) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.folder)
        found = pyarrow.dataset.dataset(partition.path, filesystem=system, format="parquet")
        for batch in found.to_batches(columns=self.columns.names):
            yield from pa.Table.from_batches([batch]).cast(self.columns, safe=False).to_batches()


class BarSnapshots(DataSource):
    """Options: ``path``. The schema is the reader's own, by names of the files' columns."""

    @classmethod
    def name(cls) -> str:
        return "bar_snapshots"

    def streamReader(self, schema: T.StructType) -> SnapshotReader:
        return SnapshotReader(self.options["path"], schema)


def stream_polled(spark: SparkSession, folder: str, schema: str, overlap_seconds: int) -> DataFrame:
    """The bars (symbol, ts, ...) of polled snapshots, each once.

    Snapshots repeat bars, of at most the last ``overlap_seconds``: the repeats are known by (symbol, ts) as long as the
    watermark keeps them, and older ones are late. Snapshots hold closed bars only, so repeats are equal. Started with a
    processing-time trigger the stream goes on polling the folder; with ``availableNow`` it ends when the folder is drained.
    """
    spark.dataSource.register(BarSnapshots)
    rows = spark.readStream.format("bar_snapshots").schema(schema).load(folder)
    return rows.withWatermark("ts", f"{overlap_seconds} seconds").dropDuplicatesWithinWatermark(["symbol", "ts"])
