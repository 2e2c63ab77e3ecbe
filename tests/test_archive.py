"""Archive files with pushed filters, and polled snapshots."""

import datetime as dt
import zipfile

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, IsNotNull, LessThan, LessThanOrEqual

from factorloom.sources import archive

UTC = dt.timezone.utc


def bars(spark, rows):
    return spark.createDataFrame([(s, dt.datetime.fromisoformat(t), c) for s, t, c in rows], "symbol string, ts timestamp, c double")


ROWS = [("ETH", "2024-01-31T23:59:00", 1.0), ("ETH", "2024-02-01T00:00:00", 2.0), ("ETH", "2024-02-29T12:00:00", None), ("A-B", "2024-02-01T05:00:00", 4.0)]


def saved(spark, tmp_path, length=archive.MONTHS):
    out = archive.write_archive(bars(spark, ROWS), str(tmp_path), "1m", length).collect()
    return {r["path"].removeprefix(f"{tmp_path}/"): r["rows"] for r in out}


def test_files_by_symbol_and_period(spark, tmp_path):
    assert saved(spark, tmp_path) == {"2024/ETH-1m-2024-01.feather": 1, "2024/ETH-1m-2024-02.feather": 2, "2024/A-B-1m-2024-02.feather": 1}
    got = archive.read_archive(spark, str(tmp_path), "1m")
    assert {(r["symbol"], r["ts"].isoformat(), r["c"]) for r in got.collect()} == set(ROWS)
    assert got.agg(F.sum("vol").alias("v")).first()["v"] == 0
    # A task that runs again leaves the same files.
    saved(spark, tmp_path)
    assert got.count() == 4 and not list(tmp_path.glob("2024/.*"))
    with pytest.raises(Exception, match="needs a symbol and a time"):
        archive.write_archive(bars(spark, ROWS).withColumn("symbol", F.lit(None).cast("string")), str(tmp_path), "1m").collect()


def test_filters_choose_files():
    day = lambda d: dt.datetime(2024, 2, d, tzinfo=UTC)
    file = archive.BarFile("p", "ETH", "zip", day(3), day(4))
    ts, symbol = ("ts",), ("symbol",)
    assert archive.may_hold(file, EqualTo(symbol, "ETH")) and not archive.may_hold(file, EqualTo(symbol, "BTC"))
    assert archive.may_hold(file, In(symbol, ("BTC", "ETH"))) and not archive.may_hold(file, In(symbol, ("BTC",)))
    assert archive.may_hold(file, EqualTo(ts, day(3))) and not archive.may_hold(file, EqualTo(ts, day(4)))
    assert not archive.may_hold(file, GreaterThan(ts, day(4))) and not archive.may_hold(file, GreaterThanOrEqual(ts, day(4))) and archive.may_hold(file, GreaterThanOrEqual(ts, day(3)))
    assert not archive.may_hold(file, LessThan(ts, day(3))) and archive.may_hold(file, LessThanOrEqual(ts, day(3)))
    assert archive.may_hold(file, IsNotNull(ts)) and archive.may_hold(file, EqualTo(("c",), 3.0))


def test_only_chosen_files_become_partitions(spark, tmp_path):
    assert len(saved(spark, tmp_path, archive.DAYS)) == 4
    read = archive.read_archive(spark, str(tmp_path), "1m")
    assert read.rdd.getNumPartitions() == 4
    some = read.where((F.col("symbol") == "ETH") & (F.col("ts") >= F.lit("2024-02-01").cast("timestamp")) & (F.col("ts") < F.lit("2024-02-29 12:00:01").cast("timestamp")))
    assert some.rdd.getNumPartitions() == 2
    assert [r["c"] for r in some.orderBy("ts").collect()] == [2.0, None]
    # Files that stay unread may be broken.
    (tmp_path / "2024" / "BTC-1m-2024-02-01.feather").write_bytes(b"broken")
    assert some.count() == 2


def test_zip_with_and_without_header_and_feather_first(spark, tmp_path):
    folder = tmp_path / "2024"
    folder.mkdir()
    header = "open_time,open,high,low,close,volume,close_time,quote_volume,count,taker_buy_volume,taker_buy_quote_volume,ignore\n"
    line = "{},1,2,0.5,{},10,1706745659999,11,3,5,6,0\n"
    for period, start, first in (("2024-02", 1706745600000, header), ("2024-03", 1709251200000, "")):
        with zipfile.ZipFile(folder / f"X-1m-{period}.zip", "w") as z:
            z.writestr("x.csv", first + "".join(line.format(start + 60_000 * k, "" if k == 1 else k + 0.5) for k in range(3)))
    with zipfile.ZipFile(folder / "X-1m-2024-04.zip", "w") as z:
        z.writestr("x.csv", "")
    got = archive.read_archive(spark, str(tmp_path), "1m")
    rows = got.orderBy("ts").collect()
    assert [r["c"] for r in rows] == [0.5, None, 2.5] * 2 and rows[0]["ts"] == dt.datetime(2024, 2, 1) and rows[0]["trades"] == 3
    table = pa.table({"ts": pa.array([dt.datetime(2024, 2, 7, tzinfo=UTC)], pa.timestamp("us", "UTC")), "c": [9.0]})
    with pa.OSFile(str(folder / "X-1m-2024-02.feather"), "wb") as f, pa.ipc.new_file(f, table.schema) as w:
        w.write_table(table)
    # Files are listed when the archive is read anew.
    again = archive.read_archive(spark, str(tmp_path), "1m")
    assert [r["c"] for r in again.orderBy("ts").collect()] == [9.0, 0.5, None, 2.5]


def test_empty_archive(spark, tmp_path):
    assert archive.read_archive(spark, str(tmp_path / "none"), "1m").count() == 0
    assert archive.write_archive(bars(spark, []), str(tmp_path), "1m").count() == 0


def snapshot(folder, number, rows):
    place = folder / f"poll={number}"
    place.mkdir(parents=True)
    pdf = pd.DataFrame([(s, pd.Timestamp(t, tz="UTC"), c, "x") for s, t, c in rows], columns=["symbol", "ts", "c", "extra"])
    pdf.to_parquet(place / "part.parquet", index=False)


def drain(spark, tmp_path):
    found = archive.stream_polled(spark, str(tmp_path / "in"), "symbol string, ts timestamp, c double", 3600)
    writer = found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check"))
    writer.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    return sorted((r["symbol"] or "", r["ts"].strftime("%H:%M"), r["c"]) for r in spark.read.schema(found.schema).parquet(str(tmp_path / "out")).collect())


def test_polled_bars_come_once_over_restarts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "other").mkdir()
    at = lambda m: f"2024-01-01T00:{m:02d}:00"
    snapshot(tmp_path / "in", 9, [("a", at(0), 1.0), ("a", at(1), 2.0), (None, at(1), 3.0)])
    snapshot(tmp_path / "in", 10, [("a", at(1), 2.0), ("a", at(2), 4.0), (None, at(1), 3.0)])
    first = [("", "00:01", 3.0), ("a", "00:00", 1.0), ("a", "00:01", 2.0), ("a", "00:02", 4.0)]
    assert drain(spark, tmp_path) == first
    assert drain(spark, tmp_path) == first
    # Numbers are compared as numbers; one below the last offset comes too late.
    snapshot(tmp_path / "in", 11, [("a", at(2), 4.0), ("a", at(3), 5.0)])
    snapshot(tmp_path / "in", 7, [("a", at(9), 7.0)])
    assert drain(spark, tmp_path) == first + [("a", "00:03", 5.0)]


def test_offsets_of_a_missing_folder(tmp_path):
    reader = archive.SnapshotReader(str(tmp_path / "none"), archive.BARS)
    assert reader.initialOffset() == reader.latestOffset() == {"poll": -1} and reader.partitions({"poll": -1}, {"poll": -1}) == []
