"""Streams: the keyed buffer over several micro-batches and restarts."""

import numpy as np
import pandas as pd
import pytest

from factorloom.streaming.buffer import AT, NEW, packed, rocksdb_state, surplus, unpacked, with_context
from factorloom.streaming.factors import stream_last_values

START = pd.Timestamp("2024-01-01")
SCHEMA = "symbol string, ts timestamp, c double"


def bars(symbol, minutes, values=None):
    minutes = list(minutes)
    return pd.DataFrame({"symbol": symbol, "ts": [None if m is None else START + pd.Timedelta(minutes=m) for m in minutes], "c": [float(m or 0) for m in minutes] if values is None else values})


def write(folder, k, *parts):
    folder.mkdir(exist_ok=True)
    table = pd.concat(parts)
    table["ts"] = pd.to_datetime(table.ts)
    table.to_parquet(folder / f"{k}.parquet", coerce_timestamps="us", index=False)


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def contexts(spark, tmp_path, rows):
    """What the buffer gave in each micro-batch, in one run over what is there."""
    seen = []
    given = with_context(stream(spark, tmp_path / "in"), ["c"], rows)
    writer = given.writeStream.foreachBatch(lambda df, k: seen.append(df.toPandas())).option("checkpointLocation", str(tmp_path / "check"))
    with rocksdb_state(spark):
        writer.trigger(availableNow=True).start().awaitTermination()
    return seen


def minutes(rows):
    return sorted(int((t - START).total_seconds() // 60) for t in rows.ts)


def test_segments_go_only_when_the_rest_is_enough():
    assert surplus([10, 10, 10], 20) == 1 and surplus([10, 10, 10], 21) == 0 and surplus([30], 5) == 0
    assert surplus([1] * 7, 3) == 4 and surplus([], 3) == 0
    rows = pd.DataFrame({AT: [1, 2], "c": [0.5, np.nan]})
    pd.testing.assert_frame_equal(unpacked(packed(rows)), rows)


def test_each_batch_gets_the_newest_rows_before_it(spark, tmp_path):
    for k in range(8):
        write(tmp_path / "in", k, bars("a", range(5 * k, 5 * k + 5)), bars("b", [k]))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    seen = contexts(spark, tmp_path, 7)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
    for k, rows in enumerate(seen):
        a, b = rows[rows.symbol == "a"], rows[rows.symbol == "b"]
        assert minutes(a[a[NEW]]) == list(range(5 * k, 5 * k + 5)) and minutes(b[b[NEW]]) == [k]
        assert minutes(a[~a[NEW]]) == list(range(max(0, 5 * k - 7), 5 * k))
        assert minutes(b[~b[NEW]]) == list(range(max(0, k - 7), k))


def test_late_repeated_and_odd_rows(spark, tmp_path):
    write(tmp_path / "in", 0, bars("a", [1, 2, 2, None, 3], [1.0, 2.0, 2.0, 9.0, np.nan]), bars(None, [5]))
    write(tmp_path / "in", 1, bars("a", [3, 0, 6, 4]), bars(None, [6]), bars("", [1]))
    write(tmp_path / "in", 2, bars("a", [2, 1]))
    # The first two micro-batches in one run, the last in a second one from the same checkpoint.
    late = (tmp_path / "in" / "2.parquet").rename(tmp_path / "later.parquet")
    seen = contexts(spark, tmp_path, 4)
    late.rename(tmp_path / "in" / "2.parquet")
    seen += contexts(spark, tmp_path, 4)
    of = lambda rows, s: rows[rows.symbol.isna()] if s is None else rows[rows.symbol == s]
    assert minutes(of(seen[0], "a")) == [1, 2, 3] and minutes(of(seen[0], None)) == [5]
    a = of(seen[1], "a")
    assert minutes(a[a[NEW]]) == [4, 6] and minutes(a[~a[NEW]]) == [1, 2, 3]
    none = of(seen[1], None)
    assert minutes(none[none[NEW]]) == [6] and minutes(none[~none[NEW]]) == [5] and minutes(of(seen[1], "")) == [1]
    assert sum(map(len, seen[2:])) == 0


def test_an_idle_series_is_forgotten(spark, tmp_path):
    import time

    write(tmp_path / "in", 0, bars("a", [1, 2]))
    seen = []
    given = with_context(stream(spark, tmp_path / "in"), ["c"], 5, idle_seconds=1)
    writer = given.writeStream.foreachBatch(lambda df, k: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "check"))
    with rocksdb_state(spark):
        query = writer.trigger(processingTime="200 milliseconds").start()
    try:
        until = time.time() + 60
        while len(seen) < 2 and time.time() < until:
            time.sleep(0.2)
        # Long enough for the timer and for micro-batches that find it expired.
        time.sleep(8)
        write(tmp_path / "in", 1, bars("a", [1, 3]))
        while len(seen) < 4 and time.time() < until:
            time.sleep(0.2)
    finally:
        query.stop()
    # Nothing of before is there: no context, and minute 1 isn't late.
    assert sorted((int(r.c), r[NEW]) for r in seen) == [(1, True), (1, True), (2, True), (3, True)]


def test_settings(spark, tmp_path):
    write(tmp_path / "in", 0, bars("a", [1]))
    with pytest.raises(ValueError, match="one row"):
        with_context(stream(spark, tmp_path / "in"), ["c"], 0)


def test_factors_of_batches_equal_those_of_the_whole(spark, tmp_path):
    from factorloom.plans import compile_factors

    rng = np.random.default_rng(3)
    parts = []
    for k in range(6):
        part = pd.concat([bars(s, range(20 * k, 20 * k + 20), rng.normal(size=20)) for s in ("a", "b")]).sample(frac=1, random_state=k)
        write(tmp_path / "in", k, part)
        parts.append(part)
    factors = {"f": "sub(ts_sma_8(c), ts_lag_3(c))", "g": "ts_rank_10(c)"}
    seen = []
    # Two framed levels of 8 and 10 rows and the deviation of 12 of them reach back under 40 rows.
    writer = stream_last_values(stream(spark, tmp_path / "in"), factors, 40, lambda df, k: seen.append(df.toPandas()), norm_window=12)
    with rocksdb_state(spark):
        writer.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    order = ["symbol", "ts"]
    got = pd.concat(seen).sort_values(order)
    whole = spark.createDataFrame(pd.concat(parts), SCHEMA)
    want = compile_factors(whole, factors, norm_window=12).toPandas().sort_values(order)
    assert len([x for x in seen if len(x)]) == 6 and len(got) == len(want) == 240
    np.testing.assert_allclose(got[["f", "g"]], want[["f", "g"]], atol=1e-9)


def test_rows_of_one_time_stay_in_order_of_their_ids_across_batches(spark, tmp_path):
    from factorloom.functions.frames import Series
    from factorloom.plans import compile_factors
    from factorloom.streaming import stream_recursive

    schema = "symbol string, ts timestamp, c double, id long"
    rows = bars("a", [k // 3 for k in range(30)], np.random.default_rng(4).normal(size=30)).assign(id=range(30))
    # Times 3 and 6 are split between micro-batches; the last has a row older than the newest.
    late = bars("a", [2], [5.0]).assign(id=99)
    for k, part in enumerate((rows[:10], rows[10:20], pd.concat([rows[20:], late]))):
        write(tmp_path / "in", k, part.sample(frac=1, random_state=k))
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    series, seen = Series(order=("ts", "id")), []
    writer = stream_last_values(read(), {"f": "ts_sma_8(c)"}, 40, lambda df, k: seen.append(df.toPandas()), 12, series)
    with rocksdb_state(spark):
        writer.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    got = pd.concat(seen).sort_values("id")
    want = compile_factors(spark.createDataFrame(rows, schema), {"f": "ts_sma_8(c)"}, series, norm_window=12).toPandas().sort_values("id")
    assert got.id.tolist() == list(range(30))
    np.testing.assert_allclose(got.f, want.f, atol=1e-9)
    emas = []
    query = stream_recursive(read(), {"e": "ta_ema_8(c)"}, "id").writeStream.foreachBatch(lambda df, k: emas.extend(df.orderBy("ts").collect()))
    query.option("checkpointLocation", str(tmp_path / "again")).trigger(availableNow=True).start().awaitTermination()
    assert len(emas) == 30


@pytest.mark.parametrize("name", ["streamed_factors", "streamed_last_values"])
def test_equal_times_equal_sql(spark, tmp_path, name):
    import duckdb

    from factorloom.queries.streams import QUERIES, SQL

    rng = np.random.default_rng(5)
    at = START + pd.to_timedelta(np.arange(60) // 2, unit="min")
    events = pd.DataFrame({"event_id": range(60), "ts": at, "event_type": "a", "value": rng.uniform(1, 9, 60)})
    events.to_parquet(tmp_path / "events.parquet", coerce_timestamps="us", index=False)
    want = duckdb.sql(SQL[name]).fetchall()
    got = [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()]
    assert len(got) == 60
    np.testing.assert_allclose([r[1:] for r in sorted(got)], [r[1:] for r in sorted(want)], atol=2e-5)
