"""CUSUM events, barriers, concurrency, weights and draws against plain Python."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.operators import barriers, sampling

HOUR = pd.Timedelta(hours=1)


@pytest.fixture(scope="module")
def market(spark):
    rng = np.random.RandomState(42)
    ts = pd.date_range("2025-01-01", periods=360, freq="15min")
    close = 100 * np.exp(np.cumsum(rng.standard_t(5, 360) * 0.002))
    pdf = pd.DataFrame({"symbol": "s", "ts": ts, "c": close})
    move = np.abs(np.log(pdf.c).diff())
    enter = pdf[move > move.quantile(0.9)][["symbol", "ts"]].assign(trgt=0.004)
    return pdf, enter, spark.createDataFrame(pdf), spark.createDataFrame(enter)


def plain_barriers(pdf, enter, pt, sl, hold):
    out = {}
    close = pdf.set_index("ts").c
    for t0, width in zip(enter.ts, enter.trgt):
        later = close.index[close.index >= t0 + hold]
        vertical = later[0] if len(later) else None
        path = close[t0 : vertical or close.index[-1]] / close[t0] - 1
        hits = [path.index[path > pt * width].min() if pt > 0 else pd.NaT, path.index[path < -sl * width].min() if sl > 0 else pd.NaT, vertical or pd.NaT]
        found = [x for x in hits if x is not pd.NaT and not pd.isna(x)]
        exit_ = min(found) if found else None
        out[t0] = (exit_, math.log(close[exit_] / close[t0]) if exit_ is not None else 0.0)
    return out


@pytest.mark.parametrize("pt,sl,hours", [(1.2, 1.0, 4), (6, 5, 10), (0, 1.0, 2), (0, 0, 3)])
def test_triple_barrier(market, pt, sl, hours):
    pdf, enter, prices, entries = market
    got = barriers.triple_barrier(entries, prices, pt, sl, hours * 3600, "trgt").toPandas()
    want = plain_barriers(pdf, enter, pt, sl, hours * HOUR)
    assert len(got) == len(want)
    for r in got.itertuples():
        exit_, ret = want[r.ts]
        assert (pd.isna(r.exit) and exit_ is None) or r.exit == exit_
        assert r.ret == pytest.approx(ret, abs=1e-12)


def test_sides_turn_returns(market):
    _, _, prices, entries = market
    a = barriers.triple_barrier(entries.withColumn("side", F.lit(-1.0)), prices, 1, 1, 7200, "trgt", "side").toPandas().set_index("ts")
    assert set(a.side) == {-1.0} and {"stop", "profit"} & set(a.barrier)
    assert (a[a.barrier == "profit"].ret > 0).all() and (a[a.barrier == "stop"].ret < 0).all()


def test_cusum_resets_one_side_and_skips_bad_thresholds():
    state = barriers.Cusum()
    assert [state.step(x, 1.0) for x in (0, 0.6, 1.2, 1.3, -0.2, -0.3)] == [0, 0, 1, 0, -1, 0]
    state = barriers.Cusum()
    assert [state.step(x, t) for x, t in ((0, 1.0), (5, math.nan), (5.5, 0.4), (9, 0.0), (9.1, None), (9.6, 0.4))] == [0, 0, 1, 0, 0, 1]


def test_volatility_matches_pandas(market):
    pdf, _, prices, _ = market
    got = barriers.ewm_volatility(barriers.prepared_close(prices), 20, 2.0).orderBy("ts").toPandas().volatility
    want = (np.log(pdf.c).diff().ewm(span=20).std() * 2).bfill()
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_last_of_repeated_timestamps(spark):
    rows = [("s", 1, 10.0, 1), ("s", 1, 11.0, 2), ("s", 2, 12.0, 1)]
    df = spark.createDataFrame(rows, "symbol string, ts int, c double, arrival int")
    got = barriers.prepared_close(df, log=False, arrival="arrival").orderBy("ts").collect()
    assert [r["base"] for r in got] == [11.0, 12.0]


@pytest.fixture(scope="module")
def sampled(market):
    pdf, enter, prices, entries = market
    out = sampling.sampling_pipeline(prices, entries, 1.2, 1.0, 4 * 3600, 0.5, "trgt")
    events = out["events"].orderBy("event_id").toPandas()
    close = pdf.set_index("ts").c
    return out, events, close, {t: sum((events.t0 <= t) & (t <= events.t1)) for t in close.index}


def test_concurrency_and_weights(market, sampled):
    out, events, close, load = sampled
    got = sampling.concurrency(market[2], out["events"]).toPandas()
    assert dict(zip(got.ts, got.concurrent)) == load
    w = out["weights"].orderBy("event_id").toPandas()
    r = np.log(close).diff().fillna(0)
    tw = [np.mean([1 / load[t] for t in close[a:b].index]) for a, b in zip(events.t0, events.t1)]
    ret = np.array([abs(sum(r[t] / load[t] for t in close[a:b].index)) for a, b in zip(events.t0, events.t1)])
    np.testing.assert_allclose(w.tW, tw)
    np.testing.assert_allclose(w.w_ret, ret * len(ret) / ret.sum())
    csum = np.cumsum(tw)
    np.testing.assert_allclose(w.w_td, 1 - 0.5 / csum[-1] * csum[-1] + 0.5 / csum[-1] * csum)
    assert w.w.sum() == pytest.approx(len(w))
    with pytest.raises(ValueError):
        sampling.decay_weights(out["weights"], -1)


def test_uniqueness_from_pairs_equals_weights(sampled):
    out, _, _, _ = sampled
    a = sampling.average_uniqueness(out["pairs"]).toPandas().set_index("event_id").uniqueness
    b = out["weights"].toPandas().set_index("event_id").tW
    np.testing.assert_allclose(a.sort_index(), b.sort_index())


def test_integer_events_are_drawn_by_their_uniqueness():
    lo, hi = np.array([0, 0, 50]), np.array([10, 10, 60])
    counts = np.zeros(3)
    for seed in range(300):
        counts[sampling.draw_sequentially(lo, hi, 2, np.random.RandomState(seed))[1]] += 1
    # Whatever was drawn first, the lone event has the best chance next.
    assert counts[2] > counts[0] and counts[2] > counts[1]
    assert sampling.draw_sequentially(lo, hi, 5, np.random.RandomState(1)) == sampling.draw_sequentially(lo, hi, 5, np.random.RandomState(1))


def _plain_chance(lo, hi, sequence):
    """The chance of a sequence of draws when each looks at all events and all bars."""
    load, chance = np.ones(int(hi.max())), 1.0
    for pick in sequence:
        u = np.array([(1 / load[a:b]).mean() for a, b in zip(lo, hi)])
        chance *= u[pick] / u.sum()
        load[lo[pick] : hi[pick]] += 1
    return chance


def test_draws_by_bounds_have_the_law_of_the_plain_loop(monkeypatch):
    lo, hi = np.array([0, 2, 3, 9]), np.array([4, 8, 5, 12])
    for least in (1, 64):  # Bounds computed anew within a sequence, and never.
        monkeypatch.setattr(sampling, "LEAST_TRIES", least)
        runs, random, seen = 20_000, np.random.RandomState(7), {}
        for _ in range(runs):
            drawn = tuple(sampling.draw_sequentially(lo, hi, 3, random))
            seen[drawn] = seen.get(drawn, 0) + 1
        expected = {s: runs * _plain_chance(lo, hi, s) for s in itertools.product(range(4), repeat=3)}
        assert abs(sum(expected.values()) - runs) < 1e-6
        # 63 degrees of freedom: 103 is passed by chance once in a thousand.
        assert sum((seen.get(s, 0) - e) ** 2 / e for s, e in expected.items()) < 103


def test_many_draws_follow_the_plain_loop():
    random = np.random.RandomState(3)
    lo = np.sort(random.randint(0, 3000, 800))
    hi = lo + random.randint(1, 60, 800)
    load = np.ones(int(hi.max()))
    drawn = sampling.draw_sequentially(lo, hi, 4000, np.random.RandomState(5))
    # Expected and found draws of the events' thirds by length, given what was drawn before.
    part, found, expected, spread = np.digitize(hi - lo, [20, 40]), np.zeros(3), np.zeros(3), np.zeros(3)
    for pick in drawn:
        share = np.r_[0.0, np.cumsum(1 / load)]
        u = (share[hi] - share[lo]) / (hi - lo)
        p = np.bincount(part, u / u.sum(), 3)
        expected, spread = expected + p, spread + p * (1 - p)
        found[part[pick]] += 1
        load[lo[pick] : hi[pick]] += 1
    assert (np.abs(found - expected) < 4 * np.sqrt(spread)).all()


def test_event_ranges_count_bars(spark):
    at = lambda m: (pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=m)).to_pydatetime()
    bars = spark.createDataFrame([("a", at(m)) for m in (0, 10, 10, 20, 30)] + [("b", at(5))], "symbol string, ts timestamp")
    events = [("a", 0, at(0), at(0)), ("a", 1, at(5), at(20)), ("a", 2, at(11), at(19)), ("a", 3, at(10), at(90)), ("a", 4, None, at(9)), ("b", 0, at(0), at(5)), ("c", 0, at(0), at(5))]
    found = sampling.event_ranges(bars, spark.createDataFrame(events, "symbol string, event_id long, t0 timestamp, t1 timestamp"))
    assert {tuple(r) for r in found.collect()} == {("a", 0, 0, 1), ("a", 1, 1, 3), ("a", 3, 1, 4), ("b", 0, 0, 1)}
    none = found.where("false")
    assert sampling.sequential_bootstrap(none).count() == 0
    assert sampling.draw_sequentially(np.array([]), np.array([]), 3, np.random.RandomState(1)) == []


def test_draws_repeat_and_beat_plain_ones(sampled):
    out, events, _, _ = sampled
    a = [r["event_id"] for r in out["drawn"].orderBy("place").collect()]
    b = [r["event_id"] for r in sampling.sequential_bootstrap(out["pairs"]).orderBy("place").collect()]
    assert a == b and len(a) == len(events) and set(a) <= set(events.event_id)
    q = sampling.sampling_quality(sampling.bootstrap_trials(out["pairs"], 12), out["weights"]).first()
    assert q["uniqueness_lift"] > 0 and q["seq_win_ratio"] > 0.5 and 0 < q["weight_top_1pct_mass"] <= q["weight_top_5pct_mass"] < 1


def test_events_are_checked(spark):
    schema = "symbol string, event_id long, t0 timestamp, t1 timestamp"
    with pytest.raises(ValueError, match="no events"):
        sampling.checked_events(spark.createDataFrame([], schema))
    bad = spark.sql("SELECT 's' AS symbol, 0L AS event_id, timestamp'2025-01-02' AS t0, timestamp'2025-01-01' AS t1")
    with pytest.raises(ValueError, match="lack an end"):
        sampling.checked_events(bad)


ODD = [5.0, None, 5.6, 0.0, float("nan"), 4.0, float("inf"), 4.1, -1.0, 6.5, 6.4, None, None, 3.0, 0.0, 9.0, 9.1, 2.0]


def odd_prices(spark):
    rows = [("s", (pd.Timestamp("2025-01-01") + k * HOUR).to_pydatetime(), x) for k, x in enumerate(ODD * 6)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, c double")


def plain_cusum(values, threshold):
    last, up, down, out = None, 0.0, 0.0, []
    for k, x in enumerate(values):
        if x is None or not math.isfinite(x) or x <= 0:
            continue
        change, last = (0.0 if last is None else math.log(x) - last), math.log(x)
        up, down = max(0.0, up + change), min(0.0, down + change)
        if up > threshold:
            out.append((k, 1.0))
            up = 0.0
        elif down < -threshold:
            out.append((k, -1.0))
            down = 0.0
    return out


def test_missing_prices_add_nothing(spark):
    close = barriers.prepared_close(odd_prices(spark))
    start = pd.Timestamp("2025-01-01")
    want = plain_cusum(ODD * 6, 0.3)
    for threshold in (0.3, "t"):
        got = barriers.cusum_events(close.withColumn("t", F.lit(0.3)), threshold).orderBy("ts").collect()
        assert [((r["ts"] - start) / HOUR, r["side"]) for r in got] == want
    # What comes unprepared, NaN and infinities included, is passed over as well.
    raw = close.withColumn("base", F.when(F.col("base").isNull(), F.lit(float("nan"))).otherwise(F.col("base")))
    assert len(barriers.cusum_events(raw, 0.3).collect()) == len(want)


def test_volatility_over_missing_prices(spark):
    close = barriers.prepared_close(odd_prices(spark))
    known = [math.log(x) for x in ODD * 6 if x is not None and math.isfinite(x) and x > 0]
    want = pd.Series(np.diff(known)).ewm(span=10).std().dropna().tolist()
    got = barriers.ewm_volatility(close, 10).where("base is not null").orderBy("ts").toPandas().volatility.tolist()
    assert got[2:] == pytest.approx(want, rel=1e-9) and got[0] == got[1] == got[2]


def test_barriers_and_grid_over_missing_prices(spark):
    close = barriers.prepared_close(odd_prices(spark))
    events = barriers.cusum_events(close, 0.3)
    got = barriers.triple_barrier(events, close, 0.2, 0.2, 4 * 3600).collect()
    assert len(got) == events.count() and all(math.isfinite(r["ret"]) for r in got)
    start, prices = pd.Timestamp("2025-01-01"), ODD * 6
    for r in got:
        if r["barrier"] in ("profit", "stop"):
            x = prices[int((r["exit"] - start) / HOUR)]
            assert x is not None and x == x
    everything = close.select("symbol", "ts")
    assert barriers.triple_barrier(everything, close, 0.2, 0.2, 4 * 3600).count() == len(prices)
    grid = barriers.barrier_grid(odd_prices(spark), (5,), (0.5, 1.0), ((1.0, 1.0),), (4 * 3600,)).collect()
    assert grid and all(g["events"] >= g["profits"] + g["losses"] for g in grid)


def test_streamed_cusum_equals_batch_over_missing_prices(spark, tmp_path):
    from factorloom.streaming.factors import stream_cusum

    close = barriers.prepared_close(odd_prices(spark)).withColumn("base", F.coalesce("base", F.when(F.col("c").isNotNull(), F.lit(float("nan")))))
    close.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(close.schema).parquet(str(tmp_path / "in"))
    writer = stream_cusum(stream, 0.3).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
    writer.trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, barriers.cusum_events(close, 0.3).collect())) and got.count()


def test_top_mass_without_events_is_one_row_as_in_sql(spark, tmp_path):
    import duckdb

    from factorloom.queries.events import QUERIES, SQL

    # Unit prices that never move by a tenth give no entries.
    days = pd.date_range("2024-01-01", periods=40)
    lines = pd.DataFrame({"l_shipdate": days, "l_extendedprice": [100.0 + k % 3 for k in range(40)], "l_quantity": 1.0})
    lines.to_parquet(tmp_path / "lineitem.parquet", coerce_timestamps="us", index=False)
    lineitem = lines  # noqa: F841
    want = duckdb.sql(SQL["event_top_mass"]).fetchall()
    got = [tuple(r) for r in QUERIES["event_top_mass"](spark, str(tmp_path)).collect()]
    assert got == want == [("all", None, None)]
    assert QUERIES["event_weights"](spark, str(tmp_path)).isEmpty()


def test_streamed_cusum_of_zeros_and_equal_times_equals_sql(spark, tmp_path):
    import duckdb

    from factorloom.queries.streams import QUERIES, SQL

    # Zeros, also next to each other, and several rows of one time, whose order is that of their ids.
    values = [5.0, 0.0, 30.0, 30.0, 0.2, 0.0, 0.0, 7.0, 90.0, 1.0]
    at = pd.Timestamp("2024-01-01") + pd.to_timedelta([0, 1, 2, 2, 2, 3, 4, 5, 6, 6], unit="min")
    events = pd.DataFrame({"event_id": range(10), "ts": at, "user_id": 1, "event_type": "a", "value": values, "props": ""})
    events.to_parquet(tmp_path / "events.parquet", coerce_timestamps="us", index=False)
    want = duckdb.sql(SQL["streamed_cusum"]).fetchall()
    got = [tuple(r) for r in QUERIES["streamed_cusum"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(got) > 4
