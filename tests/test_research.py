"""Sources, samples, evolution, models, simulation and streams."""

import math
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.operators import backtest, correlation, evolve, features, labels, metrics, normalise, resample
from factorloom.plans import parse, to_text
from factorloom.plans.expr import Const, Feature, depth
from factorloom.queries import streams
from factorloom.sources import bars as source
from factorloom.sources.tables import event_bars, load
from factorloom.streaming import stream_bars
from factorloom.streaming.buffer import rocksdb_state
from factorloom.streaming.factors import stream_last_values

SF = "/root/testdata/sf0.001"


def test_periods():
    assert source.periods("2024-11-20", "2025-02-01") == ["2024-11", "2024-12", "2025-01", "2025-02"]
    assert source.periods("2024-02-28", "2024-03-01", source.Frequency.DAILY) == ["2024-02-28", "2024-02-29", "2024-03-01"]


def test_zipped_files_become_partitioned_parquet(spark, tmp_path):
    store = source.BarStore(str(tmp_path / "raw"), "ETH", "15m")
    for month, start in (("2024-01", 1704067200000), ("2024-02", 1706745600000)):
        path = tmp_path / "raw" / "2024" / f"ETH-15m-{month}.zip"
        path.parent.mkdir(parents=True, exist_ok=True)
        rows = "\n".join(f"{start + k * 900000},1,{2 + k},0.5,1.5,{10 * k},{start + k * 900000 + 899999},3.5,7,1,2,0" for k in range(4))
        head = ",".join(source.RAW_COLUMNS) + "\n" if month == "2024-02" else ""
        with zipfile.ZipFile(path, "w") as z:
            z.writestr(f"{month}.csv", head + rows)
    source.ingest(spark, store, "2024-01", "2024-03", str(tmp_path / "bars"))
    got = spark.read.parquet(str(tmp_path / "bars"))
    assert got.count() == 8 and {(r["symbol"], r["month"]) for r in got.collect()} == {("ETH", 1), ("ETH", 2)}
    plan = got.where("month = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    with pytest.raises(FileNotFoundError):
        source.read_bars(spark, store, "2023-01", "2023-02")
    one = source.read_bars(spark, store, "2024-02", "2024-02", suffix="zip").orderBy("ts").first()
    assert one["ts"] == pd.Timestamp("2024-02-01") and (one["o"], one["h"], one["vol_ccy"], one["trades"]) == (1, 2, 3.5, 7)


def test_missing_columns_are_zero(spark):
    raw = spark.createDataFrame([(1704067200000, 1.0, 2.0)], "open_time long, open double, close double")
    row = source.standard_bars(raw, "X").first()
    assert (row["o"], row["c"], row["vol"], row["taker_buy_volume"]) == (1.0, 2.0, 0.0, 0.0)


def minute_bars(spark, n=300, gap=(100, 140)):
    rng = np.random.RandomState(0)
    rows = [("s", pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=15 * k), *[float(x) for x in sorted(rng.rand(4) + 1)], float(rng.randint(0, 3)), 1.0, 1.0) for k in range(n) if not gap[0] <= k < gap[1]]
    return pd.DataFrame(rows, columns=["symbol", "ts", "l", "o", "c", "h", "vol", "vol_ccy", "trades"]), None


def test_resampling_matches_pandas(spark):
    pdf, _ = minute_bars(spark)
    df = spark.createDataFrame(pdf)
    agg = {"o": "first", "h": "max", "l": "min", "c": "last", "vol": "sum"}
    for offset in (0, 45):
        want = pdf.set_index("ts").resample("2h", closed="left", label="left", offset=f"{offset}min").agg(agg).dropna()
        got = resample.resample(df, 7200, offset * 60).orderBy("ts").toPandas().set_index("ts")
        pd.testing.assert_frame_equal(got[list(agg)], want, check_freq=False, check_index_type=False)
    fan = resample.offset_buckets(df, 7200, 900).toPandas()
    assert set(fan.feature_offset) == {15.0 * k for k in range(8)}
    one = fan[fan.feature_offset == 45].sort_values("ts").set_index("ts")[["o", "h", "l", "c"]]
    want = pdf.set_index("ts").resample("2h", offset="45min").agg({k: agg[k] for k in "ohlc"}).dropna()
    pd.testing.assert_frame_equal(one, want[want.index >= pdf.ts.min()], check_freq=False)
    with pytest.raises(ValueError):
        resample.offset_buckets(df, 7200, 1000)


def test_gaps_are_filled_forward(spark):
    pdf, _ = minute_bars(spark)
    got = resample.resample(spark.createDataFrame(pdf), 900, fill_gaps=True, drop_zero_volume=False).orderBy("ts").toPandas()
    assert len(got) == 300 and got.c[139] == got.c[99] and got.vol[120] == 0
    assert (resample.resample(spark.createDataFrame(pdf), 900, fill_gaps=True).where("vol = 0").count()) == 0


def test_chunks_equal_array_split(spark):
    df = spark.range(23).select(F.lit("s").alias("symbol"), F.col("id").alias("ts"))
    got = df.select("ts", resample.chunk_id("ts", 5).alias("k")).orderBy("ts").toPandas().k.tolist()
    assert got == [i + 1 for i, part in enumerate(np.array_split(range(23), 5)) for _ in part]


def test_percent_ranks(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (None,), (5.0,)], "x double")
    got = df.select("x", resample.percent_rank("x").alias("r")).toPandas().sort_values("x")
    assert got.r.tolist()[:4] == pd.Series([1.0, 2, 2, 5]).rank(pct=True).tolist() and got.r.isna().sum() == 1


def test_samples_follow_their_times(spark):
    pdf, _ = minute_bars(spark)
    config = labels.SampleConfig(coarse=7200, step=900, horizon_steps=4, window=10)
    rows = labels.samples(spark.createDataFrame(pdf), config).orderBy("ts").toPandas()
    close = pdf.set_index("ts").c
    assert len(rows) and not rows.ts.duplicated().any()
    assert (rows.decision_timestamps == rows.ts + pd.Timedelta(hours=2)).all()
    np.testing.assert_allclose(rows.t_price, close[rows.decision_timestamps].to_numpy())
    np.testing.assert_allclose(rows.return_f, np.log(close[rows.prediction_timestamps].to_numpy() / rows.t_price))
    early = labels.samples(spark.createDataFrame(pdf), labels.SampleConfig(7200, 900, 4, 10, closed_prices=True)).toPandas()
    assert (early.current_data_timestamps == early.decision_timestamps - pd.Timedelta(minutes=15)).all()
    split = labels.with_split(spark.createDataFrame(rows[["symbol", "ts"]]), ("2024-01-01", "2024-01-02"), ("2024-01-02", "2024-01-04"), 3600)
    parts = split.groupBy("split").agg(F.max("ts").alias("z"), F.min("ts").alias("a")).toPandas().set_index("split")
    assert parts.z["train"] <= pd.Timestamp("2024-01-01 23:00") and parts.a["test"] >= pd.Timestamp("2024-01-02")


def test_every_feature_is_finite(spark):
    pdf, _ = minute_bars(spark, 120, (0, 0))
    out = features.base_features(spark.createDataFrame(pdf), features.ALL).toPandas()
    assert np.isfinite(out[list(features.ALL)].to_numpy()).all() and len(out) == 120
    with pytest.raises(ValueError, match="no features"):
        features.base_features(spark.createDataFrame(pdf), ("absent",))


def test_gauss_rank_with_a_seed_matches_its_definition(spark):
    rng = np.random.RandomState(7)
    x = np.round(rng.randn(60), 1)
    df = spark.createDataFrame([("s", k, float(v)) for k, v in enumerate(x)], "symbol string, ts int, x double")
    got = normalise.gauss_rank(df, "x", "z", 20, seed=42).orderBy("ts").toPandas().z
    u = np.random.RandomState(42).random_sample(60)
    want = np.zeros(60)
    for i in range(20, 60):
        less, ties = (x[i - 20 : i] < x[i]).sum(), (x[i - 20 : i] == x[i]).sum()
        q = (less + u[i] * (ties + 1 if ties else 1)) / 21
        r = math.sqrt(-2 * math.log(min(q, 1 - q)))
        z = r - (2.515517 + 0.802853 * r + 0.010328 * r * r) / (1 + 1.432788 * r + 0.189269 * r * r + 0.001308 * r**3)
        want[i] = np.clip(-z if q < 0.5 else z, -6, 6)
    np.testing.assert_allclose(got, want, atol=1e-12)


def test_trees_change_but_stay_whole():
    from factorloom.functions import active_operators

    config = evolve.EvolveConfig(population=10, hall_of_fame=5, components=3)
    b = evolve.Breeder(["o", "c"], active_operators(), config, 1)
    for _ in range(40):
        a, d = b.build(), b.build()
        assert 1 <= depth(a) <= 3
        for new in (b.crossover(a, d), b.hoist_mutation(a), b.point_mutation(a), b.subtree_mutation(a)):
            assert parse(to_text(new)) == new if not isinstance(new, (Const, Feature)) else True
    t = parse("add(abs(c), o)")
    assert to_text(evolve.graft(t, 2, parse("neg(o)"))) == "add(abs(neg(o)), o)"
    assert to_text(evolve.graft(t, 3, Const(1.0))) == "add(abs(c), 1.0)"


def plain_filter(r, fitness, limit):
    """The rule in words: in order, each program that is still in meets all later ones; of two alike the less fit goes."""
    out = set()
    for i in range(len(fitness)):
        if i in out:
            continue
        for j in range(i + 1, len(fitness)):
            if abs(r[i][j]) > limit:
                out.add(i if fitness[i] < fitness[j] else j)
    return [k not in out for k in range(len(fitness))]


def test_filter_drops_the_less_fit_of_like_programs():
    near = {0: np.array([1, 2])}
    # The first goes on throwing out in the turn in which it is thrown out itself.
    assert evolve.independent(near, np.array([1.0, 2.0, 0.5])).tolist() == [False, True, False]
    assert evolve.independent({}, np.array([1.0, 2.0])).tolist() == [True, True]
    rng = np.random.RandomState(1)
    for _ in range(200):
        n = rng.randint(2, 12)
        r = np.triu(rng.uniform(-1, 1, (n, n)), 1)
        fitness = rng.randint(0, 4, n).astype(float)
        pairs = {i: np.flatnonzero(np.abs(r[i]) > 0.6) for i in range(n) if (np.abs(r[i]) > 0.6).any()}
        assert evolve.independent(pairs, fitness).tolist() == plain_filter(r.tolist(), fitness.tolist(), 0.6)


def test_thinning_settles_the_largest_pairs_first():
    assert evolve.thinned([(0, 1), (1, 2), (0, 3)], {0, 1, 2, 3}, 2) == {0, 2}
    assert evolve.thinned([], {0, 1}, 1) == {0, 1}


@pytest.mark.parametrize("factors,tile,chunk", [(7, 3, 2), (40, 16, 16), (5, 500, 50)])
def test_blocked_correlations_equal_numpy(spark, monkeypatch, factors, tile, chunk):
    monkeypatch.setattr(correlation, "TILE", tile)
    monkeypatch.setattr(correlation, "CHUNK", chunk)
    monkeypatch.setattr(correlation, "ROWS_PER_TASK", 60)
    rng = np.random.RandomState(2)
    x = rng.randn(300, factors) @ rng.randn(factors, factors) + 1e6
    x[:, 2] = 0.1
    frames, first = None, 0
    for batch in np.array_split(np.arange(factors), 3):
        rows = [("s", k, *map(float, x[k, batch])) for k in range(300)]
        names = [f"f{i}" for i in range(len(batch))]
        part = spark.createDataFrame(rows, "symbol string, ts int, " + ", ".join(f"{n} double" for n in names))
        part = correlation.stacked(part.repartition(3), names, first)
        frames, first = part if frames is None else frames.unionByName(part), first + len(batch)
    with np.errstate(all="ignore"):
        want = np.corrcoef(x.T)
    got = {(r["a"], r["b"]): r["r"] for r in correlation.correlated(frames, factors).collect()}
    assert len(got) == factors * (factors - 1) // 2
    for (a, b), r in got.items():
        assert a < b and (r is None if 2 in (a, b) else abs(r - want[a, b]) < 1e-7)
    beyond = {(r["a"], r["b"]) for r in correlation.correlated(frames, factors, 0.3).collect()}
    assert beyond == {k for k, r in got.items() if r is not None and abs(r) > 0.3}


@pytest.mark.parametrize("fan", [2, 3])
def test_parts_of_correlations_merge_in_a_tree(spark, monkeypatch, fan):
    for name, size in (("TILE", 4), ("CHUNK", 3), ("ROWS_PER_TASK", 25), ("FAN", fan)):
        monkeypatch.setattr(correlation, name, size)
    rng = np.random.RandomState(5)
    # A drift, so that the means of parts are apart; one factor is constant.
    x = rng.randn(400, 6) @ rng.randn(6, 6) + np.linspace(0, 50, 400)[:, None] * rng.randn(6) + 1e5
    x[:, 4] = 0.1
    df = spark.createDataFrame(pd.DataFrame({"symbol": "s", "ts": np.arange(400), "x": x.tolist()}))
    rows = df.select(F.struct("symbol", "ts").alias("row"), F.lit(0).alias("first"), "x")
    got = {(r["a"], r["b"]): r["r"] for r in correlation.correlated(rows, 6).collect()}
    with np.errstate(all="ignore"):
        want = np.corrcoef(x.T)
    assert len(got) == 15
    for (a, b), r in got.items():
        assert r is None if 4 in (a, b) else abs(r - want[a, b]) < 1e-9


def test_correlations_of_two_thousand_factors(spark):
    """As many factors as a large population has; as columns of one frame their pairs could not be planned."""
    n, rows = 2000, 400
    rng = np.random.RandomState(3)
    x = rng.randn(rows, n)
    x[:, 1000:1100] = x[:, :100] + 0.1 * rng.randn(rows, 100)
    parts = [pd.DataFrame({"symbol": "s", "ts": np.arange(rows), "first": k, "x": x[:, k : k + 50].tolist()}) for k in range(0, n, 50)]
    df = spark.createDataFrame(pd.concat(parts)).select(F.struct("symbol", "ts").alias("row"), F.col("first").cast("int").alias("first"), "x")
    got = {(r["a"], r["b"]) for r in correlation.correlated(df, n, 0.9).collect()}
    want = np.triu(np.abs(np.corrcoef(x.T)) > 0.9, 1)
    assert got == set(zip(*(v.tolist() for v in np.nonzero(want)))) and len(got) >= 100


@pytest.fixture(scope="module")
def small_run(spark):
    df = event_bars(load(spark, SF, "events")).withColumn("y", labels.forward_return("c", 1)).dropna(subset=["y"])
    config = evolve.EvolveConfig(population=8, generations=2, hall_of_fame=6, components=3, tournament=3, init_depth=(1, 2), max_depth=3, crossover=0.5, subtree=0.1, hoist=0.1, point=0.2, parsimony="auto", norm_window=50, max_samples=0.8)
    make = lambda: evolve.Evolution(df.select("symbol", "ts", "o", "h", "l", "c", "vol", "y"), ["o", "h", "l", "c", "vol"], "y", config, scoring=metrics.Scoring(window=20))
    run = make()
    return run, run.run(), make


def test_evolution_repeats_and_orders_its_programs(small_run):
    run, best, make = small_run
    assert 0 < len(best) <= 3 and [p.raw for p in best] == sorted((p.raw for p in best), reverse=True)
    assert len({p.text for p in best}) == len(best) and len(run.report) >= 1
    assert [p.text for p in make().run()] == [p.text for p in best]
    assert run.table(best).count() == len(best)


def test_evolved_factors_as_stages(spark, small_run):
    run, best, _ = small_run
    out = evolve.FactorTransformer({"f": best[0].text}, norm_window=50).transform(run.df)
    assert out.count() == run.df.count() and set(out.columns) == {*run.df.columns, "f"}
    p = evolve.FactorClassifier(best[0].text, norm_window=50).transform(run.df).agg(F.min("probability").alias("a"), F.max("probability").alias("z")).first()
    assert 0 <= p["a"] <= p["z"] <= 1
    assert "prediction" in evolve.FactorRegressor(best[0].text, norm_window=50).transform(run.df).columns


def test_settings_are_checked():
    for bad in ({"metric": "mi_score"}, {"metric": "nothing"}, {"crossover": 1.2}, {"components": 500}, {"init_method": "odd"}, {"init_depth": (3, 1)}, {"max_samples": 0}):
        with pytest.raises(ValueError):
            evolve.EvolveConfig(**bad)


def test_simulation_trades_at_the_worse_price(spark):
    rows = [("s", 0, 10.0, 10.0, 0.0), ("s", 1, 11.0, 10.5, 1.0), ("s", 2, 10.0, 12.0, -1.0), ("s", 3, 13.0, 12.5, -1.0)]
    df = spark.createDataFrame(rows, "symbol string, ts int, o double, c double, pos double")
    got = backtest.simulate(df, fee=0.01).orderBy("ts").toPandas()
    assert got.trade_price.tolist() == [10.0, 10.5, 12.0]
    np.testing.assert_allclose(got.gain, [0.0, math.log(12 / 10.5) - 0.01, -0.02])
    assert backtest.simulation_report(backtest.simulate(df, fee=0.01), 365).first()["trades"] == 2


def test_model_recovers_its_line(spark):
    rng = np.random.RandomState(0)
    x = rng.randn(300, 2)
    rows = [("s", k, "train" if k < 200 else "test", float(a), float(b), float(0.5 * a - 2 * b + 0.1)) for k, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "symbol string, ts int, split string, a double, b double, return_f double")
    model, scale = backtest.fit_model(df, ["a", "b"])
    np.testing.assert_allclose([*model.coefficients, model.intercept], [0.5, -2, 0.1], atol=1e-8)
    pos = backtest.positions(df, model, scale, ["a", "b"]).toPandas().pos
    assert pos.abs().max() <= 5 and backtest.coefficients(spark, model, ["a", "b"]).count() == 3


def test_upsert_keeps_the_old_row(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "expression string, n int")
    new = spark.createDataFrame([("b", 9), ("c", 3), ("c", 4)], "expression string, n int")
    assert {tuple(r) for r in backtest.upsert(old, new).collect()} == {("a", 1), ("b", 2), ("c", 3)}
    assert backtest.upsert(None, new).count() == 2


def test_streamed_bars_equal_batch_bars(spark):
    got = streams.drained(stream_bars(streams.ticks(spark, SF), 21600, late_seconds=60), spark)
    batch = event_bars(load(spark, SF, "events")).select(got.columns)
    assert got.exceptAll(batch).isEmpty() and got.count() >= batch.count() - 5


def test_streamed_state_equals_batch(spark, tmp_path):
    """Events in several micro-batches, with state between them."""
    from factorloom.functions.recursive import Ema
    from factorloom.streaming import stream_cusum, stream_recursive

    rows = load(spark, SF, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "value").toPandas().sort_values("ts")
    for k, part in enumerate(np.array_split(np.arange(len(rows)), 4)):
        rows.iloc[part].to_parquet(tmp_path / f"{k}.parquet", coerce_timestamps="us")
    schema = "symbol string, ts timestamp, value double"
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    got = streams.drained(stream_recursive(read(), {"e": "ta_ema_8(value)"}), spark).toPandas().sort_values(["symbol", "ts"])
    want = []
    for _, d in rows.groupby("symbol"):
        state = Ema(8)
        want += [0.0 if v != v else v for v in map(state.step, d.value)]
    assert len(got) == len(rows)
    np.testing.assert_allclose(got.e, want)
    events = streams.drained(stream_cusum(read(), 300.0, "value"), spark)
    from factorloom.operators.barriers import cusum_events

    batch = cusum_events(spark.createDataFrame(rows), 300.0, "value")
    assert events.exceptAll(batch).isEmpty() and events.count() == batch.count() > 0


def test_streamed_factors_use_a_bounded_buffer(spark, tmp_path):
    rows = [("s", pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=k), float(k * k % 17)) for k in range(40)]
    pdf = pd.DataFrame(rows, columns=["symbol", "ts", "c"])
    (tmp_path / "in").mkdir()
    for k in range(4):
        pdf.iloc[10 * k : 10 * k + 10].to_parquet(tmp_path / "in" / f"{k}.parquet", coerce_timestamps="us")
    stream = spark.readStream.schema("symbol string, ts timestamp, c double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    writer = stream_last_values(stream, {"d": "sub(ts_lag_3(c), 0)"}, 15, lambda df, k: seen.append(df.toPandas()), norm_window=5)
    with rocksdb_state(spark):
        writer.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    got = pd.concat(seen).sort_values("ts")
    assert len(got) == 40 and [len(x) for x in seen] == [10] * 4
    shifted = pdf.c.shift(3).fillna(0)
    want = (shifted / shifted.rolling(5, min_periods=1).std()).replace([np.inf, np.nan], 0)
    # The first rows of a buffer have no past, which its length of 15 hides from new rows.
    np.testing.assert_allclose(got.d.to_numpy(), want.to_numpy())


def test_queries_import_without_the_text_operators():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
