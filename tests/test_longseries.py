"""Series cut into blocks: the same columns as whole series, in many tasks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.functions.frames import ROW, Series
from factorloom.functions.registry import OPERATORS, active_operators, lookup
from factorloom.functions.scans import FORMS, recur, scan_of
from factorloom.plans.compile import compile_factors
from factorloom.plans.expr import parse
from factorloom.plans.longseries import compile_long_factors, dealt, numbered, reach_of

COLUMNS = ("h", "l", "c", "v")


@pytest.fixture(scope="module")
def bars(spark):
    r = np.random.default_rng(3)
    parts = []
    for symbol, n in (("long", 2500), ("mid", 180), ("one", 1), (None, 40)):
        c = 100 * np.exp(np.cumsum(r.normal(0, 0.01, n)))
        for k in np.flatnonzero(r.random(n) < 0.02)[1:]:
            c[k] = c[k - 1]
        up, down = np.abs(r.normal(0, 0.5, (2, n)))
        parts.append(pd.DataFrame({"symbol": symbol, "ts": np.arange(n) * 3 + 5, "c": c, "h": c + up, "l": c - down, "v": r.integers(0, 9, n).astype(float)}))
    pdf = pd.concat(parts).sample(frac=1, random_state=1)
    rows = [tuple(None if x is None or x != x else x for x in row) for row in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, "symbol string, ts long, c double, h double, l double, v double").cache()


def same(bars, calls, block_rows=60, norm_window=25, **more):
    want = compile_factors(bars, calls, norm_window=norm_window, **more).toPandas().sort_values(["symbol", "ts"], ignore_index=True)
    got = compile_long_factors(bars, calls, norm_window=norm_window, block_rows=block_rows, **more).toPandas().sort_values(["symbol", "ts"], ignore_index=True)
    assert len(want) == len(got)
    for name in calls:
        np.testing.assert_allclose(got[name], want[name], rtol=1e-9, atol=1e-9, err_msg=name)


ARGUMENTS = {"ta_atr": "h, l, c", "ta_natr": "h, l, c", "ta_minus_dm": "h, l", "ta_minus_di": "h, l, c", "ad_oscillator": "h, l, c, v", "TA_AD": "h, l, c, v", "TA_OBV": "c, v"}


def test_recurrence():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 10, 97, 1000):
        a, b, s, want = r.uniform(-1, 1, n), r.normal(size=n), 1.5, []
        for x, y in zip(a, b):
            s = x * s + y
            want.append(s)
        np.testing.assert_allclose(recur(a, b, 1.5), want, rtol=1e-12, atol=1e-12)


def test_every_scan_equals_its_steps(spark):
    """From any cut on, against the state objects of the present form."""
    r = np.random.default_rng(7)
    n = 400
    c = 50 + np.cumsum(r.normal(size=n))
    known = {"c": c, "h": c + r.random(n), "l": c - r.random(n), "v": r.integers(0, 5, n).astype(float)}
    active_operators()
    names = [x for x in OPERATORS if scan_of(x)]
    assert {x if x in FORMS else x.rpartition("_")[0] for x in names} == set(FORMS)
    for name in names:
        op = lookup(name)
        if op.kind != "recursive":
            continue
        x = [known[k] for k in ARGUMENTS.get(name.rpartition("_")[0], ARGUMENTS.get(name, "c")).split(", ")]
        steps = op.build()
        want = np.array([steps.step(*row) for row in zip(*x)])
        for cuts in ([0, n], [0, 1, 2, 30, 31, 170, n], [0, 200, n]):
            scan, state, got = scan_of(name), None, []
            state = np.zeros(scan.size)
            for a, z in zip(cuts, cuts[1:]):
                rows, before, part = np.arange(a + 1, z + 1), [v[a - 1] if a else 0.0 for v in x], [v[a:z] for v in x]
                got.append(scan.values(state, rows, before, *part))
                effect = scan.effect(rows, before, *part)
                state = effect[:, :-1] @ state + effect[:, -1]
            np.testing.assert_allclose(np.concatenate(got), want, rtol=1e-9, atol=1e-9, err_msg=name)


def test_scans_in_blocks(bars):
    periods = {"ta_ema": 8, "ta_dema": 8, "ta_tema": 8, "ta_trix": 8, "ta_rsi": 6, "ta_cmo": 14, "ta_atr": 14, "ta_natr": 14, "ta_minus_dm": 14, "ta_minus_di": 14}
    calls = {p: f"{p}_{t}({ARGUMENTS.get(p, 'c')})" for p, t in periods.items()}
    calls |= {p: f"{p}({ARGUMENTS.get(p, 'c')})" for p in ("macd_gap", "ad_oscillator", "TA_AD", "TA_OBV")}
    same(bars, calls)


def test_frames_in_blocks(bars):
    framed = {op.name: op for op in active_operators() if op.kind != "recursive" and op.arity <= 2}
    calls = {n: f"{n}({', '.join(('c', 'v')[: op.arity])})" for n, op in framed.items() if n.rpartition("_")[2] not in ("40", "55")}
    same(bars, dict(list(calls.items())[::3]), block_rows=100)


def test_nested_frames_scans_and_others(bars):
    calls = {
        "a": "div(ts_delta_3(ts_sma_8(c)), ts_std_10(c))",
        "b": "ta_ema_8(sub(ta_rsi_6(ts_lag_3(c)), ts_rank_5(v)))",
        "d": "ts_sma_8(ta_kama_8(ta_ema_8(c)))",
        "e": "TA_SAR(h, l)",
        "k": "2.5",
        "f": "c",
    }
    same(bars, calls, block_rows=150, keep=["v"])


def test_numbers_and_halos(spark, bars):
    rows = numbered(bars, Series())
    got = rows.orderBy("symbol", ROW).groupBy("symbol").agg(F.collect_list("ts").alias("ts"), F.sort_array(F.collect_list(ROW)).alias("n")).collect()
    assert all(g["n"] == list(range(1, len(g["ts"]) + 1)) and g["ts"] == sorted(g["ts"]) for g in got)
    out = dealt(rows, Series(), 100, 30).groupBy("symbol", "__cut").agg(F.count_if("__halo").alias("halo"), F.count_if(~F.col("__halo")).alias("own")).collect()
    sizes = {"long": 2500, "mid": 180, "one": 1, None: 40}
    for o in out:
        assert o["own"] == max(0, min(100, sizes[o["symbol"]] - 100 * o["__cut"])) and o["halo"] <= 30
        assert not o["own"] or o["halo"] == (30 if o["__cut"] else 0)
    with pytest.raises(ValueError, match="halo"):
        dealt(rows, Series(), 10, 11)
    assert reach_of(parse("ts_lag_3(ta_ema_8(ts_sma_8(c)))"), 100) == 6 + 1 + 16 + 3 * 100


def test_one_series_in_many_tasks(spark):
    """A single series of a hundred blocks is worked on by many tasks, none of which reads much more than its share."""
    df = spark.range(20_000).select(F.lit("s").alias("symbol"), F.col("id").alias("ts"), F.sin(F.col("id") / 50).alias("c"))
    calls = {"x": "ts_sma_8(c)", "y": "ta_ema_21(c)"}
    out = compile_long_factors(df, calls, norm_window=50, block_rows=200)
    used = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(u["count"] for u in used) == 20_000 and (len(used) >= 2 or spark.conf.get("spark.sql.adaptive.enabled") == "true")
    same(df, calls, block_rows=200, norm_window=50)


def test_empty_and_odd_tables(spark):
    empty = spark.createDataFrame([], "symbol string, ts long, c double")
    assert compile_long_factors(empty, {"x": "ta_ema_8(ts_sma_8(c))"}).count() == 0
    odd = spark.createDataFrame([("s", k, x) for k, x in enumerate([1.0, None, float("nan"), float("inf"), 2.0] * 30)], "symbol string, ts long, c double")
    same(odd, {"x": "ts_sma_8(c)", "y": "ta_rsi_6(c)"}, block_rows=40, norm_window=10)
    no_keys = odd.drop("symbol")
    got = compile_long_factors(no_keys, {"x": "ta_ema_8(c)"}, Series((), ("ts",)), 10, 40).orderBy("ts").toPandas()
    want = compile_factors(no_keys, {"x": "ta_ema_8(c)"}, Series((), ("ts",)), 10).orderBy("ts").toPandas()
    np.testing.assert_allclose(got.x, want.x, rtol=1e-9)


def test_query_over_several_blocks(spark):
    """The registered query equals its SQL where the events fill more than one block."""
    import duckdb

    from factorloom.queries import QUERIES, SQL

    con = duckdb.connect()
    con.execute("CREATE VIEW events AS SELECT * FROM read_parquet('/root/testdata/sf0.01/events.parquet')")
    want = con.execute(SQL["long_series"]).df().sort_values("at", ignore_index=True)
    got = QUERIES["long_series"](spark, "/root/testdata/sf0.01").toPandas().sort_values("at", ignore_index=True)
    assert len(got) == len(want) > 5000 and list(got["at"]) == list(want["at"])
    for c in ("sma", "std", "balance", "nested"):
        np.testing.assert_allclose(got[c], want[c], atol=2e-5, err_msg=c)


def test_tasks_grow_in_number_with_the_rows(spark, monkeypatch):
    from factorloom.plans import longseries

    monkeypatch.setattr(longseries, "TASK_ROWS", 100, raising=False)
    df = spark.range(6_000).select(F.lit("a").alias("symbol"), F.timestamp_seconds("id").alias("ts"), F.rand(1).alias("c"))
    for calls in ({"x": "ts_sma_8(c)"}, {"x": "ts_lag_3(ta_ema_8(c))"}):
        found = longseries.compile_long_factors(df, calls, norm_window=10, block_rows=50)
        sizes = found.groupBy(F.spark_partition_id()).count().toPandas()["count"]
        # 60 tasks of two blocks each on average; before, Spark made as few as its setting of 8.
        assert sizes.sum() == 6_000 and len(sizes) > 30 and sizes.max() < 750
