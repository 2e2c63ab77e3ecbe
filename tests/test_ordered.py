"""Ranks and quantiles by order against NumPy, pandas and Spark's own aggregates."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.operators import backtest, ordered, resample

GRID = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]


@pytest.fixture(scope="module")
def values(spark):
    """A hot group, a hot value, ties, nulls in key and value, a group of one row and one of nulls alone."""
    random = np.random.RandomState(11)
    rows = [("hot", float(x), float(y)) for x, y in zip(random.normal(size=3000), random.randint(0, 5, 3000))]
    rows += [("ties", float(x), 7.0) for x in random.choice([1.0, 2.0, 2.5], 400, p=[0.8, 0.1, 0.1])]
    rows += [(None, float(x), None) for x in random.normal(size=50)]
    rows += [("one", 3.0, -1.0), ("none", None, None), ("none", None, None), ("hot", None, 1.0)]
    return spark.createDataFrame(rows, "g string, x double, y double").repartition(7)


def test_quantiles_equal_percentile(values):
    got = {r["g"]: r for r in ordered.exact_quantiles(values, {"x": "qx", "y": "qy"}, GRID, ("g",)).collect()}
    known = {r["g"]: r for r in ordered.exact_quantiles(values, {"x": "qx", "y": "qy"}, GRID, ("g",), longest=10_000).collect()}
    assert set(got) == {"hot", "ties", "one", "none", None} and got["none"]["qx"] is None and got[None]["qy"] is None
    assert got == known
    x = values.where("g = 'hot' and x is not null").toPandas()["x"]
    np.testing.assert_allclose(got["hot"]["qx"], np.quantile(x, GRID), rtol=1e-12)


def test_quantiles_of_a_whole_table(spark, values):
    got = ordered.exact_quantiles(values, {"x": "q"}, [0.5]).first()["q"]
    assert math.isclose(got[0], values.where("x is not null").toPandas()["x"].median(), rel_tol=1e-12)
    empty = ordered.exact_quantiles(values.where("false"), {"x": "q"}, [0.5])
    assert [r["q"] for r in empty.collect()] == [None]
    assert ordered.exact_quantiles(values.where("false"), {"x": "q"}, [0.5], ("g",)).count() == 0
    with pytest.raises(ValueError, match="from 0 to 1"):
        ordered.exact_quantiles(values, {"x": "q"}, [1.5])


def test_ranks_equal_windows(values):
    rows = values.withColumn("x", F.round("x", 1))
    got = ordered.with_ranks(rows, {"x": "rx", "y": "ry"}).toPandas()
    for c in ("x", "y"):
        np.testing.assert_allclose(got[f"r{c}"], got[c].rank(pct=True))
    keyed = ordered.with_ranks(rows, {"x": "r"}, ("g",), percent=False).toPandas()
    assert len(keyed) == values.count()
    np.testing.assert_allclose(keyed["r"], keyed.groupby("g", dropna=False)["x"].rank())
    want = rows.select("x", resample.percent_rank("x").alias("r")).toPandas().sort_values(["x", "r"])
    np.testing.assert_allclose(got.sort_values(["x", "rx"])["rx"], want["r"])


def test_ranks_are_of_many_tasks(values):
    plan = ordered.with_ranks(values, {"x": "r"})._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_nan_and_both_zeros(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (1.0,), (None,)], "x double")
    got = {str(r["x"]): r["r"] for r in ordered.with_ranks(df, {"x": "r"}, percent=False).collect()}
    assert got == {"0.0": 1.5, "-0.0": 1.5, "nan": 4.0, "1.0": 3.0, "None": None}


def test_diagnostics_by_order(spark):
    random = np.random.RandomState(4)
    a = np.round(random.normal(size=300), 1)
    b = np.round(a + random.normal(size=300), 1)
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b})).unionByName(spark.createDataFrame([(None, 1.0)], "a double, b double"))
    got = backtest.diagnostics(df, "a", "b", 0.1).first()
    assert got["n"] == 300 and math.isclose(got["spearman"], pd.Series(a).rank().corr(pd.Series(b).rank()), rel_tol=1e-9)
    by_a = sorted(range(300), key=lambda i: (-a[i], b[i], i))[:30]
    by_b = sorted(range(300), key=lambda i: (-b[i], a[i], i))[:30]
    assert got["overlap"] == len(set(by_a) & set(by_b)) / 30
    few = backtest.diagnostics(df.limit(4), "a", "b").first()
    assert few["spearman"] is None and few["overlap"] is None
    assert backtest.diagnostics(df.where("false"), "a", "b").first()["n"] == 0


def test_elite_pool_by_order(spark):
    table = spark.createDataFrame([(i, float(i % 10), float(i)) for i in range(50)] + [(50, None, 1.0)], "id int, x double, y double")
    got = {r["id"] for r in backtest.elite_pool(table, ["x", "y", "absent"], 0.8).collect()}
    x, y = [i % 10 for i in range(50)], list(range(50))
    assert got == {i for i in range(50) if x[i] >= np.quantile(x, 0.8) and y[i] >= np.quantile(y, 0.8)}
