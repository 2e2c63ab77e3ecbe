"""Box-Cox and Yeo-Johnson exponents against grids of the likelihood in NumPy."""

import numpy as np
import pytest

from factorloom.functions.frames import Series
from factorloom.operators import power


def _transformed(x, m, kind):
    up = lambda b, e: b if abs(e) < 1e-12 else np.expm1(e * b) / e
    if kind == "box_cox":
        return up(np.log(x), m)
    return np.where(x >= 0, up(np.log1p(np.maximum(x, 0)), m), -up(np.log1p(np.maximum(-x, 0)), 2 - m))


def _likelihood(y, jacobian):
    """None where rounding makes up the variance."""
    return jacobian - len(y) / 2 * np.log(y.var()) if 1e-24 * (y**2).mean() < y.var() < np.inf else -np.inf


def _best(x, kind):
    j = np.log(x) if kind == "box_cox" else np.sign(x) * np.log1p(np.abs(x))
    centre, width = 0.0, 60.0
    for _ in range(4):
        grid = np.linspace(centre - width, centre + width, 1201)
        scores = [_likelihood(_transformed(x, m, kind), (m - 1) * j.sum()) for m in grid]
        centre, width = grid[int(np.argmax(scores))], width / 300
    return centre, max(scores)


@pytest.fixture(scope="module")
def groups():
    random = np.random.RandomState(9)
    return {
        "log": np.exp(random.normal(size=4000)),
        "square": random.normal(6, 1, 500) ** 2,
        "root": np.sqrt(np.abs(random.normal(4, 1, 500))),
        "left": -np.exp(random.normal(size=300)),
        "far": np.abs(random.normal(50, 1, 400)) ** 0.1,  # The peak is far beyond the first points.
        None: random.normal(size=200),
    }


@pytest.mark.parametrize("kind", power.KINDS)
def test_exponents_equal_a_grid(spark, groups, kind):
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs]
    odd = [("log", None), ("log", float("nan")), ("log", float("inf")), ("same", 2.0), ("same", 2.0), ("single", 1.0), ("void", None)]
    df = spark.createDataFrame(rows + odd, "symbol string, r double").repartition(5)
    fitted = power.fit_power(df, "r", kind)
    got = {r["symbol"]: r for r in fitted.collect()}
    assert set(got) == {*groups, "same", "single"}
    assert got["same"]["lambda"] is None and got["single"]["lambda"] is None and got["same"]["n"] == 2
    for g, xs in groups.items():
        x = xs - xs.min() + 1 if kind == "box_cox" else xs
        exponent, likelihood = _best(x, kind)
        assert got[g]["n"] == len(xs) and abs(got[g]["lambda"] - exponent) < 1e-4 and abs(got[g]["log_likelihood"] - likelihood) < 1e-6 * max(1, abs(likelihood)), g
    out = power.power_transformed(df, "r", "v", kind, fitted=fitted)
    assert out.columns == ["symbol", "r", "v"] and out.count() == len(rows) + len(odd)
    got_log = np.sort(out.where("symbol = 'log' and v is not null").toPandas()["v"])
    x = groups["log"] - groups["log"].min() + 1 if kind == "box_cox" else groups["log"]
    np.testing.assert_allclose(got_log, np.sort(_transformed(x, got["log"]["lambda"], kind)), rtol=1e-9, atol=1e-12)
    assert out.where("symbol in ('same', 'single', 'void') and v is not null").count() == 0


def test_whole_tables_empty_tables_and_other_kinds(spark):
    df = spark.createDataFrame([(float(x),) for x in range(1, 40)], "r double")
    one = power.fit_power(df, "r", "yeo_johnson", Series((), ())).collect()
    assert len(one) == 1 and abs(one[0]["lambda"] - _best(np.arange(1.0, 40), "yeo_johnson")[0]) < 1e-4
    none = spark.createDataFrame([], "symbol string, r double")
    assert power.fit_power(none, "r").count() == 0 and power.power_transformed(none, "r", "v").count() == 0
    with pytest.raises(ValueError, match="kind"):
        power.fit_power(df, "r", "log")
