"""Scores against NumPy and pandas."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.operators import backtest, metrics

S = metrics.Scoring(periods=365, window=20)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.RandomState(42)
    parts = []
    for symbol, n in (("a", 203), ("b", 97)):
        y = rng.standard_t(3, n) * 0.02
        parts.append(pd.DataFrame({"symbol": symbol, "ts": np.arange(n), "y": y, "good": y + rng.randn(n) * 0.01, "bad": -y + rng.randn(n) * 0.01, "ties": np.round(y, 2)}))
    pdf = pd.concat(parts, ignore_index=True)
    return pdf, spark.createDataFrame(pdf.sample(frac=1, random_state=0))


NAMES = ["good", "bad", "ties"]


def table(df, names):
    got = metrics.evaluate(df, NAMES, names, "y", scoring=S).toPandas()
    assert len(got) == 6
    return got.set_index(["factor", "symbol"])


def each(pdf):
    for symbol, d in pdf.groupby("symbol"):
        for f in NAMES:
            yield (f, symbol), d.y.to_numpy(), d[f].to_numpy()


def rank(x):
    return pd.Series(x).rank().to_numpy()


def test_fits_and_ranks(data):
    pdf, df = data
    got = table(df, ["weighted_pearson", "weighted_spearman", "mean_absolute_error", "root_mean_square_error", "avg_pic", "avg_sic"])
    for key, y, p in each(pdf):
        r = got.loc[key]
        assert r.weighted_pearson == pytest.approx(abs(np.corrcoef(y, p)[0, 1]))
        assert r.weighted_spearman == pytest.approx(abs(np.corrcoef(rank(y), rank(p))[0, 1]))
        assert r.mean_absolute_error == pytest.approx(np.abs(y - p).mean()) and r.root_mean_square_error == pytest.approx(math.sqrt(((y - p) ** 2).mean()))
        parts = list(zip(np.array_split(y, 5), np.array_split(p, 5)))
        assert r.avg_pic == pytest.approx(np.mean([np.corrcoef(a, b)[0, 1] for a, b in parts]))
        assert r.avg_sic == pytest.approx(np.mean([np.corrcoef(rank(a), rank(b))[0, 1] for a, b in parts]))


def test_paths(data):
    pdf, df = data
    got = table(df, ["max_dd", "avg_mdd", "calmar", "sharp"])
    for key, y, p in each(pdf):
        r = np.clip(y, -0.2, 0.2) * np.clip(p, -20, 20)
        pnl = r.cumsum()
        drop = (pnl - np.maximum.accumulate(pnl)).min()
        assert got.loc[key].max_dd == pytest.approx(drop, abs=1e-12)
        assert got.loc[key].avg_mdd == pytest.approx(np.mean([(s - np.maximum.accumulate(s)).min() for s in np.array_split(pnl, 5)]), abs=1e-12)
        assert got.loc[key].sharp == pytest.approx(r.mean() / r.std() * math.sqrt(365))
        assert got.loc[key].calmar == pytest.approx(r.mean() * 365 / -drop) if drop else math.isinf(got.loc[key].calmar)


def test_margins_prefer_the_good_predictor(data):
    pdf, df = data
    names = ["extreme_wrong_sign_penalty", "weighted_margin_score", "asym_extreme_direction_score"]
    got = table(df, names)
    for symbol in "ab":
        assert (got.loc[("good", symbol)] > got.loc[("bad", symbol)]).all()
    for key, y, p in each(pdf):
        yc = np.clip(y, *np.quantile(y, [0.01, 0.99]))
        thr = np.quantile(np.abs(yc), 0.95)
        ext, m = np.abs(yc) >= thr, p * yc
        w = np.where(ext, 1 + np.abs(yc) / (thr + 1e-12), 1)
        reward = (y * np.sign(p)).mean()
        assert got.loc[key].extreme_wrong_sign_penalty == pytest.approx(reward - ((m < 0) * w * ext).mean())
        assert got.loc[key].weighted_margin_score == pytest.approx(reward - (w * np.maximum(0, -m)).mean())


def test_information(data):
    pdf, df = data
    got = table(df, ["mi_score", "entropy_gain_score"])

    def bins(x):
        e = np.unique(np.quantile(x, np.linspace(0, 1, 17)))
        return np.digitize(x, e[1:-1], right=True) if len(e) > 2 else np.zeros(len(x), int)

    for key, y, p in each(pdf):
        if key[0] == "ties":
            continue  # values on an edge may fall either way between engines
        a, b = bins(p), bins(y)
        joint = np.zeros((a.max() + 1, b.max() + 1))
        np.add.at(joint, (a, b), 1 / len(y))
        pa, pb = joint.sum(1), joint.sum(0)
        mi = np.sum(joint * np.log((joint + 1e-12) / (pa[:, None] * pb + 1e-12)))
        ha, hb = (-np.sum(v * np.log(v + 1e-12)) for v in (pa, pb))
        assert got.loc[key].mi_score == pytest.approx(mi / math.sqrt(ha * hb), rel=2e-2)
        assert got.loc[key].entropy_gain_score == pytest.approx(mi / hb, rel=2e-2)


def test_ranges_and_given_range(data):
    pdf, df = data
    long = metrics.long_form(df, NAMES, "y", S)
    got = metrics.range_metrics(long, S).toPandas().set_index(["factor", "symbol"])
    bounds = metrics.range_metrics(long, S).select("factor", "symbol", F.col("max_ic_up").alias("up"), F.col("max_ic_dn").alias("dn"))
    given = metrics.given_range_ic(long, bounds, S).toPandas().set_index(["factor", "symbol"])
    for key, y, p in each(pdf):
        order = np.argsort(p, kind="stable")
        ics = [np.corrcoef(rank(p[k]), rank(y[k]))[0, 1] if len(set(p[k])) > 1 else -9 for k in np.array_split(order, 5)]
        best = int(np.argmax(ics))
        assert got.loc[key].max_ic_value == pytest.approx(ics[best]) and got.loc[key].max_ic_group == best + 1
        inside = (p >= got.loc[key].max_ic_dn) & (p <= got.loc[key].max_ic_up)
        if inside.sum() > 20:
            assert given.loc[key].given_ic == pytest.approx(np.corrcoef(rank(p[inside]), rank(y[inside]))[0, 1])
        else:
            assert math.isnan(given.loc[key].given_ic)


def test_positions(data):
    pdf, df = data
    got = table(df, ["sharpe_fixed_threshold", "sharpe_std_threshold"])
    for key, y, p in each(pdf):
        x = pd.Series(p)
        hi, lo = x.rolling(20).quantile(0.9), x.rolling(20).quantile(0.1)
        r = np.select([x > hi, x < lo], [1, -1], 0) * np.clip(y, -0.2, 0.2)
        assert got.loc[key].sharpe_fixed_threshold == pytest.approx(r.mean() / r.std() * math.sqrt(365), rel=1e-6)


def test_user_metrics(data):
    _, df = data
    metrics.register_metric("hit_rate", lambda y, p, w: F.avg(F.when((y > 0) == (p > 0), 1.0).otherwise(0.0)))
    got = table(df, ["hit_rate"])
    assert got.loc[("good", "a")].hit_rate > 0.7 > 0.4 > got.loc[("bad", "a")].hit_rate
    with pytest.raises(ValueError):
        metrics.register_metric("not a name", lambda y, p, w: F.avg(y))
    with pytest.raises(ValueError):
        metrics.register_metric("constant", lambda y, p, w: 1.0)
    metrics.METRICS.pop("hit_rate")
    with pytest.raises(ValueError, match="no metrics"):
        table(df, ["hit_rate"])


def test_correlations(data):
    pdf, df = data
    got = {(r["a"], r["b"]): r["r"] for r in backtest.correlations(df, NAMES).collect()}
    want = pdf[NAMES].corr()
    assert all(got[k] == pytest.approx(want.loc[k]) for k in got) and len(got) == 3


def test_constant_factor(spark):
    df = spark.createDataFrame([("s", k, 0.01 * (k % 3 - 1), 1.0) for k in range(60)], "symbol string, ts int, y double, flat double")
    row = metrics.evaluate(df, ["flat"], [m for m in metrics.METRICS], "y", scoring=S).first().asDict()
    assert row["avg_pic"] is None and row["weighted_pearson"] == 0 and row["mi_score"] == 0 and row["max_ic_value"] is None
