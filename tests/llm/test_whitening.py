"""Whitening against NumPy over the whole table, and rows out of the ordinary."""

import math

import numpy as np
import pytest

from factorloom.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>"


def plain(vectors, components=8):
    """(whole numbers, deviations, whitened up to sign, shares) of lists of floats."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    y = [[n * c - s for c, s in zip(row, sums)] for row in x]
    c = np.array([[v / n for v in row] for row in y])
    covariance = c.T @ c / n
    e, axes = np.linalg.eigh(covariance)
    e, axes = e[::-1][:components], axes[:, ::-1][:, :components]
    return [sum(v * v for v in row) for row in y], c @ axes / np.sqrt(e), e / np.trace(covariance)


def vectors_of(seed, n, d, scale=1.0):
    r = np.random.default_rng(seed)
    return (r.normal(size=(n, d)) * np.geomspace(3, 0.5, d) * scale + r.normal(size=d) * 5).astype(np.float32).tolist()


@pytest.mark.parametrize("n, d", [(300, 12), (40, 3), (1000, 20)])
def test_against_numpy(spark, n, d):
    vectors = vectors_of(n, n, d)
    rows = whitening.whole_rows(spark.createDataFrame(list(enumerate(vectors)), SCHEMA))
    model = whitening.fit(rows)
    got = sorted(whitening.whiten(rows, model).collect())
    deviations, whitened, shares = plain(vectors)
    assert [g["deviation"] for g in got] == deviations
    w = np.array([g["whitened"] for g in got])
    assert w.shape == whitened.shape
    np.testing.assert_allclose(w * np.sign((w * whitened).sum(axis=0)), whitened, rtol=1e-7, atol=1e-8)
    np.testing.assert_allclose(model.explained, shares, rtol=1e-9)
    assert whitening.identity_error(whitening.whiten(rows, model), len(model.explained)) < 1e-9


def test_query(spark, sf_dir):
    rows = queries.op12_whitening(spark, sf_dir).toPandas()
    assert len(rows) == 500 * 8 and set(rows.component) == set(range(1, 9)) and set(rows.n) == {500}
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    deviations, whitened, shares = plain([r["embedding"] for r in table])
    wide = rows.pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    np.testing.assert_allclose(wide * np.sign((wide * whitened).sum(axis=0)), whitened, rtol=1e-6, atol=1e-8)
    assert rows.drop_duplicates("vec_id").sort_values("vec_id").deviation.tolist() == deviations
    np.testing.assert_allclose(rows.drop_duplicates("component").sort_values("component").explained, shares, rtol=1e-9)
    assert rows.identity_error.nunique() == 1 and rows.identity_error[0] < 1e-9


def test_odd_rows(spark):
    good = vectors_of(5, 30, 3)
    bad = [None, [], [1.0, None, 2.0], [math.nan, 0.0, 0.0], [math.inf, 0.0, 0.0], [1e30, 0.0, 0.0], [1.0, 2.0], [1.0, 2.0, 3.0, 4.0]]
    table = [(None if k % 5 == 0 else k // 2, v) for k, v in enumerate(good + bad + good)]
    df = spark.createDataFrame(table, SCHEMA)
    rows = whitening.whole_rows(df)
    model = whitening.fit(rows)
    got = whitening.whiten(rows, model).collect()
    assert len(got) == 60 and model.n == 60
    assert sorted(g["deviation"] for g in got) == sorted(plain(good + good)[0])


def test_without_variance(spark):
    for table in ([], [(1, None)], [(1, [1.0, 2.0])], [(k, [0.5, 0.25]) for k in range(9)], [(1, []), (2, [])]):
        rows = whitening.whole_rows(spark.createDataFrame(table, SCHEMA))
        model = whitening.fit(rows)
        got = whitening.whiten(rows, model).collect()
        assert all(g["whitened"] == [] and g["deviation"] == 0 for g in got) and model.explained == []
        assert len(got) == sum(v is not None for _, v in table)


def test_large_entries_are_exact(spark):
    vectors = [[2.0**40, 1.0], [-(2.0**40), 2.0], [2.0**20, 3.0], [0.0, 5.0]]
    rows = whitening.whole_rows(spark.createDataFrame(list(enumerate(vectors)), SCHEMA))
    want = [v if v < 1 << 63 else None for v in plain(vectors)[0]]
    got = sorted(whitening.whiten(rows, whitening.fit(rows)).collect())
    assert [g["deviation"] for g in got] == want and None in want


def test_clashing_columns(spark):
    names = ("row", "x", "size", "count", "k", "c", "deviation", "whitened")
    df = spark.createDataFrame([(k, v, *[f"own {x}" for x in names]) for k, v in enumerate(vectors_of(1, 20, 3))], f"{SCHEMA}, {', '.join(f'{x} string' for x in names)}")
    rows = whitening.whole_rows(df)
    got = whitening.whiten(rows, whitening.fit(rows)).collect()
    assert all(g[x] == f"own {x}" for g in got for x in names[:6]) and all(len(g["whitened"]) == 3 for g in got)
