"""Registered queries against their SQL, on the smallest tables."""

import duckdb
import pytest

from factorloom.operators import mining
from factorloom.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = ("events", "lineitem", "orders")


def cell(x):
    if x is None or x != x:
        return "-"
    return f"{x:.5g}" if isinstance(x, float) else str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    found = duck.execute(SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(got.columns)
    rows = sorted(tuple(cell(r[c]) for c in sorted(names)) for r in got.collect())
    place = sorted(range(len(names)), key=lambda k: names[k])
    want = sorted(tuple(cell(r[k]) for k in place) for r in found.fetchall())
    assert rows == want


def test_settings_of_a_run():
    raw = {"sampling": {"coarse": 7200, "step": 900, "horizon_steps": 8, "window": 200}, "train": ["2025-08-01", "2025-09-01"], "test": ["2025-09-01", "2025-10-01"], "evolve": {"population": 20, "hall_of_fame": 10, "components": 5}}
    config = mining.MiningConfig.from_dict(raw)
    assert config.horizon == 7200 and config.evolve.population == 20 and config.train == ("2025-08-01", "2025-09-01") and config.scoring.periods == 365 * 96
    with pytest.raises(ValueError, match="no settings"):
        mining.MiningConfig.from_dict(raw | {"tournament": 3})


def test_settings_from_yaml(tmp_path):
    yaml = pytest.importorskip("yaml")
    raw = {"sampling": {"coarse": 7200, "step": 900, "horizon_steps": 8, "window": 200}, "train": ["2025-08-01", "2025-09-01"], "test": ["2025-09-01", "2025-10-01"], "metrics": ["avg_pic"]}
    (tmp_path / "run.yaml").write_text(yaml.safe_dump(raw))
    config = mining.MiningConfig.from_yaml(str(tmp_path / "run.yaml"))
    assert config == mining.MiningConfig.from_dict(raw) and config.metrics == ("avg_pic",)


def test_a_whole_run(spark):
    rows = QUERIES["mining_run"](spark, "/root/testdata/sf0.01").toPandas()
    assert len(rows) and rows.expression.nunique() <= 3
    assert {"fitness_avg_pic_train", "fitness_avg_pic_test", "given_ic_test", "fitness_sharp_train_pct_rank", "depth", "length"} <= set(rows.columns)
