"""Queries against their SQL on the smallest tables."""

import duckdb
import pytest

from factorloom.llm import oracles, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(oracles.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF)
    rows = sorted(map(repr, (tuple(r[c] for c in sorted(got.columns)) for r in got.collect())))
    found = con.execute(oracles.SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(got.columns)
    place = sorted(range(len(names)), key=lambda k: names[k])
    assert rows == sorted(repr(tuple(r[k] for k in place)) for r in found.fetchall())
