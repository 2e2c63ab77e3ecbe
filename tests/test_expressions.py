"""Reading, printing and drawing expressions, and the shape of compiled plans."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factorloom.functions import active_operators
from factorloom.plans import Call, Const, Feature, compile_factors, depth, evaluate_last, length, parse, to_dot, to_text
from factorloom.plans.expr import ExpressionError

OPS = active_operators()
leaves = st.one_of(st.sampled_from("ohlc").map(Feature), st.floats(-5, 5, allow_nan=False).map(Const))
trees = st.recursive(
    leaves,
    lambda inner: st.sampled_from(OPS).flatmap(lambda op: st.lists(inner, min_size=op.arity, max_size=op.arity).map(lambda a: Call(op.name, tuple(a)))),
    max_leaves=8,
)


@settings(max_examples=60, deadline=None)
@given(trees)
def test_printed_trees_read_back(tree):
    assert parse(to_text(tree)) == tree
    assert length(tree) >= depth(tree) + 1


@pytest.mark.parametrize("text", ["add(c)", "nothing(c)", "add(c, )", "add(c, o", "c d", "", "add(c; o)", "__import__('os')"])
def test_bad_expressions(text):
    with pytest.raises(ExpressionError):
        parse(text)


def test_sum_of_sums(spark):
    df = spark.createDataFrame([("s", k, float(k), 2.0 * k, 3.0) for k in range(3)], "symbol string, ts int, feature1 double, feature2 double, feature3 double")
    got = compile_factors(df, {"y": "add(add(feature1, feature2), add(feature3, feature2))"}).orderBy("ts").toPandas()
    assert got.y.tolist() == [3, 8, 13]


def test_drawing():
    dot = to_dot(parse("add(c, 0.5)"), faded={1})
    assert dot.startswith("digraph") and "0 -> 1;" in dot and "0 -> 2;" in dot and "#cecece" in dot


def test_missing_features(spark):
    df = spark.createDataFrame([("s", 1, 1.0)], "symbol string, ts int, c double")
    with pytest.raises(ExpressionError, match="absent"):
        compile_factors(df, {"y": "abs(absent)"})
    values, errors = evaluate_last(df, {"good": "abs(c)", "bad": "abs(absent)", "worse": "oops("})
    assert set(errors) == {"bad", "worse"} and values.first()["good"] == 1.0


def test_one_exchange_and_shared_subtrees(spark):
    df = spark.range(50).selectExpr("CAST(id % 3 AS STRING) AS symbol", "id AS ts", "rand(1) AS c")
    deep = {"a": "ts_std_10(ts_sma_8(c))", "b": "sub(ts_sma_8(c), ts_std_10(ts_sma_8(c)))"}
    out = compile_factors(df, deep)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    # One average for both expressions.
    assert plan.count("avg(") == compile_factors(df, {"a": "ts_std_10(ts_sma_8(c))"})._jdf.queryExecution().executedPlan().toString().count("avg(")
