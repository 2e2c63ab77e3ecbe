"""The table of operators and how users add their own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCALAR_OR_WINDOW, RECURSIVE = "column", "recursive"


@dataclass(frozen=True)
class Operator:
    """``build``: for kind "column", (series, *columns) -> Column; for "recursive", () -> an object whose ``step(*values)``
    takes one row and returns one float (NaN while there is no value)."""

    name: str
    arity: int
    kind: str
    build: Callable
    normalised: bool = True
    active: bool = True


OPERATORS: dict[str, Operator] = {}


def operator(name: str, arity: int, normalised: bool = True, active: bool = True) -> Callable:
    """Registers a builder of Columns."""

    def add(build: Callable) -> Callable:
        OPERATORS[name] = Operator(name, arity, SCALAR_OR_WINDOW, build, normalised, active)
        return build

    return add


def family(prefix: str, arity: int, periods: tuple[int, ...], active: bool = True) -> Callable:
    """Registers ``{prefix}_{t}`` for each period of a builder that takes the period after the series."""

    def add(build: Callable) -> Callable:
        for t in periods:
            OPERATORS[f"{prefix}_{t}"] = Operator(
                f"{prefix}_{t}", arity, SCALAR_OR_WINDOW, lambda s, *x, t=t: build(s, t, *x), True, active
            )
        return build

    return add


def recursive(prefix: str, arity: int, periods: tuple[int, ...] = (), active: bool = True) -> Callable:
    """Registers a class of recursive state, one operator for each period (or one without)."""

    def add(state: type) -> type:
        if not periods:
            OPERATORS[prefix] = Operator(prefix, arity, RECURSIVE, state, True, active)
        for t in periods:
            OPERATORS[f"{prefix}_{t}"] = Operator(f"{prefix}_{t}", arity, RECURSIVE, lambda t=t: state(t), True, active)
        return state

    return add


def lookup(name: str) -> Operator:
    from . import cumulative, recursive, rolling, scalar  # noqa: F401  they fill the table

    if name not in OPERATORS:
        raise KeyError(f"no operator named {name!r}")
    return OPERATORS[name]


def active_operators() -> list[Operator]:
    from . import cumulative, recursive, rolling, scalar  # noqa: F401

    return [op for op in OPERATORS.values() if op.active]


def _closure_frame(spark: SparkSession, arity: int, value: float, rows: int = 10) -> DataFrame:
    return spark.range(rows, numPartitions=1).select(
        F.lit("s").alias("symbol"), F.col("id").alias("ts"), *[F.lit(value).alias(f"x{i}") for i in range(arity)]
    )


def register_operator(
    spark: SparkSession,
    name: str,
    arity: int,
    build: Callable[..., Column],
    normalised: bool = True,
    check: bool = True,
) -> Operator:
    """Adds a user's operator after the closure checks: rows of ones, zeros and minus ones give as many finite values.

    ``build`` gets (series, *columns) and returns a Column; a Python body may be wrapped as a pandas UDF in it.
    """
    from .frames import ROW, Series

    if not isinstance(arity, int) or isinstance(arity, bool) or arity < 1:
        raise ValueError(f"arity must be a positive integer, not {arity!r}")
    if not name.isidentifier():
        raise ValueError(f"{name!r} is no name for an operator")
    for value in (1.0, 0.0, -1.0) if check else ():
        series = Series()
        rows = _closure_frame(spark, arity, value).withColumn(ROW, F.row_number().over(series.plain))
        try:
            # Straight from the builder: compiled factors would have bad numbers replaced.
            out = rows.select(build(series, *[F.col(f"x{i}") for i in range(arity)]).cast("double").alias("y"))
            got = out.agg(F.count("y").alias("n"), F.count_if(F.isnan("y") | (F.abs("y") == float("inf"))).alias("bad")).first()
        except Exception as wrong:
            raise ValueError(f"{name} can't be evaluated: {wrong}") from wrong
        if got["n"] != 10 or got["bad"]:
            raise ValueError(f"{name} isn't closed over a column of {value}: {got['n']} values, {got['bad']} not finite")
    OPERATORS[name] = Operator(name, arity, SCALAR_OR_WINDOW, build, normalised)
    return OPERATORS[name]
