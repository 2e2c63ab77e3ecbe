"""Row-local operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .frames import Series
from .registry import operator

#: Denominators and logarithms within this distance of zero are replaced.
NEAR_ZERO = 0.001


@operator("add", 2, normalised=False)
def add(_: Series, a: Column, b: Column) -> Column:
    return a + b


@operator("sub", 2, normalised=False)
def sub(_: Series, a: Column, b: Column) -> Column:
    return a - b


@operator("mul", 2, normalised=False)
def mul(_: Series, a: Column, b: Column) -> Column:
    return a * b


@operator("div", 2, normalised=False)
def div(_: Series, a: Column, b: Column) -> Column:
    return F.when(F.abs(b) > NEAR_ZERO, a / b).otherwise(F.lit(1.0))


@operator("sqrt", 1, normalised=False)
def sqrt(_: Series, a: Column) -> Column:
    return F.sqrt(F.abs(a))


@operator("log", 1, normalised=False)
def log(_: Series, a: Column) -> Column:
    return F.when(F.abs(a) > NEAR_ZERO, F.log(F.abs(a))).otherwise(F.lit(0.0))


@operator("neg", 1, normalised=False)
def neg(_: Series, a: Column) -> Column:
    return -a


@operator("inv", 1, normalised=False)
def inv(_: Series, a: Column) -> Column:
    return F.when(F.abs(a) > NEAR_ZERO, F.lit(1.0) / a).otherwise(F.lit(0.0))


@operator("abs", 1, normalised=False)
def absolute(_: Series, a: Column) -> Column:
    return F.abs(a)


@operator("max", 2, normalised=False)
def larger(_: Series, a: Column, b: Column) -> Column:
    return F.greatest(a, b)


@operator("min", 2, normalised=False)
def smaller(_: Series, a: Column, b: Column) -> Column:
    return F.least(a, b)


@operator("sin", 1, normalised=False)
def sin(_: Series, a: Column) -> Column:
    return F.sin(a)


@operator("cos", 1, normalised=False)
def cos(_: Series, a: Column) -> Column:
    return F.cos(a)


@operator("tan", 1, normalised=False)
def tan(_: Series, a: Column) -> Column:
    return F.tan(a)


@operator("sig", 1, active=False)
def sig(_: Series, a: Column) -> Column:
    """Logistic function; as a probability it is taken before normalisation (see the classifier)."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-a))


@operator("tanh", 1)
def tanh(_: Series, a: Column) -> Column:
    return F.tanh(a)


@operator("elu", 1)
def elu(_: Series, a: Column) -> Column:
    return F.when(a > 0, a).otherwise(F.exp(a) - F.lit(1.0))


@operator("TA_BOP", 4)
def balance_of_power(_: Series, o: Column, h: Column, low: Column, c: Column) -> Column:
    return F.when(h - low > 0, (c - o) / (h - low)).otherwise(F.lit(0.0))
