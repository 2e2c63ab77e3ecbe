"""Operators over all bars so far."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .frames import Series
from .registry import operator


@operator("TA_AD", 4, active=False)
def accumulation(s: Series, h: Column, low: Column, c: Column, v: Column) -> Column:
    place = F.when(h - low > 0, ((c - low) - (h - c)) / (h - low)).otherwise(F.lit(0.0))
    return F.sum(place * v).over(s.upto)


@operator("TA_OBV", 2, active=False)
def on_balance_volume(s: Series, price: Column, v: Column) -> Column:
    """Volume added on rises and taken off on falls; starts with the first bar's volume."""
    step = price - F.lag(price).over(s.plain)
    return F.sum(F.when(step.isNull() | (step > 0), v).when(step < 0, -v).otherwise(F.lit(0.0))).over(s.upto)


def running_sum(s: Series, x: Column) -> Column:
    return F.sum(x).over(s.upto)
