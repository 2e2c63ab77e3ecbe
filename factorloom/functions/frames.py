"""Windows over ordered series, and the numeric guards that every operator shares."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

#: Name of the row-number column that the compiler adds; frames are gated by it instead of by a count of their own.
ROW = "__row"


@dataclass(frozen=True)
class Series:
    """Which columns make a series, and which put its rows in order."""

    keys: tuple[str, ...] = ("symbol",)
    order: tuple[str, ...] = ("ts",)

    @property
    def plain(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    @property
    def upto(self) -> WindowSpec:
        """All rows so far."""
        return self.plain.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    @property
    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.keys)

    def last(self, t: int) -> WindowSpec:
        """The latest ``t`` rows, the current one included."""
        return self.plain.rowsBetween(-(t - 1), Window.currentRow)

    def before(self, t: int) -> WindowSpec:
        """The ``t`` rows before the current one."""
        return self.plain.rowsBetween(-t, -1)

    @property
    def row(self) -> Column:
        """1 for the first row of a series, and so on."""
        return F.col(ROW)

    def enough(self, value: Column, rows: int) -> Column:
        """``value`` where that many rows have been seen, else 0."""
        return F.when(self.row >= rows, value).otherwise(F.lit(0.0))


def clean(x: Column) -> Column:
    """Null, NaN and infinities become 0; negative zero becomes zero."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(x.cast("double") + F.lit(0.0))


def ratio(top: Column, bottom: Column) -> Column:
    """Division that gives null over zero (divisions raise under ANSI rules)."""
    return F.try_divide(top, bottom)
