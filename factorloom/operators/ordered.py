"""Ranks and quantiles of whole groups, however large: values in order over all tasks.

Equal values are counted first, before anything is shuffled. The distinct values are then dealt by ranges of (group, value),
summed up in each partition, and the sums of the partitions before are added, for the groups that go on from one
partition to the next. So a group is spread over as many tasks as its values need, ties are one row and stay together, and no
task keeps a group's values in memory, as ``percentile`` and a window over the whole table do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import ROW, Series
from ..plans.longseries import numbered

NAME, VALUE, COUNT, BEFORE, TOTAL = "__name", "__value", "__count", "__before", "__total"


def value_counts(df: DataFrame, columns: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, NAME, VALUE, COUNT, BEFORE): the distinct values, as doubles, of each column and group, with the number of
    rows that have them and of rows with a smaller value. Nulls are left out; NaN is greater than all others. Both zeros are one."""
    doubles = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    long = doubles.unpivot(list(keys), columns, NAME, VALUE).where(F.col(VALUE).isNotNull())
    counts = long.groupBy(*keys, NAME, VALUE).agg(F.count("*").alias(COUNT))
    summed = numbered(counts, Series((*keys, NAME), (VALUE,)), COUNT)
    return summed.withColumn(BEFORE, F.col(ROW) - F.col(COUNT)).drop(ROW)


def _met(rows: DataFrame, others: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``others`` that has equal ``names``, nulls included."""
    if not names:
        return rows.join(others, how=how)
    renamed = others.withColumnsRenamed({k: f"__o_{k}" for k in names})
    on = [F.col(k).eqNullSafe(F.col(f"__o_{k}")) for k in names]
    return rows.join(renamed, on, how).drop(*[f"__o_{k}" for k in names])


def _with_totals(counts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    names = [*keys, NAME]
    return _met(counts, counts.groupBy(*names).agg(F.sum(COUNT).alias(TOTAL)), names)


def exact_quantiles(df: DataFrame, columns: dict[str, str], probabilities: list[float], keys: tuple[str, ...] = (), longest: int | None = None) -> DataFrame:
    """(keys, one array for each column): the interpolated quantiles of every group, as ``percentile`` gives them.

    ``columns`` maps columns to the names of their results. A group without values has null instead of an array; an empty table
    gives no row, or, without ``keys``, one row of nulls. A caller who knows that no group has more than ``longest`` rows, and that
    an executor can hold as many, says so and gets ``percentile``, one aggregate without the order; the values are the same.
    """
    if not probabilities or not all(0 <= q <= 1 for q in probabilities):
        raise ValueError("probabilities must be from 0 to 1")
    if longest is not None:
        grid = F.array(*[F.lit(float(q)) for q in probabilities])
        return df.groupBy(*keys).agg(*[F.percentile(F.col(c).cast("double"), grid).alias(out) for c, out in columns.items()])
    counts = _with_totals(value_counts(df, list(columns), keys), keys)
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(q)) * (F.col(TOTAL) - 1)).alias("at")) for i, q in enumerate(probabilities)])
    holds = lambda place: (place >= F.col(BEFORE)) & (place < F.col(BEFORE) + F.col(COUNT))
    # At most two values for each probability go on from here.
    near = counts.withColumn("__w", F.explode(F.filter(wanted, lambda w: holds(F.floor(w["at"])) | holds(F.ceil(w["at"])))))
    low, high = F.floor("__w.at"), F.ceil("__w.at")
    ends = near.groupBy(*keys, NAME, "__w").agg(F.max(F.when(holds(low), F.col(VALUE))).alias("__a"), F.max(F.when(holds(high), F.col(VALUE))).alias("__z"))
    value = F.when(F.col("__a") == F.col("__z"), F.col("__a")).otherwise((high - F.col("__w.at")) * F.col("__a") + (F.col("__w.at") - low) * F.col("__z"))
    pairs = ends.withColumn("__v", F.struct(F.col("__w.i").alias("i"), value.alias("v")))
    of = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(NAME) == c, F.col("__v")))), lambda x: x["v"])
    found = pairs.groupBy(*keys).agg(*[F.when(F.count_if(F.col(NAME) == c) > 0, of(c)).alias(out) for c, out in columns.items()])
    # Groups in which every value is null have no counts.
    return _met(df.select(*keys).distinct(), found, list(keys), "left") if keys else found


def with_ranks(df: DataFrame, columns: dict[str, str], keys: tuple[str, ...] = (), percent: bool = True) -> DataFrame:
    """``df`` with the average rank from 1 of each column's values in their group, over their number if ``percent``.

    ``columns`` maps columns to the names of their ranks. Null has a null rank, NaN the last. Ranks are computed once for a
    distinct value and joined to the rows; a value that many rows share is one row on its side of that join, which adaptive
    execution splits on the other.
    """
    counts = _with_totals(value_counts(df, list(columns), keys), keys)
    rank = F.col(BEFORE) + (F.col(COUNT) + 1) / 2.0
    ranks = counts.select(*[F.col(k).alias(f"__k_{k}") for k in keys], NAME, VALUE, ((rank / F.col(TOTAL)) if percent else rank).alias("__rank"))
    for c, out in columns.items():
        one = ranks.where(F.col(NAME) == c).select(*[f"__k_{k}" for k in keys], F.col(VALUE).alias("__v"), F.col("__rank").alias(out))
        on = F.col(c).cast("double") == F.col("__v")
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        df = df.join(one, on, "left").drop("__v", *[f"__k_{k}" for k in keys])
    return df


def top_shared(df: DataFrame, a: str, b: str, k: Column) -> DataFrame:
    """One row (top, shared): the rows among the first ``k`` by ``a`` falling, then by ``b``, and those that are among the first ``k``
    by ``b`` falling, then by ``a``, too. ``k`` may use TOTAL, the number of rows. Of equal rows the same ones come first in both orders.
    """
    pairs = df.select(F.lit(0).alias(NAME), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).groupBy(NAME, "a", "b").agg(F.count("*").alias(COUNT))
    of = lambda rows, first, then, out: numbered(rows.withColumn("__o", -F.col(first)), Series((NAME,), ("__o", then)), COUNT).withColumn(out, F.col(ROW) - F.col(COUNT)).drop(ROW, "__o")
    both = of(of(pairs, "a", "b", "pa"), "b", "a", "pb")
    whole = pairs.agg(F.sum(COUNT).alias(TOTAL))
    among = lambda before: F.greatest(F.lit(0), F.least(F.col(COUNT), k - F.col(before)))
    return both.join(F.broadcast(whole)).agg(F.sum(among("pa")).alias("top"), F.sum(F.least(among("pa"), among("pb"))).alias("shared"))
