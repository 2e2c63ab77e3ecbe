"""Compiles expressions into a DataFrame plan, a level of the trees at a time.

Equal subtrees of all expressions become one column (two equal window expressions in a plan are computed twice, so this
has to be done here). All window operators of a level share one Window node, and so do their normalising deviations;
every level stays on the partitioning and order of the first, so that a plan without recursive operators has a single
exchange. The recursive operators of a level run together in one pass over sorted partitions that holds one Arrow batch
and the states of one series, never a whole series.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import ROW, Series
from ..functions.registry import RECURSIVE, lookup
from .expr import Call, Const, ExpressionError, Feature, Node, depth, features_of, parse, walk

#: Rows of the normalising deviation.
NORM_WINDOW = 2000
BLOCK, IN_BLOCK = "__block", "__in_block"


# Expressions that repeat for every factor are SQL text, as a wide plan would otherwise spend seconds on building Columns.


def _named(c: str) -> str:
    return f"`{c}`"


def _cleaned(x: str, name: str) -> str:
    """``frames.clean`` as text."""
    x = f"CAST({x} AS DOUBLE)"
    return f"CASE WHEN {x} IS NULL OR isnan({x}) OR abs({x}) = double('Infinity') THEN 0D ELSE {x} + 0D END AS {_named(name)}"


def _deviation(c: str, series: Series, t: int) -> str:
    part = f"PARTITION BY {', '.join(map(_named, series.keys))} " if series.keys else ""
    order = ", ".join(map(_named, series.order))
    return f"stddev_samp({_named(c)}) OVER ({part}ORDER BY {order} ROWS BETWEEN {t - 1} PRECEDING AND CURRENT ROW) AS {_named(c + '_s')}"


def _replaced(df: DataFrame, new: dict[str, str], drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the columns of ``new`` (name -> SQL with alias) in place of those of the same names."""
    return df.selectExpr(*[new.get(c, _named(c)) for c in df.columns if c not in drop])


def _run_recursive(df: DataFrame, series: Series, jobs: dict[str, tuple[Callable, list[str | float]]]) -> DataFrame:
    """Adds a column for each job (name -> (make state, argument columns or constants))."""
    keys = list(series.keys)
    schema = T.StructType([*df.schema.fields, *[T.StructField(name, T.DoubleType()) for name in jobs]])

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, states = None, {}
        for batch in batches:
            n = batch.num_rows
            key_rows = list(zip(*[batch.column(k).to_pylist() for k in keys])) if keys else [()] * n
            starts = [i for i in range(n) if i == 0 or key_rows[i] != key_rows[i - 1]]
            inputs = {a: batch.column(a).to_pylist() for _, args in jobs.values() for a in args if isinstance(a, str)}
            out: dict[str, list[float]] = {name: [] for name in jobs}
            for a, z in zip(starts, [*starts[1:], n]):
                if current is None or key_rows[a] != current:
                    current = key_rows[a]
                    states = {name: make() for name, (make, _) in jobs.items()}
                for name, (_, args) in jobs.items():
                    step = states[name].step
                    columns = [inputs[x][a:z] if isinstance(x, str) else [x] * (z - a) for x in args]
                    out[name] += map(step, *columns)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(v, pa.float64()) for v in out.values()]], names=[*batch.schema.names, *out]
            )

    dealt = df.repartition(*keys) if keys else df.coalesce(1)
    return dealt.sortWithinPartitions(*keys, *series.order).mapInArrow(of_partition, schema)


def with_long_deviation(df: DataFrame, series: Series, columns: dict[str, str], t: int, means: dict[str, str] | None = None) -> DataFrame:
    """Rolling sample deviations, and means where wanted (column -> name of the result), over long frames, linear in the rows.

    Rows are cut into blocks of ``t``. A frame is the end of one block and the beginning of the next, so its moments are
    merged from running moments inside blocks, forwards and backwards. No running totals are subtracted, so no digits
    are lost, and means are taken from each block's first value, so that a constant frame has exactly no deviation.
    """
    cut = df.withColumn(BLOCK, F.floor((F.col(ROW) - 1) / t)).withColumn(IN_BLOCK, (F.col(ROW) - 1) % t)
    block = Window.partitionBy(*series.keys, BLOCK)
    ahead = block.orderBy(IN_BLOCK).rowsBetween(Window.unboundedPreceding, 0)
    back = block.orderBy(F.desc(IN_BLOCK)).rowsBetween(Window.unboundedPreceding, 0)

    def moments(x: str, w) -> Column:
        n, first = F.count(x).over(w).cast("double"), F.col(f"__f_{x}")
        mean = first + F.avg(F.col(x) - first).over(w)
        return F.struct(n.alias("n"), mean.alias("m"), (F.var_pop(x).over(w) * n).alias("q"))

    cut = cut.withColumns({f"__f_{x}": F.first(x).over(ahead) for x in columns})
    cut = cut.withColumns({f"__a_{x}": moments(x, ahead) for x in columns})
    cut = cut.withColumns({f"__b_{x}": moments(x, back) for x in columns})
    # The frame's part in the block before: what stands from t-1 rows ago to that block's end.
    cut = cut.withColumns({f"__p_{x}": F.lag(f"__b_{x}", t - 1).over(series.plain) for x in columns})
    out = {}
    for x, name in columns.items():
        a, p = F.col(f"__a_{x}"), F.col(f"__p_{x}")
        both = p.isNotNull() & (F.col(IN_BLOCK) < t - 1)
        n = F.when(both, a["n"] + p["n"]).otherwise(a["n"])
        q = F.when(both, a["q"] + p["q"] + (a["m"] - p["m"]) * (a["m"] - p["m"]) * a["n"] * p["n"] / (a["n"] + p["n"])).otherwise(a["q"])
        out[name] = F.when(n > 1, F.sqrt(q / (n - 1)))
        if means and x in means:
            out[means[x]] = F.when(both, a["m"] + (p["m"] - a["m"]) * p["n"] / n).otherwise(a["m"])
    return cut.withColumns(out).drop(BLOCK, IN_BLOCK, *[f"__{k}_{x}" for k in "abfp" for x in columns])


def compile_factors(
    df: DataFrame,
    factors: dict[str, str | Node],
    series: Series = Series(),
    norm_window: int = NORM_WINDOW,
    long_frames: bool = True,
    keep: list[str] | None = None,
    longest: int | None = None,
) -> DataFrame:
    """``df`` (its series columns and ``keep``) with one double column for each factor (name -> expression).

    ``long_frames`` takes the linear form of the normalising deviation; the other reads the whole frame for every row. A caller
    who knows that no series has more rows than ``longest`` gets the other form wherever frames reach no further than that, as
    it needs fewer sorts; both give equal results.
    Nulls, NaN and infinities in features count as 0, and no factor holds any.
    """
    long_frames = long_frames and (longest is None or longest > norm_window)
    trees = {name: parse(x) if isinstance(x, str) else x for name, x in factors.items()}
    missing = sorted({f for t in trees.values() for f in features_of(t)} - set(df.columns))
    if missing:
        raise ExpressionError(f"no features named {missing}")
    kept = [c for c in dict.fromkeys([*series.keys, *series.order, *(keep or [])])]
    nodes = sorted({x for t in trees.values() for x in walk(t)}, key=depth)
    column = {x: f"__n{k}" for k, x in enumerate(nodes)}
    features = [x for x in nodes if isinstance(x, Feature)]
    now = df.selectExpr(*map(_named, kept), *[_cleaned(_named(x.name), column[x]) for x in features])
    now = now.withColumn(ROW, F.row_number().over(series.plain))

    def value(x: Node) -> Column:
        return F.lit(x.value) if isinstance(x, Const) else F.col(column[x])

    for level in range(1, max(map(depth, nodes), default=0) + 1):
        here = [x for x in nodes if isinstance(x, Call) and depth(x) == level]
        jobs = {
            column[x]: (lookup(x.name).build, [a.value if isinstance(a, Const) else column[a] for a in x.args])
            for x in here
            if lookup(x.name).kind == RECURSIVE
        }
        if jobs:
            now = _run_recursive(now, series, jobs)
        built = {column[x]: lookup(x.name).build(series, *map(value, x.args)) for x in here if column[x] not in jobs}
        if built:
            now = now.withColumns(built)
        now = _replaced(now, {column[x]: _cleaned(_named(column[x]), column[x]) for x in here})
        scaled = [column[x] for x in here if lookup(x.name).normalised]
        if scaled:
            if long_frames:
                now = with_long_deviation(now, series, {c: f"{c}_s" for c in scaled}, norm_window)
            else:
                now = now.selectExpr("*", *[_deviation(c, series, norm_window) for c in scaled])
            over = {c: _cleaned(f"try_divide({_named(c)}, {_named(c + '_s')})", c) for c in scaled}
            now = _replaced(now, over, tuple(f"{c}_s" for c in scaled))
    return now.select(*kept, *[value(t).cast("double").alias(name) for name, t in trees.items()])


def evaluate_last(df: DataFrame, factors: dict[str, str], series: Series = Series(), **options) -> tuple[DataFrame, dict[str, str]]:
    """(values, errors): the latest value of each factor in each series; factors that can't be read, with the reason."""
    good, errors = {}, {}
    for name, text in factors.items():
        try:
            tree = parse(text)
            if missing := sorted(features_of(tree) - set(df.columns)):
                raise ExpressionError(f"no features named {missing}")
            good[name] = tree
        except ExpressionError as wrong:
            errors[name] = str(wrong)
    values = compile_factors(df, good, series, **options)
    newest = F.struct(*series.order)
    latest = [F.max_by(c, newest).alias(c) for c in good]
    grouped = values.groupBy(*series.keys)
    return grouped.agg(*[F.max(c).alias(c) for c in series.order], *latest), errors
