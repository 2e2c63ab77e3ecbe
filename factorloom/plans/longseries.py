"""Factors over series longer than a task should read: every series is cut into blocks of rows, by their number.

Rows are numbered first: one exchange by ranges of (series, order), a count in each partition, and the counts of the partitions
before it, for the series that go on from one partition to the next. They are then dealt to blocks of ``block_rows``
rows, and a block also gets a copy of the rows just before it, its halo, as many as all the frames of a factor reach back
together. Framed operators and their deviations read a block as they read a series. Recursive operators with a form as affine
maps (``functions/scans.py``) take two passes: the map of each block, the states at all blocks' starts from the maps in
order, the values from those states; only then are halos dealt again. So the work of one series goes to as many tasks as it
has blocks, and no task holds more than a block and its halo. Operators without such a form run over whole series, one task for
each, as ``compile_factors`` runs them, and between the blocks of the others.

Tasks grow in number with the rows, so that none sorts many more than ``TASK_ROWS`` or a block. Exchanges say how many; those
that leave it to Spark are made few and large by compressed size, which says little about a task's memory.

Numbered rows and the rows before a scan are checkpointed (``spark.checkpoint.dir``), since both passes have to see the same blocks.
Rows of a series with equal order are in one order, whichever it is, for all operators.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import ROW, Series
from ..functions.registry import RECURSIVE, lookup
from ..functions.scans import Scan, scan_of
from .compile import NORM_WINDOW, _cleaned, _named, _replaced, _run_recursive, with_long_deviation
from .expr import Call, Const, ExpressionError, Feature, Node, depth, features_of, parse, walk

BLOCK_ROWS = 200_000
#: Rows that a task should get: whole blocks, several at a time if they are short.
TASK_ROWS = 50_000
CUT, HALO, PART, ALL, STATE = "__cut", "__halo", "__part", "__all", "__state"


def reach_of(tree: Node, norm_window: int) -> int:
    """How many rows before its own a value depends on through frames; states are carried and need none but the row before."""
    if not isinstance(tree, Call):
        return 0
    op = lookup(tree.name)
    t = tree.name.rpartition("_")[2]
    # No frame of an operator is longer than twice the number in its name; those without a number look one row back.
    own = 2 * int(t) if t.isdigit() and scan_of(tree.name) is None else 1
    return own + (norm_window if op.normalised else 0) + max((reach_of(x, norm_window) for x in tree.args), default=0)


def _cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the folder of ``spark.checkpoint.dir``; where that is unset, in one of its own, for a local master only."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="factorloom-"))
    return df.checkpoint()


def _changes(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """The places at which a run of equal values of ``columns`` begins, the first left out."""
    n = batch.num_rows
    new = np.zeros(max(n - 1, 0), bool)
    for c in columns:
        a, b = batch.column(c).slice(1), batch.column(c).slice(0, n - 1)
        new |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return np.flatnonzero(new) + 1


def _key(batch: pa.RecordBatch, columns: list[str], place: int) -> tuple:
    return tuple(batch.column(c)[place].as_py() for c in columns)


def _tasks(rows: int, block_rows: int, df: DataFrame) -> int:
    """How many tasks ``rows`` rows in blocks make: as many as they ask for, or as run at once if there are blocks for these."""
    blocks = -(-rows // block_rows)
    return max(1, -(-rows // max(TASK_ROWS, block_rows)), min(blocks, df.sparkSession.sparkContext.defaultParallelism))


def numbered(df: DataFrame, series: Series, weight: str | None = None, tasks: int | None = None) -> DataFrame:
    """``df`` with ``ROW``, the number of each row in its series from 1; or, of rows that stand for ``weight`` equal ones each, a whole
    number, that of the last of these."""
    keys = list(series.keys)

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            rows = np.empty(n, np.int64)
            stands = batch.column(weight).to_numpy(zero_copy_only=False) if weight else np.ones(n, np.int64)
            starts = [0, *_changes(batch, keys)]
            for a, z in zip(starts, [*starts[1:], n]):
                if last is None or (a, _key(batch, keys, a)) != (0, last):
                    count = 0
                rows[a:z] = count + np.cumsum(stands[a:z])
                count = int(rows[z - 1])
            last = _key(batch, keys, n - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows)], names=[*batch.schema.names, ROW])

    ranged = df.repartitionByRange(*([tasks] if tasks else []), *keys, *series.order).sortWithinPartitions(*keys, *series.order).withColumn(PART, F.spark_partition_id())
    rows = _cut(ranged.mapInArrow(of_partition, T.StructType([*ranged.schema.fields, T.StructField(ROW, T.LongType())])))
    counts = rows.groupBy(*keys, PART).agg(F.max(ROW).alias("__n"))
    onward = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    # At most one series goes on from each partition to the next, so there are fewer rows than partitions here.
    before = counts.withColumn("__before", F.sum("__n").over(onward)).where("__before > 0").select(F.struct(*keys).alias("__k"), F.col(PART).alias("__p"), "__before")
    met = rows.join(F.broadcast(before), (F.col(PART) == F.col("__p")) & F.struct(*keys).eqNullSafe(F.col("__k")), "left")
    return met.withColumn(ROW, F.col(ROW) + F.coalesce("__before", F.lit(0))).drop(PART, "__k", "__p", "__before")


def dealt(rows: DataFrame, series: Series, block_rows: int, halo: int, tasks: int | None = None) -> DataFrame:
    """Numbered rows in their blocks, and once more, as ``HALO``, in the block after if they are among its ``halo`` rows before."""
    if halo > block_rows:
        raise ValueError(f"a halo of {halo} rows needs blocks of as many")
    cut = F.expr(f"({ROW} - 1) div {block_rows}")
    own = F.struct(cut.alias("cut"), F.lit(False).alias("halo"))
    after = F.struct((cut + 1).alias("cut"), F.lit(True).alias("halo"))
    places = F.when(F.col(ROW) > (cut + 1) * block_rows - halo, F.array(own, after)).otherwise(F.array(own))
    spread = rows.withColumn("__place", F.explode(places)).withColumn(CUT, F.col("__place.cut")).withColumn(HALO, F.col("__place.halo")).drop("__place")
    return spread.repartition(*([tasks] if tasks else []), *series.keys, CUT)


def _blocks(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each block, of batches sorted by block."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = [0, *_changes(batch, keys)]
        for a, z in zip(starts, [*starts[1:], batch.num_rows]):
            key = _key(batch, keys, a)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, z - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _own(block: pa.Table, jobs: dict[str, tuple[Scan, list[str | float]]]) -> tuple[int, np.ndarray, dict[str, tuple[list, list]]]:
    """Of a block: how many halo rows it has, the numbers of its own, and for each job the values before and those of them."""
    rows = block.column(ROW).to_numpy()
    first = int(block.column(HALO).to_numpy().sum())
    own = rows[first:]
    known = {x: block.column(x).to_numpy() for _, args in jobs.values() for x in args if isinstance(x, str)}
    before = lambda x: float(known[x][first - 1]) if first else 0.0
    given = {}
    for name, (_, args) in jobs.items():
        given[name] = ([before(x) if isinstance(x, str) else x for x in args], [known[x][first:] if isinstance(x, str) else np.full(len(own), x) for x in args])
    return first, own, given


def with_scans(rows: DataFrame, series: Series, jobs: dict[str, tuple[Scan, list[str | float]]], tasks: int | None = None) -> DataFrame:
    """Own rows of ``dealt`` rows with a column for each job (name -> (scan, argument columns or constants))."""
    keys = [*series.keys, CUT]
    sizes = [scan.size for scan, _ in jobs.values()]
    used = list(dict.fromkeys([*keys, ROW, HALO, *[x for _, args in jobs.values() for x in args if isinstance(x, str)]]))
    rows = _cut(rows)
    key_fields = [rows.schema[k] for k in keys]
    numbers = lambda name: T.StructField(name, T.ArrayType(T.DoubleType()))

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, keys):
            _, own, given = _own(block, jobs)
            if len(own):
                effect = np.concatenate([scan.effect(own, given[n][0], *given[n][1]).ravel() for n, (scan, _) in jobs.items()])
                yield pa.RecordBatch.from_arrays([*[block.column(k).combine_chunks().slice(0, 1) for k in keys], pa.array([effect.tolist()])], names=[*keys, STATE])

    def states(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(CUT, ignore_index=True)
        now, out = [np.zeros(p) for p in sizes], []
        for effect in pdf[STATE]:
            out.append(np.concatenate(now).tolist())
            at = 0
            for k, p in enumerate(sizes):
                part = np.asarray(effect[at : at + p * (p + 1)]).reshape(p, p + 1)
                now[k], at = part[:, :p] @ now[k] + part[:, p], at + p * (p + 1)
        return pdf.assign(**{STATE: out})

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, keys):
            first, own, given = _own(block, jobs)
            if not len(own):
                continue
            carried, at, out = block.column(STATE)[first].as_py(), 0, []
            for name, (scan, _) in jobs.items():
                out.append(pa.array(scan.values(np.array(carried[at : at + scan.size]), own, given[name][0], *given[name][1])))
                at += scan.size
            kept = block.slice(first).drop_columns([STATE, HALO, CUT])
            for name, x in zip(jobs, out):
                kept = kept.append_column(name, x)
            yield from kept.to_batches()

    order = [*keys, ROW]
    effects = rows.select(*used).sortWithinPartitions(*order).mapInArrow(maps, T.StructType([*key_fields, numbers(STATE)]))
    # A row for each block of a series; its group is as long as the series has blocks.
    starts = effects.groupBy(*series.keys).applyInPandas(states, T.StructType([*key_fields, numbers(STATE)]))
    starts = starts.select(F.struct(*keys).alias("__k"), F.xxhash64(*keys).alias("__h"), STATE)
    hashed = rows.withColumn("__g", F.xxhash64(*keys)).repartition(*([tasks] if tasks else []), "__g")
    met = hashed.join(starts, (F.col("__g") == F.col("__h")) & F.struct(*keys).eqNullSafe(F.col("__k")), "left").drop("__g", "__h", "__k")
    fields = [f for f in met.schema.fields if f.name not in (STATE, HALO, CUT)] + [T.StructField(n, T.DoubleType()) for n in jobs]
    return met.repartition(*([tasks] if tasks else []), *keys).sortWithinPartitions(*order).mapInArrow(values, T.StructType(fields))


def compile_long_factors(
    df: DataFrame,
    factors: dict[str, str | Node],
    series: Series = Series(),
    norm_window: int = NORM_WINDOW,
    block_rows: int = BLOCK_ROWS,
    keep: list[str] | None = None,
) -> DataFrame:
    """What ``compile_factors`` gives, with each series cut into blocks of at least ``block_rows`` rows.

    Blocks are as long as the halo if that is longer. Nulls, NaN and infinities in features count as 0. A null key is a series.
    """
    trees = {name: parse(x) if isinstance(x, str) else x for name, x in factors.items()}
    missing = sorted({f for t in trees.values() for f in features_of(t)} - set(df.columns))
    if missing:
        raise ExpressionError(f"no features named {missing}")
    kept = [c for c in dict.fromkeys([*series.keys, *series.order, *(keep or [])])]
    nodes = sorted({x for t in trees.values() for x in walk(t)}, key=depth)
    column = {x: f"__n{k}" for k, x in enumerate(nodes)}
    now = df.selectExpr(*map(_named, kept), *[_cleaned(_named(x.name), column[x]) for x in nodes if isinstance(x, Feature)])
    whole = series
    if not series.keys:
        whole, now = Series((ALL,), series.order), now.withColumn(ALL, F.lit(0))
    halo = max((reach_of(t, norm_window) for t in trees.values()), default=0)
    block_rows = max(block_rows, halo)
    inside = Series((*whole.keys, CUT), (ROW,))
    tasks = _tasks(df.count(), block_rows, df)
    deal = lambda rows: dealt(rows, whole, block_rows, halo, tasks)
    now = deal(numbered(now, whole, tasks=tasks))

    def value(x: Node):
        return F.lit(x.value) if isinstance(x, Const) else F.col(column[x])

    for level in range(1, max(map(depth, nodes), default=0) + 1):
        here = [x for x in nodes if isinstance(x, Call) and depth(x) == level]
        arguments = lambda x: [a.value if isinstance(a, Const) else column[a] for a in x.args]
        scans = {column[x]: (scan, arguments(x)) for x in here if (scan := scan_of(x.name))}
        others: dict[str, tuple[Callable, list]] = {column[x]: (lookup(x.name).build, arguments(x)) for x in here if lookup(x.name).kind == RECURSIVE and column[x] not in scans}
        if scans or others:
            now = with_scans(now, whole, scans, tasks) if scans else now.where(~F.col(HALO)).drop(HALO, CUT)
            if others:
                now = _run_recursive(now, Series(whole.keys, (ROW,)), others)
            now = deal(now)
        built = {column[x]: lookup(x.name).build(inside, *map(value, x.args)) for x in here if column[x] not in scans and column[x] not in others}
        if built:
            now = now.withColumns(built)
        now = _replaced(now, {column[x]: _cleaned(_named(column[x]), column[x]) for x in here})
        scaled = [column[x] for x in here if lookup(x.name).normalised]
        if scaled:
            now = with_long_deviation(now, inside, {c: f"{c}_s" for c in scaled}, norm_window)
            over = {c: _cleaned(f"try_divide({_named(c)}, {_named(c + '_s')})", c) for c in scaled}
            now = _replaced(now, over, tuple(f"{c}_s" for c in scaled))
    return now.where(~F.col(HALO)).select(*kept, *[value(t).cast("double").alias(name) for name, t in trees.items()])
