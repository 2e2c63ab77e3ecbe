"""Factors and CUSUM events over a stream of bars, with state for each symbol.

Rows of a symbol are taken in the order of their timestamps within a micro-batch; a row not newer than the last one is
late and left out. Where ``ties`` names a column that orders rows of one time, these are all taken, in its order, and only
a row older than the newest of earlier micro-batches is late. The state of recursive operators is the operators themselves; that of windowed factors is a bounded
buffer of the last rows (``buffer.py``). Windowed factors are computed by the batch compiler on buffer and new rows together, so batch
and stream share every definition.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.frames import Series
from ..functions.registry import RECURSIVE, lookup
from ..operators.barriers import Cusum
from ..plans.compile import compile_factors
from ..plans.expr import Call, Const, Feature, features_of, parse
from .buffer import NEW, with_context

STATE = "newest timestamp, steps binary"


def _stateful(bars: DataFrame, make: Callable[[], dict], inputs: dict[str, list[str | float]], keep: Callable[[pd.DataFrame], pd.Series] | None = None, ties: str | None = None) -> DataFrame:
    """(symbol, ts, one column for each step of ``make``)."""
    names = list(inputs)
    columns = sorted({x for args in inputs.values() for x in args if isinstance(x, str)})
    order = ["ts"] if ties is None else ["ts", "__tie"]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest, steps = (state.get[0], pickle.loads(state.get[1])) if state.exists else (None, make())
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        if ties is None:
            fresh = []
            for ts in rows["ts"]:
                fresh.append(newest is None or ts > newest)
                newest = ts if fresh[-1] else newest
            rows = rows[fresh]
        else:
            rows = rows[rows["ts"].notna() & (newest is None or rows["ts"] >= newest)]
            newest = rows["ts"].iloc[-1].to_pydatetime() if len(rows) else newest
        given = {x: rows[x].tolist() for x in columns}
        results = {n: list(map(steps[n].step, *[given[x] if isinstance(x, str) else [x] * len(rows) for x in inputs[n]])) for n in names}
        out = pd.DataFrame({"symbol": key[0], "ts": rows["ts"].to_numpy(), **{n: np.nan_to_num(np.array(x, float), posinf=np.inf, neginf=-np.inf) for n, x in results.items()}})
        state.update((newest, pickle.dumps(steps)))
        yield out if keep is None else out[keep(out)]

    schema = ", ".join(["symbol string", "ts timestamp", *[f"{n} double" for n in names]])
    given = bars.select("symbol", "ts", *columns, *([] if ties is None else [F.col(ties).alias("__tie")]))
    return given.groupBy("symbol").applyInPandasWithState(run, schema, STATE, "append", GroupStateTimeout.NoTimeout)


def stream_recursive(bars: DataFrame, factors: dict[str, str], ties: str | None = None) -> DataFrame:
    """(symbol, ts, raw values) of recursive operators applied to columns, such as ``ta_ema_8(c)``; not normalised."""
    inputs, make = {}, {}
    for name, text in factors.items():
        tree = parse(text)
        if not isinstance(tree, Call) or lookup(tree.name).kind != RECURSIVE or any(isinstance(a, Call) for a in tree.args):
            raise ValueError(f"{text} isn't a recursive operator of columns")
        make[name] = lookup(tree.name).build
        inputs[name] = [a.value if isinstance(a, Const) else a.name for a in tree.args if isinstance(a, (Const, Feature))]
    return _stateful(bars, lambda: {n: m() for n, m in make.items()}, inputs, ties=ties)


def stream_cusum(bars: DataFrame, threshold: float | str, column: str = "base", ties: str | None = None, unbounded: bool = False) -> DataFrame:
    """(symbol, ts, side) of CUSUM events, as they happen. Infinite values are passed over or, if ``unbounded``, count as such."""
    args = [column, threshold if isinstance(threshold, str) else float(threshold)]
    return _stateful(bars, lambda: {"side": Cusum(unbounded)}, {"side": args}, keep=lambda out: out["side"] != 0, ties=ties)


def stream_last_values(bars: DataFrame, factors: dict[str, str], buffer_rows: int, sink: Callable[[DataFrame, int], None], norm_window: int | None = None, series: Series = Series(), idle_seconds: float | None = None):
    """A writer that, for each micro-batch, evaluates ``factors`` for its new bars on them and the last ``buffer_rows`` bars that
    their series had before, and hands (keys, time, factors) to ``sink``. The buffer is keyed state (``buffer.with_context``).

    Values depend on the buffer's length as much as on the factors (deviations and running sums see no further back),
    just as a batch run over the same rows would. Where ``series`` names more columns after the time, these order rows of one
    time, which then are all taken. Start the returned writer with ``.start()`` inside ``rocksdb_state``. A
    micro-batch that is run again after a failure hands the same rows to ``sink`` under the same number.
    """
    trees = {name: parse(text) for name, text in factors.items()}
    features = sorted({f for tree in trees.values() for f in features_of(tree)})
    options = {} if norm_window is None else {"norm_window": norm_window}

    def of_batch(rows: DataFrame, batch_id: int) -> None:
        values = compile_factors(rows, trees, series, keep=[NEW], **options).where(NEW).drop(NEW).persist()
        try:
            sink(values, batch_id)
        finally:
            values.unpersist()

    return with_context(bars, features, buffer_rows, series, idle_seconds).writeStream.foreachBatch(of_batch)
