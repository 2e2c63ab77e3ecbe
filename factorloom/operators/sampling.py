"""Weights and bootstraps of overlapping events.

Events are (symbol, event_id, t0, t1). Concurrency comes from +1 and -1 steps and a running sum, and averages over an
event's bars from differences of running sums read at its two ends, so no event meets all of its bars.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import ratio
from .barriers import triple_barrier

def events_from_barriers(barriers: DataFrame) -> DataFrame:
    """(symbol, event_id, t0, t1, ret, side): barriers with an exit not before the entry; of equal entries the one that
    ends first. Ids are numbered by time in each symbol, from 0."""
    valid = barriers.where("exit is not null and exit >= ts").select("symbol", F.col("ts").alias("t0"), F.col("exit").alias("t1"), "ret", "side")
    one = valid.groupBy("symbol", "t0").agg(F.min("t1").alias("t1"), F.min_by("ret", "t1").alias("ret"), F.min_by("side", "t1").alias("side"))
    return one.withColumn("event_id", (F.row_number().over(Window.partitionBy("symbol").orderBy("t0")) - 1).cast("long"))


def checked_events(events: DataFrame) -> DataFrame:
    """Raises unless there are events and each has both ends, in order."""
    bad = events.agg(F.count("*").alias("n"), F.count_if(F.col("t0").isNull() | F.col("t1").isNull() | (F.col("t1") < F.col("t0"))).alias("bad")).first()
    if not bad["n"]:
        raise ValueError("there are no events")
    if bad["bad"]:
        raise ValueError(f"{bad['bad']} events lack an end or end before they begin")
    return events


def concurrency(bars: DataFrame, events: DataFrame) -> DataFrame:
    """``bars`` (symbol, ts, ...) with ``concurrent``: the events under way at each bar, both ends included."""
    steps = events.select("symbol", F.col("t0").alias("ts"), F.lit(1).alias("step"), F.lit(0).alias("late")).unionByName(
        # An event ends after the bar at its end.
        events.select("symbol", F.col("t1").alias("ts"), F.lit(-1).alias("step"), F.lit(2).alias("late"))
    )
    steps = steps.groupBy("symbol", "ts", "late").agg(F.sum("step").alias("step"))
    marks = bars.select("symbol", "ts").distinct().withColumns({"step": F.lit(0), "late": F.lit(1)})
    order = Window.partitionBy("symbol").orderBy("ts", "late").rowsBetween(Window.unboundedPreceding, 0)
    count = steps.unionByName(marks).withColumn("concurrent", F.sum("step").over(order)).where("late = 1")
    return bars.join(count.select("symbol", "ts", "concurrent"), ["symbol", "ts"])


def _between(bars: DataFrame, events: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """``events`` with each sum of ``bars`` over the bars of the event, as differences of running sums."""
    upto = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    run = bars.select("symbol", "ts", *[F.sum(F.coalesce(v, F.lit(0.0))).over(upto).alias(k) for k, v in sums.items()])
    # The last bar at or before t1 and the last before t0, by one order of bars and ends.
    marks = (
        run.select("symbol", "ts", F.lit(1).alias("late"), F.struct(*sums).alias("at"), F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("string").alias("end"))
        .unionByName(events.select("symbol", F.col("t0").alias("ts"), F.lit(0).alias("late"), F.lit(None).alias("at"), F.col("event_id").cast("long").alias("event_id"), F.lit("a").alias("end")))
        .unionByName(events.select("symbol", F.col("t1").alias("ts"), F.lit(2).alias("late"), F.lit(None).alias("at"), F.col("event_id").cast("long").alias("event_id"), F.lit("z").alias("end")))
    )
    order = Window.partitionBy("symbol").orderBy("ts", "late").rowsBetween(Window.unboundedPreceding, 0)
    read = marks.withColumn("at", F.last("at", ignorenulls=True).over(order)).where("end is not null")
    ends = read.groupBy("symbol", "event_id").agg(F.max(F.when(F.col("end") == "a", F.col("at"))).alias("a"), F.max(F.when(F.col("end") == "z", F.col("at"))).alias("z"))
    value = {k: F.coalesce(F.col(f"z.{k}"), F.lit(0.0)) - F.coalesce(F.col(f"a.{k}"), F.lit(0.0)) for k in sums}
    return events.join(ends.select("symbol", "event_id", *[v.alias(k) for k, v in value.items()]), ["symbol", "event_id"])


def _inverse() -> Column:
    return F.when(F.col("concurrent") > 0, 1.0 / F.col("concurrent"))


def uniqueness_weights(bars: DataFrame, events: DataFrame) -> DataFrame:
    """``events`` with ``tW``: the mean over the event's bars of one over the events under way."""
    counted = concurrency(bars, events)
    sums = _between(counted, events, {"__s": _inverse(), "__n": F.when(F.col("concurrent") > 0, 1.0)})
    return sums.withColumn("tW", F.coalesce(ratio(F.col("__s"), F.col("__n")), F.lit(0.0))).drop("__s", "__n")


def _scaled_to_count(df: DataFrame, column: str) -> DataFrame:
    whole = Window.partitionBy("symbol")
    total = F.sum(column).over(whole)
    return df.withColumn(column, F.when(total > 0, F.col(column) * F.count("*").over(whole) / total).otherwise(F.col(column)))


def return_weights(bars: DataFrame, events: DataFrame, price: str = "c", out: str = "w_ret") -> DataFrame:
    """``events`` with the absolute sum of log returns, each shared among the events under way; scaled to sum to their number."""
    order = Window.partitionBy("symbol").orderBy("ts")
    counted = concurrency(bars, events).withColumn("__r", F.coalesce(F.log(price) - F.lag(F.log(price)).over(order), F.lit(0.0)))
    sums = _between(counted, events, {"__s": F.col("__r") * _inverse()})
    return _scaled_to_count(sums.withColumn(out, F.abs("__s")).drop("__s"), out)


def decay_weights(weighted: DataFrame, td: float = 1.0, of: str = "tW", out: str = "w_td") -> DataFrame:
    """Weights linear in the running sum of ``of``: 1 for the newest; ``td`` for the oldest, and 0 for the oldest part if
    it is negative."""
    if isinstance(td, bool) or not isinstance(td, (int, float)) or not -1 < td <= 1:
        raise ValueError("td must be over -1 and at most 1")
    run = F.sum(of).over(Window.partitionBy("symbol").orderBy("t0").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(of).over(Window.partitionBy("symbol"))
    slope = ratio(F.lit(1.0 - td), total) if td >= 0 else ratio(F.lit(1.0), (td + 1.0) * total)
    return weighted.withColumn(out, F.greatest(F.lit(0.0), 1.0 - slope * total + slope * run))


def composite_weights(bars: DataFrame, events: DataFrame, td: float = 1.0, normalise: bool = True) -> DataFrame:
    """(events, tW, w_ret, w_td, w): their product, scaled to sum to the number of events."""
    unique = decay_weights(uniqueness_weights(bars, events), td)
    returns = return_weights(bars, events).select("symbol", "event_id", "w_ret")
    out = unique.join(returns, ["symbol", "event_id"]).withColumn("w", F.col("tW") * F.col("w_ret") * F.col("w_td"))
    return _scaled_to_count(out, "w") if normalise else out


def indicator_pairs(bars: DataFrame, events: DataFrame, bucket_seconds: int = 86_400) -> DataFrame:
    """(symbol, ts, event_id): which bars an event covers. A sparse form, as long as events last; joined by time bucket."""
    bucket = lambda c: F.floor(F.unix_timestamp(c) / bucket_seconds)
    spread = events.select("symbol", "event_id", "t0", "t1", F.explode(F.sequence(bucket("t0"), bucket("t1"))).alias("b"))
    joined = bars.select("symbol", "ts", bucket("ts").alias("b")).join(spread, ["symbol", "b"])
    return joined.where((F.col("ts") >= F.col("t0")) & (F.col("ts") <= F.col("t1"))).select("symbol", "ts", "event_id")


def average_uniqueness(pairs: DataFrame) -> DataFrame:
    """(symbol, event_id, uniqueness) from indicator pairs."""
    shared = pairs.groupBy("symbol", "ts").agg(F.count("*").alias("n"))
    return pairs.join(shared, ["symbol", "ts"]).groupBy("symbol", "event_id").agg(F.avg(1.0 / F.col("n")).alias("uniqueness"))


def _cells(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Events as ranges of cells, and the bars of each cell: no event begins or ends inside one, so there are at most two
    cells for each event, however many bars there are."""
    cuts = np.unique(np.r_[lo, hi])
    return np.searchsorted(cuts, lo), np.searchsorted(cuts, hi), np.diff(cuts).astype(float)


def _shares(a: np.ndarray, b: np.ndarray, width: np.ndarray, load: np.ndarray) -> np.ndarray:
    """The mean of one over ``load`` over the bars of each event."""
    share, bars = np.r_[0.0, np.cumsum(width / load)], np.r_[0.0, np.cumsum(width)]
    return (share[b] - share[a]) / np.maximum(bars[b] - bars[a], 1)


def _uniqueness(lo: np.ndarray, hi: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Average uniqueness of every chosen event among them; events are ranges of bars."""
    a, b, width = _cells(lo[chosen], hi[chosen])
    step = np.zeros(len(width) + 1)
    np.add.at(step, a, 1)
    np.add.at(step, b, -1)
    return _shares(a, b, width, np.maximum(np.cumsum(step)[:-1], 1))


LEAST_TRIES = 64


def draw_sequentially(lo: np.ndarray, hi: np.ndarray, size: int, random: np.random.RandomState) -> list[int]:
    """Draws events in turn, each in proportion to how unique it would be among those drawn.

    A draw only adds to the events under way, so what an event's uniqueness was at any time bounds what it is later. Events
    are proposed in proportion to such bounds and taken with the chance uniqueness / bound, which is the law of the plain
    loop without a pass over all events for each draw; only a proposed event's own cells are read. When less than half of
    some proposals were taken, all bounds are computed anew. That is seldom: each time the sum of bounds has about halved, as
    often as the events under way double.
    """
    a, b, width = _cells(lo, hi)
    length, load, drawn = np.maximum(hi - lo, 1), np.ones(len(width)), []
    while len(lo) and len(drawn) < size:
        # Differences of running sums are rounded; a bound must not fall below the value.
        bound = _shares(a, b, width, load) * (1 + 1e-9) + 1e-12 * (hi > lo)
        upto = np.cumsum(bound)
        if not upto[-1] > 0:
            raise ValueError("no event covers a bar")
        tries, taken = 0, 0
        while len(drawn) < size and 2 * taken >= tries:
            tries, taken = max(LEAST_TRIES, len(lo) // 16), 0
            proposed = np.minimum(np.searchsorted(upto, random.random_sample(tries) * upto[-1], side="right"), len(lo) - 1)
            for pick, chance in zip(proposed.tolist(), random.random_sample(tries).tolist()):
                own = slice(a[pick], b[pick])
                if chance * bound[pick] * length[pick] < float(width[own] @ (1 / load[own])):
                    drawn.append(pick)
                    load[own] += 1
                    taken += 1
                    if len(drawn) == size:
                        break
    return drawn


def event_ranges(bars: DataFrame, events: DataFrame) -> DataFrame:
    """(symbol, event_id, lo, hi): events as ranges of bars, numbered from 0 in each symbol, ``hi`` not included.

    One order of bars and ends, a row for each bar and two for each event; no event meets its bars. Bars of equal time are
    one bar. Events that cover no bar, or lack an end, are left out: their uniqueness is 0 and they can't be drawn.
    """
    none = F.lit(None)
    marks = (
        bars.select("symbol", "ts").distinct().select("symbol", "ts", F.lit(1).alias("late"), F.lit(1).alias("bar"), none.cast("long").alias("event_id"))
        .unionByName(events.select("symbol", F.col("t0").alias("ts"), F.lit(0).alias("late"), F.lit(0).alias("bar"), F.col("event_id").cast("long").alias("event_id")))
        .unionByName(events.select("symbol", F.col("t1").alias("ts"), F.lit(2).alias("late"), F.lit(0).alias("bar"), F.col("event_id").cast("long").alias("event_id")))
    )
    order = Window.partitionBy("symbol").orderBy("ts", "late").rowsBetween(Window.unboundedPreceding, 0)
    read = marks.where("ts is not null").withColumn("n", F.sum("bar").over(order)).where("late <> 1")
    ends = read.groupBy("symbol", "event_id").agg(F.max(F.when(F.col("late") == 0, F.col("n"))).alias("lo"), F.max(F.when(F.col("late") == 2, F.col("n"))).alias("hi"))
    return ends.where("hi > lo")


def _ranges(found: DataFrame) -> DataFrame:
    """``event_ranges`` as they are; indicator pairs as ranges of the bars that any event covers."""
    if {"lo", "hi"} <= set(found.columns):
        return found.select("symbol", "event_id", "lo", "hi")
    bars = found.select("symbol", "ts").distinct().withColumn("bar", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1)
    return found.join(bars, ["symbol", "ts"]).groupBy("symbol", "event_id").agg(F.min("bar").alias("lo"), (F.max("bar") + 1).alias("hi"))


TRIALS = "symbol string, trial int, std_u double, seq_u double, drawn array<long>"


def bootstrap_trials(found: DataFrame, trials: int, seed: int = 42, size: int | None = None) -> DataFrame:
    """(symbol, trial, std_u, seq_u, drawn): average uniqueness of a plain and of a sequential draw, and the latter's events.

    ``found`` are ``event_ranges``, or indicator pairs. One task for each symbol and trial, with the seed plus the trial's number; a draw depends on those before it, so it
    can't be split. Tasks hold two numbers for each event.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("event_id")
        lo, hi, ids = rows["lo"].to_numpy(), rows["hi"].to_numpy(), rows["event_id"].to_numpy()
        trial = int(rows["trial"].iloc[0])
        random, k = np.random.RandomState(seed + trial), size or len(rows)
        plain = random.choice(len(rows), size=k, replace=True)
        drawn = np.array(draw_sequentially(lo, hi, k, random))
        mean = lambda c: float(_uniqueness(lo, hi, c).mean())
        return pd.DataFrame([(rows["symbol"].iloc[0], trial, mean(plain), mean(drawn), ids[drawn].tolist())], columns=["symbol", "trial", "std_u", "seq_u", "drawn"])

    each = _ranges(found).withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    return each.groupBy("symbol", "trial").applyInPandas(run, TRIALS)


def sequential_bootstrap(found: DataFrame, size: int | None = None, seed: int = 42) -> DataFrame:
    """(symbol, place, event_id) of one sequential draw from ``event_ranges`` or indicator pairs."""
    one = bootstrap_trials(found, 1, seed, size)
    return one.select("symbol", F.posexplode("drawn").alias("place", "event_id"))


def sampling_quality(trials: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(symbol, std_u_mean, seq_u_mean, seq_win_ratio, uniqueness_lift[, weight_top_1pct_mass, weight_top_5pct_mass])."""
    out = trials.groupBy("symbol").agg(
        F.avg("std_u").alias("std_u_mean"), F.avg("seq_u").alias("seq_u_mean"),
        F.avg(F.when(F.col("seq_u") > F.col("std_u"), 1.0).otherwise(0.0)).alias("seq_win_ratio"),
    )
    out = out.withColumn("uniqueness_lift", F.col("seq_u_mean") - F.col("std_u_mean"))
    return out if weights is None else out.join(top_mass(weights), "symbol", "left")


def top_mass(weights: DataFrame) -> DataFrame:
    """Share of all weight that the heaviest 1 % and 5 % of events hold (at least one event each)."""
    heavy = weights.where("w > 0").select("symbol", "w", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("w"))).alias("r"), F.count("*").over(Window.partitionBy("symbol")).alias("n"))
    part = lambda q: ratio(F.sum(F.when(F.col("r") <= F.greatest(F.lit(1), F.ceil(F.col("n") * q)), F.col("w"))), F.sum("w"))
    return heavy.groupBy("symbol").agg(part(0.01).alias("weight_top_1pct_mass"), part(0.05).alias("weight_top_5pct_mass"))


def sampling_pipeline(bars: DataFrame, entries: DataFrame, pt: float, sl: float, holding_seconds: int, td: float = 1.0, trgt: str | None = None, seed: int = 42) -> dict[str, DataFrame]:
    """Barriers, events, weights, indicator pairs, a sequential draw and the drawn rows, from prices and entry times."""
    barriers = triple_barrier(entries, bars, pt, sl, holding_seconds, trgt)
    events = events_from_barriers(barriers)
    weights = composite_weights(bars, events, td)
    pairs = indicator_pairs(bars, events)
    drawn = sequential_bootstrap(event_ranges(bars, events), seed=seed)
    return {"barriers": barriers, "events": events, "weights": weights, "pairs": pairs, "drawn": drawn, "rows": drawn.join(weights, ["symbol", "event_id"])}
