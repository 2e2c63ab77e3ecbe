"""Events of a price series: CUSUM filters and the triple barrier.

One rule for missing prices holds in batches, grids and streams: a price that is null, NaN, infinite or, where logarithms are
taken, not positive adds nothing, and the next change is taken from the last price that was known. Such a bar is no event and
touches no barrier; a return to or from such a price counts as 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.frames import Series, ratio
from ..functions.recursive import EwmStd
from ..plans.compile import _run_recursive


class Cusum:
    """Symmetric CUSUM filter: 1 or -1 where a sum of changes passes the threshold, which resets that sum alone.

    Rows whose threshold isn't a positive number add nothing, though the next change is taken from them all the same. A null
    or non-finite value is passed over: it adds nothing, and the last known value stays. If ``unbounded``, infinite values
    (such as the logarithm of zero) are values like any other: a change to or from them passes every threshold, and one
    between two of them is NaN, above all numbers as in SQL.
    """

    def __init__(self, unbounded: bool = False) -> None:
        self.last, self.up, self.down, self.unbounded = math.nan, 0.0, 0.0, unbounded

    def step(self, x: float | None, threshold: float | None) -> float:
        if x is None or x != x or not (self.unbounded or math.isfinite(x)):
            return 0.0
        before, self.last = self.last, x
        change = x - before
        if before != before or threshold is None or not math.isfinite(threshold) or threshold <= 0:
            return 0.0
        if change != change:
            self.up = self.down = 0.0
            return 1.0
        self.up, self.down = max(0.0, self.up + change), min(0.0, self.down + change)
        if self.up > threshold:
            self.up = 0.0
            return 1.0
        if self.down < -threshold:
            self.down = 0.0
            return -1.0
        return 0.0


def prepared_close(prices: DataFrame, price: str = "c", log: bool = True, arrival: str | None = None) -> DataFrame:
    """(symbol, ts, c, base): the last of several rows with one timestamp (by ``arrival`` if given), and its logarithm."""
    rows = prices
    if arrival:
        newest = Window.partitionBy("symbol", "ts").orderBy(F.desc(arrival))
        rows = rows.withColumn("__k", F.row_number().over(newest)).where("__k = 1")
    x = F.col(price).cast("double")
    x = F.when(F.abs(x) < float("inf"), x)
    return rows.select("symbol", "ts", x.alias("c"), (F.log(x) if log else x).alias("base"))


def cusum_events(series_rows: DataFrame, threshold: float | str, column: str = "base", series: Series = Series()) -> DataFrame:
    """(symbol, ts, side) of the events; ``threshold`` is a number or the name of a column with one for each row."""
    job = {"side": (Cusum, [column, threshold if isinstance(threshold, str) else float(threshold)])}
    return _run_recursive(series_rows, series, job).where("side != 0").select(*series.keys, *series.order, "side")


class _Skipping(EwmStd):
    """Rows without a change keep the state as it is."""

    def step(self, x: float | None) -> float:
        return math.nan if x is None or not math.isfinite(x) else super().step(x)


def changes(column: str, series: Series = Series()) -> Column:
    """The change from the last known value to this one; null where either is missing."""
    x = F.col(column)
    known = F.when(F.abs(x) < float("inf"), x)
    return known - F.last(known, ignorenulls=True).over(series.plain.rowsBetween(Window.unboundedPreceding, -1))


def ewm_volatility(series_rows: DataFrame, span: int, factor: float = 1.0, column: str = "base", out: str = "volatility", series: Series = Series()) -> DataFrame:
    """Exponentially weighted deviation of one-bar changes times ``factor``; the first rows take the first value after them."""
    now = series_rows.withColumn("__d", changes(column, series))
    now = _run_recursive(now, series, {"__s": (lambda: _Skipping(span), ["__d"])})
    known = F.when(~F.isnan("__s"), F.col("__s") * factor)
    return now.withColumn(out, F.last(known, ignorenulls=True).over(_backwards(series))).drop("__d", "__s")


def _backwards(series: Series) -> WindowSpec:
    """From the last row down to the current one: a running frame, where one up to the last row is read anew for each row."""
    return Window.partitionBy(*series.keys).orderBy(*[F.desc(x) for x in series.order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def vertical_barriers(events: DataFrame, prices: DataFrame, holding_seconds: int, series: Series = Series()) -> DataFrame:
    """``events`` with ``vertical``: the first bar at or after each event's ``ts`` plus the holding time, null beyond the end."""
    key, at = series.keys[0], series.order[0]
    found = _next_bars(events.select(key, at).distinct(), prices.select(key, at, F.lit(None).cast("double").alias("c")), (holding_seconds,), series)
    return events.join(found.select(key, at, F.col("bar").alias("vertical")), [key, at], "left")


def _next_bars(entries: DataFrame, prices: DataFrame, holdings: tuple[int, ...], series: Series) -> DataFrame:
    """(key, order, holding, bar, price): the first bar at or after each entry's time plus each holding time.

    A forward as-of join by one sort: targets and bars are put in one order, the latest first, and each target takes the
    last bar before it. Targets without a bar are there with nulls.
    """
    key, at = series.keys[0], series.order[0]
    ahead = entries.select(key, F.col(at).alias("event"), F.explode(F.array(*[F.lit(h) for h in holdings])).alias("holding"))
    none = F.lit(None).cast("struct<bar:timestamp,price:double>")
    targets = ahead.select(key, (F.col("event") + F.make_dt_interval(secs=F.col("holding"))).alias("when"), "event", "holding", none.alias("found"))
    bars = prices.select(key, F.col(at).alias("when"), F.lit(None).cast("timestamp").alias("event"), F.lit(None).cast("int").alias("holding"), F.struct(F.col(at).alias("bar"), F.col("c").alias("price")).alias("found"))
    # At equal times the bar comes before the target, so that it is found.
    down = Window.partitionBy(key).orderBy(F.desc("when"), F.col("event").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = targets.unionByName(bars).withColumn("last", F.last("found", ignorenulls=True).over(down)).where("event is not null")
    return met.select(key, F.col("event").alias(at), "holding", "last.bar", "last.price")


def _hour(ts: Column | str, seconds: int) -> Column:
    return F.floor(F.unix_timestamp(ts) / seconds)


def barrier_touches(events: DataFrame, prices: DataFrame, pt: float, sl: float, bucket_seconds: int = 86_400) -> DataFrame:
    """``events`` (symbol, ts, vertical, trgt, side) with ``pt`` and ``sl``: when the path's signed return first passes them.

    A multiple of 0 or less switches a barrier off; without a vertical barrier the path runs to the last bar. Bars and
    events meet by time bucket (an equi-join), not by comparing every bar with every event.
    """
    final = prices.groupBy("symbol").agg(F.max("ts").alias("final_ts"))
    entry = prices.select("symbol", "ts", F.col("c").alias("entry"))
    e = events.join(entry, ["symbol", "ts"], "left").join(final, "symbol", "left")
    e = e.withColumn("until", F.coalesce("vertical", "final_ts"))
    spread = e.select(
        "symbol", F.col("ts").alias("t0"), "until", "trgt", "side", "entry",
        F.explode(F.sequence(_hour("ts", bucket_seconds), _hour("until", bucket_seconds))).alias("bucket"),
    )
    bars = prices.select("symbol", F.col("ts").alias("bar"), "c", _hour("ts", bucket_seconds).alias("bucket"))
    path = spread.join(bars, ["symbol", "bucket"]).where((F.col("bar") >= F.col("t0")) & (F.col("bar") <= F.col("until")))
    gain = (ratio(F.col("c"), F.col("entry")) - 1.0) * F.col("side")
    never = F.lit(None).cast("timestamp")
    up = F.min(F.when(gain > pt * F.col("trgt"), F.col("bar"))) if pt > 0 else F.min(never)
    down = F.min(F.when(gain < -sl * F.col("trgt"), F.col("bar"))) if sl > 0 else F.min(never)
    hits = path.groupBy("symbol", F.col("t0").alias("ts")).agg(up.alias("pt"), down.alias("sl"))
    return events.join(hits, ["symbol", "ts"], "left")


def triple_barrier(events: DataFrame, prices: DataFrame, pt: float, sl: float, holding_seconds: int, trgt: str | None = None, side: str | None = None) -> DataFrame:
    """(symbol, ts, exit, price, ret, side, barrier) of each entry: the earliest barrier, and the log return up to it.

    ``trgt`` and ``side`` name columns of ``events``: the width that ``pt`` and ``sl`` multiply, and the direction held.
    Entries that meet no barrier have no exit and a return of 0.
    """
    rows = events.select(
        "symbol", "ts", (F.col(trgt) if trgt else F.lit(1.0)).alias("trgt"), (F.col(side) if side else F.lit(1.0)).alias("side")
    ).dropDuplicates(["symbol", "ts"])
    touched = barrier_touches(vertical_barriers(rows, prices, holding_seconds), prices, pt, sl)
    out = touched.withColumn("exit", F.least("vertical", "pt", "sl"))
    at = lambda when, name: prices.select("symbol", F.col("ts").alias(when), F.col("c").alias(name))
    out = out.join(at("ts", "price"), ["symbol", "ts"], "left").join(at("exit", "exit_price"), ["symbol", "exit"], "left")
    ret = F.coalesce((F.log("exit_price") - F.log("price")) * F.col("side"), F.lit(0.0))
    which = F.when(F.col("exit").isNull(), "none").when(F.col("exit") == F.col("sl"), "stop").when(F.col("exit") == F.col("pt"), "profit").otherwise("vertical")
    return out.select("symbol", "ts", "exit", "price", F.when(F.col("exit").isNotNull(), ret).otherwise(F.lit(0.0)).alias("ret"), "side", which.alias("barrier"))


def outcome_counts(labelled: DataFrame, by: list[str]) -> DataFrame:
    """Events, results by sign, barriers, and shares of the events that ended with a gain or a loss."""
    n = lambda c: F.count_if(c)
    up, down = n(F.col("ret") > 0), n(F.col("ret") < 0)
    return labelled.groupBy(*by).agg(
        F.count("*").alias("events"), up.alias("profits"), down.alias("losses"), n(F.col("ret") == 0).alias("neutral"), n(F.col("barrier") == "vertical").alias("verticals"),
        F.coalesce(ratio(up, up + down), F.lit(0.0)).alias("profit_ratio"),
        F.coalesce(ratio(down, up + down), F.lit(0.0)).alias("loss_ratio"),
    )


def barrier_grid(
    prices: DataFrame, spans: tuple[int, ...], ks: tuple[float, ...], multiples: tuple[tuple[float, float], ...], holdings: tuple[int, ...]
) -> DataFrame:
    """Outcome counts for every span, threshold factor, pair of multiples and holding time, as one plan.

    Volatilities of all spans are one pass, and so are the CUSUM filters. The paths of all entries are joined once, for the
    longest holding time: when a path first passes a pair of multiples does not depend on how long it is held, so each
    path gives one first touch for each pair, and the holding times are compared with that.
    """
    close = prepared_close(prices)
    now = close.withColumn("__d", changes("base"))
    now = _run_recursive(now, Series(), {f"v{s}": ((lambda s=s: _Skipping(s)), ["__d"]) for s in spans})
    now = now.withColumns({f"v{s}": F.last(F.when(~F.isnan(f"v{s}"), F.col(f"v{s}")), ignorenulls=True).over(_backwards(Series())) for s in spans})
    tags = {f"e{i}_{j}": (s, k) for i, s in enumerate(spans) for j, k in enumerate(ks)}
    now = now.withColumns({f"t_{t}": F.col(f"v{s}") * k for t, (s, k) in tags.items()})
    now = _run_recursive(now, Series(), {t: (Cusum, ["base", f"t_{t}"]) for t in tags})
    long = F.array(*[F.struct(F.lit(s).alias("span"), F.lit(float(k)).alias("k"), F.col(t).alias("fired"), F.col(f"t_{t}").alias("trgt")) for t, (s, k) in tags.items()])
    events = now.select("symbol", "ts", F.col("c").alias("entry"), F.filter(long, lambda e: e["fired"] != 0).alias("fired")).where(F.size("fired") > 0)
    return _grid_counts(_grid_touches(events, close, multiples, holdings), multiples)


def _grid_touches(events: DataFrame, close: DataFrame, multiples: tuple[tuple[float, float], ...], holdings: tuple[int, ...], bucket: int = 86_400) -> DataFrame:
    """(symbol, ts, span, k, entry, ends, touches): for each event of ``events`` (symbol, ts, entry, fired) what each holding
    time ends with, and the first bar of the path, as long as the longest of them, that passes each pair of multiples."""
    final = close.groupBy("symbol").agg(F.max("ts").alias("final_ts"))
    ends = _next_bars(events.select("symbol", "ts"), close, holdings, Series()).join(final, "symbol")
    each = F.struct("holding", F.col("bar").alias("vertical"), "price", F.coalesce("bar", "final_ts").alias("until"))
    ends = ends.groupBy("symbol", "ts").agg(F.sort_array(F.collect_list(each)).alias("ends"))
    entries = events.join(ends, ["symbol", "ts"]).withColumn("until", F.array_max(F.transform("ends", lambda e: e["until"])))
    spread = entries.withColumn("bucket", F.explode(F.sequence(_hour("ts", bucket), _hour("until", bucket))))
    bars = close.select("symbol", F.col("ts").alias("bar"), "c", _hour("ts", bucket).alias("bucket"))
    path = spread.join(bars, ["symbol", "bucket"]).where((F.col("bar") >= F.col("ts")) & (F.col("bar") <= F.col("until")))
    path = path.select("symbol", "ts", "entry", "ends", "bar", "c", (ratio(F.col("c"), F.col("entry")) - 1.0).alias("gain"), F.explode("fired").alias("e"))
    beyond = lambda pt, sl: (F.col("gain") > pt * F.col("e.trgt")) | (F.col("gain") < -sl * F.col("e.trgt"))
    first = [F.min(F.when(beyond(pt, sl), F.struct("bar", "c"))) for pt, sl in multiples]
    by = path.groupBy("symbol", "ts", F.col("e.span").alias("span"), F.col("e.k").alias("k"))
    return by.agg(F.first("entry").alias("entry"), F.first("ends").alias("ends"), F.array(*first).alias("touches"))


def _grid_counts(touched: DataFrame, multiples: tuple[tuple[float, float], ...]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(float(pt)).alias("pt"), F.lit(float(sl)).alias("sl")) for pt, sl in multiples])
    rows = touched.select("span", "k", "entry", "ends", F.posexplode(F.arrays_zip(pairs.alias("m"), F.col("touches").alias("x"))))
    rows = rows.select("span", "k", "entry", "col.m.pt", "col.m.sl", F.col("col.x").alias("x"), F.explode("ends").alias("end"))
    in_time = F.coalesce(F.col("x.bar") <= F.col("end.until"), F.lit(False))
    left = F.when(in_time, F.col("x.c")).otherwise(F.col("end.price"))
    which = F.when(in_time, "touch").when(F.col("end.vertical").isNotNull(), "vertical").otherwise("none")
    labelled = rows.select("span", "k", "pt", "sl", F.col("end.holding").alias("holding"), which.alias("barrier"), F.coalesce(F.log(left) - F.log("entry"), F.lit(0.0)).alias("ret"))
    out = outcome_counts(labelled, ["span", "k", "pt", "sl", "holding"])
    return out.select("span", "k", "pt", "sl", "holding", "events", "profits", "losses", "neutral", "verticals", "profit_ratio", "loss_ratio")
