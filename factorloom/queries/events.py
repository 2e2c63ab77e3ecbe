"""CUSUM events, triple barriers, concurrency and weights, over daily bars of order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import barriers, sampling
from .common import BASE, DAYS, bars, days, epoch, lagged, presented, rounded, sql_round

HOLD, PT, SL, WIDTH = 10 * 86_400, 1.2, 1.0, 0.05
THRESHOLD = 0.25
SPANS, KS, MULTIPLES, HOLDINGS = (60, 120), (1.5, 2.5), ((1.0, 1.0), (1.5, 1.0)), (5 * 86_400, 10 * 86_400)


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return days(spark, sf_dir).select("symbol", "ts", "c")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days after a move beyond a tenth."""
    from pyspark.sql import Window

    p = _prices(spark, sf_dir)
    move = F.log("c") - F.lag(F.log("c")).over(Window.partitionBy("symbol").orderBy("ts"))
    return p.withColumn("move", move).where(F.abs("move") > 0.1).select("symbol", "ts", F.lit(WIDTH).alias("trgt"), F.signum("move").alias("side"))


ENTRIES = f"{DAYS}, moves AS (SELECT symbol, bar, c, ln(c) - ln({lagged('c')}) AS move FROM days), entries AS (SELECT symbol, bar, sign(move) AS side FROM moves WHERE abs(move) > 0.1)"
BARRIERS = f"""{ENTRIES},
vert AS (SELECT e.*, (SELECT min(d.bar) FROM days d WHERE d.bar >= e.bar + {HOLD}) AS vertical FROM entries e), final_bar AS (SELECT max(bar) AS final FROM days),
paths AS (SELECT v.symbol, v.bar, d.bar AS touch, (d.c / s.c - 1) * v.side AS gain FROM vert v JOIN final_bar ON true JOIN days s ON s.bar = v.bar JOIN days d ON d.bar BETWEEN v.bar AND coalesce(v.vertical, final)),
hits AS (SELECT bar, min(touch) FILTER (gain > {PT * WIDTH!r}) AS pt, min(touch) FILTER (gain < -{SL * WIDTH!r}) AS sl FROM paths GROUP BY bar),
touched AS (SELECT v.symbol, v.bar, v.side, v.vertical, h.pt, h.sl, least(v.vertical, h.pt, h.sl) AS exit FROM vert v LEFT JOIN hits h USING (bar)),
barriers AS (SELECT t.*, s.c AS price, CASE WHEN exit IS NULL THEN 0 ELSE (ln(x.c) - ln(s.c)) * side END AS ret,
  CASE WHEN exit IS NULL THEN 'none' WHEN exit = sl THEN 'stop' WHEN exit = pt THEN 'profit' ELSE 'vertical' END AS barrier FROM touched t JOIN days s ON s.bar = t.bar LEFT JOIN days x ON x.bar = t.exit)"""


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return barriers.triple_barrier(_entries(spark, sf_dir), _prices(spark, sf_dir), PT, SL, HOLD, "trgt", "side")


def barrier_vertical(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = barriers.vertical_barriers(_entries(spark, sf_dir), _prices(spark, sf_dir), HOLD)
    return found.select("symbol", epoch().alias("bar"), F.coalesce(epoch("vertical"), F.lit(-1)).alias("vertical"))


def barrier_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presented(_labelled(spark, sf_dir), ["price", "ret", "side"], ["barrier", F.coalesce(epoch("exit"), F.lit(-1)).alias("exit")], digits=5)


def barrier_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = barriers.outcome_counts(_labelled(spark, sf_dir), ["symbol"])
    return found.select("symbol", "events", "profits", "losses", "neutral", "verticals", rounded("profit_ratio").alias("profit_ratio"), rounded("loss_ratio").alias("loss_ratio"))


def barrier_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans, threshold factors, multiples and holding times of one symbol's bars."""
    found = barriers.barrier_grid(_prices(spark, sf_dir), SPANS, KS, MULTIPLES, HOLDINGS)
    return found.select(*[c for c in found.columns if not c.endswith("ratio")], rounded("profit_ratio").alias("profit_ratio"), rounded("loss_ratio").alias("loss_ratio"))


def cusum(spark: SparkSession, sf_dir: str) -> DataFrame:
    close = barriers.prepared_close(bars(spark, sf_dir))
    return presented(barriers.cusum_events(close, THRESHOLD), ["side"])


def cusum_tables(source: str, keys: tuple[str, ...] = ("symbol",)) -> str:
    """The recursive table ``s`` (keys, bar, rn, side) over ``source`` (keys, bar, rn, d: the change, t: the threshold)."""
    named = ", ".join(f"d.{k}" for k in keys)
    up, down, able = "greatest(0, s.up + d.d)", "least(0, s.down + d.d)", "coalesce(d.t > 0, false)"
    return f"""s AS (SELECT {', '.join(keys)}, bar, rn, CAST(0 AS DOUBLE) AS up, CAST(0 AS DOUBLE) AS down, CAST(0 AS DOUBLE) AS side FROM {source} WHERE rn = 1 UNION ALL
  SELECT {named}, d.bar, d.rn, CASE WHEN NOT {able} THEN s.up WHEN {up} > d.t THEN 0 ELSE {up} END,
    CASE WHEN NOT {able} THEN s.down WHEN {up} <= d.t AND {down} < -d.t THEN 0 ELSE {down} END,
    CASE WHEN NOT {able} THEN 0 WHEN {up} > d.t THEN 1 WHEN {down} < -d.t THEN -1 ELSE 0 END
  FROM s JOIN {source} d ON {' AND '.join(f'd.{k} = s.{k}' for k in keys)} AND d.rn = s.rn + 1)"""


_CHANGES = f"SELECT symbol, bar, rn, ln(c) - ln({lagged('c')}) AS d FROM base"
_CUSUM = f"""WITH RECURSIVE {BASE}, d AS (SELECT *, {THRESHOLD} AS t FROM ({_CHANGES})), {cusum_tables('d')}
SELECT symbol, bar, side FROM s WHERE side <> 0"""


def cusum_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds that follow the volatility."""
    close = barriers.ewm_volatility(barriers.prepared_close(bars(spark, sf_dir)), 60, 1.5)
    return presented(barriers.cusum_events(close, "volatility"), ["side"])


def volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presented(barriers.ewm_volatility(barriers.prepared_close(bars(spark, sf_dir)), 20), ["volatility"], digits=8)


def volatility_tables(span: int, name: str = "") -> str:
    """Tables ending in ``vol{name}`` (symbol, bar, volatility) over ``d`` (symbol, bar, rn, d)."""
    p, m, v, k = (f"{x}{name}" for x in "pmvk")
    return f"""{p} AS (SELECT a.symbol, a.bar, a.rn, power(1 - 2.0 / {span + 1}, a.rn - b.rn) AS w, b.d FROM d a JOIN d b ON a.symbol = b.symbol AND b.rn <= a.rn AND b.d IS NOT NULL),
{m} AS (SELECT symbol, bar, rn, sum(w) AS w, sum(w * w) AS w2, sum(w * d) / sum(w) AS m FROM {p} GROUP BY ALL),
{v} AS (SELECT m.symbol, m.bar, m.rn, sqrt(sum(p.w * (p.d - m) * (p.d - m)) / any_value(m.w) / nullif(1 - any_value(w2) / (any_value(m.w) * any_value(m.w)), 0)) AS v FROM {p} p JOIN {m} m USING (symbol, bar, rn) GROUP BY ALL),
{k} AS (SELECT d.symbol, d.bar, CASE WHEN d.rn >= 3 THEN v END AS v FROM d LEFT JOIN {v} USING (symbol, bar)),
vol{name} AS (SELECT symbol, bar, first_value(v IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS volatility FROM {k})"""


_VOLATILITY = f"WITH {BASE}, d AS ({_CHANGES}), {volatility_tables(20)} SELECT symbol, bar, {sql_round('volatility', 8)} AS volatility FROM vol"
_DYNAMIC = f"""WITH RECURSIVE {BASE}, d AS ({_CHANGES}), {volatility_tables(60)}, x AS (SELECT d.*, 1.5 * volatility AS t FROM d JOIN vol USING (symbol, bar)), {cusum_tables('x')}
SELECT symbol, bar, side FROM s WHERE side <> 0"""
_VALUES = lambda name, values: f"(VALUES {', '.join('(' + ', '.join(map(str, v)) + ')' for v in values)}) AS {name}"
_SWEEP = f"""WITH RECURSIVE {DAYS}, base AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar) AS rn FROM days), d AS ({_CHANGES}),
{', '.join(volatility_tables(span, str(span)) for span in SPANS)},
vols AS ({' UNION ALL '.join(f"SELECT symbol, bar, {span} AS span, volatility FROM vol{span}" for span in SPANS)}),
x AS (SELECT symbol, bar, rn, d, span, CAST(k AS DOUBLE) AS k, k * volatility AS t FROM d JOIN vols USING (symbol, bar), {_VALUES('f(k)', [(k,) for k in KS])}),
{cusum_tables('x', ('symbol', 'span', 'k'))},
ev AS (SELECT s.symbol, s.bar, s.span, s.k, x.t AS trgt, days.c AS entry FROM s JOIN x USING (symbol, span, k, bar) JOIN days USING (symbol, bar) WHERE side <> 0),
held AS (SELECT ev.*, holding, pt, sl, (SELECT min(y.bar) FROM days y WHERE y.bar >= ev.bar + holding) AS vertical FROM ev, {_VALUES('h(holding)', [(h,) for h in HOLDINGS])}, {_VALUES('m(pt, sl)', MULTIPLES)}),
last_bar AS (SELECT max(bar) AS final FROM days),
touched AS (SELECT h.symbol, h.bar, span, k, holding, pt, sl, min(y.bar) FILTER (y.c / entry - 1 > pt * trgt OR y.c / entry - 1 < -sl * trgt) AS touch
  FROM held h JOIN last_bar ON true JOIN days y ON y.bar BETWEEN h.bar AND coalesce(vertical, final) GROUP BY ALL),
done AS (SELECT h.span, h.k, h.pt, h.sl, h.holding, CASE WHEN touch IS NOT NULL THEN 'touch' WHEN vertical IS NOT NULL THEN 'vertical' ELSE 'none' END AS barrier, coalesce(ln(y.c) - ln(entry), 0) AS ret
  FROM held h JOIN touched t USING (symbol, bar, span, k, holding, pt, sl) LEFT JOIN days y ON y.bar = coalesce(touch, vertical))
SELECT CAST(span AS INTEGER) AS span, k, CAST(pt AS DOUBLE) AS pt, CAST(sl AS DOUBLE) AS sl, CAST(holding AS INTEGER) AS holding, count(*) AS events, count(*) FILTER (ret > 0) AS profits,
  count(*) FILTER (ret < 0) AS losses, count(*) FILTER (ret = 0) AS neutral, count(*) FILTER (barrier = 'vertical') AS verticals,
  {sql_round('coalesce(count(*) FILTER (ret > 0) * 1.0 / nullif(count(*) FILTER (ret <> 0), 0), 0)')} AS profit_ratio, {sql_round('coalesce(count(*) FILTER (ret < 0) * 1.0 / nullif(count(*) FILTER (ret <> 0), 0), 0)')} AS loss_ratio
FROM done GROUP BY 1, 2, 3, 4, 5"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.events_from_barriers(_labelled(spark, sf_dir))


EVENTS = f"{BARRIERS}, events AS (SELECT symbol, bar AS t0, exit AS t1, ret, side, row_number() OVER (ORDER BY bar) - 1 AS event_id FROM barriers WHERE exit IS NOT NULL)"
COUNTED = f"""{EVENTS}, counted AS (SELECT d.symbol, d.bar, any_value(d.c) AS c, count(e.t0) AS concurrent FROM days d LEFT JOIN events e ON d.bar BETWEEN e.t0 AND e.t1 GROUP BY ALL),
rets AS (SELECT *, coalesce(ln(c) - ln({lagged('c')}), 0) AS r FROM counted)"""
WEIGHTS = f"""{COUNTED}, covered AS (SELECT e.symbol, e.event_id, e.t0, avg(1.0 / concurrent) AS tw, abs(sum(r / concurrent)) AS wr FROM events e JOIN rets x ON x.bar BETWEEN e.t0 AND e.t1 GROUP BY ALL),
scaled AS (SELECT *, wr * count(*) OVER () / sum(wr) OVER () AS w_ret, sum(tw) OVER (ORDER BY t0 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run, sum(tw) OVER () AS total FROM covered),
decayed AS (SELECT *, greatest(0, 1 - 0.5 / total * total + 0.5 / total * run) AS w_td FROM scaled),
weights AS (SELECT *, tw * w_ret * w_td * count(*) OVER () / sum(tw * w_ret * w_td) OVER () AS w FROM decayed)"""


def event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("symbol", "event_id", epoch("t0").alias("t0"), epoch("t1").alias("t1"), rounded("ret", 5).alias("ret"), rounded("side").alias("side"))


def event_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.concurrency(_prices(spark, sf_dir), _events(spark, sf_dir)).select("symbol", epoch().alias("bar"), "concurrent")


def event_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sampling.composite_weights(_prices(spark, sf_dir), _events(spark, sf_dir), td=0.5)
    return found.select("symbol", "event_id", *[rounded(c, 5).alias(n) for c, n in (("tW", "tw"), ("w_ret", "w_ret"), ("w_td", "w_td"), ("w", "w"))])


def event_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.indicator_pairs(_prices(spark, sf_dir), _events(spark, sf_dir)).select("symbol", epoch().alias("bar"), "event_id")


def event_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = sampling.indicator_pairs(_prices(spark, sf_dir), _events(spark, sf_dir))
    return sampling.average_uniqueness(pairs).select("symbol", "event_id", rounded("uniqueness").alias("uniqueness"))


def event_top_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row, of nulls where no event has a weight: the average of more order lines a day can leave no move beyond a tenth."""
    found = sampling.top_mass(sampling.composite_weights(_prices(spark, sf_dir), _events(spark, sf_dir), td=0.5))
    found = spark.range(1).select(F.lit("all").alias("symbol")).join(found, "symbol", "left")
    return found.select("symbol", *[rounded(c).alias(c) for c in ("weight_top_1pct_mass", "weight_top_5pct_mass")])


def bootstrap_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sequential draw over all daily events."""
    return sampling.sequential_bootstrap(sampling.event_ranges(_prices(spark, sf_dir), _events(spark, sf_dir)))


def bootstrap_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 plain and sequential draws over all daily events, compared."""
    b, e = _prices(spark, sf_dir), _events(spark, sf_dir)
    found = sampling.sampling_quality(sampling.bootstrap_trials(sampling.event_ranges(b, e), 100), sampling.composite_weights(b, e))
    return found.select("symbol", *[rounded(c).alias(c) for c in found.columns if c != "symbol"])


def sampling_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of one sequential draw over all daily entries, with their weights."""
    found = sampling.sampling_pipeline(_prices(spark, sf_dir), _entries(spark, sf_dir), PT, SL, HOLD, 0.5, "trgt")["rows"]
    return found.select("symbol", "place", "event_id", *[rounded(c).alias(n) for c, n in (("tW", "tw"), ("w_ret", "w_ret"), ("w_td", "w_td"), ("w", "w"))])


QUERIES = {
    f.__name__: f
    for f in (
        sampling_pipeline, barrier_vertical, barrier_labels, barrier_outcomes, barrier_sweep, cusum, cusum_dynamic, volatility, event_table, event_concurrency, event_weights,
        event_pairs, event_uniqueness, event_top_mass, bootstrap_draws, bootstrap_quality,
    )
}
_HEAVY = "heavy AS (SELECT w, row_number() OVER (ORDER BY w DESC) AS r, count(*) OVER () AS n FROM weights WHERE w > 0)"
SQL = {
    "barrier_vertical": f"WITH {BARRIERS} SELECT symbol, bar, coalesce(vertical, -1) AS vertical FROM vert",
    "barrier_labels": f"WITH {BARRIERS} SELECT symbol, bar, barrier, coalesce(exit, -1) AS exit, {sql_round('price', 5)} AS price, {sql_round('ret', 5)} AS ret, {sql_round('side', 5)} AS side FROM barriers",
    "barrier_outcomes": f"""WITH {BARRIERS} SELECT symbol, count(*) AS events, count(*) FILTER (ret > 0) AS profits, count(*) FILTER (ret < 0) AS losses, count(*) FILTER (ret = 0) AS neutral,
count(*) FILTER (barrier = 'vertical') AS verticals, {sql_round('count(*) FILTER (ret > 0) * 1.0 / count(*) FILTER (ret <> 0)')} AS profit_ratio, {sql_round('count(*) FILTER (ret < 0) * 1.0 / count(*) FILTER (ret <> 0)')} AS loss_ratio FROM barriers GROUP BY symbol""",
    "cusum": _CUSUM,
    "cusum_dynamic": _DYNAMIC,
    "barrier_sweep": _SWEEP,
    "volatility": _VOLATILITY,
    "event_table": f"WITH {EVENTS} SELECT symbol, event_id, t0, t1, {sql_round('ret', 5)} AS ret, {sql_round('side')} AS side FROM events",
    "event_concurrency": f"WITH {COUNTED} SELECT symbol, bar, concurrent FROM counted",
    "event_weights": f"WITH {WEIGHTS} SELECT symbol, event_id, {', '.join(f'{sql_round(c, 5)} AS {c}' for c in ('tw', 'w_ret', 'w_td', 'w'))} FROM weights",
    "event_pairs": f"WITH {EVENTS} SELECT d.symbol, d.bar, event_id FROM events e JOIN days d ON d.bar BETWEEN t0 AND t1",
    "event_uniqueness": f"WITH {WEIGHTS} SELECT symbol, event_id, {sql_round('tw')} AS uniqueness FROM weights",
    "event_top_mass": f"WITH {WEIGHTS}, {_HEAVY} SELECT 'all' AS symbol, {sql_round('sum(w) FILTER (r <= greatest(1, ceil(n * 0.01))) / sum(w)')} AS weight_top_1pct_mass, {sql_round('sum(w) FILTER (r <= greatest(1, ceil(n * 0.05))) / sum(w)')} AS weight_top_5pct_mass FROM heavy",
}
