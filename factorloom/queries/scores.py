"""Metrics of factors, factor tables, models, simulation and evolution."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import backtest, evolve, labels, metrics, mining
from ..plans.compile import compile_factors, evaluate_last
from .common import BASE, bars, epoch, most_bars, presented, rounded, sql_round

#: Plain factors, so that their SQL is short.
FACTORS = {"f1": "sub(c, o)", "f2": "sub(h, l)"}
S = metrics.Scoring(periods=4 * 365, window=30)
SPLIT_AT = 1_705_708_800  # 2024-01-20


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, ts, c, o, f1, f2, y, split): factors and the next bar's log return."""
    now = bars(spark, sf_dir).withColumn("y", labels.forward_return("c", 1))
    rows = compile_factors(now.dropna(subset=["y"]), FACTORS, keep=["o", "c", "y"])
    return rows.withColumn("split", F.when(epoch() < SPLIT_AT, "train").otherwise("test"))


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.long_form(frame(spark, sf_dir), list(FACTORS), "y", S)


def _metric_query(name: str, group, columns: list[str], digits: int = 6):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return group(_long(spark, sf_dir), S).select("factor", "symbol", *[rounded(c, digits).alias(c) for c in columns])

    run.__name__ = name
    return run


FRAME = f"""{BASE}, y AS (SELECT symbol, bar, rn, o, h, l, c, c - o AS f1, h - l AS f2, ln(lead(c) OVER (PARTITION BY symbol ORDER BY bar)) - ln(c) AS y FROM base),
frame AS (SELECT * FROM y WHERE y IS NOT NULL),
long AS (SELECT symbol, bar, 'f1' AS factor, f1 AS p, y FROM frame UNION ALL SELECT symbol, bar, 'f2', f2, y FROM frame)"""
G = "factor, symbol"


def _rank(x: str, keys: str) -> str:
    return f"rank() OVER (PARTITION BY {keys} ORDER BY {x}) + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0"


def _chunk(order: str, source: str = "long", keys: str = G) -> str:
    return f"SELECT *, ntile(5) OVER (PARTITION BY {keys} ORDER BY {order}) AS chunk FROM {source}"


def _corr(a: str, b: str) -> str:
    return f"covar_samp({a}, {b}) / nullif(stddev_samp({a}) * stddev_samp({b}), 0)"


def _run(x: str, keys: str = G) -> str:
    return f"{x} OVER (PARTITION BY {keys} ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _out(columns: list[str], digits: int = 6) -> str:
    return f"{G}, " + ", ".join(f"{sql_round(c, digits)} AS {c}" for c in columns)


FIT = ["weighted_pearson", "mean_absolute_error", "mean_square_error", "root_mean_square_error", "log_loss"]
PATH = ["max_dd", "avg_mdd", "calmar", "sharp"]
MARGIN = ["extreme_wrong_sign_penalty", "weighted_margin_score", "asym_extreme_direction_score"]
RETURN = "greatest(-0.2, least(0.2, y)) * greatest(-20, least(20, p))"

_FIT = f"""WITH {FRAME}, c AS (SELECT *, greatest(1e-15, least(1 - 1e-15, p)) AS lp, greatest(1e-15, least(1 - 1e-15, 1 - p)) AS lq FROM long),
m AS (SELECT {G}, abs(corr(p, y)) AS weighted_pearson, avg(abs(p - y)) AS mean_absolute_error, avg((p - y) * (p - y)) AS mean_square_error,
  sqrt(avg((p - y) * (p - y))) AS root_mean_square_error, avg(-(y * ln(lp) + (1 - y) * ln(lq))) AS log_loss FROM c GROUP BY ALL) SELECT {_out(FIT, 5)} FROM m"""
_RANKS = f"""WITH {FRAME}, r AS (SELECT {G}, {_rank('p', G)} AS rp, {_rank('y', G)} AS ry FROM long),
m AS (SELECT {G}, abs(corr(rp, ry)) AS weighted_spearman FROM r GROUP BY ALL) SELECT {_out(['weighted_spearman'])} FROM m"""
_CHUNKS = f"""WITH {FRAME}, c AS ({_chunk('bar')}), r AS (SELECT *, {_rank('p', G + ', chunk')} AS rp, {_rank('y', G + ', chunk')} AS ry FROM c),
k AS (SELECT {G}, chunk, {_corr('p', 'y')} AS pic, {_corr('rp', 'ry')} AS sic FROM r GROUP BY ALL),
m AS (SELECT {G}, avg(pic) AS avg_pic, avg(sic) AS avg_sic FROM k GROUP BY ALL) SELECT {_out(['avg_pic', 'avg_sic'])} FROM m"""
_RANGE_PARTS = f"""c AS ({_chunk('p, bar')}), r AS (SELECT *, {_rank('p', G + ', chunk')} AS rp, {_rank('y', G + ', chunk')} AS ry FROM c),
k AS (SELECT {G}, chunk, {_corr('rp', 'ry')} AS ic, max(p) AS up, min(p) AS dn FROM r GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY {G} ORDER BY ic DESC, chunk) AS place FROM k WHERE ic IS NOT NULL)"""
_RANGES = f"""WITH {FRAME}, {_RANGE_PARTS}
SELECT a.factor, a.symbol, {sql_round('a.ic')} AS max_ic_value, CAST(a.chunk AS INTEGER) AS max_ic_group, (a.chunk - 1 + b.chunk - 1) BETWEEN 3 AND 5 AS max_ic_symmetric,
  {sql_round('a.up')} AS max_ic_up, {sql_round('a.dn')} AS max_ic_dn FROM o a JOIN o b ON a.factor = b.factor AND a.symbol = b.symbol AND a.place = 1 AND b.place = 2"""
_PATHS = f"""WITH {FRAME}, r AS (SELECT *, {RETURN} AS r, ntile(5) OVER (PARTITION BY {G} ORDER BY bar) AS chunk FROM long), q AS (SELECT *, {_run('sum(r)')} AS pnl FROM r),
d AS (SELECT *, pnl - {_run('max(pnl)')} AS fall, pnl - {_run('max(pnl)', G + ', chunk')} AS part FROM q),
k AS (SELECT {G}, chunk, min(part) AS part FROM d GROUP BY ALL), ka AS (SELECT {G}, avg(part) AS avg_mdd FROM k GROUP BY ALL),
m AS (SELECT {G}, min(fall) AS max_dd, avg(r) * 1460 / -nullif(min(fall), 0) AS calmar, avg(r) / stddev_pop(r) * sqrt(1460.0) AS sharp FROM d GROUP BY ALL)
SELECT {_out(PATH, 5)} FROM m JOIN ka USING (factor, symbol)"""
_W = f"OVER (PARTITION BY {G} ORDER BY bar ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"
_POSITIONS = f"""WITH {FRAME}, b AS (SELECT *, count(*) {_W} AS n, quantile_cont(p, 0.1) {_W} AS lo, quantile_cont(p, 0.9) {_W} AS hi, avg(p) {_W} AS m, stddev_samp(p) {_W} AS d FROM long),
h AS (SELECT *, CASE WHEN n = 30 AND p > hi THEN 1 WHEN n = 30 AND p < lo THEN -1 ELSE 0 END * greatest(-0.2, least(0.2, y)) AS a,
  CASE WHEN n = 30 AND p > m + 2 * d THEN 1 WHEN n = 30 AND p < m - 2 * d THEN -1 ELSE 0 END * greatest(-0.2, least(0.2, y)) AS b FROM b),
m AS (SELECT {G}, avg(a) / nullif(stddev_pop(a), 0) * sqrt(1460.0) AS sharpe_fixed_threshold, avg(b) / nullif(stddev_pop(b), 0) * sqrt(1460.0) AS sharpe_std_threshold FROM h GROUP BY ALL)
SELECT {_out(['sharpe_fixed_threshold', 'sharpe_std_threshold'], 5)} FROM m"""
_MARGINS = f"""WITH {FRAME}, b AS (SELECT {G}, quantile_cont(y, 0.01) AS lo, quantile_cont(y, 0.99) AS hi FROM long GROUP BY ALL),
c AS (SELECT long.*, greatest(lo, least(hi, y)) AS yc FROM long JOIN b USING (factor, symbol)), t AS (SELECT {G}, quantile_cont(abs(yc), 0.95) AS lim FROM c GROUP BY ALL),
e AS (SELECT c.*, p * yc AS margin, abs(yc) >= lim AS extreme, CASE WHEN abs(yc) >= lim THEN 1 + abs(yc) / (lim + 1e-12) ELSE 1 END AS heavy FROM c JOIN t USING (factor, symbol)),
m AS (SELECT {G}, avg(y * sign(p)) - avg(CASE WHEN margin < 0 AND extreme THEN heavy ELSE 0 END) AS extreme_wrong_sign_penalty, avg(y * sign(p)) - avg(heavy * greatest(0, -margin)) AS weighted_margin_score,
  avg(y * sign(p)) - avg(heavy * (3 * greatest(0, -margin) + 0.3 * greatest(0, 0.2 - margin))) AS asym_extreme_direction_score FROM e GROUP BY ALL) SELECT {_out(MARGIN, 5)} FROM m"""
_EDGES = ", ".join(str(k / 16) for k in range(1, 16))
_INFORMATION = f"""WITH {FRAME}, e AS (SELECT {G}, quantile_cont(p, [{_EDGES}]) AS ep, quantile_cont(y, [{_EDGES}]) AS ey, min(p) AS p0, max(p) AS p1, min(y) AS y0, max(y) AS y1, count(*) AS n FROM long GROUP BY ALL),
b AS (SELECT {G}, n, len(list_filter(list_distinct(ep), lambda x: x > p0 AND x < p1 AND x < p - abs(p) * 1e-12)) AS bp, len(list_filter(list_distinct(ey), lambda x: x > y0 AND x < y1 AND x < y - abs(y) * 1e-12)) AS b_y FROM long JOIN e USING (factor, symbol)),
c AS (SELECT {G}, bp, b_y, count(*) * 1.0 / any_value(n) AS q FROM b GROUP BY ALL), d AS (SELECT *, sum(q) OVER (PARTITION BY {G}, bp) AS qp, sum(q) OVER (PARTITION BY {G}, b_y) AS qy FROM c),
m AS (SELECT {G}, sum(q * ln((q + 1e-12) / (qp * qy + 1e-12))) AS mi, -sum(q * ln(qp + 1e-12)) AS hp, -sum(q * ln(qy + 1e-12)) AS hy FROM d GROUP BY ALL),
z AS (SELECT {G}, mi / sqrt(hp * hy) AS mi_score, mi / hy AS entropy_gain_score FROM m) SELECT {_out(['mi_score', 'entropy_gain_score'], 4)} FROM z"""
_CONSTRAINED = f"""WITH {FRAME}, s AS (SELECT {G}, avg(CASE WHEN (p > 0) = (y > 0) THEN 1.0 ELSE 0 END) AS hit, coalesce({_corr('p', 'y')}, 0) AS r, max(p) - min(p) AS reach, max(abs(p)) AS top,
  count(*) FILTER (abs(y) > 0.02) AS wild, avg(CASE WHEN (p > 0) = (y > 0) THEN 1.0 ELSE 0 END) FILTER (abs(y) > 0.02) AS wild_hit FROM long GROUP BY ALL),
c AS ({_chunk('bar')}), e AS (SELECT {G}, chunk, list_sort(list(p)) AS ps, list_sort(list(y)) AS ys FROM c GROUP BY ALL),
d AS (SELECT {G}, avg(list_sum(list_transform(range(1, len(ps) + 1), lambda i: abs(ps[i] - ys[i]))) / len(ps)) AS emd FROM e GROUP BY ALL),
g AS (SELECT long.*, 1 + p / nullif(top, 0) * y AS g FROM long JOIN s USING (factor, symbol)),
v AS (SELECT *, CASE WHEN {_run('min(g)')} > 0 THEN exp({_run('sum(ln(greatest(g, 1e-300)))')}) END AS v FROM g), w AS (SELECT *, {_run('max(v)')} AS peak FROM v),
f AS (SELECT {G}, max((peak - v) / peak) AS fall, min(g) AS least FROM w GROUP BY ALL),
z AS (SELECT {G}, hit * (1 + abs(r)) / 2 - (0.25 * CASE WHEN reach > 1e-8 THEN emd / reach ELSE 1 END + 0.25 * CASE WHEN wild < 5 THEN 0 ELSE (1 - wild_hit) * (1 - wild_hit) END
  + 0.2 * CASE WHEN least <= 0 THEN 1 ELSE least(fall, 1) END) AS score FROM s JOIN d USING (factor, symbol) JOIN f USING (factor, symbol))
SELECT {G}, {sql_round('CASE WHEN score > 0 THEN score ELSE -999 END', 5)} AS risk_constrained_chunk FROM z"""


def metric_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.range_metrics(_long(spark, sf_dir), S)
    return found.select("factor", "symbol", "max_ic_group", "max_ic_symmetric", *[rounded(c).alias(c) for c in ("max_ic_value", "max_ic_up", "max_ic_dn")])


def metric_constrained(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.constrained_metrics(_long(spark, sf_dir), S)
    x = F.col("risk_constrained_chunk")
    return found.select("factor", "symbol", rounded(F.when(x == float("-inf"), F.lit(-999.0)).otherwise(x), 5).alias("risk_constrained_chunk"))


def metric_given_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range of a factor that is best in all rows, tried on those rows."""
    long = _long(spark, sf_dir)
    bounds = metrics.range_metrics(long, S).select("factor", "symbol", F.col("max_ic_up").alias("up"), F.col("max_ic_dn").alias("dn"))
    found = metrics.given_range_ic(long, bounds, S)
    return found.select("factor", "symbol", "rows", rounded("given_ic").alias("given_ic"))


_GIVEN = f"""WITH {FRAME}, {_RANGE_PARTS}, i AS (SELECT long.* FROM long JOIN o USING (factor, symbol) WHERE place = 1 AND p BETWEEN dn AND up),
j AS (SELECT {G}, {_rank('p', G)} AS rp, {_rank('y', G)} AS ry FROM i)
SELECT {G}, count(*) AS rows, {sql_round(f"CASE WHEN count(*) > 20 THEN {_corr('rp', 'ry')} END")} AS given_ic FROM j GROUP BY ALL"""


def result_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.paths(_long(spark, sf_dir), S)
    return presented(found, ["rts", "pnl", "rolling_sharp"], ["factor"])


_RESULT_PATHS = f"""WITH {FRAME}, r AS (SELECT *, {RETURN} AS r FROM long)
SELECT symbol, bar, factor, {sql_round('r')} AS rts, {sql_round(_run('sum(r)'))} AS pnl,
  {sql_round(f"CASE WHEN count(*) {_W} = 30 THEN coalesce(avg(r) {_W} / nullif(stddev_samp(r) {_W}, 0) * sqrt(1460.0), 0) ELSE 0 END")} AS rolling_sharp FROM r"""


def decay_of_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compile_factors(bars(spark, sf_dir), FACTORS, keep=["c"], longest=most_bars(spark, sf_dir))
    found = backtest.ic_decay(rows, list(FACTORS), lags=(1, 3, 5, 7))
    return found.select("factor", "symbol", "lag", rounded("ic").alias("ic"))


_DECAY = f"""WITH {BASE}, a AS (SELECT symbol, bar, c - o AS f1, h - l AS f2, unnest([1, 3, 5, 7]) AS lag, c, rn FROM base),
b AS (SELECT a.*, coalesce(ln(z.c) - ln(a.c), 0) AS r FROM a LEFT JOIN base z ON z.symbol = a.symbol AND z.rn = a.rn + a.lag),
l AS (SELECT symbol, lag, 'f1' AS factor, f1 AS x, r FROM b UNION ALL SELECT symbol, lag, 'f2', f2, r FROM b)
SELECT factor, symbol, lag, {sql_round(_corr('x', 'r'))} AS ic FROM l GROUP BY ALL"""


def factor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training and test scores, with the percentile ranks of the factors' test correlations."""
    found = backtest.factor_table(frame(spark, sf_dir), list(FACTORS), ["avg_pic", "sharp"], "y", scoring=S)
    found = backtest.with_percent_ranks(found, ["fitness_avg_pic_test"])
    return found.select("factor", "symbol", *[rounded(c, 5).alias(c) for c in found.columns if c not in ("factor", "symbol")])


def _split_scores(part: str, test: str) -> str:
    return f"""l_{part} AS (SELECT * FROM long WHERE bar {test} {SPLIT_AT}), c_{part} AS ({_chunk('bar', f'l_{part}')}),
k_{part} AS (SELECT {G}, chunk, {_corr('p', 'y')} AS pic FROM c_{part} GROUP BY ALL), a_{part} AS (SELECT {G}, CASE WHEN count(pic) = count(*) THEN avg(pic) END AS pic FROM k_{part} GROUP BY ALL),
s_{part} AS (SELECT {G}, avg({RETURN}) / nullif(stddev_pop({RETURN}), 0) * sqrt(1460.0) AS sharp FROM l_{part} GROUP BY ALL)"""


_FACTOR_SCORES = f"""WITH {FRAME}, {_split_scores('train', '<')}, {_split_scores('test', '>=')},
c AS ({_chunk('p, bar', 'l_train')}), r AS (SELECT *, {_rank('p', G + ', chunk')} AS rp, {_rank('y', G + ', chunk')} AS ry FROM c),
k AS (SELECT {G}, chunk, {_corr('rp', 'ry')} AS ic, max(p) AS up, min(p) AS dn FROM r GROUP BY ALL), o AS (SELECT * FROM k WHERE ic IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {G} ORDER BY ic DESC, chunk) = 1),
i AS (SELECT l_test.* FROM l_test JOIN o USING (factor, symbol) WHERE p BETWEEN dn AND up), j AS (SELECT {G}, {_rank('p', G)} AS rp, {_rank('y', G)} AS ry FROM i),
g AS (SELECT {G}, CASE WHEN count(*) > 20 THEN {_corr('rp', 'ry')} END AS given FROM j GROUP BY ALL)
SELECT a.factor, a.symbol, {sql_round('a.pic', 5)} AS fitness_avg_pic_train, {sql_round('b.pic', 5)} AS fitness_avg_pic_test, {sql_round('s.sharp', 5)} AS fitness_sharp_train, {sql_round('t.sharp', 5)} AS fitness_sharp_test,
  {sql_round('given', 5)} AS given_ic_test, {sql_round('CASE WHEN b.pic IS NOT NULL THEN (rank() OVER (ORDER BY b.pic) + (count(*) OVER (PARTITION BY b.pic) - 1) / 2.0) / count(b.pic) OVER () END', 5)} AS fitness_avg_pic_test_pct_rank
FROM a_train a JOIN a_test b USING (factor, symbol) JOIN s_train s USING (factor, symbol) JOIN s_test t USING (factor, symbol) LEFT JOIN g USING (factor, symbol)"""


def elite_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores at or above their medians in both columns; columns that are absent don't count."""
    table = metrics.evaluate(frame(spark, sf_dir), list(FACTORS), ["avg_pic", "sharp"], "y", scoring=S)
    found = backtest.elite_pool(table, ["avg_pic", "sharp", "absent"], 0.5)
    return found.select("factor", "symbol", *[rounded(c, 5).alias(c) for c in ("avg_pic", "sharp")])


_ELITE = f"""WITH {FRAME}, c AS ({_chunk('bar')}), k AS (SELECT {G}, chunk, {_corr('p', 'y')} AS pic FROM c GROUP BY ALL), a AS (SELECT {G}, CASE WHEN count(pic) = count(*) THEN avg(pic) END AS avg_pic FROM k GROUP BY ALL),
s AS (SELECT {G}, avg({RETURN}) / nullif(stddev_pop({RETURN}), 0) * sqrt(1460.0) AS sharp FROM long GROUP BY ALL), t AS (SELECT * FROM a JOIN s USING (factor, symbol) WHERE avg_pic IS NOT NULL AND sharp IS NOT NULL),
q AS (SELECT quantile_cont(avg_pic, 0.5) AS qa, quantile_cont(sharp, 0.5) AS qs FROM t) SELECT {_out(['avg_pic', 'sharp'], 5)} FROM t, q WHERE avg_pic >= qa AND sharp >= qs"""


def table_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old rows win over new ones of the same key."""
    b = bars(spark, sf_dir).groupBy(F.col("symbol").alias("expression")).agg(F.count("*").alias("n"))
    old = b.where("expression < 'm'").withColumn("n", F.lit(-1).cast("long"))
    return backtest.upsert(old, b)


def table_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = backtest.diagnostics(bars(spark, sf_dir).select("vol", "vol_ccy"), "vol_ccy", "vol")
    return found.select("n", rounded("spearman").alias("spearman"))


def factor_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compile_factors(bars(spark, sf_dir), FACTORS | {"f3": "sub(c, l)"}, longest=most_bars(spark, sf_dir))
    return backtest.correlations(rows, ["f1", "f2", "f3"]).select("a", "b", rounded("r").alias("r"))


def _modelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir)
    model, scale = backtest.fit_model(rows, ["f1"], "y")
    return backtest.positions(rows, model, scale, ["f1"])


def linear_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of a least-squares model of one factor, fitted on the training rows."""
    return presented(_modelled(spark, sf_dir), ["pos"], ["split"], digits=5)


_MODEL = f"""{FRAME}, m AS (SELECT regr_slope(y, f1) AS b, regr_intercept(y, f1) AS a FROM frame WHERE bar < {SPLIT_AT}),
q AS (SELECT quantile_cont(a + b * f1, 0.01) AS lo, quantile_cont(a + b * f1, 0.99) AS hi FROM frame, m WHERE bar < {SPLIT_AT}),
modelled AS (SELECT frame.*, greatest(-5, least(5, (a + b * f1) * 2 / (abs(lo) + abs(hi)))) AS pos FROM frame, m, q)"""


def simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir).withColumn("pos", F.signum("f1"))
    return presented(backtest.simulate(rows), ["pos", "trade_price", "gain", "pnl"])


_SIMULATION = f"""{FRAME}, a AS (SELECT symbol, bar, sign(f1) AS pos, c, lead(o) OVER (PARTITION BY symbol ORDER BY bar) AS nxt FROM frame), b AS (SELECT *, coalesce(pos - lag(pos) OVER (PARTITION BY symbol ORDER BY bar), 0) AS change FROM a WHERE nxt IS NOT NULL),
d AS (SELECT *, CASE WHEN change > 0 THEN greatest(c, nxt) ELSE least(c, nxt) END AS price FROM b),
sim AS (SELECT *, pos * coalesce(ln(lead(price) OVER (PARTITION BY symbol ORDER BY bar)) - ln(price), 0) - abs(change) * 0.0005 AS gain FROM d),
path AS (SELECT *, sum(gain) OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pnl FROM sim)"""


def simulation_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir).withColumn("pos", F.signum("f1"))
    found = backtest.simulation_report(backtest.simulate(rows), 4 * 365)
    return found.select("symbol", "trades", *[rounded(c, 4).alias(c) for c in ("win_rate", "profit_loss_ratio", "annual_return", "sharpe")])


def latest_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value of each factor; one that can't be read is reported, not raised."""
    values, _ = evaluate_last(bars(spark, sf_dir), FACTORS | {"bad": "nothing(c)"})
    return presented(values, list(FACTORS))


EVOLVE = evolve.EvolveConfig(population=12, generations=2, hall_of_fame=8, components=4, tournament=3, init_depth=(1, 2), metric="avg_sic", max_correlation=0.95, batch=24, max_depth=3)


def evolved_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small run of genetic programming; only a few programs are bred here, all of their rows are scored."""
    rows = bars(spark, sf_dir).withColumn("y", labels.forward_return("c", 1)).dropna(subset=["y"])
    run = evolve.Evolution(rows.select("symbol", "ts", "o", "h", "l", "c", "vol", "y"), ["o", "h", "l", "c", "vol"], "y", EVOLVE, scoring=S)
    return run.table(run.run())


MINING = mining.MiningConfig(
    sampling=labels.SampleConfig(coarse=4 * 3600, step=3600, horizon_steps=4, window=20), train=("2024-01-02 00:00:00", "2024-01-20 00:00:00"), test=("2024-01-20 06:00:00", "2024-01-28 00:00:00"),
    evolve=replace(EVOLVE, population=8, generations=1, hall_of_fame=6, components=3), metrics=("avg_pic", "sharp"),
)


def mining_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From events to scored factors: samples, a small evolution on the training rows, scores of both parts."""
    return mining.mine(bars(spark, sf_dir, 3600), MINING)["factors"]


QUERIES = {
    f.__name__: f
    for f in (
        _metric_query("metric_fit", metrics.fit_metrics, FIT, 5),
        _metric_query("metric_ranks", metrics.rank_metrics, ["weighted_spearman"]),
        _metric_query("metric_chunks", metrics.chunk_metrics, ["avg_pic", "avg_sic"]),
        _metric_query("metric_paths", metrics.path_metrics, PATH, 5),
        _metric_query("metric_positions", metrics.position_metrics, ["sharpe_fixed_threshold", "sharpe_std_threshold"], 5),
        _metric_query("metric_margins", metrics.margin_metrics, MARGIN, 5),
        _metric_query("metric_information", metrics.information_metrics, ["mi_score", "entropy_gain_score"], 4),
        metric_ranges, metric_constrained, metric_given_range, result_paths, decay_of_ic, factor_scores, elite_factors, table_upsert, table_diagnostics,
        factor_correlations, linear_model, simulation, simulation_figures, latest_values, evolved_factors, mining_run,
    )
}
SQL = {
    "metric_fit": _FIT,
    "metric_ranks": _RANKS,
    "metric_chunks": _CHUNKS,
    "metric_paths": _PATHS,
    "metric_positions": _POSITIONS,
    "metric_margins": _MARGINS,
    "metric_information": _INFORMATION,
    "metric_ranges": _RANGES,
    "metric_constrained": _CONSTRAINED,
    "metric_given_range": _GIVEN,
    "result_paths": _RESULT_PATHS,
    "decay_of_ic": _DECAY,
    "factor_scores": _FACTOR_SCORES,
    "elite_factors": _ELITE,
    "table_upsert": f"WITH {BASE} SELECT symbol AS expression, CASE WHEN symbol < 'm' THEN -1 ELSE count(*) END AS n FROM base GROUP BY symbol",
    "table_diagnostics": f"WITH {BASE}, r AS (SELECT {_rank('vol', '1')} AS a, {_rank('vol_ccy', '1')} AS b FROM base) SELECT count(*) AS n, {sql_round(_corr('a', 'b'))} AS spearman FROM r",
    "factor_correlations": f"""WITH {BASE}, f AS (SELECT c - o AS f1, h - l AS f2, c - l AS f3 FROM base) SELECT 'f1' AS a, 'f2' AS b, {sql_round(_corr('f1', 'f2'))} AS r FROM f
UNION ALL SELECT 'f1', 'f3', {sql_round(_corr('f1', 'f3'))} FROM f UNION ALL SELECT 'f2', 'f3', {sql_round(_corr('f2', 'f3'))} FROM f""",
    "linear_model": f"WITH {_MODEL} SELECT symbol, bar, CASE WHEN bar < {SPLIT_AT} THEN 'train' ELSE 'test' END AS split, {sql_round('pos', 5)} AS pos FROM modelled",
    "simulation": f"WITH {_SIMULATION} SELECT symbol, bar, {sql_round('pos')} AS pos, {sql_round('price')} AS trade_price, {sql_round('gain')} AS gain, {sql_round('pnl')} AS pnl FROM path",
    "simulation_figures": f"""WITH {_SIMULATION} SELECT symbol, count(*) FILTER (change <> 0) AS trades, {sql_round('avg(CASE WHEN gain > 0 THEN 1.0 ELSE 0 END)', 4)} AS win_rate,
{sql_round('avg(gain) FILTER (gain > 0) / abs(avg(gain) FILTER (gain < 0))', 4)} AS profit_loss_ratio, {sql_round('avg(gain) * 1460', 4)} AS annual_return, {sql_round('avg(gain) * 1460 / (stddev_pop(gain) * sqrt(1460.0))', 4)} AS sharpe FROM path GROUP BY symbol""",
    "latest_values": f"WITH {BASE} SELECT symbol, max(bar) AS bar, {sql_round('arg_max(c - o, bar)')} AS f1, {sql_round('arg_max(h - l, bar)')} AS f2 FROM base GROUP BY symbol",
}
