"""Bars, features, normalisers, labels and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import Series
from ..operators import features, labels, normalise, power, resample
from ..sources.tables import daily_orders, load
from .common import BASE, DAYS, bars, bars_cte, days, frame, lagged, over, presented, rounded, running, sql_round
from .feature_sql import SQL as FEATURE_SQL

DAY, HOUR = 86_400, 3_600
BAR = ["o", "h", "l", "c", "vol", "vol_ccy"]
GAUSS = 30


def bars_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presented(bars(spark, sf_dir), BAR, digits=4)


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highs and lows are quotients that often end in a rounding tie, so they are given in full."""
    return presented(days(spark, sf_dir), ["c", "vol"], ["h", "l"], digits=4)


def orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presented(daily_orders(load(spark, sf_dir, "orders")), ["total", "mean", "n"], digits=2)


def resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presented(resample.resample(bars(spark, sf_dir), DAY, offset=6 * HOUR), BAR, digits=4)


_DAILY = "CAST(floor((bar - 21600) / 86400.0) AS BIGINT) * 86400 + 21600"
_AGGREGATES = "arg_min(o, bar) AS o, max(h) AS h, min(l) AS l, arg_max(c, bar) AS c, sum(vol) AS vol, sum(vol_ccy) AS vol_ccy"
_BAR_OUT = ", ".join(f"{sql_round(c, 4)} AS {c}" for c in BAR)


def gaps_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarter-hour bars on a full grid, prices carried forward."""
    return presented(resample.resample(bars(spark, sf_dir, 900), 900, fill_gaps=True, drop_zero_volume=False), BAR, digits=4)


def traded_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presented(resample.resample(bars(spark, sf_dir, 900), 900, fill_gaps=True, drop_zero_volume=True), BAR, digits=4)


def offset_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-hour buckets at all quarter-hour shifts."""
    return presented(resample.offset_buckets(bars(spark, sf_dir, 900), 2 * HOUR, 900), BAR, ["feature_offset"], digits=4)


_FAN = f"""WITH {bars_cte(900)}, slid AS (
  SELECT *, unnest(range(0, 8)) * 900 AS back FROM bars),
grid AS (SELECT symbol, bar - back AS start, bar, o, h, l, c, vol, vol_ccy FROM slid),
agg AS (SELECT symbol, start, arg_min(o, bar) AS o, max(h) AS h, min(l) AS l, arg_max(c, bar) AS c, sum(vol) AS vol, sum(vol_ccy) AS vol_ccy FROM grid GROUP BY 1, 2)
SELECT symbol, start AS bar, (start % 7200) / 60.0 AS feature_offset, {_BAR_OUT} FROM agg JOIN (SELECT symbol, min(bar) AS first FROM bars GROUP BY 1) USING (symbol) WHERE start >= first"""


def base_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presented(features.base_features(bars(spark, sf_dir)), [*BAR, "h_ts_std_10"], digits=4)


def framed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features without recursion."""
    names = tuple(features.FEATURES)
    return presented(features.base_features(bars(spark, sf_dir), names), list(names), digits=4)


def recursive_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All recursive features, and those made of other features."""
    names = (*features.RECURSIVE, *features.SECOND)
    return presented(features.base_features(bars(spark, sf_dir), names), list(names), digits=4)


def latest_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presented(features.latest_features(bars(spark, sf_dir), window=60), ["h_ts_std_10"], digits=4)


def _feature_sql(source: str) -> str:
    return f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar) AS k FROM {source}),
raw AS (SELECT *, CASE WHEN k >= 5 THEN {over('stddev_samp(h)', 10)} ELSE 0 END AS x FROM numbered),
done AS (SELECT *, x / greatest(coalesce(stddev_samp(x) OVER {frame(1999)}, 0), 1e-6) AS f FROM raw)"""


def normalisers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Series()
    now = normalise.norm(bars(spark, sf_dir), "c", "norm_60", 60)
    now = normalise.return_norm(now, "c", "return_norm", 60)
    now = normalise.log_norm(now, "c", "log_norm", 60)
    c = F.col("c")
    now = now.withColumns(
        {"expanding": normalise.expanding_zscore(c, s), "zscore_20": F.coalesce(normalise.label_zscore(c, 20, s), F.lit(0.0)), "scale_20": normalise.rolling_scale(c, 20, s), "feature": normalise.feature_norm(c, s, 60)}
    )
    return presented(now, ["norm_60", "return_norm", "log_norm", "expanding", "zscore_20", "scale_20", "feature"])


_NORMALISERS = f"""WITH {BASE}, a AS (SELECT *, ln(1 + c) AS p, sign(c) * ln(1 + abs(c)) / ln(1 + abs(avg(c) OVER (PARTITION BY symbol)) + 1e-8) AS g FROM base)
SELECT symbol, bar,
  {sql_round(f"coalesce(c / nullif({over('stddev_samp(c)', 60)}, 0), 0)")} AS norm_60,
  {sql_round(f"coalesce(p / nullif({over('stddev_samp(p)', 60)}, 0), 0)")} AS return_norm,
  {sql_round(f"coalesce(g / nullif({over('stddev_samp(g)', 60)}, 0), 0)")} AS log_norm,
  {sql_round(f"coalesce((c - {running('avg(c)')}) / nullif({running('stddev_samp(c)')}, 0), 0)")} AS expanding,
  {sql_round(f"CASE WHEN rn >= 20 THEN coalesce((c - {over('avg(c)', 20)}) / nullif({over('stddev_pop(c)', 20)}, 0), 0) ELSE 0 END")} AS zscore_20,
  {sql_round(f"CASE WHEN rn >= 20 THEN coalesce(c / nullif({over('stddev_pop(c)', 20)}, 0), 0) ELSE 0 END")} AS scale_20,
  {sql_round(f"c / greatest(coalesce({over('stddev_samp(c)', 60)}, 0), 1e-6)")} AS feature
FROM a"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = bars(spark, sf_dir).withColumn("ret", labels.forward_return("c", 1)).dropna(subset=["ret"])
    return normalise.gauss_rank(now, "ret", "score", GAUSS)


def gauss_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = normalise.inverse_gauss_rank(_scored(spark, sf_dir), "score", "ret", "restored", GAUSS)
    return presented(now, ["score", "restored"])


def _scored_sql(ret: str, window: int, x: str = "ret") -> str:
    """Tables ending in ``scored``: the Gauss ranks of ``x`` among the ``window`` rows before, over the rows of ``ret``."""
    return f"""r AS ({ret}),
v AS (SELECT *, list({x}) OVER {frame(window, '1 PRECEDING')} AS v FROM r WHERE {x} IS NOT NULL AND ret IS NOT NULL),
q AS (SELECT *, len(list_filter(v, lambda z: z < {x})) AS less, len(list_filter(v, lambda z: z = {x})) AS ties FROM v),
p AS (SELECT *, (less + 0.5 * CASE WHEN ties > 0 THEN ties + 1 ELSE 1 END) / {window + 1} AS p FROM q),
z AS (SELECT *, sqrt(-2 * ln(least(p, 1 - p))) AS z FROM p),
scored AS (SELECT *, CASE WHEN len(v) = {window} THEN greatest(-6, least(6, CASE WHEN p < 0.5 THEN -1 ELSE 1 END * (z - (2.515517 + 0.802853 * z + 0.010328 * z * z)
  / (1 + 1.432788 * z + 0.189269 * z * z + 0.001308 * z * z * z)))) ELSE 0 END AS score FROM z)"""


_SCORED = _scored_sql("SELECT symbol, bar, ln(lead(c) OVER (PARTITION BY symbol ORDER BY bar)) - ln(c) AS ret FROM base", GAUSS)
_RESTORED = f"""WITH {BASE}, {_SCORED},
t AS (SELECT *, 1 / (1 + 0.3275911 * abs(score) / sqrt(2.0)) AS t FROM scored),
e AS (SELECT *, 0.5 * (1 + sign(score) * (1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-score * score / 2))) AS cdf FROM t),
restored AS (SELECT symbol, bar, ret, score, CASE WHEN len(v) = {GAUSS} THEN list_sort(v)[1 + CAST(greatest(0, least(floor(cdf * {GAUSS}), {GAUSS - 1})) AS BIGINT)] ELSE 0 END AS restored FROM e)"""
_GAUSS = f"{_RESTORED} SELECT symbol, bar, {sql_round('score')} AS score, {sql_round('restored')} AS restored FROM restored"
_mean_rank = lambda x: f"rank() OVER (PARTITION BY symbol ORDER BY {x}) + (count(*) OVER (PARTITION BY symbol, {x}) - 1) / 2.0"
_INVERSE = f"""{_RESTORED}, ranked AS (SELECT *, {_mean_rank('ret')} AS rx, {_mean_rank('restored')} AS ry FROM restored)
SELECT symbol, count(*) AS n, {sql_round('avg(abs((restored - ret) / ret)) FILTER (abs(ret) > 1e-12)', 5)} AS mean_relative_error, {sql_round('corr(ret, restored)', 5)} AS pearson, {sql_round('corr(rx, ry)', 5)} AS spearman FROM ranked GROUP BY symbol"""


def held_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = normalise.position_performance(_scored(spark, sf_dir), "score", "ret", skip=GAUSS, periods=4 * 365)
    return found.select("symbol", *[rounded(c, 5).alias(c) for c in found.columns if c != "symbol"])


_FIGURES = ("gross_return", "total_return", "annual_return", "sharpe", "max_drawdown", "win_rate", "fees", "direction_accuracy", "position_volatility", "flip_rate")


def _positions_sql(skip: int, periods: float) -> str:
    """Tables ending in ``g``: the figures of positions by the sign of ``scored``."""
    return f"""a AS (SELECT *, CASE WHEN score > 0 THEN 1.0 ELSE -1.0 END AS pos, row_number() OVER (PARTITION BY symbol ORDER BY bar) AS k FROM scored),
b AS (SELECT *, abs(pos - {lagged('pos')}) AS turn FROM a),
d AS (SELECT *, pos * ret - turn * 0.0004 AS net FROM b WHERE k > {skip}),
e AS (SELECT *, 1 + {running('sum(net)')} AS value, abs(pos - {lagged('pos')}) > 1 AS flip FROM d),
f AS (SELECT *, value / {running('max(value)')} - 1 AS fall FROM e),
g AS (SELECT symbol, sum(abs(ret)) AS gross_return, sum(net) AS total_return, sum(net) / (count(*) / {periods}) AS annual_return, avg(net) / stddev_samp(net) * sqrt({periods}) AS sharpe,
  min(fall) AS max_drawdown, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0 END) AS win_rate, sum(turn * 0.0004) AS fees, avg(CASE WHEN sign(pos) = sign(ret) THEN 1.0 ELSE 0 END) AS direction_accuracy,
  stddev_samp(pos) AS position_volatility, avg(CASE WHEN flip THEN 1.0 ELSE 0 END) AS flip_rate FROM f GROUP BY symbol)"""


_FIGURES_OUT = f"""{', '.join(f'{sql_round(c, 5)} AS {c}' for c in _FIGURES)},
  {sql_round('annual_return / nullif(abs(max_drawdown), 0)', 5)} AS return_over_drawdown, {sql_round('total_return / nullif(fees, 0)', 5)} AS return_over_fees"""
_POSITIONS = f"WITH {BASE}, {_SCORED}, {_positions_sql(GAUSS, 1460.0)} SELECT symbol, {_FIGURES_OUT} FROM g"
SWEEP_WINDOWS, SWEEP_HORIZONS = (10, 20), (1, 3)


def _sweep_sql(window: int, horizon: int) -> str:
    ahead = lambda n: f"lead(c, {n}) OVER (PARTITION BY symbol ORDER BY bar) / c - 1"
    scored = _scored_sql(f"SELECT symbol, bar, {ahead(1)} AS ret, {ahead(horizon)} AS fwd FROM base", window, "fwd")
    return f"SELECT * FROM (WITH {BASE}, {scored}, {_positions_sql(window, 8760.0)} SELECT CAST({window} AS INTEGER) AS \"window\", CAST({horizon} AS INTEGER) AS horizon, symbol, {_FIGURES_OUT} FROM g)"


_SWEEP = " UNION ALL ".join(_sweep_sql(w, h) for w in SWEEP_WINDOWS for h in SWEEP_HORIZONS)


def quantiles_of_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = normalise.quantile_consistency(_scored(spark, sf_dir), "ret", "score")
    return found.select("symbol", "part", "quantile", *[rounded(c, 5).alias(c) for c in ("original", "normalised", "rank_correlation")])


_QUANTILES = f"""WITH {BASE}, {_SCORED},
long AS (SELECT symbol, 'all' AS part, ret AS x, score AS y FROM scored UNION ALL SELECT symbol, 'positive', ret, score FROM scored WHERE ret > 0 UNION ALL SELECT symbol, 'negative', ret, score FROM scored WHERE ret < 0),
g AS (SELECT unnest([{', '.join(str(q) for q in normalise.QUANTILES)}])::DOUBLE AS quantile),
f AS (SELECT symbol, part, quantile FROM (SELECT DISTINCT symbol, part FROM long), g),
lists AS (SELECT symbol, part, list_sort(list(x)) AS xs, list_sort(list(y)) AS ys, count(*) AS n FROM long GROUP BY 1, 2),
vals AS (SELECT symbol, part, quantile, (n - 1) * quantile AS pos, xs, ys FROM f JOIN lists USING (symbol, part)),
ranked AS (SELECT a.symbol, corr(x, y) AS rank_correlation FROM
  (SELECT symbol, ret AS x, row_number() OVER (PARTITION BY symbol ORDER BY ret) AS k FROM scored) a JOIN
  (SELECT symbol, score AS y, row_number() OVER (PARTITION BY symbol ORDER BY score) AS k FROM scored) b ON a.symbol = b.symbol AND a.k = b.k GROUP BY 1)
SELECT symbol, part, quantile,
  {sql_round('xs[1 + CAST(floor(pos) AS BIGINT)] + (pos - floor(pos)) * (xs[1 + CAST(ceil(pos) AS BIGINT)] - xs[1 + CAST(floor(pos) AS BIGINT)])', 5)} AS original,
  {sql_round('ys[1 + CAST(floor(pos) AS BIGINT)] + (pos - floor(pos)) * (ys[1 + CAST(ceil(pos) AS BIGINT)] - ys[1 + CAST(floor(pos) AS BIGINT)])', 5)} AS normalised,
  {sql_round('rank_correlation', 5)} AS rank_correlation FROM vals JOIN ranked USING (symbol)"""


def score_inverse_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = normalise.inverse_gauss_rank(_scored(spark, sf_dir), "score", "ret", "restored", GAUSS)
    found = normalise.inverse_check(now, "ret", "restored")
    return found.select("symbol", "n", *[rounded(c, 5).alias(c) for c in ("mean_relative_error", "pearson", "spearman")])


def gauss_rank_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = normalise.label_sweep(bars(spark, sf_dir), "c", SWEEP_WINDOWS, SWEEP_HORIZONS)
    return found.select("window", "horizon", "symbol", *[rounded(c, 5).alias(c) for c in found.columns[3:]])


def forward_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = labels.scaled_forward_return(bars(spark, sf_dir), "c", 5, "label")
    return presented(now, ["ret", "label"])


_FORWARD = f"""WITH {BASE}, a AS (SELECT symbol, bar, ln(lead(c, 5) OVER (PARTITION BY symbol ORDER BY bar)) - ln(c) AS ret FROM base),
b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar) AS k FROM a WHERE ret IS NOT NULL)
SELECT symbol, bar, {sql_round('ret')} AS ret, {sql_round(f"CASE WHEN k >= 5 THEN coalesce(ret / nullif({over('stddev_pop(ret)', 5)}, 0), 0) ELSE 0 END")} AS label FROM b"""

SAMPLES = labels.SampleConfig(coarse=4 * HOUR, step=HOUR, horizon_steps=4, window=20)
TRAIN, TEST = ("2024-01-02 00:00:00", "2024-01-20 00:00:00"), ("2024-01-20 06:00:00", "2024-01-28 00:00:00")


def training_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labels.samples(bars(spark, sf_dir, HOUR), SAMPLES)
    rows = labels.with_split(rows, TRAIN, TEST, SAMPLES.step * SAMPLES.horizon_steps)
    return presented(rows, ["c", "h_ts_std_10", "t_price", "t_future_price", "return_f", "ret_rolling_zscore"], ["feature_offset", "split"], digits=5)


_SAMPLES = f"""WITH {bars_cte(HOUR)}, slid AS (SELECT symbol, bar - unnest(range(0, 4)) * 3600 AS start, bar, o, h, l, c FROM bars),
agg AS (SELECT symbol, start, max(h) AS h, arg_max(c, bar) AS c FROM slid GROUP BY 1, 2),
grid AS (SELECT agg.* FROM agg JOIN (SELECT symbol, min(bar) AS first FROM bars GROUP BY 1) USING (symbol) WHERE start >= first),
n AS (SELECT *, (start % 14400) / 60.0 AS feature_offset, row_number() OVER (PARTITION BY symbol, start % 14400 ORDER BY start) AS k FROM grid),
raw AS (SELECT *, CASE WHEN k >= 5 THEN {over('stddev_samp(h)', 10, 'symbol, feature_offset', 'start')} ELSE 0 END AS x FROM n),
feat AS (SELECT *, x / greatest(coalesce({over('stddev_samp(x)', 5, 'symbol, feature_offset', 'start')}, 0), 1e-6) AS f FROM raw),
priced AS (SELECT feat.*, a.c AS t_price, b.c AS t_future_price, ln(b.c / a.c) AS return_f FROM feat
  JOIN bars a ON a.symbol = feat.symbol AND a.bar = start + 14400 JOIN bars b ON b.symbol = feat.symbol AND b.bar = start + 28800),
z AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY start) AS j, {over('avg(return_f)', 20, order='start')} AS m, {over('stddev_pop(return_f)', 20, order='start')} AS d FROM priced)
SELECT symbol, start AS bar, feature_offset,
  CASE WHEN start BETWEEN epoch(TIMESTAMP '{TRAIN[0]}') AND epoch(TIMESTAMP '{TRAIN[1]}') - 14400 THEN 'train' WHEN start BETWEEN epoch(TIMESTAMP '{TEST[0]}') AND epoch(TIMESTAMP '{TEST[1]}') THEN 'test' END AS split,
  {sql_round('c', 5)} AS c, {sql_round('f', 5)} AS h_ts_std_10, {sql_round('t_price', 5)} AS t_price, {sql_round('t_future_price', 5)} AS t_future_price,
  {sql_round('return_f', 5)} AS return_f, {sql_round('(return_f - m) / d', 5)} AS ret_rolling_zscore FROM z WHERE j >= 20 AND d > 0"""


def label_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = bars(spark, sf_dir).withColumn("ret", labels.forward_return("c", 1)).dropna(subset=["ret"])
    found = labels.label_shapes(now, "ret", (10, 20))
    return found.select("symbol", "form", "n", *[rounded(c, 5).alias(c) for c in ("mean", "std", "skew", "kurtosis")])


_MOMENTS = f"""WITH {BASE}, r AS (SELECT symbol, bar, ln(lead(c) OVER (PARTITION BY symbol ORDER BY bar)) - ln(c) AS ret FROM base),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar) AS k FROM r WHERE ret IS NOT NULL),
b AS (SELECT symbol, quantile_cont(ret, 0.05) AS lo, quantile_cont(ret, 0.95) AS hi FROM k GROUP BY 1),
long AS (SELECT symbol, 'raw' AS form, ret AS v FROM k UNION ALL SELECT symbol, 'log1p', sign(ret) * ln(1 + abs(ret)) FROM k
  UNION ALL SELECT symbol, 'winsorised', greatest(lo, least(hi, ret)) FROM k JOIN b USING (symbol)
  UNION ALL SELECT symbol, 'zscore_10', CASE WHEN k >= 10 THEN (ret - {over('avg(ret)', 10)}) / nullif({over('stddev_pop(ret)', 10)}, 0) END FROM k
  UNION ALL SELECT symbol, 'zscore_20', CASE WHEN k >= 20 THEN (ret - {over('avg(ret)', 20)}) / nullif({over('stddev_pop(ret)', 20)}, 0) END FROM k)
SELECT symbol, form, count(*) AS n, {sql_round('avg(v)', 5)} AS mean, {sql_round('stddev_samp(v)', 5)} AS std, {sql_round('skewness(v) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0))', 5)} AS skew, {sql_round('kurtosis_pop(v)', 5)} AS kurtosis FROM long WHERE v IS NOT NULL GROUP BY 1, 2"""


def power_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward returns by both power transforms: the fitted exponent of each symbol, and the moments of what it gives."""
    now = bars(spark, sf_dir).withColumn("ret", labels.forward_return("c", 1)).select("symbol", "ret")
    parts = []
    for kind in power.KINDS:
        fitted = power.fit_power(now, "ret", kind)
        moments = power.power_transformed(now, "ret", "v", kind, fitted=fitted).where("v is not null").groupBy("symbol").agg(
            F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.skewness("v").alias("skew"), F.kurtosis("v").alias("kurtosis")
        )
        parts.append(fitted.join(moments, "symbol").withColumn("form", F.lit(kind)))
    found = parts[0].unionByName(parts[1])
    return found.select("symbol", "form", "n", *[rounded(c, d).alias(a) for c, a, d in (("lambda", "exponent", 3), ("log_likelihood", "likelihood", 4), ("mean", "mean", 3), ("std", "std", 3), ("skew", "skew", 3), ("kurtosis", "kurtosis", 3))])


def _power_sql(x: str = "x", m: str = "m", form: str = "form") -> str:
    up = lambda b, e: f"CASE WHEN abs({e}) < 1e-12 THEN {b} ELSE (exp({e} * {b}) - 1) / {e} END"
    return f"CASE WHEN {form} = 'box_cox' THEN {up(f'ln({x})', m)} WHEN {x} >= 0 THEN {up(f'ln(1 + {x})', m)} ELSE -({up(f'ln(1 - {x})', f'(2 - {m})')}) END"


def _search(level: int, step: float) -> str:
    """The best of 41 exponents around the level before's."""
    return f"""g{level} AS (SELECT symbol, form, m + k * CAST({step} AS DOUBLE) AS m FROM m{level - 1}, range(-20, 21) AS t(k)),
m{level} AS (SELECT symbol, form, m, ll FROM (SELECT symbol, form, m, (m - 1) * sum(j) - count(*) / 2.0 * ln(var_pop({_power_sql()})) AS ll FROM u JOIN g{level} USING (symbol, form) GROUP BY symbol, form, m)
  QUALIFY row_number() OVER (PARTITION BY symbol, form ORDER BY ll DESC) = 1)"""


_POWER = f"""WITH {BASE}, r AS (SELECT symbol, ln(lead(c) OVER (PARTITION BY symbol ORDER BY bar)) - ln(c) AS ret FROM base),
s AS (SELECT symbol, ret, 1 + ret - min(ret) OVER (PARTITION BY symbol) AS x FROM r WHERE ret IS NOT NULL),
u AS (SELECT symbol, 'box_cox' AS form, x, ln(x) AS j FROM s UNION ALL SELECT symbol, 'yeo_johnson', ret, sign(ret) * ln(1 + abs(ret)) FROM s),
m0 AS (SELECT DISTINCT symbol, form, CAST(1 AS DOUBLE) AS m FROM u), {", ".join(_search(i + 1, step) for i, step in enumerate((0.25, 0.02, 0.0015, 0.0001, 0.00001, 0.000001)))}
SELECT symbol, form, count(*) AS n, {sql_round('any_value(m)', 3)} AS exponent, {sql_round('any_value(ll)', 4)} AS likelihood, {sql_round('avg(v)', 3)} AS mean, {sql_round('stddev_samp(v)', 3)} AS std,
  {sql_round('skewness(v) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0))', 3)} AS skew, {sql_round('kurtosis_pop(v)', 3)} AS kurtosis
FROM (SELECT symbol, form, m, ll, {_power_sql()} AS v FROM u JOIN m6 USING (symbol, form)) GROUP BY symbol, form"""

QUERIES = {
    f.__name__: f
    for f in (
        bars_of_events, bars_daily, orders_daily, resampled, gaps_filled, traded_only, offset_fan_out, base_feature, framed_features, recursive_features, latest_feature,
        normalisers, gauss_ranks, held_positions, quantiles_of_scores, score_inverse_check, gauss_rank_sweep, forward_labels, training_samples, label_moments, power_labels,
    )
}

_GRID = f"""WITH {bars_cte(900)}, grid AS (SELECT symbol, unnest(range(min(bar), max(bar) + 900, 900)) AS bar FROM bars GROUP BY 1),
j AS (SELECT symbol, bar, {', '.join(f'b.{c}' for c in BAR)} FROM grid LEFT JOIN bars b USING (symbol, bar)),
done AS (SELECT symbol, bar, {', '.join(f"{running(f'last_value({c} IGNORE NULLS)')} AS {c}" for c in BAR[:4])}, coalesce(vol, 0) AS vol, coalesce(vol_ccy, 0) AS vol_ccy FROM j)
SELECT symbol, bar, {_BAR_OUT} FROM done"""
SQL = {
    "bars_of_events": f"WITH {bars_cte()} SELECT symbol, bar, {_BAR_OUT} FROM bars",
    "bars_daily": f"WITH {DAYS} SELECT symbol, bar, h, l, {', '.join(f'{sql_round(c, 4)} AS {c}' for c in ('c', 'vol'))} FROM days",
    "orders_daily": "SELECT 'all' AS symbol, CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) AS bar, round(sum(o_totalprice), 2) + 0.0 AS total, round(avg(o_totalprice), 2) + 0.0 AS mean, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 2",
    "resampled": f"WITH {bars_cte()}, d AS (SELECT symbol, {_DAILY} AS bar, {_AGGREGATES} FROM bars GROUP BY 1, 2) SELECT symbol, bar, {_BAR_OUT} FROM d".replace("arg_min(o, bar)", "arg_min(o, bars.bar)").replace("arg_max(c, bar)", "arg_max(c, bars.bar)"),
    "gaps_filled": _GRID,
    "traded_only": _GRID + " WHERE vol <> 0",
    "offset_fan_out": _FAN,
    "base_feature": f"WITH {bars_cte()}, {_feature_sql('bars')} SELECT symbol, bar, {_BAR_OUT}, {sql_round('f', 4)} AS h_ts_std_10 FROM done",
    "latest_feature": f"WITH {bars_cte()}, tail AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar DESC) <= 60), {_feature_sql('tail').replace('1999', '59')} SELECT symbol, bar, {sql_round('f', 4)} AS h_ts_std_10 FROM done QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar DESC) = 1",
    "normalisers": _NORMALISERS,
    "gauss_ranks": _GAUSS,
    "held_positions": _POSITIONS,
    "quantiles_of_scores": _QUANTILES,
    "forward_labels": _FORWARD,
    "training_samples": _SAMPLES,
    "label_moments": _MOMENTS,
    "power_labels": _POWER,
    "score_inverse_check": _INVERSE,
    "gauss_rank_sweep": _SWEEP,
    **FEATURE_SQL,
}
