"""Factor tables, elite pools, a linear model of factors, and a trading simulator."""

from __future__ import annotations

import math

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import Series, ratio
from .correlation import correlated, stacked
from .metrics import Scoring, evaluate, given_range_ic, long_form, range_metrics
from .ordered import TOTAL, exact_quantiles, top_shared, with_ranks

DECAY_LAGS = tuple(range(1, 50, 2))


def factor_table(df: DataFrame, factors: list[str], metrics: list[str], y: str, raw_y: str | None = None, scoring: Scoring = Scoring(), split: str = "split") -> DataFrame:
    """(factor, keys, fitness_{metric}_train, fitness_{metric}_test, given_ic_test): all scores on both parts of ``split``.

    The range in which a factor did best in training is tried on the test rows.
    """
    parts = []
    for part in ("train", "test"):
        scored = evaluate(df.where(F.col(split) == part), factors, metrics, y, raw_y, scoring)
        parts.append(scored.select(*scoring.group, *[F.col(m).alias(f"fitness_{m}_{part}") for m in metrics]))
    train = long_form(df.where(F.col(split) == "train"), factors, y, scoring)
    test = long_form(df.where(F.col(split) == "test"), factors, y, scoring)
    bounds = range_metrics(train, scoring).select(*scoring.group, F.col("max_ic_up").alias("up"), F.col("max_ic_dn").alias("dn"))
    given = given_range_ic(test, bounds, scoring).select(*scoring.group, F.col("given_ic").alias("given_ic_test"))
    keys = list(scoring.group)
    return parts[0].join(parts[1], keys, "full").join(given, keys, "left")


def upsert(old: DataFrame | None, new: DataFrame, key: str = "expression") -> DataFrame:
    """Both tables, one row for each key: the old one's where it has one, else the first of the new by all columns."""
    if old is None:
        return upsert(new.limit(0), new, key)
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    first = Window.partitionBy(key).orderBy("__new", *[c for c in both.columns if c not in (key, "__new")])
    return both.withColumn("__k", F.row_number().over(first)).where("__k = 1").drop("__k", "__new")


def with_percent_ranks(table: DataFrame, columns: list[str]) -> DataFrame:
    """The table with ``..._pct_rank`` of each column, ranked over all tasks."""
    return with_ranks(table, {c: f"{c}_pct_rank" for c in columns})


def elite_pool(table: DataFrame, columns: list[str], quantile: float = 0.9) -> DataFrame:
    """Rows at or above that quantile in every column; columns that the table lacks are left out, rows with nulls go."""
    used = [c for c in columns if c in table.columns]
    if not used:
        raise ValueError(f"the table has none of {columns}")
    whole = table.dropna(subset=used)
    # One row.
    limits = exact_quantiles(whole, {c: f"__q_{c}" for c in used}, [quantile])
    good = whole.join(F.broadcast(limits))
    for c in used:
        good = good.where(F.col(c) >= F.get(f"__q_{c}", F.lit(0)))
    return good.drop(*[f"__q_{c}" for c in used])


def diagnostics(table: DataFrame, a: str, b: str, share: float = 0.1) -> DataFrame:
    """(n, spearman, overlap): rank correlation of two columns and how many of their top rows they have in common; rows with a null are left out."""
    rows = table.dropna(subset=[a, b]).select(F.col(a).alias("a"), F.col(b).alias("b"))
    ranked = with_ranks(rows, {"a": "ra", "b": "rb"})
    figures = ranked.agg(F.count("*").alias("n"), ratio(F.covar_samp("ra", "rb"), F.stddev_samp("ra") * F.stddev_samp("rb")).alias("r"))
    top = top_shared(rows, "a", "b", F.greatest(F.lit(1), F.floor(F.col(TOTAL) * share)))
    # One row each.
    return figures.join(F.broadcast(top)).select(
        "n", F.when(F.col("n") >= 5, F.col("r")).alias("spearman"), F.when(F.col("n") >= 10, ratio(F.col("shared").cast("double"), F.col("top").cast("double"))).alias("overlap")
    )


def ic_decay(df: DataFrame, factors: list[str], price: str = "c", lags: tuple[int, ...] = DECAY_LAGS, series: Series = Series()) -> DataFrame:
    """(factor, keys, lag, ic): correlation with the log return ``lag`` bars ahead; returns beyond the end count as 0."""
    log = F.log(price)
    ahead = df.select(*series.keys, *factors, *[F.coalesce(F.lead(log, n).over(series.plain) - log, F.lit(0.0)).alias(f"__{n}") for n in lags])
    long = ahead.unpivot([*series.keys, *[f"__{n}" for n in lags]], factors, "factor", "x")
    corr = lambda n: ratio(F.covar_samp("x", f"__{n}"), F.stddev_samp("x") * F.stddev_samp(f"__{n}"))
    wide = long.groupBy("factor", *series.keys).agg(*[corr(n).alias(str(n)) for n in lags])
    return wide.unpivot(["factor", *series.keys], [str(n) for n in lags], "lag", "ic").withColumn("lag", F.col("lag").cast("int"))


def fit_model(df: DataFrame, factors: list[str], ret: str = "return_f", split: str = "split") -> tuple[LinearRegressionModel, float]:
    """(model, scale): least squares of returns on factors over the training rows; positions are predictions times the
    scale, which puts their 1st and 99th percentiles about 2 apart."""
    features = VectorAssembler(inputCols=factors, outputCol="features")
    train = features.transform(df.where(F.col(split) == "train"))
    model = LinearRegression(featuresCol="features", labelCol=ret, solver="normal", standardization=False, regParam=0.0).fit(train)
    low, high = model.transform(train).agg(F.percentile("prediction", F.array(F.lit(0.01), F.lit(0.99)))).first()[0]
    reach = abs(low) + abs(high)
    return model, 2.0 / reach if reach else 0.0


def positions(df: DataFrame, model: LinearRegressionModel, scale: float, factors: list[str], most: float = 5.0) -> DataFrame:
    """``df`` with ``pos``, clipped. The prediction is a plain sum of products, without a pass through vectors."""
    x = F.lit(float(model.intercept))
    for name, w in zip(factors, model.coefficients.toArray().tolist(), strict=True):
        x = x + F.col(name) * F.lit(float(w))
    return df.withColumn("pos", F.greatest(F.lit(-most), F.least(F.lit(most), x * F.lit(scale))))


def coefficients(spark, model: LinearRegressionModel, factors: list[str]) -> DataFrame:
    """(term, weight): the model as a table."""
    rows = [("intercept", float(model.intercept)), *zip(factors, model.coefficients.toArray().tolist())]
    return spark.createDataFrame(rows, "term string, weight double")


def simulate(df: DataFrame, fee: float = 0.0005, series: Series = Series(), pos: str = "pos", o: str = "o", c: str = "c") -> DataFrame:
    """Row by row: (keys, order, pos, trade_price, gain, pnl).

    A change of position trades at the worse of the close and the next open: the higher for a purchase, the lower for a
    sale. The last bar has no next open and is left out; the bar before it is held to its own price.
    """
    w = series.plain
    now = df.select(*series.keys, *series.order, F.col(pos).alias("pos"), F.col(c).alias("c"), F.lead(o).over(w).alias("next_open")).where("next_open is not null")
    now = now.withColumn("change", F.coalesce(F.col("pos") - F.lag("pos").over(w), F.lit(0.0)))
    now = now.withColumn("trade_price", F.when(F.col("change") > 0, F.greatest("c", "next_open")).otherwise(F.least("c", "next_open")))
    move = F.coalesce(F.log(F.lead("trade_price").over(w)) - F.log("trade_price"), F.lit(0.0))
    now = now.withColumn("gain", F.col("pos") * move - F.abs("change") * fee)
    return now.withColumn("pnl", F.sum("gain").over(series.upto)).select(*series.keys, *series.order, "pos", "trade_price", "change", "gain", "pnl")


def simulation_report(sim: DataFrame, periods: int, series: Series = Series()) -> DataFrame:
    """Six figures: share of winning bars, gain over loss, annual return, drawdown relative to the peak, Sharpe, Calmar."""
    now = sim.withColumn("peak", F.max("pnl").over(series.upto))
    now = now.withColumn("drop", ratio(F.col("pnl") - F.col("peak"), F.col("peak")))
    year = F.avg("gain") * periods
    loss = F.abs(F.avg(F.when(F.col("gain") < 0, F.col("gain"))))
    return now.groupBy(*series.keys).agg(
        F.avg(F.when(F.col("gain") > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        ratio(F.avg(F.when(F.col("gain") > 0, F.col("gain"))), loss).alias("profit_loss_ratio"),
        year.alias("annual_return"),
        F.min("drop").alias("max_drawdown"),
        ratio(year, F.stddev_pop("gain") * math.sqrt(periods)).alias("sharpe"),
        ratio(year, -F.min("drop")).alias("calmar"),
        F.count_if(F.col("change") != 0).alias("trades"),
    )


def single_factor_path(df: DataFrame, factor: str, ret: str, scoring: Scoring = Scoring(), split: str = "split") -> DataFrame:
    """Results, running sum and rolling Sharpe of one factor, for each part of ``split`` on its own."""
    from .metrics import paths

    s = Scoring((*scoring.keys, split), scoring.order, scoring.periods, scoring.window)
    return paths(long_form(df.where(F.col(split).isNotNull()), [factor], ret, s), s)


def correlations(df: DataFrame, factors: list[str], series: Series = Series()) -> DataFrame:
    """(a, b, r) for all pairs of factors, in the order in which they are named; null where one doesn't vary."""
    names = F.array(*[F.lit(x) for x in factors])
    found = correlated(stacked(df, factors, series=series), len(factors))
    return found.select(F.get(names, F.col("a")).alias("a"), F.get(names, F.col("b")).alias("b"), "r")
