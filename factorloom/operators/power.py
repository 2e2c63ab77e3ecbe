"""Box-Cox and Yeo-Johnson transforms of labels, their exponent fitted by maximum likelihood in each group.

The likelihood of an exponent needs the number of rows, a sum of logarithms and a variance, so one aggregate gives it for POINTS
exponents of every group. Each round keeps the stretch around the best of them: an inner best point narrows it,
one at an end moves it. Rounds are few, whatever the rows; a hot group is summed up before any shuffle, and the rows are
written once (``spark.checkpoint.dir``) and read again in each round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import Series
from ..plans.longseries import _cut

KINDS = ("box_cox", "yeo_johnson")
POINTS, FIRST_STEP, PRECISION, ROUNDS = 33, 0.5, 1e-6, 40
BROADCAST_GROUPS = 200_000
X, SHIFT, LAMBDA = "__x", "__shift", "lambda"


def _power(log: Column, exponent: Column) -> Column:
    flat = F.abs(exponent) < 1e-12
    return F.when(flat, log).otherwise(F.expm1(exponent * log) / F.when(flat, 1.0).otherwise(exponent))


def power_transform(x: Column, exponent: Column, kind: str) -> Column:
    """The transform of a value: of positive ones (Box-Cox) or of any (Yeo-Johnson); null beyond that."""
    if kind == "box_cox":
        return F.when(x > 0, _power(F.log(x), exponent))
    return F.when(x >= 0, _power(F.log1p(x), exponent)).when(x < 0, -_power(F.log1p(-x), 2.0 - exponent))


def _jacobian(x: Column, kind: str) -> Column:
    return F.log(x) if kind == "box_cox" else F.signum(x) * F.log1p(F.abs(x))


def _spread(x: Column, exponent: Column, kind: str, side: Column) -> Column:
    """A value that differs from the transform by what is constant in its group, so it has the same variance. Where all values of
    a group are on one side, the constant of a steep power is left out, as it would swallow the digits of small powers."""
    b = F.log(x) if kind == "box_cox" else F.log1p(F.abs(x))
    own = F.when(side < 0, 2.0 - exponent).otherwise(exponent)
    return F.when(side == 0, power_transform(x, exponent, kind)).when(F.abs(own) < 0.5, _power(b, own)).otherwise(F.exp(own * b) / own)


def _checked(kind: str) -> None:
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")


def _beside(rows: DataFrame, groups: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """Rows with what is known of their group; groups without rows go, null keys are equal."""
    other = groups.withColumnsRenamed({k: f"__g_{k}" for k in keys})
    other = F.broadcast(other) if few else other
    on = [F.col(k).eqNullSafe(F.col(f"__g_{k}")) for k in keys]
    return (rows.join(other, on, "left") if keys else rows.join(other, how="left")).drop(*[f"__g_{k}" for k in keys])


def fit_power(rows: DataFrame, column: str, kind: str = "box_cox", series: Series = Series()) -> DataFrame:
    """(keys, n, shift, lambda, log_likelihood) of each group, the exponent to 1e-6.

    For Box-Cox all values are shifted so that the smallest of the group is 1; otherwise ``shift`` is 0. Nulls and values that
    are not finite are left out. A group of fewer than two different values has a null exponent; a group without values is
    left out. The likelihood is taken to have one peak, as it has for samples of more than a few values.
    """
    _checked(kind)
    keys = list(series.keys)
    finite = rows.select(*keys, F.col(column).cast("double").alias(X)).where(F.col(X).isNotNull() & ~F.isnan(X) & (F.abs(X) < float("inf")))
    values = _cut(finite)
    shift = 1.0 - F.min(X) if kind == "box_cox" else F.lit(0.0)
    varied = F.max(X) > F.min(X)
    side = F.lit(1) if kind == "box_cox" else F.when(F.min(X) >= 0, 1).when(F.max(X) < 0, -1).otherwise(0)
    groups = values.groupBy(*keys).agg(F.count("*").alias("n"), shift.alias(SHIFT), F.when(varied, 1.0).alias(LAMBDA), F.when(varied, FIRST_STEP).otherwise(0.0).alias("__step"), side.alias("__side"))
    now = _cut(groups.where("n > 0").withColumn("log_likelihood", F.lit(None).cast("double")))
    few = now.count() <= BROADCAST_GROUPS
    half = POINTS // 2
    points = F.array(*[F.lit(float(i - half)) for i in range(POINTS)])
    state = ["n", SHIFT, LAMBDA, "__step", "__side"]
    for _ in range(ROUNDS):
        open_ = now.where(F.col("__step") > PRECISION)
        if open_.isEmpty():
            break
        # A row for each exponent, summed up before any shuffle.
        met = _beside(values, open_, keys, few).where(F.col(LAMBDA).isNotNull()).withColumn("__i", F.explode(points))
        x, exponent = F.col(X) + F.col(SHIFT), F.col(LAMBDA) + F.col("__i") * F.col("__step")
        sums = met.groupBy(*keys, "__i").agg(*[F.first(c).alias(c) for c in state], F.sum(_jacobian(x, kind)).alias("__j"), F.var_pop(_spread(x, exponent, kind, F.col("__side"))).alias("__v"))
        # A variance too small or too large for a double has no likelihood.
        likelihood = F.when((F.col("__v") > 1e-290) & (F.col("__v") < float("inf")), (exponent - 1.0) * F.col("__j") - F.col("n") / 2.0 * F.log("__v"))
        best = sums.withColumn("__l", likelihood).groupBy(*keys).agg(*[F.first(c).alias(c) for c in state], F.max("__l").alias("log_likelihood"), F.max_by("__i", "__l").alias("__i"))
        inner = F.abs("__i") < half
        step = F.when(F.col("__i").isNull(), 0.0).when(inner, F.col("__step") / half).otherwise(F.col("__step"))
        moved = best.select(*keys, "n", SHIFT, exponent.alias(LAMBDA), step.alias("__step"), "__side", "log_likelihood")
        now = _cut(moved.unionByName(now.where(F.col("__step") <= PRECISION)))
    # What is still moving after all rounds has no peak within reach.
    found = F.when(F.col("__step") <= PRECISION, F.col(LAMBDA))
    return now.select(*keys, "n", F.col(SHIFT).alias("shift"), found.alias(LAMBDA), F.when(found.isNotNull(), F.col("log_likelihood")).alias("log_likelihood"))


def power_transformed(rows: DataFrame, column: str, out: str, kind: str = "box_cox", series: Series = Series(), fitted: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``out``, the transform of ``column`` by its group's exponent: ``fitted``, from training rows say, or a fit of these
    rows. Null for values that are null or not finite, below the range of the fitted ones (Box-Cox), or without an exponent."""
    _checked(kind)
    fitted = fit_power(rows, column, kind, series) if fitted is None else fitted
    known = fitted.select(*series.keys, F.col("shift").alias(SHIFT), F.col(LAMBDA).alias("__lambda"))
    met = _beside(rows, known, list(series.keys), known.count() <= BROADCAST_GROUPS)
    x = F.col(column).cast("double")
    value = power_transform(x + F.col(SHIFT), F.col("__lambda"), kind)
    return met.withColumn(out, F.when(~F.isnan(x) & (F.abs(x) < float("inf")), value)).drop(SHIFT, "__lambda")
