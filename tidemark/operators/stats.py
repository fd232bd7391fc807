"""Statistics, scaling factors and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import in_order


def median(df: DataFrame, key: str, value: Column, out: str = "median") -> DataFrame:
    """(key, out): the exact median by places in the order of values, so no task holds the values of a key. Nulls don't count."""
    rows = df.select(key, value.alias(out)).filter(F.col(out).isNotNull()).withColumn("_id", F.monotonically_increasing_id())
    placed = in_order(rows, key, [F.col(out), F.col("_id")], "_r")
    middle = placed.filter((2 * F.col("_r")).between(F.col("_r_of"), F.col("_r_of") + 2))
    return middle.groupBy(key).agg(F.avg(out).alias(out))


def basic(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, sums, extremes and spread of a value by series, of itself and of its size."""
    v = F.col(value)
    sums = df.groupBy(key).agg(
        F.avg(v).alias("mean"), F.sum(v).alias("total"), F.sum(F.abs(v)).alias("sum_abs"), F.avg(F.abs(v)).alias("mean_abs"),
        F.max(v).alias("max"), F.min(v).alias("min"), F.stddev_pop(v).alias("stddev"), F.var_samp(v).alias("var"), (F.max(v) - F.min(v)).alias("range"), F.count(v).alias("n"),
    )
    got = sums.join(median(df, key, F.abs(v), "median_abs"), key, "left")
    return got.select(key, "mean", "total", "sum_abs", "mean_abs", "median_abs", "max", "min", "stddev", "var", "range", "n")


def deviation_score(value: Column) -> Column:
    """Aggregate: mean size times the population deviation to the power of a tenth."""
    return F.avg(F.abs(value)) * F.pow(F.stddev_pop(value), F.lit(0.1))


def band_means(df: DataFrame, key: str, value: str, q: float) -> DataFrame:
    """Means of the lowest and highest share q of |value|, and of what lies between."""
    ids = df.withColumn("_id", F.monotonically_increasing_id())
    ranked = in_order(ids, key, [F.abs(F.col(value)), F.col(value), F.col("_id")], "_r").withColumn("_n", F.col("_r_of")).withColumn("_k", F.greatest(F.floor(F.col("_n") * q), F.lit(1)))
    size = F.abs(F.col(value))
    low, high = F.col("_r") <= F.col("_k"), F.col("_r") > F.col("_n") - F.col("_k")
    return ranked.groupBy(key).agg(F.avg(F.when(low, size)).alias("low"), F.avg(F.when(~low & ~high, size)).alias("middle"), F.avg(F.when(high, size)).alias("high"))


def scaling(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """dc (the mean) and sf (the mean distance from it, 1 instead of 0) by keys."""
    dc = df.groupBy(*keys).agg(F.avg(value).alias("dc"))
    got = df.join(dc, keys).groupBy(*keys).agg(F.first("dc").alias("dc"), F.avg(F.abs(F.col(value) - F.col("dc"))).alias("sf"))
    return got.withColumn("sf", F.when(F.col("sf") == 0, 1.0).otherwise(F.col("sf")))


def scaled(df: DataFrame, factors: DataFrame, keys: list[str], value: str, out: str = "scaled") -> DataFrame:
    return df.join(factors, keys).withColumn(out, (F.col(value) - F.col("dc")) / F.col("sf"))


def errors(forecast: Column, actual: Column, known: Column) -> list[Column]:
    """Aggregates: mae, mape, alpha (percent by which the last known value's error is larger), direction and better rates."""
    e, r = F.abs(forecast - actual), F.abs(known - actual)
    return [
        F.avg(e).alias("mae"), (100 * F.sum(e) / F.sum(F.abs(actual))).alias("mape"), (100 * (F.sum(r) / F.sum(e) - 1)).alias("alpha"),
        (100 * F.avg((F.signum(forecast - known) == F.signum(actual - known)).cast("double"))).alias("direction"), (100 * F.avg((e < r).cast("double"))).alias("better"),
    ]


def fit_quality(predicted: Column, actual: Column) -> list[Column]:
    """Aggregates: mean squared error and squared correlation, from plain sums."""
    n, sp, sy = F.count("*"), F.sum(predicted), F.sum(actual)
    spp, syy, spy = F.sum(predicted * predicted), F.sum(actual * actual), F.sum(predicted * actual)
    r2 = F.pow(n * spy - sp * sy, F.lit(2)) / ((n * spp - sp * sp) * (n * syy - sy * sy))
    return [F.avg((predicted - actual) * (predicted - actual)).alias("mse"), r2.alias("r2")]


def laplace_scale(df: DataFrame, key: str, residual: str) -> DataFrame:
    """Mean |residual| without those beyond five standard deviations of the first estimate (sqrt(2) times its mean)."""
    first = df.groupBy(key).agg(F.avg(F.abs(residual)).alias("_mae"))
    kept = df.join(first, key).filter(F.abs(F.col(residual)) <= 5 * F.sqrt(F.lit(2.0)) * F.col("_mae"))
    return kept.groupBy(key).agg(F.avg(F.abs(residual)).alias("scale"), F.count("*").alias("n"))


def entropies(df: DataFrame, keys: list[str], value: str, threshold: float, power: float) -> DataFrame:
    """Spectral entropy of normalised sizes, and the Shannon, threshold, norm and log-energy costs."""
    x = F.col(value)
    total = df.groupBy(*keys).agg(F.sum(F.abs(x)).alias("_total"))
    p = F.abs(x) / F.col("_total")
    sq = x * x
    return df.join(total, keys).groupBy(*keys).agg(
        F.sum(F.when(p > 0, -p * F.log2(p)).otherwise(0.0)).alias("spectral"), F.sum(F.when(sq > 0, -sq * F.log(sq)).otherwise(0.0)).alias("shannon"),
        F.sum((F.abs(x) > threshold).cast("long")).alias("above"), F.sum(F.pow(F.abs(x), F.lit(power))).alias("norm"), F.sum(F.when(sq > 0, F.log(sq)).otherwise(0.0)).alias("log_energy"),
    )
