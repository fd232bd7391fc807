"""Window operators of series: moving means, shifts, masks, returns, chunks and self-similarity.

Anything that reaches over an offset is an equi-join on row_ix, so a window never spans a whole series unless it
runs along it row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import in_order
from .spectral import behind, fir


def circular_mean(df: DataFrame, key: str, value: str, radius: int, out: str = "mean") -> DataFrame:
    """Mean over 2*radius+1 neighbours by row_ix, wrapping round each series' ends: a circular filter, moved back by the radius."""
    size = 2 * radius + 1
    sums = fir(df.select(key, "row_ix", F.col(value).cast("double").alias("_v"), *(["n_rows"] if "n_rows" in df.columns else [])), key, "_v", [1.0 / size] * size, 1, "_m", True, keep_size=True)
    means = sums.select(key, F.pmod(F.col("row_ix") - radius, F.col("n_rows")).alias("row_ix"), F.col("_m").alias(out))
    return df.join(means, [key, "row_ix"])


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def norm_trailing(df: DataFrame, key: str, value: str, bins: int, out: str = "smooth") -> DataFrame:
    """From row `bins` on the sum of bins+1 values over bins, before it the value; then shifted to keep the series' total."""
    rows = behind(df, key, value, bins).withColumn("_s", F.when(F.col("row_ix") >= bins, _total(F.col("_x")) / bins).otherwise(F.col(value))).drop("_x")
    shift = rows.groupBy(key).agg(((F.sum(value) - F.sum("_s")) / F.count("*")).alias("_d"))
    return rows.join(shift, key).withColumn(out, F.col("_s") + F.col("_d")).drop("_s", "_d")


def tapered(row_ix: Column, n: Column, multiplier: float, exponent: float) -> Column:
    """Mask weight multiplier * (1 - t/n)^exponent at place t of n."""
    return multiplier * F.pow(1 - row_ix / n, F.lit(exponent))


def by_source(df: DataFrame, key: str, value: str, source: Column, out: str) -> DataFrame:
    """df with `out`, the value at row `source` of the same series (null outside); source may use row_ix and n."""
    n = df.groupBy(key).agg((F.max("row_ix") + 1).alias("n"))
    asked = df.join(n, key).withColumn("_src", source.cast("long"))
    return asked.join(df.select(key, F.col("row_ix").alias("_src"), F.col(value).alias(out)), [key, "_src"], "left").drop("_src")


def shifted(df: DataFrame, key: str, value: str, k: int, out: str = "shifted") -> DataFrame:
    """out[i] = in[(i - k) mod n]."""
    return by_source(df, key, value, F.pmod(F.col("row_ix") - k, F.col("n")), out)


def stretched(df: DataFrame, key: str, value: str, factor: float, out: str = "stretched") -> DataFrame:
    """out[i] = in[floor(i / factor)], as far as the series goes."""
    return by_source(df, key, value, F.floor(F.col("row_ix") / factor), out)


def moving(df: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """Simple moving mean and population deviation over the last n rows."""
    got = behind(df, key, value, n - 1).withColumn("sma", _total(F.col("_x")) / F.size("_x"))
    squares = F.transform("_x", lambda x: (x - F.col("sma")) * (x - F.col("sma")))
    return got.withColumn("sdev", F.sqrt(_total(squares) / F.size("_x"))).drop("_x")


def chunked(df: DataFrame, key: str, size: int, overlap: float) -> DataFrame:
    """df with `chunk`: chunks of `size` rows that share a part `overlap` with the next; a row may be in several."""
    step = max(1, int(size * (1 - overlap)))
    first = F.greatest(F.lit(0), F.ceil((F.col("row_ix") - size + 1) / F.lit(step))).cast("long")
    return df.withColumn("chunk", F.explode(F.sequence(first, F.floor(F.col("row_ix") / step).cast("long"))))


def self_similarity(df: DataFrame, key: str, value: str, offsets: list[int]) -> DataFrame:
    """Mean |x - y| / (|x| + |y|) of rows `offset` apart, by series and offset."""
    later = df.select(key, "row_ix", F.col(value).alias("_y"), F.explode(F.array(*map(F.lit, offsets))).alias("offset"))
    pairs = later.withColumn("row_ix", F.col("row_ix") - F.col("offset")).join(df.select(key, "row_ix", F.col(value).alias("_x")), [key, "row_ix"])
    size = F.abs("_x") + F.abs("_y")
    return pairs.groupBy(key, "offset").agg(F.avg(F.when(size == 0, 0.0).otherwise(F.abs(F.col("_x") - F.col("_y")) / size)).alias("distance"))


def best_stretch(df: DataFrame, key: str, value: str, offsets: list[int], multiplier: float, limit: float) -> DataFrame:
    """(key, offset, stretch, distance): how the first `offset` rows of a series resemble its last ones, row i beside row floor(i * stretch), at the stretch
    (1, multiplier, multiplier^2, ... above the limit) with the least mean |x - y| / (|x| + |y|); of equals the largest. Series shorter than an offset have no row for it."""
    stretches, now = [], 1.0
    while now > limit:
        stretches.append(now)
        now *= multiplier
    asked = F.array(*(F.struct(F.lit(o).cast("long").alias("offset"), F.lit(s).alias("stretch")) for o in offsets for s in stretches))
    n = df.groupBy(key).agg((F.max("row_ix") + 1).alias("_n"))
    first = df.filter(F.col("row_ix") < max(offsets)).join(n, key).select(key, "row_ix", "_n", F.col(value).alias("_x"), F.explode(asked).alias("_a")).select(key, "row_ix", "_n", "_x", "_a.*")
    first = first.filter((F.col("row_ix") < F.col("offset")) & (F.col("offset") <= F.col("_n")))
    at = F.col("_n") - F.col("offset") + F.floor(F.col("row_ix") * F.col("stretch")).cast("long")
    pairs = first.withColumn("row_ix", at).join(df.select(key, "row_ix", F.col(value).alias("_y")), [key, "row_ix"])
    size = F.abs("_x") + F.abs("_y")
    each = pairs.groupBy(key, "offset", "stretch").agg(F.avg(F.when(size == 0, 0.0).otherwise(F.abs(F.col("_x") - F.col("_y")) / size)).alias("d"))
    best = F.min(F.struct(F.round("d", 9).alias("d"), (-F.col("stretch")).alias("s"))).alias("b")
    return each.groupBy(key, "offset").agg(best).select(key, "offset", (-F.col("b.s")).alias("stretch"), F.col("b.d").alias("distance"))


def worst_rows(df: DataFrame, key: str, label: str, drop: int) -> DataFrame:
    """df without the `drop` rows of each series whose summed distance to all labels is largest.

    Over sorted labels the sum of |L_i - L_j| follows from the prefix sum, so no pairs are formed."""
    got = in_order(df, key, [F.col(label), F.col("row_ix")], "_i", {"_run": F.col(label)})
    totals = df.groupBy(key).agg(F.sum(label).alias("_total"))
    score = F.col(label) * (2 * F.col("_i") - F.col("_i_of")) + F.col("_total") - 2 * F.col("_run")
    scored = got.join(totals, key).withColumn("score", score).withColumn("_s", -F.round("score", 6))
    ranked = in_order(scored.select(*df.columns, "score", "_s"), key, [F.col("_s"), F.col("row_ix")], "_r")
    return ranked.filter(F.col("_r") > drop).drop("_r", "_r_of", "_s")


def weights_from_scores(df: DataFrame, key: str, score: str) -> DataFrame:
    """df with `weight`: scores inverted around their extremes, over their mean (the extremes less the mean score)."""
    ends = df.groupBy(key).agg((F.max(score) + F.min(score)).alias("_ends"), F.avg(score).alias("_mean"))
    return df.join(ends, key).withColumn("weight", (F.col("_ends") - F.col(score)) / (F.col("_ends") - F.col("_mean"))).select(*df.columns, "weight")


def snapped_to(df: DataFrame, value: str, allowed: list[float], out: str = "snapped") -> DataFrame:
    """df with the nearest of the allowed values (a parameter); on a mid-point the larger."""
    a = sorted(allowed)
    pick = F.lit(a[0])
    for low, high in zip(a, a[1:], strict=False):
        pick = F.when(F.col(value) >= (low + high) / 2, F.lit(high)).otherwise(pick)
    return df.withColumn(out, pick)
