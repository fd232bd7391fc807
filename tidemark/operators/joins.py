"""Joins of series: exact, nearest, by interval, against grids, with declared sets and with periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import DAY, SECOND, asof, bucket, gaps, grid, nearest, previous, row_index, running

MONTH = 30 * DAY


def within_deviation(probes: DataFrame, data: DataFrame, key: str, probe_time: str, data_time: str, values: list[str], deviation: int, width: int = DAY) -> DataFrame:
    """probes with the nearest row (ties to the later), none if it lies farther than `deviation`."""
    return nearest(probes, data, key, probe_time, data_time, values, deviation, width)


def available_lags(probes: DataFrame, data: DataFrame, key: str, probe_time: str, data_time: str, lag: int, max_gap: int, width: int = DAY) -> DataFrame:
    """probes with row_ix of the last data row at or before them and `reason`: null, "no row", "gap" or "lag"."""
    indexed = row_index(data.select(key, data_time), key, data_time, width)
    got = asof(probes, indexed, key, probe_time, data_time, ["row_ix"], "before", True, width)
    reason = F.when(F.col("found").isNull(), "no row").when(F.col(probe_time) - F.col("found.t") > max_gap, "gap").when(F.col("found.row_ix") < lag, "lag")
    return got.withColumn("row_ix", F.col("found.row_ix")).withColumn("reason", reason).drop("found")


def missing_grid(df: DataFrame, key: str, time: str, step: int) -> DataFrame:
    """Grid times between a series' first and last row that have no row."""
    ends = df.groupBy(key).agg(F.min(time).alias("_lo"), (F.max(time) + step).alias("_hi"))
    return grid(ends, "_lo", "_hi", step, time).select(key, time).join(df.select(key, time).distinct(), [key, time], "left_anti")


def latest_gap(df: DataFrame, key: str, time: str, step: int, width: int = DAY) -> DataFrame:
    """The newest missing interval of each series."""
    return gaps(df, key, time, step, width).groupBy(key).agg(F.max_by(F.struct("gap_start", "gap_end"), "gap_start").alias("g")).select(key, "g.*")


def needed_ranges(offers: DataFrame, stored: DataFrame, key: str, time: str) -> DataFrame:
    """Offered (lo, hi) cut to begin at the newest stored time; offers with nothing new are left out."""
    newest = stored.groupBy(key).agg(F.max(time).alias("_newest"))
    got = offers.join(newest, key, "left").withColumn("lo", F.greatest("lo", F.coalesce("_newest", "lo"))).drop("_newest")
    return got.filter("lo < hi")


def incomplete(declared: DataFrame, valid: DataFrame, keys: list[str]) -> DataFrame:
    """Declared keys without a valid row: empty means complete."""
    return declared.join(valid, keys, "left_anti")


def merged_intervals(intervals: DataFrame, key: str, start: str, end: str, width: int = DAY) -> DataFrame:
    """Union of intervals: those that touch or overlap as one. Running ends and island numbers go bucket by bucket."""
    longest = intervals.groupBy(key, start).agg(F.max(end).alias(end))
    seen = previous(running(longest, key, start, {}, {"_upto": F.col(end)}, width), key, start, ["_upto"], width)
    opened = seen.withColumn("_new", F.when(F.col("prev__upto").isNull() | (F.col(start) > F.col("prev__upto")), 1).otherwise(0)).select(key, start, end, "_new")
    islands = running(opened, key, start, {"_island": F.col("_new")}, width=width)
    return islands.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def reconciled(covered: DataFrame, asked: DataFrame, key: str, month: int = 30 * DAY, least: int = 10 * SECOND) -> DataFrame:
    """One step of the book of checked intervals: (key, lo, hi, front_lo, front_hi, back_lo, back_hi) for asked (key, since, until).

    covered (key, lo, hi) are the intervals so far; a key without one starts as an empty interval at `until`. The end moves up to `until` if that
    is `least` or more ahead, the start back to `since`, a month at most. front and back are the new parts [lo, hi) to look for gaps in, null where none."""
    held = asked.join(covered, key, "left").withColumns({"_lo": F.coalesce("lo", "until"), "_hi": F.coalesce("hi", "until")})
    ahead, behind = F.col("until") >= F.col("_hi") + least, F.col("since") < F.col("_lo")
    start = F.when(behind, F.greatest(F.col("_lo") - month, "since")).otherwise(F.col("_lo"))
    front = [F.when(ahead, F.col(c)).alias(n) for c, n in (("_hi", "front_lo"), ("until", "front_hi"))]
    back = [F.when(behind, start).alias("back_lo"), F.when(behind, F.col("_lo")).alias("back_hi")]
    return held.select(key, start.alias("lo"), F.when(ahead, F.col("until")).otherwise(F.col("_hi")).alias("hi"), *front, *back)


def retained(book: DataFrame, last_request: str, retention: int, now: Column) -> DataFrame:
    """The rows of the book that were asked for within `retention` of now."""
    return book.filter(F.col(last_request) + retention >= now)


def in_period(df: DataFrame, time: str, periods: DataFrame) -> DataFrame:
    """df with `period` of the (name, lo, hi) that the time lies strictly inside; a bucket of MONTH is the equi-key, so no table need be small."""
    spread = periods.select("name", "lo", "hi", F.explode(F.sequence(bucket("lo", MONTH), bucket("hi", MONTH))).alias("_pb"))
    inside = (F.col("_b") == F.col("_pb")) & (F.col(time) > F.col("lo")) & (F.col(time) < F.col("hi"))
    return df.withColumn("_b", bucket(time, MONTH)).join(spread, inside, "left").select(*df.columns, F.col("name").alias("period"))


def wildcard(column: str, value: Column | int) -> Column:
    """Matches an equal value, or a null that stands for any."""
    return F.col(column).isNull() | (F.col(column) == value)


def merged_factors(old: DataFrame, new: DataFrame, keys: list[str], values: list[str], overwrite: bool = False) -> DataFrame:
    """Full merge: new values fill unset ones, or go before them when asked to."""
    a, b = (new, old) if overwrite else (old, new)
    both = a.alias("a").join(b.alias("b"), keys, "full_outer")
    return both.select(*keys, *(F.coalesce(F.col(f"a.{v}"), F.col(f"b.{v}")).alias(v) for v in values))


def kept_pairs(rows: DataFrame, key: str, every: int, columns: list[str]) -> DataFrame:
    """Pairs (i, j) of a series' rows 0..n-1 whose i*n+j is divisible by `every`, with both rows' columns.

    Each row makes the numbers of its own partners, so no cross product is formed and no list is longer than GRID; rows need row_ix."""
    n = rows.groupBy(key).agg((F.max("row_ix") + 1).alias("n"))
    left = rows.select(key, F.col("row_ix").alias("i"), *(F.col(c).alias(f"{c}_i") for c in columns)).join(n, key)
    first = left.withColumn("_j", F.pmod(-(F.col("i") * F.col("n")), F.lit(every).cast("long"))).filter("_j < n")
    pairs = grid(first, "_j", "n", every, "j").drop("_j", "n")
    right = rows.select(key, F.col("row_ix").alias("j"), *(F.col(c).alias(f"{c}_j") for c in columns))
    return pairs.join(right, [key, "j"])
