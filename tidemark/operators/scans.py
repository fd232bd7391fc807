"""Scans, projections, filters and sampling of series tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import DAY, row_index


def table_name(owner: str | Column, name: str | Column, seconds: str | Column) -> Column:
    """Physical name q_<owner>_<name>_<seconds>: lower case, anything but letters and digits as _."""
    return F.lower(F.regexp_replace(F.concat_ws("_", F.lit("q"), owner, name, seconds), "[^A-Za-z0-9]", "_"))


def catalog(df: DataFrame, key: str, time: str, owner: Column, name: Column) -> DataFrame:
    """One row for each series: its name, first and last time, rows, and median-free resolution (span over steps)."""
    got = df.groupBy(key).agg(F.min(time).alias("first_t"), F.max(time).alias("last_t"), F.count("*").alias("n"))
    seconds = F.when(F.col("n") > 1, F.floor((F.col("last_t") - F.col("first_t")) / (F.col("n") - 1) / 1_000_000)).otherwise(0).cast("long")
    return got.withColumn("resolution", seconds).withColumn("table_name", table_name(owner, name, F.col("resolution").cast("string")))


def range_scan(df: DataFrame, time: str, lo, hi, limit: int | None = None) -> DataFrame:
    """Rows of [lo, hi] in order of time, the first `limit` of them if given."""
    got = df.filter(F.col(time).between(lo, hi)).orderBy(time)
    return got if limit is None else got.limit(limit)


def latest(df: DataFrame, key: str, time: str, n: int, upto=None) -> DataFrame:
    """The n newest rows of each series at or before `upto`."""
    rows = df if upto is None else df.filter(F.col(time) <= upto)
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(time)))).filter(F.col("_r") <= n).drop("_r")


def nth_last(df: DataFrame, key: str, time: str, position: int, before) -> DataFrame:
    """The row `position` places behind the newest one before a time, in each series."""
    rows = df.filter(F.col(time) < before)
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(time)))).filter(F.col("_r") == position + 1).drop("_r")


def edges(df: DataFrame, key: str, time: str, changed: str, columns: list[str]) -> DataFrame:
    """Oldest, newest and last changed row of each series."""
    row = F.struct(time, *columns)
    return df.groupBy(key).agg(F.min_by(row, time).alias("oldest"), F.max_by(row, time).alias("newest"), F.max_by(row, F.struct(changed, time)).alias("changed"))


def frames(df: DataFrame, key: str, time: str, size: int, width: int = DAY) -> DataFrame:
    """Groups of `size` consecutive rows: frame, first and last time, rows, and whether the frame is full."""
    rows = row_index(df, key, time, width)
    got = rows.groupBy(key, F.floor(F.col("row_ix") / size).cast("long").alias("frame")).agg(F.min(time).alias("first_t"), F.max(time).alias("last_t"), F.count("*").alias("n"))
    return got.withColumn("full", F.col("n") == size)


def column_of(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """`keep` and one value column, named value; an unknown column is an error."""
    if column not in df.columns:
        raise ValueError(f"no column {column}")
    return df.select(*keep, F.col(column).alias("value"))


def slice_with_tail(df: DataFrame, key: str, time: str, lo, hi, tail: int, width: int = DAY) -> DataFrame:
    """Rows of [lo, hi) and the `tail` rows before them, of series that have so many."""
    rows = row_index(df, key, time, width)
    start = rows.filter(F.col(time) < lo).groupBy(key).agg((F.max("row_ix") + 1).alias("_at"))
    placed = rows.join(start, key, "left").withColumn("_at", F.coalesce("_at", F.lit(0)))
    return placed.filter((F.col("_at") >= tail) & (F.col(time) < hi) & (F.col("row_ix") >= F.col("_at") - tail)).drop("_at")


def snapped(time: Column, step: int, deviation: int) -> Column:
    """Time on the grid: down if it is at most `deviation` past a slot, up if less than that before the next, else null."""
    if deviation * 2 > step:
        raise ValueError("the deviation may be half a step at most")
    over = F.pmod(time, F.lit(step))
    return F.when(over <= deviation, time - over).when(F.pmod(time + deviation, F.lit(step)) < deviation, time - over + step).cast("long")


def appended_on_grid(df: DataFrame, key: str, time: str, step: int, deviation: int) -> DataFrame:
    """Rows that fit the grid, with the slot as their time; of those in one slot the nearest, then the earliest."""
    rows = df.withColumn("slot", snapped(F.col(time), step, deviation)).filter("slot IS NOT NULL")
    order = Window.partitionBy(key, "slot").orderBy(F.abs(F.col(time) - F.col("slot")), time)
    return rows.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def normal(value: Column) -> Column:
    """Neither null, NaN nor infinite; zero, or not too small to be a normal number."""
    size = F.abs(value)
    return F.coalesce(~F.isnan(value) & (size < float("inf")) & ((size == 0) | (size >= 2.2250738585072014e-308)), F.lit(False))


def outside_session(time: Column, weekday: int, hour: int) -> Column:
    """False on or behind a weekday (Monday 0) at or behind an hour: the rows that a session filter skips."""
    day = F.pmod(F.floor(time / F.lit(86_400_000_000)) + 3, F.lit(7))
    at = F.pmod(F.floor(time / F.lit(3_600_000_000)), F.lit(24))
    return ~((day >= weekday) & (at >= hour))


def adjacent_levels(levels: int, ratio: float, count: str | Column) -> Column:
    """Levels around `level`, ratio*count of them, clamped at both ends: ratio 0 gives the level itself, 1 all."""
    level = F.col("level")
    half = F.lit(int(round(ratio * (levels - 1))))
    lo = F.greatest(F.lit(0), F.least(level - F.floor(half / 2), F.lit(levels - 1) - half)).cast("int")
    return F.sequence(lo, (lo + half).cast("int"))


def stratified(df: DataFrame, label: str, n: int, order: Column) -> DataFrame:
    """For each class max(1, ceil(size * n / total)) rows, the first in `order`."""
    sizes = df.groupBy(label).agg(F.count("*").alias("_size"))
    quota = sizes.select(label, F.greatest(F.lit(1), F.ceil(F.col("_size") * n / F.sum("_size").over(Window.partitionBy(F.lit(0))))).alias("_quota"))  # one row a class
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy(order)))
    return ranked.join(quota, label).filter("_r <= _quota").drop("_r", "_quota")
