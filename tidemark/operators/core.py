"""What the series operators rest on: buckets, row index, as-of joins, range joins, grids and gaps.

A series is a key and a time; times are whole microseconds (see `micros`). A long series is cut into buckets of time,
each a window partition of its own. What must cross buckets (a row number, the last row seen) goes through a table with one row for each bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.shared import written

#: Values of a grid that one list holds.
GRID = 4096
SECOND = 1_000_000
MINUTE, HOUR, DAY = 60 * SECOND, 3600 * SECOND, 86400 * SECOND


def micros(column: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(column) if isinstance(column, str) else column)


def bucket(time: str | Column, width: int) -> Column:
    t = F.col(time) if isinstance(time, str) else time
    return F.floor(t / F.lit(width)).cast("long")


def row_index(df: DataFrame, key: str, time: str, width: int = DAY, out: str = "row_ix", ties: tuple[str, ...] = ()) -> DataFrame:
    """df with the row's place (from 0) in its series, by (time, *ties)."""
    rows = df.withColumn("_b", bucket(time, width))
    upto = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(key, "_b").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0))).drop("_n")
    inside = Window.partitionBy(key, "_b").orderBy(time, *ties)
    return rows.withColumn("_i", F.row_number().over(inside)).join(counts, [key, "_b"]).withColumn(out, (F.col("_before") + F.col("_i") - 1).cast("long")).select(*df.columns, out)


def asof(probes: DataFrame, data: DataFrame, key: str, probe_time: str, data_time: str, values: list[str], direction: str = "before", equal: bool = True, width: int = DAY, out: str = "found") -> DataFrame:
    """probes with `out`: struct(data_time as t, *values) of the data row next to them in time, null where there is none.

    direction: "before" takes the last row at or before the probe, "after" the first at or behind it; equal=False leaves
    out rows of the probe's own time. Of data rows of one time the greatest struct counts. The state crosses buckets
    through a table of each bucket's edge row."""
    back = direction == "before"
    sign = 1 if back else -1
    found = F.struct(F.col(data_time).alias("t"), *values)
    right = data.groupBy(key, data_time).agg(F.max(found).alias("_r")).select(key, F.col(data_time).alias("_t"), "_r")
    first_side = 0 if equal else 1
    tagged = probes.select(F.col(key), F.col(probe_time).alias("_t"), F.struct(*probes.columns).alias("_p"), F.lit(1 - first_side).alias("_side"))
    union = tagged.unionByName(right.withColumn("_side", F.lit(first_side)), allowMissingColumns=True).withColumn("_b", bucket("_t", width) * sign)
    w = Window.partitionBy(key, "_b").orderBy(F.col("_t") * sign, "_side").rowsBetween(Window.unboundedPreceding, 0)
    near = union.withColumn("_near", F.last("_r", ignorenulls=True).over(w))
    edges = union.groupBy(key, "_b").agg((F.max_by if back else F.min_by)("_r", F.when(F.col("_r").isNotNull(), F.col("_t"))).alias("_edge"))
    carry = edges.withColumn("_carry", F.last("_edge", ignorenulls=True).over(Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).drop("_edge")
    return near.filter(F.col("_p").isNotNull()).join(carry, [key, "_b"], "left").select("_p.*", F.coalesce("_near", "_carry").alias(out))


def nearest(probes: DataFrame, data: DataFrame, key: str, probe_time: str, data_time: str, values: list[str], max_gap: int | None = None, width: int = DAY, out: str = "found") -> DataFrame:
    """probes with the data row nearest in time; a tie goes to the later row; farther than max_gap counts as none.

    One union and one sort by (key, bucket) find the rows before and behind a probe; each bucket's edge rows are carried both ways."""
    found = F.struct(F.col(data_time).alias("t"), *values)
    right = data.groupBy(key, data_time).agg(F.max(found).alias("_r")).select(key, F.col(data_time).alias("_t"), "_r", F.lit(0).alias("_side"))
    tagged = probes.select(F.col(key), F.col(probe_time).alias("_t"), F.struct(*probes.columns).alias("_p"), F.lit(1).alias("_side"))
    union = tagged.unionByName(right, allowMissingColumns=True).withColumn("_b", bucket("_t", width))
    w = Window.partitionBy(key, "_b").orderBy("_t", "_side")
    low = F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    high = F.first("_r", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    near = union.withColumn("_lo", low).withColumn("_hi", high).filter(F.col("_p").isNotNull())
    there = F.when(F.col("_r").isNotNull(), F.col("_t"))
    edges = union.groupBy(key, "_b").agg(F.max_by("_r", there).alias("_last"), F.min_by("_r", there).alias("_first"))
    along = Window.partitionBy(key).orderBy("_b")
    carry = edges.select(key, "_b", F.last("_last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.first("_first", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    both = near.join(carry, [key, "_b"], "left").select("_p", "_t", F.coalesce("_lo", "_before").alias("_lo"), F.coalesce("_hi", "_after").alias("_hi"))
    below, above = F.col("_t") - F.col("_lo.t"), F.col("_hi.t") - F.col("_t")
    pick = F.when(below.isNull() | (above <= below), F.col("_hi")).otherwise(F.col("_lo"))
    if max_gap is not None:
        pick = F.when(F.least(below, above) <= max_gap, pick)
    return both.withColumn("_pick", pick).select("_p.*", F.col("_pick").alias(out))


def range_join(intervals: DataFrame, points: DataFrame, key: str, start: str, end: str, time: str, width: int, how: str = "inner") -> DataFrame:
    """Points with start <= time < end, on buckets as an equi-key; each interval goes to the buckets it touches."""
    spread = grid(intervals, bucket(start, width), bucket(F.greatest(F.col(end) - 1, F.col(start)), width) + 1, 1, "_b")
    marked = points.withColumn("_pb", bucket(time, width)).withColumnRenamed(key, "_pk")
    inside = (F.col(key) == F.col("_pk")) & (F.col("_b") == F.col("_pb")) & (F.col(time) >= F.col(start)) & (F.col(time) < F.col(end))
    return spread.join(marked, inside, how).drop("_b", "_pb", "_pk")


def grid(df: DataFrame, start: str | Column, end: str | Column, step: int, out: str = "t") -> DataFrame:
    """A row for each of start, start+step, ... before end; one row where start equals end. A long grid is made in lists of GRID values."""
    s, e = (F.col(x) if isinstance(x, str) else x for x in (start, end))
    places = F.floor((F.greatest(e - 1, s) - s) / F.lit(step)).cast("long")
    parts = df.withColumn("_start", s).withColumn("_places", places).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_places") / GRID).cast("long"))))
    own = F.sequence(F.col("_part") * GRID, F.least(F.col("_places"), F.col("_part") * GRID + GRID - 1))
    return parts.withColumn("_place", F.explode(own)).withColumn(out, F.col("_start") + F.col("_place") * step).drop("_start", "_places", "_part", "_place")


def running(df: DataFrame, key: str, time: str, sums: dict[str, Column], tops: dict[str, Column] | None = None, width: int = DAY) -> DataFrame:
    """df with running sums and running maxima of columns along each series (distinct times), the row itself included.

    Each bucket runs for itself; what the buckets before it come to is carried on through a table with one row a bucket."""
    tops = tops or {}
    rows = df.withColumn("_b", bucket(time, width)).withColumns({f"_{n}": c for n, c in (sums | tops).items()})
    inside = Window.partitionBy(key, "_b").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.groupBy(key, "_b").agg(*(F.sum(f"_{n}").alias(f"_{n}") for n in sums), *(F.max(f"_{n}").alias(f"_{n}") for n in tops))
    carry = whole.select(key, "_b", *(F.sum(f"_{n}").over(before).alias(f"_c_{n}") for n in sums), *(F.max(f"_{n}").over(before).alias(f"_c_{n}") for n in tops))
    run = {f"_r_{n}": F.sum(f"_{n}").over(inside) for n in sums} | {f"_r_{n}": F.max(f"_{n}").over(inside) for n in tops}
    got = rows.withColumns(run).join(carry, [key, "_b"], "left")
    return got.select(*df.columns, *((F.coalesce(f"_c_{n}", F.lit(0)) + F.col(f"_r_{n}")).alias(n) for n in sums), *(F.greatest(f"_c_{n}", f"_r_{n}").alias(n) for n in tops))


def in_order(df: DataFrame, key: str, order: list[Column], out: str = "place", sums: dict[str, Column] | None = None) -> DataFrame:
    """df with its place (from 1) in its key's rows by `order`, which must leave no ties, `<out>_of` (the rows of the key), and running sums (the row included).

    Rows are dealt out in ranges of (key, order) and written, so a key with most rows is many ranges; places and sums before a range come from a
    table with one row for each key and range."""
    sums = sums or {}
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(df.withColumns({f"_{name}": c for name, c in sums.items()}).repartitionByRange(n, F.col(key), *order).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy(key, "_range").orderBy(*order)
    before, whole = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(key)
    edges = rows.groupBy(key, "_range").agg(F.count("*").alias("_n"), *(F.sum(f"_{name}").alias(f"_{name}") for name in sums))
    carry = edges.select(key, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias(f"{out}_of"), *(F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_c_{name}") for name in sums))
    got = rows.withColumn("_i", F.row_number().over(inside)).withColumns({f"_r_{name}": F.sum(f"_{name}").over(inside.rowsBetween(Window.unboundedPreceding, 0)) for name in sums})
    return got.join(carry, [key, "_range"]).select(*df.columns, (F.col("_before") + F.col("_i")).alias(out), f"{out}_of", *((F.col(f"_c_{name}") + F.col(f"_r_{name}")).alias(name) for name in sums))


def previous(df: DataFrame, key: str, time: str, columns: list[str], width: int = DAY) -> DataFrame:
    """df with prev_<column> of the row before in its series (bucketed lag), for distinct times."""
    w = Window.partitionBy(key, "_b").orderBy(time)
    rows = df.withColumn("_b", bucket(time, width)).withColumn("_l", F.lag(F.struct(*columns)).over(w))
    edge = rows.groupBy(key, "_b").agg(F.max_by(F.struct(*columns), time).alias("_e"))
    carry = edge.withColumn("_c", F.lag("_e").over(Window.partitionBy(key).orderBy("_b"))).drop("_e")
    joined = rows.join(carry, [key, "_b"]).withColumn("_l", F.coalesce("_l", "_c"))
    return joined.select(*df.columns, *(F.col(f"_l.{c}").alias(f"prev_{c}") for c in columns))


def gaps(df: DataFrame, key: str, time: str, step: int, width: int = DAY, start: int | None = None) -> DataFrame:
    """(key, gap_start, gap_end): runs of missing grid times between neighbouring rows more than a step apart; with `start` of the rows from it on, and the
    run from it to a series' first row."""
    rows = df.select(key, time).distinct()
    rows = rows if start is None else rows.filter(F.col(time) >= start)
    near = previous(rows, key, time, [time], width)
    found = near.filter(F.col(time) - F.col(f"prev_{time}") > step).select(key, (F.col(f"prev_{time}") + step).alias("gap_start"), F.col(time).alias("gap_end"))
    if start is None:
        return found
    first = rows.groupBy(key).agg(F.min(time).alias("gap_end")).filter(F.col("gap_end") > start)
    return found.unionByName(first.select(key, F.lit(start).cast("long").alias("gap_start"), "gap_end"))


def overlay(old: DataFrame, new: DataFrame, key: str, time: str) -> DataFrame:
    """Union with tail overwrite: in each series, what is old ends before the first new time."""
    first = new.groupBy(key).agg(F.min(time).alias("_first"))
    kept = old.join(first, key, "left").filter(F.col("_first").isNull() | (F.col(time) < F.col("_first"))).drop("_first")
    return kept.unionByName(new)


def replace_keys(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Key-replace: new rows win over old ones with the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
