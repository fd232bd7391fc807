"""Bars and time-weighted averages from ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import DAY, bucket, grid, previous


def validity(ticks: DataFrame, key: str, time: str, value: str, width: int = DAY) -> DataFrame:
    """Each tick with `until`, the time of the next one in its series (null for the last)."""
    flipped = previous(ticks.withColumn("_neg", -F.col(time)), key, "_neg", ["_neg"], width)
    return flipped.withColumn("until", -F.col("prev__neg")).drop("_neg", "prev__neg")


def twap_bars(ticks: DataFrame, key: str, time: str, value: str, step: int, width: int = DAY) -> DataFrame:
    """bar, twap, ticks, close of every bar that a tick starts in or that a tick's price holds through until the next tick.

    A price holds from its tick to the next. A bar's average weighs prices by the time they hold inside it; before
    a series' first tick and behind its last there is no price, so such bars weigh what is known. ticks counts those that start in the bar."""
    held = validity(ticks, key, time, value, width).withColumn("until", F.coalesce("until", (F.floor(F.col(time) / step) + 1).cast("long") * step))
    first = (bucket(time, step) * step).alias("_first")
    # the bars that a price holds through are made in lists of bounded length, however long the silence
    parts = grid(held, first, F.greatest("until", F.col(time) + 1), step, "bar")
    inside = F.least("until", F.col("bar") + step) - F.greatest(F.col(time), F.col("bar"))
    parts = parts.withColumn("_w", inside).withColumn("_own", F.col(time) >= F.col("bar"))
    return parts.groupBy(key, "bar").agg(
        (F.sum(F.col(value) * F.col("_w")) / F.sum("_w")).alias("twap"),
        F.sum(F.col("_own").cast("long")).alias("ticks"),
        F.max_by(value, time).alias("close"),
    )


def ohlc_bars(ticks: DataFrame, key: str, time: str, value: str, step: int, spread: float = 0.0, offset: int = 0) -> DataFrame:
    """open, high, low, close of bid, the same of ask (bid + spread), and the number of ticks, by bars that start at offset + n*step."""
    bar = (bucket(F.col(time) - offset, step) * step + offset).alias("bar")
    got = ticks.groupBy(key, bar).agg(F.min_by(value, time).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, time).alias("close"), F.count("*").alias("ticks"))
    return got.select("*", *((F.col(c) + spread).alias(f"ask_{c}") for c in ("open", "high", "low", "close")))


def rollup(bars: DataFrame, key: str, step: int, offset: int = 0) -> DataFrame:
    """Longer bars from bars: first open, highest high, lowest low, last close, all ticks."""
    bar = (bucket(F.col("bar") - offset, step) * step + offset).alias("wide_bar")
    return bars.groupBy(key, bar).agg(F.min_by("open", "bar").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bar").alias("close"), F.sum("ticks").alias("ticks"))


def average_of_rates(rates: DataFrame, key: str, step: int) -> DataFrame:
    """Average price of the rates in a bar: the first open and (high + low + 2 close) / 4 of each, over their number plus one."""
    bar = (bucket("bar", step) * step).alias("wide_bar")
    total = F.min_by("open", "bar") + F.sum((F.col("high") + F.col("low") + 2 * F.col("close")) / 4)
    return rates.groupBy(key, bar).agg((total / (1 + F.count("*"))).alias("price"), F.sum("ticks").alias("ticks"), F.min_by("close", "bar").alias("close"))


def filled_grid(ticks: DataFrame, key: str, time: str, value: str, step: int, width: int = DAY) -> DataFrame:
    """t, value, ticks on the whole grid of each series from its first to its last tick; empty slots keep the last price, with no ticks."""
    newest = F.max(F.struct(F.col(time).alias("at"), F.col(value).alias("price"))).alias("_last")
    own = ticks.groupBy(key, (bucket(time, step) * step).alias("_own")).agg(newest, F.count("*").alias("ticks"))
    # each slot with ticks goes on until the next one
    held = validity(own, key, "_own", "_last", max(width, step)).withColumn("until", F.coalesce("until", F.col("_own") + step))
    slots = grid(held, "_own", "until", step)
    return slots.select(key, "t", F.col("_last.price").alias(value), F.when(F.col("t") == F.col("_own"), F.col("ticks")).otherwise(0).alias("ticks"))


def trapezoid(quotes: DataFrame, key: str, time: str, prices: list[str], quantities: list[str], step: int, width: int = DAY) -> DataFrame:
    """Trapezoid averages of quote prices by window of `step`; quantities of the last quote; a window of one quote gives that quote."""
    rows = quotes.withColumn("w", bucket(time, step) * step)
    rows = previous(rows, key, time, [time, "w", *prices], width)
    same = F.col("prev_w") == F.col("w")
    gap = F.when(same, F.col(time) - F.col(f"prev_{time}")).otherwise(0)
    rows = rows.withColumn("_dt", gap)
    aggs = []
    for p in prices:
        area = F.sum(F.when(same, (F.col(p) + F.col(f"prev_{p}")) / 2 * F.col("_dt")).otherwise(0.0))
        aggs.append(F.when(F.sum("_dt") > 0, area / F.sum("_dt")).otherwise(F.max_by(p, time)).alias(p))
    return rows.groupBy(key, "w").agg(*aggs, *(F.max_by(q, time).alias(q) for q in quantities))
