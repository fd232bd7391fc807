"""Queries over bars and time-weighted averages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import bars, core
from tidemark.operators.core import DAY, HOUR

from .tables import query, ticks


def _twap(step: int) -> str:
    return f"""WITH h AS (SELECT series, t, price, coalesce(lead(t) OVER (PARTITION BY series ORDER BY t), (t // {step} + 1) * {step}) AS until FROM {{ticks}}),
p AS (SELECT *, unnest(range(t // {step}, greatest(until - 1, t) // {step} + 1)) * {step} AS bar FROM h), w AS (SELECT *, least(until, bar + {step}) - greatest(t, bar) AS w FROM p)
SELECT series, bar, round(sum(price * w) / sum(w), 6) AS twap, count(*) FILTER (t >= bar) AS ticks, arg_max(price, t) AS close FROM w GROUP BY series, bar"""


@query("tick_twap_bars", _twap(HOUR))
def tick_twap_bars(spark, d):
    return bars.twap_bars(ticks(spark, d), "series", "t", "price", HOUR).withColumn("twap", F.round("twap", 6))




@query("per_step_forward_fill", f"""WITH e AS (SELECT series, min(t) // {HOUR} * {HOUR} AS lo, max(t) // {HOUR} * {HOUR} AS hi FROM {{ticks}} GROUP BY series), g AS (SELECT series, unnest(range(lo, hi + 1, {HOUR})) AS t FROM e),
n AS (SELECT series, t // {HOUR} * {HOUR} AS t, count(*) AS ticks FROM {{ticks}} GROUP BY ALL)
SELECT g.series, g.t, k.price, coalesce(n.ticks, 0) AS ticks FROM g ASOF JOIN (SELECT series, t + 1 AS t1, price FROM {{ticks}}) k ON k.series = g.series AND k.t1 <= g.t + {HOUR} LEFT JOIN n ON n.series = g.series AND n.t = g.t""")
def per_step_forward_fill(spark, d):
    """Every slot of the grid with the last price in force at its end; empty slots carry it on (an hour's grid here, a second's in use)."""
    return bars.filled_grid(ticks(spark, d), "series", "t", "price", HOUR)


_OHLC = "(SELECT series, t // {0} * {0} AS bar, arg_min(price, t) AS open, max(price) AS high, min(price) AS low, arg_max(price, t) AS close, count(*) AS ticks FROM {{ticks}} GROUP BY ALL)"


@query("ohlc_bars", f"SELECT series, bar, open, high, low, close, ticks, round(open + 0.01, 6) AS ask_open, round(high + 0.01, 6) AS ask_high, round(low + 0.01, 6) AS ask_low, round(close + 0.01, 6) AS ask_close FROM {_OHLC.format(HOUR).replace('{{', '{').replace('}}', '}')}")
def ohlc_bars(spark, d):
    got = bars.ohlc_bars(ticks(spark, d), "series", "t", "price", HOUR, 0.01)
    return got.select(*(F.round(c, 6).alias(c) if c.startswith("ask_") else c for c in got.columns))


@query("bar_rollup", f"SELECT series, (bar - {HOUR}) // {4 * HOUR} * {4 * HOUR} + {HOUR} AS wide_bar, arg_min(open, bar) AS open, max(high) AS high, min(low) AS low, arg_max(close, bar) AS close, CAST(sum(ticks) AS BIGINT) AS ticks FROM {_OHLC.format(HOUR).replace('{{', '{').replace('}}', '}')} GROUP BY ALL")
def bar_rollup(spark, d):
    return bars.rollup(bars.ohlc_bars(ticks(spark, d), "series", "t", "price", HOUR), "series", 4 * HOUR, HOUR)


@query("average_of_rates", f"SELECT series, bar // {DAY} * {DAY} AS wide_bar, round((arg_min(open, bar) + sum((high + low + 2 * close) / 4)) / (1 + count(*)), 6) AS price, CAST(sum(ticks) AS BIGINT) AS ticks, arg_min(close, bar) AS close FROM {_OHLC.format(HOUR).replace('{{', '{').replace('}}', '}')} GROUP BY ALL")
def average_of_rates(spark, d):
    rates = bars.ohlc_bars(ticks(spark, d), "series", "t", "price", HOUR)
    return bars.average_of_rates(rates, "series", DAY).withColumn("price", F.round("price", 6))


@query("trapezoid_twap", f"""WITH q AS (SELECT *, t // {DAY} * {DAY} AS w FROM {{ticks}}), l AS (SELECT *, lag(t) OVER p AS pt, lag(price) OVER p AS pp FROM q WINDOW p AS (PARTITION BY series, w ORDER BY t))
SELECT series, w, round(CASE WHEN sum(t - pt) > 0 THEN sum((price + pp) / 2 * (t - pt)) / sum(t - pt) ELSE arg_max(price, t) END, 6) AS bid,
  round(CASE WHEN sum(t - pt) > 0 THEN sum((price + pp) / 2 * (t - pt)) / sum(t - pt) ELSE arg_max(price, t) END + 0.01, 6) AS ask, arg_max(qty, t) AS qty FROM l GROUP BY series, w""")
def trapezoid_twap(spark, d):
    quotes = ticks(spark, d).withColumn("bid", F.col("price")).withColumn("ask", F.col("price") + 0.01)
    got = bars.trapezoid(quotes, "series", "t", ["bid", "ask"], ["qty"], DAY)
    return got.select("series", "w", F.round("bid", 6).alias("bid"), F.round("ask", 6).alias("ask"), "qty")


_DAYS = f"(SELECT DISTINCT series, t // {DAY} * {DAY} AS day FROM {{ticks}})"


def _grid_rows(spark, d):
    """The last price before each hour of every day in which a series has a tick."""
    days = ticks(spark, d).select("series", (core.bucket("t", DAY) * DAY).alias("day")).distinct()
    points = core.grid(days.withColumn("hi", F.col("day") + DAY), "day", "hi", HOUR, "g")
    rows = core.row_index(ticks(spark, d), "series", "t")
    return core.asof(points, rows, "series", "g", "t", ["row_ix", "price", "qty"]).filter("found IS NOT NULL")


_GRID_ROWS = f"(SELECT p.series, p.day, p.g, k.t, k.row_ix, k.price, k.qty FROM (SELECT series, day, unnest(range(day, day + {DAY}, {HOUR})) AS g FROM {_DAYS}) p ASOF JOIN (SELECT *, row_number() OVER (PARTITION BY series ORDER BY t) - 1 AS row_ix FROM {{ticks}}) k ON k.series = p.series AND k.t <= p.g)"


@query("grid_twap_by_index", f"SELECT series, day, (g - day) // {6 * HOUR} AS slot, min(row_ix) AS row_ix, round(avg(price), 6) AS twap FROM {_GRID_ROWS} GROUP BY ALL")
def grid_twap_by_index(spark, d):
    """24 grid steps of a day, as-of row index each, brought down to four positions."""
    got = _grid_rows(spark, d).withColumn("slot", F.floor((F.col("g") - F.col("day")) / (6 * HOUR)).cast("long"))
    return got.groupBy("series", "day", "slot").agg(F.min("found.row_ix").alias("row_ix"), F.round(F.avg("found.price"), 6).alias("twap"))


@query("twap_extremum_bias", f"""SELECT series, day, round((2.0 * avg(price) + CASE WHEN max(price) - avg(price) >= avg(price) - min(price) THEN max(price) ELSE min(price) END) / 3.0, 6) AS biased FROM {_GRID_ROWS} GROUP BY ALL""")
def twap_extremum_bias(spark, d):
    p = F.col("found.price")
    far = F.when(F.max(p) - F.avg(p) >= F.avg(p) - F.min(p), F.max(p)).otherwise(F.min(p))
    return _grid_rows(spark, d).groupBy("series", "day").agg(F.round((2.0 * F.avg(p) + far) / 3.0, 6).alias("biased"))


@query("time_weighted_volume", f"SELECT series, day, (g - day) // {6 * HOUR} AS slot, CAST(sum(qty) AS BIGINT) AS volume FROM {_GRID_ROWS} GROUP BY ALL")
def time_weighted_volume(spark, d):
    got = _grid_rows(spark, d).withColumn("slot", F.floor((F.col("g") - F.col("day")) / (6 * HOUR)).cast("long"))
    return got.groupBy("series", "day", "slot").agg(F.sum("found.qty").alias("volume"))


@query("instance_weights", f"""SELECT d.series, d.day, s.step, CAST(1 + coalesce(sum(k.qty), 0) AS BIGINT) AS weight FROM {_DAYS} d CROSS JOIN (SELECT unnest(range(4)) AS step) s
LEFT JOIN {{ticks}} k ON k.series = d.series AND k.t >= d.day + s.step * {6 * HOUR} AND k.t < d.day + (s.step + 1) * {6 * HOUR} GROUP BY ALL""")
def instance_weights(spark, d):
    days = ticks(spark, d).select("series", (core.bucket("t", DAY) * DAY).alias("day")).distinct()
    steps = days.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))).withColumn("lo", F.col("day") + F.col("step") * 6 * HOUR).withColumn("hi", F.col("lo") + 6 * HOUR)
    inside = core.range_join(steps, ticks(spark, d).select("series", "t", "qty"), "series", "lo", "hi", "t", 6 * HOUR).groupBy("series", "day", "step").agg(F.sum("qty").alias("q"))
    return steps.join(inside, ["series", "day", "step"], "left").select("series", "day", "step", (F.lit(1) + F.coalesce("q", F.lit(0))).alias("weight"))


