"""Queries over statistics, scaling factors and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import core, stats
from tidemark.operators.core import DAY, HOUR

from .bars import _OHLC
from .tables import query, r6, read, ticks

OHLC = _OHLC.format(HOUR).replace("{{", "{").replace("}}", "}")

#: Forecasts: the price before as forecast and the one before that as last known value.
FORECASTS = "(SELECT * FROM (SELECT series, t, price AS actual, (lag(price) OVER w + lag(price, 2) OVER w) / 2 AS forecast, lag(price) OVER w AS known FROM {ticks} WINDOW w AS (PARTITION BY series ORDER BY t)) WHERE forecast IS NOT NULL)"


def forecasts(spark, d):
    rows = core.previous(ticks(spark, d), "series", "t", ["price"], 7 * DAY)
    rows = core.previous(rows, "series", "t", ["prev_price"], 7 * DAY)
    return rows.select("series", "t", F.col("price").alias("actual"), ((F.col("prev_price") + F.col("prev_prev_price")) / 2).alias("forecast"), F.col("prev_price").alias("known")).filter("forecast IS NOT NULL")


@query("basic_statistics", """SELECT series, round(avg(price), 6) AS mean, round(sum(price), 4) AS total, round(sum(abs(price)), 4) AS sum_abs, round(avg(abs(price)), 6) AS mean_abs, round(median(abs(price)), 6) AS median_abs,
  max(price) AS max, min(price) AS min, round(stddev_pop(price), 6) AS stddev, round(var_samp(price), 4) AS var, round(max(price) - min(price), 6) AS "range", count(price) AS n FROM {ticks} GROUP BY series""")
def basic_statistics(spark, d):
    digits = {"total": 4, "sum_abs": 4, "var": 4, "mean": 6, "mean_abs": 6, "median_abs": 6, "stddev": 6, "range": 6}
    got = stats.basic(ticks(spark, d), "series", "price")
    return got.select(*(F.round(c, digits[c]).alias(c) if c in digits else c for c in got.columns))


@query("deviation_score", "SELECT series, round(avg(abs(price)) * pow(stddev_pop(price), 0.1), 6) AS score FROM {ticks} GROUP BY series")
def deviation_score(spark, d):
    return ticks(spark, d).groupBy("series").agg(r6(stats.deviation_score(F.col("price")), "score"))


@query("quantile_band_means", """WITH r AS (SELECT series, price, count(*) OVER (PARTITION BY series) AS n, row_number() OVER (PARTITION BY series ORDER BY abs(price), price) AS r FROM {ticks}), k AS (SELECT *, greatest(floor(n * 0.2), 1) AS k FROM r)
SELECT series, round(avg(abs(price)) FILTER (r <= k), 6) AS low, round(avg(abs(price)) FILTER (r > k AND r <= n - k), 6) AS middle, round(avg(abs(price)) FILTER (r > n - k), 6) AS high FROM k GROUP BY series""")
def quantile_band_means(spark, d):
    got = stats.band_means(ticks(spark, d), "series", "price", 0.2)
    return got.select("series", *(r6(c, c) for c in ("low", "middle", "high")))


_LAST = "(SELECT * FROM {ticks} QUALIFY row_number() OVER (PARTITION BY series ORDER BY t DESC) <= 20)"


@query("input_scaling_factors", f"""WITH c AS (SELECT series, c.name AS column_name, CASE c.name WHEN 'price' THEN price ELSE qty END AS v FROM {_LAST}, (VALUES ('price'), ('qty')) c(name)), m AS (SELECT series, column_name, avg(v) AS dc FROM c GROUP BY ALL)
SELECT series, column_name, round(any_value(dc), 6) AS dc, round(CASE WHEN avg(abs(v - dc)) = 0 THEN 1 ELSE avg(abs(v - dc)) END, 6) AS sf FROM c JOIN m USING (series, column_name) GROUP BY ALL""")
def input_scaling_factors(spark, d):
    from tidemark.operators.scans import latest

    last = latest(ticks(spark, d), "series", "t", 20)
    narrow = last.unpivot(["series"], [F.col("price").cast("double").alias("price"), F.col("qty").cast("double").alias("qty")], "column_name", "v")
    return stats.scaling(narrow, ["series", "column_name"], "v").select("series", "column_name", r6("dc", "dc"), r6("sf", "sf"))


@query("level_scaling_factors", """WITH c AS (SELECT l_returnflag AS level, l_linenumber AS step, l_suppkey % 4 AS chunk, l_extendedprice AS v FROM lineitem), m AS (SELECT level, step, chunk, avg(v) AS dc FROM c GROUP BY ALL)
SELECT level, step, chunk, round(any_value(dc), 4) AS dc, round(CASE WHEN avg(abs(v - dc)) = 0 THEN 1 ELSE avg(abs(v - dc)) END, 4) AS sf FROM c JOIN m USING (level, step, chunk) GROUP BY ALL""")
def level_scaling_factors(spark, d):
    c = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("level"), F.col("l_linenumber").alias("step"), (F.col("l_suppkey") % 4).alias("chunk"), F.col("l_extendedprice").alias("v"))
    return stats.scaling(c, ["level", "step", "chunk"], "v").select("level", "step", "chunk", F.round("dc", 4).alias("dc"), F.round("sf", 4).alias("sf"))


@query("weight_scaling", """WITH m AS (SELECT l_linenumber, avg(l_quantity) AS dc FROM lineitem GROUP BY 1), s AS (SELECT l_linenumber, any_value(dc) AS dc, avg(abs(l_quantity - dc)) AS sf FROM lineitem JOIN m USING (l_linenumber) GROUP BY 1)
SELECT l_orderkey, l_linenumber, round((10 + (l_quantity - dc) / sf) / 11, 6) AS weight FROM lineitem JOIN s USING (l_linenumber)""")
def weight_scaling(spark, d):
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    got = stats.scaled(li, stats.scaling(li, ["l_linenumber"], "l_quantity"), ["l_linenumber"], "l_quantity")
    return got.select("l_orderkey", "l_linenumber", r6((10 + F.col("scaled")) / 11, "weight"))


@query("scale_unscale", """WITH m AS (SELECT series, avg(price) AS dc FROM {ticks} GROUP BY series), s AS (SELECT series, any_value(dc) AS dc, avg(abs(price - dc)) AS sf FROM {ticks} JOIN m USING (series) GROUP BY series)
SELECT event_id, round((price - dc) / CASE WHEN sf = 0 THEN 1 ELSE sf END, 6) AS scaled, round(price, 6) AS back FROM {ticks} JOIN s USING (series)""")
def scale_unscale(spark, d):
    t = ticks(spark, d)
    got = stats.scaled(t, stats.scaling(t, ["series"], "price"), ["series"], "price")
    return got.select("event_id", r6("scaled", "scaled"), r6(F.col("scaled") * F.col("sf") + F.col("dc"), "back"))


@query("latest_result_per_key", "SELECT o_custkey, o_orderpriority, max(o_orderkey) AS response_id, arg_max(round(o_totalprice, 4), o_orderkey) AS price FROM orders GROUP BY ALL")
def latest_result_per_key(spark, d):
    o = read(spark, d, "orders")
    newest = F.max_by(F.struct("o_orderkey", F.round("o_totalprice", 4).alias("price")), "o_orderkey").alias("r")
    return o.groupBy("o_custkey", "o_orderpriority").agg(newest).select("o_custkey", "o_orderpriority", F.col("r.o_orderkey").alias("response_id"), "r.price")


@query("distinct_active_rows", "SELECT DISTINCT l_orderkey AS row_id FROM (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT l_orderkey FROM lineitem WHERE l_quantity > 30)")
def distinct_active_rows(spark, d):
    li = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("row_id"), "l_linenumber", "l_quantity")
    return li.filter("l_linenumber = 1").select("row_id").union(li.filter("l_quantity > 30").select("row_id")).distinct()


@query("error_metrics", f"""SELECT series, round(avg(abs(forecast - actual)), 6) AS mae, round(100 * sum(abs(forecast - actual)) / sum(abs(actual)), 6) AS mape, round(100 * (sum(abs(known - actual)) / sum(abs(forecast - actual)) - 1), 6) AS alpha,
  round(100 * avg(CASE WHEN sign(forecast - known) = sign(actual - known) THEN 1.0 ELSE 0.0 END), 6) AS direction, round(100 * avg(CASE WHEN abs(forecast - actual) < abs(known - actual) THEN 1.0 ELSE 0.0 END), 6) AS better FROM {FORECASTS} GROUP BY series""")
def error_metrics(spark, d):
    got = forecasts(spark, d).groupBy("series").agg(*stats.errors(F.col("forecast"), F.col("actual"), F.col("known")))
    return got.select("series", *(r6(c, c) for c in got.columns[1:]))


@query("direction_by_weekday", f"""WITH f AS (SELECT (t // 86400000000 + 3) % 7 AS weekday, (t // 3600000000) % 24 AS hour, CASE WHEN sign(forecast - known) = sign(actual - known) THEN 1.0 ELSE 0.0 END AS hit FROM {FORECASTS}),
g AS (SELECT w.weekday, h.hour AS skip_hour, avg(hit) AS rate, count(hit) AS n FROM (SELECT unnest(range(7)) AS weekday) w CROSS JOIN (SELECT unnest(range(1, 24)) AS hour) h LEFT JOIN f ON f.weekday = w.weekday AND f.hour < h.hour GROUP BY ALL)
SELECT weekday, arg_max(skip_hour, (round(rate, 9), skip_hour)) AS skip_hour, round(max(rate), 6) AS rate FROM g WHERE n > 0 GROUP BY weekday""")
def direction_by_weekday(spark, d):
    """The hour from which on each weekday is best skipped: a grid of hours against hit rates by hour, summed."""
    f = forecasts(spark, d)
    hit = (F.signum(F.col("forecast") - F.col("known")) == F.signum(F.col("actual") - F.col("known"))).cast("long")
    hourly = f.groupBy(F.pmod(F.floor(F.col("t") / DAY) + 3, F.lit(7)).alias("weekday"), F.pmod(F.floor(F.col("t") / HOUR), F.lit(24)).alias("hour")).agg(F.sum(hit).alias("hits"), F.count("*").alias("n"))
    skips = hourly.withColumn("skip_hour", F.explode(F.sequence(F.greatest(F.col("hour") + 1, F.lit(1).cast("long")), F.greatest(F.col("hour") + 1, F.lit(23).cast("long"))))).filter("skip_hour <= 23")
    rates = skips.groupBy("weekday", "skip_hour").agg((F.sum("hits") / F.sum("n")).alias("rate"))
    return rates.groupBy("weekday").agg(F.max_by("skip_hour", F.struct(F.round("rate", 9), "skip_hour")).alias("skip_hour"), r6(F.max("rate"), "rate"))


@query("envelope_error", f"""WITH f AS (SELECT series, t // {DAY} * {DAY} AS day, avg(forecast) AS f, avg(known) AS k FROM {FORECASTS} GROUP BY ALL), e AS (SELECT series, t // {DAY} * {DAY} AS day, min(price) AS low, max(price) AS high, count(*) AS n FROM {{ticks}} GROUP BY ALL)
SELECT series, day, round(greatest(low - f, f - high, 0), 6) AS error, round(greatest(low - k, k - high, 0), 6) AS known_error FROM f JOIN e USING (series, day) WHERE n >= 5""")
def envelope_error(spark, d):
    """Distance of a day's forecast from the range of the fine rows inside the day; at least five of them."""
    f = forecasts(spark, d).groupBy("series", (core.bucket("t", DAY) * DAY).alias("day")).agg(F.avg("forecast").alias("f"), F.avg("known").alias("k")).withColumn("hi", F.col("day") + DAY)
    fine = core.range_join(f, ticks(spark, d).select("series", "t", "price"), "series", "day", "hi", "t", DAY).groupBy("series", "day", "f", "k").agg(F.min("price").alias("low"), F.max("price").alias("high"), F.count("*").alias("n")).filter("n >= 5")
    away = lambda c: F.greatest(F.col("low") - F.col(c), F.col(c) - F.col("high"), F.lit(0.0))
    return fine.select("series", "day", r6(away("f"), "error"), r6(away("k"), "known_error"))


@query("hit_rate_report", f"SELECT t // (7 * {DAY}) AS week, round(avg(CASE WHEN abs(forecast - actual) < 5 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(abs(forecast - actual)), 6) AS mean_error FROM {FORECASTS} GROUP BY 1")
def hit_rate_report(spark, d):
    e = F.abs(F.col("forecast") - F.col("actual"))
    return forecasts(spark, d).groupBy(core.bucket("t", 7 * DAY).alias("week")).agg(r6(F.avg((e < 5).cast("double")), "hit_rate"), r6(F.avg(e), "mean_error"))


@query("average_range", f"SELECT series, round(avg(greatest(high - low, 0)), 6) AS avg_range FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY bar) AS r FROM {OHLC}) WHERE r > 1 GROUP BY series")
def average_range(spark, d):
    from tidemark.operators.bars import ohlc_bars

    rows = core.row_index(ohlc_bars(ticks(spark, d), "series", "t", "price", HOUR), "series", "bar")
    return rows.filter("row_ix > 0").groupBy("series").agg(r6(F.avg(F.greatest(F.col("high") - F.col("low"), F.lit(0.0))), "avg_range"))


_TRADES = f"""(SELECT f.series, f.t, sign(f.forecast - f.known) AS side, f.known AS entry, arg_max(k.price, k.t) AS exit_price, min(k.price) AS low, max(k.price) AS high
  FROM {FORECASTS} f JOIN {{ticks}} k ON k.series = f.series AND k.t >= f.t AND k.t < f.t + {DAY} GROUP BY ALL)"""


@query("trade_outcome_summary", f"SELECT series, count(*) AS trades, count(*) FILTER (side * (exit_price - entry) > 0) AS won, round(sum(side * (exit_price - entry)), 4) AS gain, round(max(CASE WHEN side >= 0 THEN entry - low ELSE high - entry END), 6) AS drawdown FROM {_TRADES} GROUP BY series")
def trade_outcome_summary(spark, d):
    return trades(spark, d).groupBy("series").agg(F.count("*").alias("trades"), F.count_if(F.col("gain") > 0).alias("won"), F.round(F.sum("gain"), 4).alias("gain"), r6(F.max("down"), "drawdown"))


def trades(spark, d):
    """A trade for each forecast: in at the last known price, out a day later, with the worst price on the way."""
    f = forecasts(spark, d).withColumn("until", F.col("t") + DAY).withColumnRenamed("t", "at")
    fine = core.range_join(f, ticks(spark, d).select("series", "t", "price"), "series", "at", "until", "t", DAY)
    got = fine.groupBy("series", "at", "forecast", "known").agg(F.max_by("price", "t").alias("out"), F.min("price").alias("low"), F.max("price").alias("high"))
    side = F.signum(F.col("forecast") - F.col("known"))
    return got.select("series", "at", (side * (F.col("out") - F.col("known"))).alias("gain"), F.when(side >= 0, F.col("known") - F.col("low")).otherwise(F.col("high") - F.col("known")).alias("down"))


@query("running_drawdown", f"""SELECT series, t AS at, round(sum(gain) OVER w, 4) AS net, round(max(down) OVER w, 6) AS drawdown, CASE WHEN max(down) OVER w > 1e-6 THEN round(sum(gain) OVER w / max(down) OVER w, 4) END AS leverage FROM (SELECT series, t, side * (exit_price - entry) AS gain, CASE WHEN side >= 0 THEN entry - low ELSE high - entry END AS down FROM {_TRADES})
WINDOW w AS (PARTITION BY series ORDER BY t ROWS UNBOUNDED PRECEDING)""")
def running_drawdown(spark, d):
    """Net gain, worst draw-down so far, and the leverage they allow (net gain over draw-down)."""
    run = core.running(trades(spark, d), "series", "at", {"net": F.col("gain")}, {"drawdown": F.col("down")}, 7 * DAY)
    return run.select("series", "at", F.round("net", 4).alias("net"), r6("drawdown", "drawdown"), F.when(F.col("drawdown") > 1e-6, F.round(F.col("net") / F.col("drawdown"), 4)).alias("leverage"))


@query("regression_metrics", f"SELECT series, round(avg((forecast - actual) ** 2), 4) AS mse, round(pow(corr(forecast, actual), 2), 6) AS r2 FROM {FORECASTS} GROUP BY series HAVING count(*) > 2")
def regression_metrics(spark, d):
    got = forecasts(spark, d).groupBy("series").agg(*stats.fit_quality(F.col("forecast"), F.col("actual")), F.count("*").alias("n")).filter("n > 2")
    return got.select("series", F.round("mse", 4).alias("mse"), r6("r2", "r2"))


@query("laplace_residual_scale", f"""WITH r AS (SELECT series, forecast - actual AS e FROM {FORECASTS}), m AS (SELECT series, avg(abs(e)) AS mae FROM r GROUP BY series)
SELECT series, round(avg(abs(e)), 6) AS scale, count(*) AS n FROM r JOIN m USING (series) WHERE abs(e) <= 5 * sqrt(2) * mae GROUP BY series""")
def laplace_residual_scale(spark, d):
    e = forecasts(spark, d).select("series", (F.col("forecast") - F.col("actual")).alias("e"))
    return stats.laplace_scale(e, "series", "e").select("series", r6("scale", "scale"), "n")


@query("entropy_costs", """WITH t AS (SELECT series, sum(abs(price)) AS total FROM {ticks} GROUP BY series) SELECT series, round(sum(CASE WHEN price <> 0 THEN -abs(price) / total * log2(abs(price) / total) ELSE 0 END), 6) AS spectral,
  round(sum(CASE WHEN price <> 0 THEN -price * price * ln(price * price) ELSE 0 END), 2) AS shannon, count(*) FILTER (abs(price) > 10) AS above, round(sum(pow(abs(price), 1.5)), 4) AS norm, round(sum(CASE WHEN price <> 0 THEN ln(price * price) ELSE 0 END), 4) AS log_energy
FROM {ticks} JOIN t USING (series) GROUP BY series""")
def entropy_costs(spark, d):
    got = stats.entropies(ticks(spark, d), ["series"], "price", 10.0, 1.5)
    return got.select("series", r6("spectral", "spectral"), F.round("shannon", 2).alias("shannon"), "above", F.round("norm", 4).alias("norm"), F.round("log_energy", 4).alias("log_energy"))


@query("relative_component_power", """WITH c AS (SELECT series, kind, avg(abs(price)) AS m FROM {ticks} GROUP BY ALL), w AS (SELECT series, avg(abs(price)) AS a FROM {ticks} GROUP BY series)
SELECT series, kind, round(abs(a / m - 3 + 1), 6) AS rel_pow FROM c JOIN w USING (series)""")
def relative_component_power(spark, d):
    t = ticks(spark, d)
    whole = t.groupBy("series").agg(F.avg(F.abs("price")).alias("a"))
    part = t.groupBy("series", "kind").agg(F.avg(F.abs("price")).alias("m"))
    return part.join(whole, "series").select("series", "kind", r6(F.abs(F.col("a") / F.col("m") - 3 + 1), "rel_pow"))


@query("best_parameters_per_group", "SELECT l_shipmode, l_partkey FROM (SELECT l_returnflag AS l_shipmode, arg_min(l_partkey, (l_extendedprice, l_orderkey, l_linenumber)) AS l_partkey FROM lineitem GROUP BY 1)")
def best_parameters_per_group(spark, d):
    li = read(spark, d, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("l_shipmode")).agg(F.min_by("l_partkey", F.struct("l_extendedprice", "l_orderkey", "l_linenumber")).alias("l_partkey"))


@query("running_evaluation", f"""SELECT series, t, round(avg(abs(forecast - actual)) OVER w + 1e-9, 4) AS mae, round(100 * sum(abs(forecast - actual)) OVER w / sum(abs(actual)) OVER w + 1e-9, 4) AS mape,
  round(100 * (sum(abs(known - actual)) OVER w / nullif(sum(abs(forecast - actual)) OVER w, 0) - 1) + 1e-9, 4) AS alpha,
  round(100 * avg(CASE WHEN sign(forecast - known) = sign(actual - known) THEN 1.0 ELSE 0.0 END) OVER w, 4) AS direction FROM {FORECASTS} WINDOW w AS (PARTITION BY series ORDER BY t ROWS UNBOUNDED PRECEDING)""")
def running_evaluation(spark, d):
    e, f = F.abs(F.col("forecast") - F.col("actual")), forecasts(spark, d)
    hit = (F.signum(F.col("forecast") - F.col("known")) == F.signum(F.col("actual") - F.col("known"))).cast("double")
    last = F.abs(F.col("known") - F.col("actual"))
    run = core.running(f, "series", "t", {"e": e, "a": F.abs("actual"), "last": last, "hits": hit, "n": F.lit(1)}, width=7 * DAY)
    # as long as all prices are zero: infinite, or no number where there is no error either
    mape = F.when(F.col("a") != 0, 100 * F.col("e") / F.col("a")).when(F.col("a") == 0, F.when(F.col("e") > 0, F.lit(float("inf"))).otherwise(F.lit(float("nan"))))
    alpha = F.round(100 * (F.col("last") / F.when(F.col("e") != 0, F.col("e")) - 1) + 1e-9, 4).alias("alpha")
    return run.select("series", "t", F.round(F.col("e") / F.col("n") + 1e-9, 4).alias("mae"), F.round(mape + 1e-9, 4).alias("mape"), alpha, F.round(100 * F.col("hits") / F.col("n"), 4).alias("direction"))

