"""Queries over joins of series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import core, joins
from tidemark.operators.core import DAY, HOUR, MINUTE, SECOND

from .tables import main_series, query, read, ticks

KINDS = ["click", "view", "purchase", "signup", "error"]
#: Probes: the start of every hour in which a series has a tick, half an hour on.
PROBES = "(SELECT DISTINCT series, t // 3600000000 * 3600000000 + 1800000000 AS probe FROM {ticks})"


def probes(spark, d):
    return ticks(spark, d).select("series", (core.bucket("t", HOUR) * HOUR + HOUR // 2).alias("probe")).distinct()


def _sides(op: str, agg: str) -> str:
    return f"SELECT p.series, p.probe, {agg}(k.t) AS found_t, arg_{agg}(k.price, k.t) AS found_price FROM {PROBES} p LEFT JOIN {{ticks}} k ON k.series = p.series AND k.t {op} p.probe GROUP BY ALL"


def _found(df):
    return df.select("series", "probe", F.col("found.t").alias("found_t"), F.col("found.price").alias("found_price"))


@query("exact_time_lookup", "SELECT m.series, m.t, round(m.price, 4) AS price FROM {main} m JOIN (SELECT DISTINCT epoch_us(l_shipdate) AS t FROM lineitem) l USING (t)")
def exact_time_lookup(spark, d):
    times = read(spark, d, "lineitem").select(core.micros("l_shipdate").alias("t")).distinct()
    return main_series(spark, d).join(times, "t").select("series", "t", F.round("price", 4).alias("price"))


@query("asof_at_or_before", _sides("<=", "max"))
def asof_at_or_before(spark, d):
    return _found(core.asof(probes(spark, d), ticks(spark, d), "series", "probe", "t", ["price"]))


@query("asof_strictly_before", _sides("<", "max"))
def asof_strictly_before(spark, d):
    return _found(core.asof(probes(spark, d), ticks(spark, d), "series", "probe", "t", ["price"], equal=False))


@query("asof_after", _sides(">=", "min"))
def asof_after(spark, d):
    return _found(core.asof(probes(spark, d), ticks(spark, d), "series", "probe", "t", ["price"], "after"))


@query("upper_bound", f"""SELECT p.series, p.probe, min(k.row_ix) AS row_ix FROM {PROBES} p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY series ORDER BY t) - 1 AS row_ix FROM {{ticks}}) k
  ON k.series = p.series AND k.t > p.probe GROUP BY ALL""")
def upper_bound(spark, d):
    rows = core.row_index(ticks(spark, d), "series", "t")
    return core.asof(probes(spark, d), rows, "series", "probe", "t", ["row_ix"], "after", equal=False).select("series", "probe", F.col("found.row_ix").alias("row_ix"))


@query("lower_bound", f"""SELECT p.series, p.probe, min(k.row_ix) AS row_ix FROM {PROBES} p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY series ORDER BY t) - 1 AS row_ix FROM {{ticks}}) k
  ON k.series = p.series AND k.t >= p.probe GROUP BY ALL""")
def lower_bound(spark, d):
    rows = core.row_index(ticks(spark, d), "series", "t")
    return core.asof(probes(spark, d), rows, "series", "probe", "t", ["row_ix"], "after").select("series", "probe", F.col("found.row_ix").alias("row_ix"))


_NEAREST = f"SELECT p.series, p.probe, k.t AS found_t, k.price AS found_price FROM {PROBES} p JOIN {{ticks}} k ON k.series = p.series {{where}} QUALIFY row_number() OVER (PARTITION BY p.series, p.probe ORDER BY abs(k.t - p.probe), k.t DESC) = 1"


@query("nearest_asof", _NEAREST.replace("{where}", ""))
def nearest_asof(spark, d):
    return _found(core.nearest(probes(spark, d), ticks(spark, d), "series", "probe", "t", ["price"]))


@query("nearest_within_deviation", _NEAREST.replace("{where}", "AND abs(k.t - p.probe) <= 600000000"))
def nearest_within_deviation(spark, d):
    return _found(joins.within_deviation(probes(spark, d), ticks(spark, d), "series", "probe", "t", ["price"], 10 * MINUTE)).filter("found_t IS NOT NULL")


@query("lag_availability", f"""SELECT series, probe, row_ix, CASE WHEN row_ix IS NULL THEN 'no row' WHEN probe - found_t > 86400000000 THEN 'gap' WHEN row_ix < 5 THEN 'lag' END AS reason FROM (
  SELECT p.series, p.probe, max(k.row_ix) AS row_ix, max(k.t) AS found_t FROM {PROBES} p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY series ORDER BY t) - 1 AS row_ix FROM {{ticks}}) k ON k.series = p.series AND k.t <= p.probe GROUP BY ALL)""")
def lag_availability(spark, d):
    return joins.available_lags(probes(spark, d), ticks(spark, d), "series", "probe", "t", 5, DAY).select("series", "probe", "row_ix", "reason")


@query("range_interval_join", f"SELECT p.series, p.probe, k.event_id FROM {PROBES} p JOIN {{ticks}} k ON k.series = p.series AND k.t >= p.probe AND k.t < p.probe + 7200000000")
def range_interval_join(spark, d):
    spans = probes(spark, d).withColumn("hi", F.col("probe") + 2 * HOUR)
    return core.range_join(spans, ticks(spark, d), "series", "probe", "hi", "t", 4 * HOUR).select("series", "probe", "event_id")


@query("main_auxiliary_alignment", f"""SELECT p.series, p.probe, {', '.join(f"max(k.t) FILTER (k.kind = '{x}') AS t_{x}" for x in ('click', 'view', 'purchase'))} FROM {PROBES} p LEFT JOIN {{ticks}} k ON k.series = p.series AND k.t < p.probe GROUP BY ALL""")
def main_auxiliary_alignment(spark, d):
    """Each label time beside the last row before it in every auxiliary series: one narrow as-of join, then a pivot."""
    kinds = ["click", "view", "purchase"]
    aux = ticks(spark, d).filter(F.col("kind").isin(kinds)).select(F.struct("series", "kind").alias("k"), "t")
    label = probes(spark, d).withColumn("kind", F.explode(F.array(*map(F.lit, kinds)))).select(F.struct("series", "kind").alias("k"), "probe")
    got = core.asof(label, aux, "k", "probe", "t", [], "before", equal=False)
    return got.groupBy(F.col("k.series").alias("series"), "probe").agg(*(F.max(F.when(F.col("k.kind") == x, F.col("found.t"))).alias(f"t_{x}") for x in kinds))


@query("interval_offset_join", "SELECT a.series, a.t, a.price, b.price AS earlier FROM {main} a JOIN {main} b ON a.series = b.series AND b.t = a.t - 86400000000 * 7".replace("a.price, b.price AS earlier", "round(a.price, 4) AS price, round(b.price, 4) AS earlier"))
def interval_offset_join(spark, d):
    m = main_series(spark, d)
    earlier = m.select("series", (F.col("t") + 7 * DAY).alias("t"), F.round("price", 4).alias("earlier"))
    return m.join(earlier, ["series", "t"]).select("series", "t", F.round("price", 4).alias("price"), "earlier")


@query("semi_join_in", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def semi_join_in(spark, d):
    big = read(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, d, "orders").join(big, "o_orderkey", "left_semi").select("o_orderkey")


_HOURS = "(SELECT DISTINCT series, t // 3600000000 * 3600000000 AS t FROM {ticks})"


def hours(spark, d):
    return ticks(spark, d).select("series", (core.bucket("t", HOUR) * HOUR).alias("t")).distinct()


@query("missing_grid_times", f"""WITH h AS {_HOURS}, e AS (SELECT series, min(t) AS lo, max(t) AS hi FROM h GROUP BY series), g AS (SELECT series, unnest(range(lo, hi + 1, 3600000000)) AS t FROM e)
SELECT series, t FROM g WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.series = g.series AND h.t = g.t)""")
def missing_grid_times(spark, d):
    return joins.missing_grid(hours(spark, d), "series", "t", HOUR)


_GAPS = f"(SELECT series, prev + 3600000000 AS gap_start, t AS gap_end FROM (SELECT *, lag(t) OVER (PARTITION BY series ORDER BY t) AS prev FROM {_HOURS}) WHERE t - prev > 3600000000)"


@query("gap_intervals", f"SELECT * FROM {_GAPS}")
def gap_intervals(spark, d):
    return core.gaps(hours(spark, d), "series", "t", HOUR)


@query("latest_missing_interval", f"SELECT series, max(gap_start) AS gap_start, arg_max(gap_end, gap_start) AS gap_end FROM {_GAPS} GROUP BY series")
def latest_missing_interval(spark, d):
    return joins.latest_gap(hours(spark, d), "series", "t", HOUR)


@query("next_needed_range", """WITH o AS (SELECT series, min(t) + 864000000000 AS lo, max(t) + event_shift AS hi FROM (SELECT *, (series % 3 - 1) * 86400000000 AS event_shift FROM {ticks}) GROUP BY series, event_shift),
n AS (SELECT series, max(t) AS newest FROM {ticks} GROUP BY series) SELECT series, greatest(lo, newest) AS lo, hi FROM o JOIN n USING (series) WHERE greatest(lo, newest) < hi""")
def next_needed_range(spark, d):
    t = ticks(spark, d)
    offers = t.groupBy("series").agg((F.min("t") + 10 * DAY).alias("lo"), (F.max("t") + (F.col("series") % 3 - 1) * DAY).alias("hi"))
    return joins.needed_ranges(offers, t, "series", "t").select("series", "lo", "hi")


@query("completeness_check", """SELECT DISTINCT series, kind FROM (SELECT DISTINCT series FROM {ticks}) CROSS JOIN (SELECT unnest(['click', 'view', 'purchase', 'signup', 'error']) AS kind) EXCEPT SELECT series, kind FROM {ticks} WHERE price > 5""")
def completeness_check(spark, d):
    t = ticks(spark, d)
    declared = t.select("series").distinct().withColumn("kind", F.explode(F.array(*map(F.lit, KINDS))))
    return joins.incomplete(declared, t.filter("price > 5").select("series", "kind").distinct(), ["series", "kind"])


@query("reconciled_intervals", """WITH i AS (SELECT series, probe AS lo, probe + 7200000000 AS hi FROM (SELECT DISTINCT series, t // 3600000000 * 3600000000 AS probe FROM {ticks})),
s AS (SELECT *, max(hi) OVER (PARTITION BY series ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM i), g AS (SELECT *, sum(CASE WHEN seen IS NULL OR lo > seen THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY lo, hi) AS island FROM s)
SELECT series, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY series, island""")
def reconciled_intervals(spark, d):
    spans = hours(spark, d).select("series", F.col("t").alias("lo"), (F.col("t") + 2 * HOUR).alias("hi"))
    return joins.merged_intervals(spans, "series", "lo", "hi")


_BOOK = f"""WITH e AS (SELECT series, min(t) AS since, max(t) AS until FROM {{ticks}} GROUP BY series), s0 AS (SELECT *, CASE WHEN series % 3 > 0 THEN until - {10 * DAY} ELSE until END AS lo0, CASE WHEN series % 3 > 0 THEN until - {5 * DAY} ELSE until END AS hi0 FROM e),
s1 AS (SELECT *, CASE WHEN since < lo0 THEN greatest(lo0 - {7 * DAY}, since) ELSE lo0 END AS lo1, CASE WHEN until >= hi0 + {10 * SECOND} THEN until ELSE hi0 END AS hi1 FROM s0)
SELECT series, CASE WHEN since < lo1 THEN greatest(lo1 - {7 * DAY}, since) ELSE lo1 END AS lo, hi1 AS hi, CASE WHEN since < lo1 THEN greatest(lo1 - {7 * DAY}, since) END AS back_lo, CASE WHEN since < lo1 THEN lo1 END AS back_hi FROM s1 WHERE until + {14 * DAY} >= (SELECT max(until) FROM e)"""


@query("reconciled_steps", _BOOK)
def reconciled_steps(spark, d):
    """Two steps of the book, seven days back each; series that have not been asked for within two weeks of the newest row are purged."""
    asked = ticks(spark, d).groupBy("series").agg(F.min("t").alias("since"), F.max("t").alias("until"))
    covered = asked.filter("series % 3 > 0").select("series", (F.col("until") - 10 * DAY).alias("lo"), (F.col("until") - 5 * DAY).alias("hi"))
    for _ in range(2):
        book = joins.reconciled(covered, asked, "series", 7 * DAY)
        covered = book.select("series", "lo", "hi")
    now = asked.agg(F.max("until").alias("now")).first()["now"]
    dated = book.join(asked.select("series", "until"), "series")
    return joins.retained(dated, "until", 14 * DAY, F.lit(now)).select("series", "lo", "hi", "back_lo", "back_hi")


@query("metadata_joins", "SELECT c_custkey, n_name, r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def metadata_joins(spark, d):
    c, n, r, o = (read(spark, d, t) for t in ("customer", "nation", "region", "orders"))
    named = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return o.groupBy("o_custkey").agg(F.count("*").alias("n")).join(named, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "n_name", "r_name", "n")


_PERIODS = [(f"summer {y}", int(f"{(y - 1970) * 31556952000000 + 7689600000000}"), int(f"{(y - 1970) * 31556952000000 + 25920000000000}")) for y in range(1992, 2003)]


@query("period_theta_join", f"SELECT series, t, name AS period FROM {{main}} LEFT JOIN (VALUES {', '.join(f'({n!r}, {a}, {b})' for n, a, b in _PERIODS)}) p(name, lo, hi) ON t > lo AND t < hi")
def period_theta_join(spark, d):
    return joins.in_period(main_series(spark, d).select("series", "t"), "t", spark.createDataFrame(_PERIODS, "name string, lo long, hi long"))


@query("time_merge_pivot", "SELECT series, t // 86400000000 AS day, round(avg(price) FILTER (kind = 'click'), 6) AS click, round(avg(price) FILTER (kind = 'view'), 6) AS view, round(avg(price) FILTER (kind = 'purchase'), 6) AS purchase FROM {ticks} GROUP BY ALL")
def time_merge_pivot(spark, d):
    got = ticks(spark, d).groupBy("series", core.bucket("t", DAY).alias("day")).pivot("kind", ["click", "view", "purchase"]).agg(F.avg("price"))
    return got.select("series", "day", *(F.round(k, 6).alias(k) for k in ("click", "view", "purchase")))


@query("forecast_actual_join", """WITH m AS (SELECT *, lag(price) OVER (PARTITION BY series ORDER BY t) AS forecast FROM {main})
SELECT series, count(*) AS n, round(avg(abs(forecast - price)), 4) AS mae FROM m WHERE forecast IS NOT NULL GROUP BY series""")
def forecast_actual_join(spark, d):
    m = main_series(spark, d)
    f = core.previous(m, "series", "t", ["price"], 365 * DAY).select("series", "t", F.col("prev_price").alias("forecast")).filter("forecast IS NOT NULL")
    return f.join(m, ["series", "t"]).groupBy("series").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("forecast") - F.col("price"))), 4).alias("mae"))


@query("wildcard_parameter_slice", "SELECT p_partkey, p_size FROM part WHERE (p_size IS NULL OR p_size = 15 OR p_size % 10 = 0) ORDER BY 1".replace("p_size IS NULL OR p_size = 15 OR p_size % 10 = 0", "CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_size END IS NULL OR p_size = 15"))
def wildcard_parameter_slice(spark, d):
    p = read(spark, d, "part").select("p_partkey", "p_size", F.when(F.col("p_size") % 10 != 0, F.col("p_size")).alias("level"))
    return p.filter(joins.wildcard("level", 15)).select("p_partkey", "p_size")


_FACTORS = "SELECT l_suppkey AS k, CASE WHEN l_suppkey % 3 > 0 THEN round(avg(l_discount), 6) END AS f FROM lineitem WHERE l_linenumber {0} GROUP BY l_suppkey"


@query("factor_merge", f"SELECT k, coalesce(a.f, b.f) AS f FROM ({_FACTORS.format('<= 2')}) a FULL JOIN ({_FACTORS.format('> 4')}) b USING (k)")
def factor_merge(spark, d):
    li = read(spark, d, "lineitem")

    def factors(part):
        return part.groupBy(F.col("l_suppkey").alias("k")).agg(F.round(F.avg("l_discount"), 6).alias("f")).withColumn("f", F.when(F.col("k") % 3 > 0, F.col("f")))

    return joins.merged_factors(factors(li.filter("l_linenumber <= 2")), factors(li.filter("l_linenumber > 4")), ["k"], ["f"])


@query("pairwise_sample", """WITH r AS (SELECT series, t, price, row_number() OVER (PARTITION BY series ORDER BY t) - 1 AS ix, count(*) OVER (PARTITION BY series) AS n FROM {main})
SELECT a.series, a.ix AS i, b.ix AS j, a.t AS t_i, b.t AS t_j, round(a.price - b.price, 4) AS label FROM r a JOIN r b USING (series) WHERE (a.ix * a.n + b.ix) % 7 = 0""")
def pairwise_sample(spark, d):
    rows = core.row_index(main_series(spark, d), "series", "t", 365 * DAY)
    got = joins.kept_pairs(rows, "series", 7, ["t", "price"])
    return got.select("series", "i", "j", "t_i", "t_j", F.round(F.col("price_i") - F.col("price_j"), 4).alias("label"))
