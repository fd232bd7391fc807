"""Queries over scans, sources, projections, filters and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import scans
from tidemark.operators.core import DAY, MINUTE, SECOND, row_index

from .tables import main_series, query, read, ticks

MID = 1705276800000000  # 2024-01-15
SPAN = (1704672000000000, 1705276800000000)


@query("series_catalog", """SELECT series, first_t, last_t, n, resolution, lower(regexp_replace('q_u' || series || '_ticks_' || resolution, '[^A-Za-z0-9]', '_', 'g')) AS table_name FROM (
  SELECT series, min(t) AS first_t, max(t) AS last_t, count(*) AS n, CAST(CASE WHEN count(*) > 1 THEN floor((max(t) - min(t)) / (count(*) - 1) / 1000000) ELSE 0 END AS BIGINT) AS resolution FROM {ticks} GROUP BY series)""")
def series_catalog(spark, d):
    return scans.catalog(ticks(spark, d), "series", "t", F.concat(F.lit("u"), "series"), F.lit("ticks"))


@query("range_scan", f"SELECT series, t, price FROM {{ticks}} WHERE t BETWEEN {SPAN[0]} AND {SPAN[1]}")
def range_scan(spark, d):
    return scans.range_scan(ticks(spark, d, *SPAN).select("series", "t", "price"), "t", *SPAN)


@query("range_scan_limit", f"SELECT series, t, price FROM {{ticks}} WHERE t BETWEEN {SPAN[0]} AND {SPAN[1]} ORDER BY t LIMIT 50")
def range_scan_limit(spark, d):
    return scans.range_scan(ticks(spark, d, *SPAN).select("series", "t", "price"), "t", *SPAN, limit=50)


@query("latest_n", f"SELECT series, t, price FROM {{ticks}} WHERE t <= {MID} QUALIFY row_number() OVER (PARTITION BY series ORDER BY t DESC) <= 5")
def latest_n(spark, d):
    return scans.latest(ticks(spark, d, hi=MID).select("series", "t", "price"), "series", "t", 5, MID)


@query("nth_last_row", f"SELECT series, t, price FROM {{ticks}} WHERE t < {MID} QUALIFY row_number() OVER (PARTITION BY series ORDER BY t DESC) = 4")
def nth_last_row(spark, d):
    return scans.nth_last(ticks(spark, d, hi=MID).select("series", "t", "price"), "series", "t", 3, MID)


@query("count_before", f"SELECT series, count(*) FILTER (t < {MID}) AS n FROM {{ticks}} GROUP BY series")
def count_before(spark, d):
    return ticks(spark, d).groupBy("series").agg(F.count_if(F.col("t") < MID).alias("n"))


@query("edge_records", """SELECT series, arg_min(t, t) AS oldest_t, arg_min(price, t) AS oldest_price, arg_max(t, t) AS newest_t, arg_max(price, t) AS newest_price,
  arg_max(t, event_id) AS changed_t, arg_max(price, event_id) AS changed_price FROM {ticks} GROUP BY series""")
def edge_records(spark, d):
    got = scans.edges(ticks(spark, d), "series", "t", "event_id", ["price"])
    return got.select("series", *(F.col(f"{w}.{c}").alias(f"{w}_{c}") for w in ("oldest", "newest", "changed") for c in ("t", "price")))


@query("changed_since", f"SELECT event_id, series, t FROM {{ticks}} WHERE t > {MID} ORDER BY t DESC LIMIT 100")
def changed_since(spark, d):
    return ticks(spark, d, MID).filter(F.col("t") > MID).select("event_id", "series", "t").orderBy(F.desc("t")).limit(100)


@query("sorted_frames", """SELECT series, row_ix // 16 AS frame, min(t) AS first_t, max(t) AS last_t, count(*) AS n, count(*) = 16 AS "full" FROM (
  SELECT *, row_number() OVER (PARTITION BY series ORDER BY t) - 1 AS row_ix FROM {ticks}) GROUP BY ALL""")
def sorted_frames(spark, d):
    return scans.frames(ticks(spark, d), "series", "t", 16)


@query("row_index", "SELECT event_id, series, row_number() OVER (PARTITION BY series ORDER BY t) - 1 AS row_ix FROM {ticks}")
def row_index_query(spark, d):
    return row_index(ticks(spark, d), "series", "t").select("event_id", "series", "row_ix")


@query("column_extract", "SELECT series, t, qty AS value FROM {ticks}")
def column_extract(spark, d):
    return scans.column_of(ticks(spark, d), "qty", ["series", "t"])


@query("slice_with_lookback", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY t) - 1 AS row_ix FROM {{ticks}}),
s AS (SELECT series, max(row_ix) + 1 AS at_ix FROM r WHERE t < {SPAN[0]} GROUP BY series)
SELECT r.series, r.t, r.row_ix FROM r LEFT JOIN s USING (series) WHERE coalesce(at_ix, 0) >= 10 AND t < {SPAN[1]} AND row_ix >= coalesce(at_ix, 0) - 10""")
def slice_with_lookback(spark, d):
    return scans.slice_with_tail(ticks(spark, d), "series", "t", *SPAN, tail=10).select("series", "t", "row_ix")


@query("column_values_in_range", f"SELECT series, list(price ORDER BY t) AS vals FROM {{ticks}} WHERE t BETWEEN {MID} AND {MID} + 86400000000 GROUP BY series".replace("list(price ORDER BY t) AS vals", "string_agg(CAST(CAST(round(price * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY t) AS vals"))
def column_values_in_range(spark, d):
    day = ticks(spark, d, MID, MID + DAY)
    rows = F.array_sort(F.collect_list(F.struct("t", F.round(F.col("price") * 100).cast("long").cast("string").alias("v"))))
    return day.groupBy("series").agg(F.array_join(F.transform(rows, lambda r: r["v"]), ",").alias("vals"))


@query("trim_with_lag", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY t) - 1 AS row_ix FROM {{ticks}}),
s AS (SELECT series, count(*) FILTER (t < {SPAN[0]}) AS at_ix FROM r GROUP BY series) SELECT r.series, t, price FROM r JOIN s USING (series) WHERE row_ix >= at_ix - 5 AND t <= {SPAN[1]}""")
def trim_with_lag(spark, d):
    rows = row_index(ticks(spark, d), "series", "t")
    at = rows.groupBy("series").agg(F.count_if(F.col("t") < SPAN[0]).alias("at"))
    return rows.join(at, "series").filter((F.col("row_ix") >= F.col("at") - 5) & (F.col("t") <= SPAN[1])).select("series", "t", "price")


_SNAP = "CASE WHEN t % 60000000 <= 5000000 THEN t - t % 60000000 WHEN (t + 5000000) % 60000000 < 5000000 THEN t - t % 60000000 + 60000000 END"


@query("snap_to_grid", f"SELECT event_id, {_SNAP} AS slot FROM {{ticks}}")
def snap_to_grid(spark, d):
    return ticks(spark, d).select("event_id", scans.snapped(F.col("t"), MINUTE, 5 * SECOND).alias("slot"))


@query("grid_checked_append", f"SELECT series, slot, price FROM (SELECT *, {_SNAP} AS slot FROM {{ticks}}) WHERE slot IS NOT NULL QUALIFY row_number() OVER (PARTITION BY series, slot ORDER BY abs(t - slot), t) = 1")
def grid_checked_append(spark, d):
    return scans.appended_on_grid(ticks(spark, d), "series", "t", MINUTE, 5 * SECOND).select("series", "slot", "price")


@query("normality_predicate", """SELECT event_id, price IS NOT NULL AND isfinite(price) AND (price = 0 OR abs(price) >= 2.2250738585072014e-308) AS is_normal,
  abs(price) > 0.01 AS above_eps, abs(price) <= 0.01 AS is_zero, abs(price - qty) <= 1.0 AS equal_eps, price < qty - 1.0 AS less_eps, price BETWEEN 10 AND 20 AS contained FROM {ticks}""")
def normality_predicate(spark, d):
    p, q = F.col("price"), F.col("qty")
    return ticks(spark, d).select("event_id", scans.normal(p).alias("is_normal"), (F.abs(p) > 0.01).alias("above_eps"), (F.abs(p) <= 0.01).alias("is_zero"), (F.abs(p - q) <= 1.0).alias("equal_eps"), (p < q - 1.0).alias("less_eps"), p.between(10, 20).alias("contained"))


@query("request_sanity", "SELECT o_orderkey AS request_id FROM orders WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL AND o_totalprice > 0 AND len(string_split(o_orderpriority, '-')) > 1")
def request_sanity(spark, d):
    o = read(spark, d, "orders")
    ok = F.col("o_custkey").isNotNull() & F.col("o_orderdate").isNotNull() & (F.col("o_totalprice") > 0) & (F.size(F.split("o_orderpriority", "-")) > 1)
    return o.filter(ok).select(F.col("o_orderkey").alias("request_id"))


@query("response_validity", f"SELECT event_id, t, price FROM {{ticks}} WHERE t >= {SPAN[0]} AND t < {SPAN[1]} AND isfinite(price)")
def response_validity(spark, d):
    return ticks(spark, d).filter((F.col("t") >= SPAN[0]) & (F.col("t") < SPAN[1]) & scans.normal(F.col("price"))).select("event_id", "t", "price")


@query("session_filter", "SELECT event_id, t FROM {ticks} WHERE NOT ((t // 86400000000 + 3) % 7 >= 4 AND (t // 3600000000) % 24 >= 20)")
def session_filter(spark, d):
    return ticks(spark, d).filter(scans.outside_session(F.col("t"), 4, 20)).select("event_id", "t")


@query("interleave_sample", "SELECT event_id, row_ix FROM (SELECT event_id, row_number() OVER (PARTITION BY series ORDER BY t) - 1 AS row_ix FROM {ticks}) WHERE row_ix % 10 = 0")
def interleave_sample(spark, d):
    return row_index(ticks(spark, d), "series", "t").filter(F.pmod("row_ix", F.lit(10)) == 0).select("event_id", "row_ix")


@query("adjacent_levels", """WITH l AS (SELECT DISTINCT qty % 16 AS level FROM {ticks}), s AS (SELECT level, greatest(0, least(level - 4 // 2, 15 - 4)) AS lo FROM l)
SELECT CAST(level AS INTEGER) AS level, CAST(unnest(range(lo, lo + 5)) AS INTEGER) AS neighbour FROM s""")
def adjacent_levels(spark, d):
    levels = ticks(spark, d).select(F.pmod("qty", F.lit(16)).cast("int").alias("level")).distinct()
    return levels.select("level", F.explode(scans.adjacent_levels(16, 0.25, "level")).alias("neighbour"))


@query("stratified_subset", """WITH s AS (SELECT label, count(*) AS size FROM embeddings GROUP BY label), q AS (SELECT label, greatest(1, CAST(ceil(size * 100 / (SELECT sum(size) FROM s)) AS BIGINT)) AS quota FROM s)
SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY (vec_id * 7919 + 13) % 10007, vec_id) AS r FROM embeddings) JOIN q USING (label) WHERE r <= quota""")
def stratified_subset(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", "label")
    return scans.stratified(e, "label", 100, F.struct(F.pmod(F.col("vec_id") * 7919 + 13, F.lit(10007)), "vec_id")).select("vec_id", "label")


@query("format_check", """SELECT l_orderkey, l_linenumber, CASE WHEN NOT isfinite(l_extendedprice) THEN 'not finite' WHEN l_quantity <= 0 THEN 'bad index' WHEN l_discount > 0.09 THEN 'discount' END AS reason
FROM lineitem WHERE NOT isfinite(l_extendedprice) OR l_quantity <= 0 OR l_discount > 0.09""")
def format_check(spark, d):
    reason = F.when(~scans.normal(F.col("l_extendedprice")), "not finite").when(F.col("l_quantity") <= 0, "bad index").when(F.col("l_discount") > 0.09, "discount")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", reason.alias("reason")).filter("reason IS NOT NULL")


@query("main_series", "SELECT series, t, round(price, 4) AS price, n FROM {main}")
def main_series_query(spark, d):
    return main_series(spark, d).withColumn("price", F.round("price", 4))



