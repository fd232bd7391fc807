"""Queries over windows, sorts, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import core
from tidemark.operators import windows as win
from tidemark.operators.core import DAY, HOUR

from .stats import OHLC
from .tables import main_series, query, r6, read, ticks

R = "(SELECT event_id, series, t, price, qty, kind, row_number() OVER (PARTITION BY series ORDER BY t) - 1 AS row_ix, count(*) OVER (PARTITION BY series) AS n FROM {ticks})"


def rows(spark, d):
    return core.row_index(ticks(spark, d), "series", "t")


@query("gap_detection", "SELECT series, t, t - prev AS step FROM (SELECT series, t, price, lag(t) OVER (PARTITION BY series ORDER BY t) AS prev FROM {ticks}) WHERE t - prev > 28800000000 OR NOT isfinite(price)")
def gap_detection(spark, d):
    got = core.previous(ticks(spark, d), "series", "t", ["t"])
    return got.filter((F.col("t") - F.col("prev_t") > 8 * HOUR) | F.isnan("price")).select("series", "t", (F.col("t") - F.col("prev_t")).alias("step"))


@query("circular_moving_average", f"SELECT a.event_id, round(sum(b.price) / 5, 6) AS mean FROM {R} a CROSS JOIN (SELECT unnest(range(-2, 3)) AS j) JOIN {R} b ON a.series = b.series AND ((b.row_ix + j) % b.n + b.n) % b.n = a.row_ix GROUP BY a.event_id")
def circular_moving_average(spark, d):
    return win.circular_mean(rows(spark, d), "series", "price", 2).select("event_id", r6("mean", "mean"))


@query("trailing_moving_average", f"""WITH s AS (SELECT *, CASE WHEN row_ix >= 4 THEN sum(price) OVER (PARTITION BY series ORDER BY row_ix ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / 4 ELSE price END AS s FROM {R}),
m AS (SELECT series, (sum(price) - sum(s)) / count(*) AS dd FROM s GROUP BY series) SELECT event_id, round(s + dd, 6) AS smooth FROM s JOIN m USING (series)""")
def trailing_moving_average(spark, d):
    return win.norm_trailing(rows(spark, d), "series", "price", 4).select("event_id", r6("smooth", "smooth"))


@query("tapering_mask", f"SELECT event_id, round(price * 2.0 * pow(1 - row_ix / n, 1.5), 4) AS tapered FROM {R}")
def tapering_mask(spark, d):
    r = rows(spark, d)
    n = r.groupBy("series").agg((F.max("row_ix") + 1).alias("n"))
    return r.join(n, "series").select("event_id", F.round(F.col("price") * win.tapered(F.col("row_ix"), F.col("n"), 2.0, 1.5), 4).alias("tapered"))


@query("block_difference", f"WITH b AS (SELECT series, row_ix // 4 AS slot, sum(price) / 4 AS v FROM {R} GROUP BY ALL) SELECT series, slot, round(v - lag(v) OVER (PARTITION BY series ORDER BY slot), 6) AS diff FROM b")
def block_difference(spark, d):
    b = rows(spark, d).groupBy("series", F.floor(F.col("row_ix") / 4).cast("long").alias("slot")).agg((F.sum("price") / 4).alias("v"))
    return b.select("series", "slot", r6(F.col("v") - F.lag("v").over(Window.partitionBy("series").orderBy("slot")), "diff"))


@query("returns_and_inverses", "SELECT event_id, round(ln((abs(price) + 1) / (abs(prev) + 1)), 6) AS log_return, round(price - prev, 6) AS diff_return, round(price, 6) AS rebuilt FROM (SELECT *, lag(price) OVER (PARTITION BY series ORDER BY t) AS prev FROM {ticks}) WHERE prev IS NOT NULL")
def returns_and_inverses(spark, d):
    got = core.previous(ticks(spark, d), "series", "t", ["price"]).filter("prev_price IS NOT NULL")
    step = F.col("price") - F.col("prev_price")
    return got.select("event_id", r6(F.log((F.abs("price") + 1) / (F.abs("prev_price") + 1)), "log_return"), r6(step, "diff_return"), r6(F.col("prev_price") + step, "rebuilt"))


@query("circular_shift", f"SELECT a.event_id, b.price AS shifted FROM {R} a JOIN {R} b ON a.series = b.series AND ((a.row_ix - 3) % a.n + a.n) % a.n = b.row_ix")
def circular_shift(spark, d):
    return win.shifted(rows(spark, d), "series", "price", 3).select("event_id", "shifted")


@query("stretch_rows", f"SELECT a.event_id, b.price AS stretched FROM {R} a LEFT JOIN {R} b ON a.series = b.series AND CAST(floor(a.row_ix / 1.5) AS BIGINT) = b.row_ix")
def stretch_rows(spark, d):
    return win.stretched(rows(spark, d), "series", "price", 1.5).select("event_id", "stretched")


@query("sma_and_deviation", f"SELECT series, bar, round(avg((high + low + 2 * close) / 4) OVER w, 6) AS sma, round(stddev_pop((high + low + 2 * close) / 4) OVER w, 6) AS sdev FROM {OHLC} WINDOW w AS (PARTITION BY series ORDER BY bar ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def sma_and_deviation(spark, d):
    from tidemark.operators.bars import ohlc_bars

    b = core.row_index(ohlc_bars(ticks(spark, d), "series", "t", "price", HOUR).withColumn("p", (F.col("high") + F.col("low") + 2 * F.col("close")) / 4), "series", "bar")
    return win.moving(b, "series", "p", 5).select("series", "bar", r6("sma", "sma"), r6("sdev", "sdev"))


@query("overlapping_chunks", f"SELECT event_id, unnest(range(greatest(0, CAST(ceil((row_ix - 15) / 12) AS BIGINT)), row_ix // 12 + 1)) AS chunk FROM {R}")
def overlapping_chunks(spark, d):
    return win.chunked(rows(spark, d), "series", 16, 0.25).select("event_id", "chunk")


@query("lagged_self_similarity", f"SELECT a.series, b.row_ix - a.row_ix AS \"offset\", round(avg(CASE WHEN abs(a.price) + abs(b.price) = 0 THEN 0 ELSE abs(a.price - b.price) / (abs(a.price) + abs(b.price)) END), 6) AS distance FROM {R} a JOIN {R} b ON a.series = b.series AND b.row_ix - a.row_ix IN (1, 2, 3, 5, 8) GROUP BY ALL")
def lagged_self_similarity(spark, d):
    got = win.self_similarity(rows(spark, d), "series", "price", [1, 2, 3, 5, 8])
    return got.select("series", F.col("offset").cast("long").alias("offset"), r6("distance", "distance"))


@query("best_stretch", f"""WITH a AS (SELECT o AS "offset", s AS stretch FROM (VALUES (2), (4), (8)) x(o), (VALUES (1.0::DOUBLE), (0.75::DOUBLE), (0.5625::DOUBLE)) y(s)),
d AS (SELECT f.series, "offset", stretch, round(avg(CASE WHEN abs(f.price) + abs(g.price) = 0 THEN 0 ELSE abs(f.price - g.price) / (abs(f.price) + abs(g.price)) END), 9) AS d
FROM {R} f JOIN a ON f.row_ix < "offset" AND "offset" <= f.n JOIN {R} g ON g.series = f.series AND g.row_ix = f.n - "offset" + CAST(floor(f.row_ix * stretch) AS BIGINT) GROUP BY ALL)
SELECT series, "offset", round(arg_min(stretch, (d, -stretch)), 6) AS stretch, round(min(d), 6) AS distance FROM d GROUP BY series, "offset" """)
def best_stretch(spark, d):
    """The best stretch of a series' end over its beginning."""
    got = win.best_stretch(rows(spark, d), "series", "price", [2, 4, 8], 0.75, 0.5)
    return got.select("series", "offset", r6("stretch", "stretch"), r6("distance", "distance"))


@query("time_sort", "SELECT event_id, series, t FROM {ticks} ORDER BY series, t")
def time_sort(spark, d):
    return ticks(spark, d).select("event_id", "series", "t").orderBy("series", "t")


@query("best_feature_columns", "SELECT l_returnflag AS level, l_suppkey AS col, round(score, 4) AS score FROM (SELECT l_returnflag, l_suppkey, avg(l_extendedprice) AS score, row_number() OVER (PARTITION BY l_returnflag ORDER BY round(avg(l_extendedprice), 4), l_suppkey) AS r FROM lineitem GROUP BY 1, 2) WHERE r <= 5")
def best_feature_columns(spark, d):
    s = read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("level"), F.col("l_suppkey").alias("col")).agg(F.round(F.avg("l_extendedprice"), 4).alias("score"))
    return s.withColumn("r", F.row_number().over(Window.partitionBy("level").orderBy("score", "col"))).filter("r <= 5").drop("r")


_CHUNKS = "(SELECT l_returnflag AS model, l_suppkey AS chunk, round(sum(l_quantity * l_discount), 6) AS score FROM lineitem GROUP BY 1, 2)"


def _chunk_scores(spark, d):
    return read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("model"), F.col("l_suppkey").alias("chunk")).agg(r6(F.sum(F.col("l_quantity") * F.col("l_discount")), "score"))


@query("best_chunks", f"SELECT * FROM {_CHUNKS} QUALIFY row_number() OVER (PARTITION BY model ORDER BY score DESC, chunk) <= 3")
def best_chunks(spark, d):
    return _chunk_scores(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("model").orderBy(F.desc("score"), "chunk"))).filter("r <= 3").drop("r")


@query("scores_to_weights", f"WITH i AS (SELECT *, max(score) OVER w + min(score) OVER w - score AS i FROM {_CHUNKS} WINDOW w AS (PARTITION BY model)) SELECT model, chunk, round(i / avg(i) OVER (PARTITION BY model), 6) AS weight FROM i")
def scores_to_weights(spark, d):
    return win.weights_from_scores(_chunk_scores(spark, d), "model", "score").select("model", "chunk", r6("weight", "weight"))


@query("drop_worst_rows", f"""WITH s AS (SELECT a.series, a.row_ix, a.event_id, round(sum(abs(a.price - b.price)), 6) AS score FROM {R} a JOIN {R} b USING (series) GROUP BY ALL)
SELECT event_id, round(score, 3) AS score FROM s QUALIFY row_number() OVER (PARTITION BY series ORDER BY score DESC, row_ix) > 3""")
def drop_worst_rows(spark, d):
    return win.worst_rows(rows(spark, d), "series", "price", 3).select("event_id", F.round("score", 3).alias("score"))


@query("priority_order", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority DESC, o_totalprice DESC, o_orderkey) AS place FROM orders")
def priority_order(spark, d):
    """Every dataset with its place by user priority, then by its own; numbered range by range."""
    o = read(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice").withColumn("whole", F.lit(0))
    return core.in_order(o, "whole", [F.desc("o_orderpriority"), F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_orderkey", "place")


@query("arg_sort", "SELECT event_id, row_number() OVER (PARTITION BY series ORDER BY price, event_id) - 1 AS place FROM {ticks}")
def arg_sort(spark, d):
    got = core.in_order(ticks(spark, d).select("series", "price", "event_id"), "series", [F.col("price"), F.col("event_id")])
    return got.select("event_id", (F.col("place") - 1).alias("place"))


@query("snap_to_allowed", "SELECT event_id, CAST(CASE WHEN price >= 55 THEN 100.0 WHEN price >= 7.5 THEN 10.0 WHEN price >= 3 THEN 5.0 ELSE 1.0 END AS DOUBLE) AS snapped FROM {ticks}")
def snap_to_allowed(spark, d):
    return win.snapped_to(ticks(spark, d), "price", [1.0, 5.0, 10.0, 100.0]).select("event_id", "snapped")


_OLD, _NEW = "(SELECT event_id, series, t, price FROM {ticks} WHERE t < 1705881600000000)", "(SELECT event_id, series, t, price + 1 AS price FROM {ticks} WHERE t >= 1704672000000000 AND event_id % 3 = 0)"


def _old(spark, d):
    return ticks(spark, d).select("event_id", "series", "t", "price").filter("t < 1705881600000000")


def _new(spark, d):
    return ticks(spark, d).filter("t >= 1704672000000000 AND event_id % 3 = 0").select("event_id", "series", "t", (F.col("price") + 1).alias("price"))


@query("tail_overwrite", f"WITH f AS (SELECT series, min(t) AS f FROM {_NEW} GROUP BY series) SELECT event_id, series, t, price FROM (SELECT o.* FROM {_OLD} o LEFT JOIN f USING (series) WHERE f IS NULL OR t < f UNION ALL SELECT * FROM {_NEW})")
def tail_overwrite(spark, d):
    return core.overlay(_old(spark, d), _new(spark, d), "series", "t")


@query("overlap_merge_gap_guard", f"""WITH f AS (SELECT series, min(t) AS f FROM {_NEW} GROUP BY series), l AS (SELECT series, max(t) AS l FROM {_OLD} GROUP BY series)
SELECT series, f - l AS gap, f - l > {3 * DAY} AS refused FROM f JOIN l USING (series)""")
def overlap_merge_gap_guard(spark, d):
    """What the merge would open between old and new rows; series whose gap is over the limit are refused."""
    f, last = _new(spark, d).groupBy("series").agg(F.min("t").alias("f")), _old(spark, d).groupBy("series").agg(F.max("t").alias("l"))
    return f.join(last, "series").select("series", (F.col("f") - F.col("l")).alias("gap"), (F.col("f") - F.col("l") > 3 * DAY).alias("refused"))


@query("set_except", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 20 EXCEPT SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > 0.05")
def set_except(spark, d):
    li = read(spark, d, "lineitem")
    return li.filter("l_quantity > 20").select("l_orderkey", "l_linenumber").subtract(li.filter("l_discount > 0.05").select("l_orderkey", "l_linenumber"))


@query("set_intersect", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 20 INTERSECT SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > 0.05")
def set_intersect(spark, d):
    li = read(spark, d, "lineitem")
    return li.filter("l_quantity > 20").select("l_orderkey", "l_linenumber").intersect(li.filter("l_discount > 0.05").select("l_orderkey", "l_linenumber"))


@query("positions_of", f"SELECT a.event_id, b.row_ix FROM {R} a JOIN {R} b ON a.series = b.series AND a.price = b.price AND a.row_ix < b.row_ix")
def positions_of(spark, d):
    r = rows(spark, d)
    other = r.select("series", "price", F.col("row_ix").alias("other"))
    return r.join(other, ["series", "price"]).filter("row_ix < other").select("event_id", F.col("other").alias("row_ix"))


@query("keep_listed_indices", f"SELECT event_id, row_ix FROM {R} WHERE row_ix IN (SELECT DISTINCT qty FROM {{ticks}} WHERE qty % 5 = 0)")
def keep_listed_indices(spark, d):
    wanted = ticks(spark, d).filter("qty % 5 = 0").select(F.col("qty").alias("row_ix")).distinct()
    return rows(spark, d).join(wanted, "row_ix", "left_semi").select("event_id", "row_ix")


@query("factor_union", "SELECT l_partkey AS k, 0 AS origin FROM lineitem WHERE l_quantity > 49 GROUP BY 1 UNION ALL SELECT l_partkey, 1 FROM lineitem WHERE l_quantity < 2 AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) GROUP BY 1")
def factor_union(spark, d):
    li = read(spark, d, "lineitem")
    old = li.filter("l_quantity > 49").select(F.col("l_partkey").alias("k")).distinct().withColumn("origin", F.lit(0))
    new = li.filter("l_quantity < 2").select(F.col("l_partkey").alias("k")).distinct().withColumn("origin", F.lit(1))
    return old.unionByName(new.join(old, "k", "left_anti"))


@query("active_set_refresh", "SELECT o_custkey, 'removed' AS change FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1 HAVING o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01') UNION ALL SELECT o_custkey, 'added' FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1 HAVING o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01')")
def active_set_refresh(spark, d):
    o = read(spark, d, "orders")
    cut = F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")
    before, now = (o.filter(c).select("o_custkey").distinct() for c in (F.col("o_orderdate") < cut, F.col("o_orderdate") >= cut))
    return before.join(now, "o_custkey", "left_anti").withColumn("change", F.lit("removed")).unionByName(now.join(before, "o_custkey", "left_anti").withColumn("change", F.lit("added")))


@query("multi_column_returns", "SELECT series, t, round(price - lag(price) OVER (PARTITION BY series ORDER BY t), 4) AS step FROM {main}")
def multi_column_returns(spark, d):
    return core.previous(main_series(spark, d), "series", "t", ["price"], 365 * DAY).select("series", "t", F.round(F.col("price") - F.col("prev_price"), 4).alias("step"))
