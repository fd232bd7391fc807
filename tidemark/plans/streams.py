"""Queries over sources, sinks and streams. Streams run over all that is there, then the result is read as a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import core
from tidemark.operators.core import DAY, HOUR, micros
from tidemark.shared import shared_path
from tidemark.sources import files, messages, requests, store
from tidemark.streaming import jobs

from .tables import TICKS, main_series, query, r6, read, ticks


def folder(spark, name: str) -> str:
    return shared_path(spark, name)


def streamed(spark, d, name: str, build, mode: str = "append"):
    """What build(stream) gives of the events, fed in ranges of time, as a table."""
    to = folder(spark, name)
    out = []
    jobs.replay(spark, f"{d}/events.parquet", to, lambda ticks: out.append(jobs.run_once(build(ticks), to, mode)))
    return out[-1]


CUT = 1705276800000000


@query("bulk_append_sink", f"SELECT event_id, series, t, price, t // {DAY} AS day FROM {{ticks}} WHERE t >= {CUT}")
def bulk_append_sink(spark, d):
    to = folder(spark, "append")
    files.append_from(ticks(spark, d).select("event_id", "series", "t", "price"), to, "t", CUT)
    return spark.read.parquet(to).withColumn("day", F.col("day").cast("long"))


@query("key_replace_sink", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS state FROM orders")
def key_replace_sink(spark, d):
    """Saves all keys, then every third one again with another state, and reads the table back."""
    to, o = folder(spark, "saved"), read(spark, d, "orders").select("o_orderkey")
    files.replace_into(to, o.withColumn("state", F.lit("old")), ["o_orderkey"])
    files.replace_into(to, o.filter("o_orderkey % 3 = 0").withColumn("state", F.lit("new")), ["o_orderkey"])
    return store.read(spark, to).select("o_orderkey", "state")


@query("row_upsert_sink", "SELECT series, max(t) AS t, arg_max(price, t) AS price FROM {ticks} GROUP BY series")
def row_upsert_sink(spark, d):
    """Upserts the ticks before a time, then those from it on into the rows stored by then."""
    to, t = folder(spark, "upserted"), ticks(spark, d).select("series", "t", "price")
    files.upsert_into(to, t.filter(F.col("t") < CUT), ["series"], "t")
    files.upsert_into(to, t.filter(F.col("t") >= CUT), ["series"], "t")
    return store.read(spark, to).select("series", "t", "price")


@query("typed_header_source", "SELECT event_id, round(price, 6) AS price, true AS absent_is_nan FROM {ticks}")
def typed_header_source(spark, d):
    to = folder(spark, "typed")
    t = ticks(spark, d)
    t.select(F.concat_ws(";", F.date_format(F.timestamp_seconds(F.col("t") / 1_000_000), "yyyy-MM-dd HH:mm:ss"), "qty", F.format_string("%.6f", "price"), "event_id")).write.text(to)
    got = files.read_typed(spark, to, "Time:time;VOLUME:double;price:double;event_id:double", ";", ["price", "event_id", "absent"])
    return got.select(F.col("event_id").cast("long").alias("event_id"), r6("price", "price"), F.isnan("absent").alias("absent_is_nan"))


@query("plain_row_source", "SELECT o_orderkey, round(o_totalprice, 2) AS price, 1.0::DOUBLE AS tick_volume FROM orders")
def plain_row_source(spark, d):
    o = read(spark, d, "orders")
    lines = o.select(F.concat_ws(",", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit("1"), F.concat(F.lit("level_0: "), F.format_string("%.2f", "o_totalprice")), F.col("o_orderkey").cast("string")).alias("value"))
    return files.parse_rows(lines).select(F.col("values")[1].cast("long").alias("o_orderkey"), F.round(F.col("values")[0], 2).alias("price"), "tick_volume")


@query("delimited_export", "SELECT o_orderkey, o_orderstatus FROM orders")
def delimited_export(spark, d):
    to = folder(spark, "tsv")
    files.export(read(spark, d, "orders").select("o_orderkey", "o_orderstatus"), to)
    return spark.read.option("sep", "\t").schema("o_orderkey long, o_orderstatus string").csv(to)


@query("libsvm_round_trip", "SELECT CAST(label AS DOUBLE) AS label, count(*) AS n, CAST(sum(len(list_filter(embedding, lambda x: x <> 0))) AS BIGINT) AS stored FROM embeddings GROUP BY label")
def libsvm_round_trip(spark, d):
    to = folder(spark, "svm")
    files.to_libsvm(read(spark, d, "embeddings"), "label", "embedding").write.text(to)
    got = spark.read.format("libsvm").option("numFeatures", "64").load(to)
    from pyspark.ml.functions import vector_to_array

    stored = F.size(F.filter(vector_to_array("features"), lambda x: x != 0))
    return got.groupBy("label").agg(F.count("*").alias("n"), F.sum(stored).alias("stored"))


@query("message_source", f"SELECT 't' || series % 3 AS \"table\", t AS time, c.name AS \"column\", CASE c.name WHEN 'price' THEN price ELSE qty END AS value FROM {TICKS}, (VALUES ('price'), ('qty')) c(name)")
def message_source(spark, d):
    """The ticks as JSON messages in files, read as a stream in two runs of one query and taken apart."""
    t, to = ticks(spark, d), folder(spark, "messages")
    row = F.struct(F.col("t").alias("time"), F.lit(1.0).alias("volume"), F.array("price", F.col("qty").cast("double")).alias("values"))
    msg = t.select("event_id", F.to_json(F.struct(F.concat(F.lit("t"), F.col("series") % 3).alias("table"), F.array(F.lit("price"), F.lit("qty")).alias("columns"), F.array(row).alias("rows"))).alias("value"))
    got = None
    for half in (0, 1):
        msg.filter(F.col("event_id") % 2 == half).select("value").write.mode("append").text(f"{to}/in")
        stream = spark.readStream.schema("value string").text(f"{to}/in")
        got = jobs.run_once(files.exploded_messages(stream), to)
    return got.select("table", "time", "column", "value")


@query("response_sink", "SELECT series, t, round(price, 4) AS price, CAST(n AS DOUBLE) AS n FROM {main}")
def response_sink(spark, d):
    m = main_series(spark, d)
    narrow = m.unpivot(["series", "t"], [F.round("price", 4).alias("price"), F.col("n").cast("double").alias("n")], "column", "value")
    return messages.complete(narrow, ["series", "t"], ["price", "n"])


@query("stream_responses", f"SELECT series, t, round(avg(price), 6) AS price, CAST(avg(qty) AS DOUBLE) AS qty FROM (SELECT series, t, max(price) AS price, max(qty) AS qty FROM {TICKS} GROUP BY series, t) WHERE t < {{mark}} GROUP BY series, t".replace("{mark}", f"((SELECT max(t) FROM {TICKS}) // 1000 * 1000 + 1000)"))
def stream_responses(spark, d):
    """Prices and quantities come as results of their own, and leave as one response a time once both are there."""

    def build(s):
        parts = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in ("price", "qty")))).alias("r")
        return messages.response_stream(s.select("series", "ts", parts).select("series", "ts", "r.*"), "series", "ts", ["price", "qty"], "1 hour")

    return streamed(spark, d, "responses", build).select("series", "t", r6("price", "price"), "qty")


@query("stream_tail_overwrite", "SELECT event_id, series, t, price FROM {ticks}")
def stream_tail_overwrite(spark, d):
    to, rows = folder(spark, "tail"), lambda s: s.select("event_id", "series", F.unix_micros("ts").alias("t"), "price")
    put = jobs.tail_overwriting(f"{to}/table", "series", "t")
    jobs.replay(spark, f"{d}/events.parquet", to, lambda s: jobs.run_batches(rows(s), to, put))
    return jobs.tail_table(spark, f"{to}/table", rows(jobs.tick_stream(spark, f"{to}/in")).schema)


@query("stream_key_replace", "SELECT slot, arg_max(price, (t, event_id)) AS price FROM (SELECT *, event_id % 100 AS slot FROM {ticks}) GROUP BY slot")
def stream_key_replace(spark, d):
    """Each batch brings the last price of a hundred slots; what is stored of a slot gives way."""
    to = folder(spark, "replace")
    save = jobs.key_replacing(f"{to}/table", ["slot"])

    def put(batch, number):
        save(batch.groupBy("slot").agg(F.max_by("price", F.struct("ts", "event_id")).alias("price")), number)

    rows = lambda s: s.select((F.col("event_id") % 100).alias("slot"), "event_id", "ts", "price")
    jobs.replay(spark, f"{d}/events.parquet", to, lambda s: jobs.run_batches(rows(s), to, put))
    return store.read(spark, f"{to}/table").select("slot", "price")


_CLOSED = f"(SELECT series, t // {HOUR} * {HOUR} AS start, avg(price) AS price, arg_min(price, t) AS open, max(price) AS high, min(price) AS low, arg_max(price, t) AS close, count(*) AS n FROM {TICKS} GROUP BY ALL)"


@query("stream_tumbling_bars", f"SELECT series, start, round(price, 6) AS price, open, high, low, close, n FROM {_CLOSED} WHERE start + {HOUR} <= (SELECT max(t) FROM {TICKS}) // 1000 * 1000 - 3600000000")
def stream_tumbling_bars(spark, d):
    got = streamed(spark, d, "bars", lambda s: jobs.tumbling_bars(s, "1 hour", "1 hour"))
    return got.select("series", F.unix_micros("start").alias("start"), r6("price", "price"), "open", "high", "low", "close", "n")


#: A stream's watermark: the newest time, in whole milliseconds, less what may be late.
_MARK = f"((SELECT max(t) FROM {TICKS}) // 1000 * 1000 - {{0}})"


@query("stream_live_second_bars", f"SELECT series, t // 1000000 * 1000000 AS start, round(avg(price), 6) AS price, count(*) AS n FROM {TICKS} GROUP BY ALL HAVING start + 1000000 <= {_MARK.replace('{0}', '600000000')}")
def stream_live_second_bars(spark, d):
    got = streamed(spark, d, "secs", lambda s: jobs.tumbling_bars(s, "1 second", "10 minutes"))
    return got.select("series", F.unix_micros("start").alias("start"), r6("price", "price"), "n")


@query("stream_trailing_twap", f"""WITH w AS (SELECT series, t, price, (t // {12 * HOUR} + k) * {12 * HOUR} AS until FROM {TICKS}, (VALUES (1), (2)) v(k)), l AS (SELECT *, lag(t) OVER p AS pt, lag(price) OVER p AS pp FROM w WINDOW p AS (PARTITION BY series, until ORDER BY t, price))
SELECT series, until, round(CASE WHEN sum(t - pt) > 0 THEN sum((price + pp) / 2 * (t - pt)) / sum(t - pt) ELSE arg_max(price, (t, price)) END, 6) AS twap FROM l GROUP BY series, until HAVING until <= {_MARK.replace('{0}', '3600000000')}""")
def stream_trailing_twap(spark, d):
    got = streamed(spark, d, "twap", lambda s: jobs.trailing_twap(s, "1 day", "12 hours", "1 hour"))
    return got.select("series", F.unix_micros("until").alias("until"), r6("twap", "twap"))


@query("stream_state_retention", f"SELECT series, max(t) AS t, count(*) AS kept FROM {TICKS} JOIN (SELECT series AS s, max(t) AS newest FROM {TICKS} GROUP BY 1) ON s = series AND t > newest - 50 * {HOUR} GROUP BY series")
def stream_state_retention(spark, d):
    got = streamed(spark, d, "kept", lambda s: jobs.retained(s, 50, HOUR))
    return got.groupBy("series").agg(F.max_by(F.struct("t", "kept"), "t").alias("r")).select("series", "r.*")


@query("stream_last_good_fallback", f"""WITH w AS (SELECT {_MARK.replace('{0}', str(HOUR))} // {HOUR} AS over),
s AS (SELECT series, t // {HOUR} AS slot, avg(price) AS price FROM {TICKS} GROUP BY ALL), n AS (SELECT *, lead(slot, 1, 1000000000) OVER (PARTITION BY series ORDER BY slot) AS next FROM s)
SELECT series, slot, round(price, 6) AS price, true AS fresh FROM n, w WHERE slot < over
UNION ALL SELECT series, unnest(range(slot + 1, least(next, slot + 11, over))) AS slot, round(price, 6), false FROM n, w WHERE slot < over""")
def stream_last_good_fallback(spark, d):
    return streamed(spark, d, "good", lambda s: jobs.last_good(s, HOUR, 10)).select("series", "slot", r6("price", "price"), "fresh")


_PERIOD = 12 * HOUR


@query("stream_asked_means", f"""WITH a AS (SELECT event_id, series, t + {6 * HOUR} AS t FROM {TICKS} WHERE event_id % 5 = 0),
w AS (SELECT greatest((SELECT max(t) FROM {TICKS}), (SELECT max(t) FROM a)) // 1000 * 1000 - {7 * HOUR} AS mark),
i AS (SELECT a.event_id, a.series, a.t, q.t AS qt, q.price, lag(q.t) OVER p AS pt, lag(q.price) OVER p AS pp FROM a JOIN {TICKS} q ON q.series = a.series AND q.t <= a.t AND q.t > a.t - {_PERIOD} WINDOW p AS (PARTITION BY a.event_id ORDER BY q.t, q.price)),
good AS (SELECT event_id, series, t, CASE WHEN sum(qt - pt) > 0 THEN sum((price + pp) / 2 * (qt - pt)) / sum(qt - pt) ELSE arg_max(price, (qt, price)) END AS price FROM i GROUP BY ALL),
back AS (SELECT a.event_id, max(g.t) AS t, arg_max(g.price, g.t) AS price FROM a JOIN good g ON g.series = a.series AND g.t < a.t GROUP BY a.event_id)
SELECT a.series, a.t, round(CASE WHEN g.event_id IS NOT NULL THEN g.price WHEN a.t <= b.t + 2 * {_PERIOD} THEN b.price END, 6) AS price, g.event_id IS NOT NULL AS fresh
FROM a LEFT JOIN good g USING (event_id) LEFT JOIN back b USING (event_id), w WHERE a.t < mark""")
def stream_asked_means(spark, d):
    """Every fifth tick asks, six hours later, for the average of the twelve hours before; a silent series answers with its last one for a day."""

    def build(s):
        asks = s.filter("event_id % 5 = 0").select("series", (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("ts"), F.lit(None).cast("double").alias("price"), F.lit(True).alias("asked"))
        return jobs.answered(s.select("series", "ts", "price", F.lit(False).alias("asked")).union(asks), _PERIOD, 2, "7 hours")  # asks are six hours ahead of the ticks they come with

    return streamed(spark, d, "asked", build).select("series", "t", r6("price", "price"), "fresh")


@query("stream_self_requests")
def stream_self_requests(spark, d):
    return streamed(spark, d, "asks", lambda s: jobs.self_requests(s, DAY, 3 * HOUR))


@query("stream_online_modes")
def stream_online_modes(spark, d):
    got = streamed(spark, d, "modes", lambda s: jobs.online_modes(s, [0.1, 0.7]))
    return got.select("series", "t", F.transform("modes", lambda x: F.round(x, 6)).alias("modes"))


@query("increment_detection", f"SELECT series, min(t) FILTER (t > mark) AS first_new, count(*) FILTER (t > mark) AS fresh FROM {{ticks}} JOIN (SELECT series AS s, max(t) AS mark FROM {{ticks}} WHERE t < {CUT} GROUP BY 1) ON s = series GROUP BY series")
def increment_detection(spark, d):
    t = ticks(spark, d)
    marks = t.filter(F.col("t") < CUT).groupBy("series").agg(F.max("t").alias("mark"))
    new = F.col("t") > F.col("mark")
    return t.join(marks, "series").groupBy("series").agg(F.min(F.when(new, F.col("t"))).alias("first_new"), F.count_if(new).alias("fresh"))


@query("open_requests", "SELECT o_custkey, o_orderpriority, epoch_us(o_orderdate) AS end_t, max(o_orderkey) AS request_id FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL")
def open_requests(spark, d):
    """The newest unprocessed request for each (user, dataset, range), by end time."""
    return requests.open_requests(_requests(spark, d)).select(F.col("user_id").alias("o_custkey"), F.col("dataset").alias("o_orderpriority"), "end_t", "request_id")


_FORCED, _PRUNED = 820454400000000, 757382400000000


def _requests(spark, d):
    o = read(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("dataset"), (micros("o_orderdate") - DAY).alias("start_t"), micros("o_orderdate").alias("end_t"), (F.col("o_orderstatus") == "F").alias("processed"))


@query("request_life_cycle", f"""WITH r AS (SELECT o_orderkey AS request_id, o_custkey AS user_id, o_orderpriority AS dataset, epoch_us(o_orderdate) - {DAY} AS start_t, epoch_us(o_orderdate) AS end_t, o_orderstatus = 'F' OR o_orderkey % 4 = 0 OR epoch_us(o_orderdate) < {_FORCED} AS processed FROM orders)
SELECT * FROM r WHERE NOT (processed AND end_t < {_PRUNED})""")
def request_life_cycle(spark, d):
    """Requests saved, some marked done, overdue ones closed, old closed ones pruned, read back after each step."""
    new = _requests(spark, d)
    to, kept = folder(spark, "requests"), folder(spark, "requests-kept")
    files.replace_into(to, new, requests.KEY)
    requests.mark_done(to, requests.table(spark, to, new.schema), new.filter("request_id % 4 = 0"))
    requests.force_finalize(to, requests.table(spark, to, new.schema), _FORCED)
    files.replace_into(kept, requests.pruned(requests.table(spark, to, new.schema), _PRUNED), requests.KEY)
    return requests.table(spark, kept, new.schema)


@query("request_grid_expansion", f"SELECT series, unnest(range(t, t + greatest((n - 1) * {12 * HOUR}, 1), {6 * HOUR})) AS t FROM {{main}}")
def request_grid_expansion(spark, d):
    m = main_series(spark, d).select("series", F.col("t").alias("lo"), (F.col("t") + (F.col("n") - 1) * 12 * HOUR).alias("hi"))
    return core.grid(m, "lo", "hi", 6 * HOUR).select("series", "t")
