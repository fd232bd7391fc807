"""Queries over scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars as sc

from .tables import query, r6, read, ticks


@query("string_trim_case", "SELECT o_orderkey, trim('  ' || o_orderpriority || ' ') AS trimmed, ltrim('  ' || o_orderpriority) AS l, rtrim(o_orderpriority || '  ') AS r, lower(o_orderpriority) AS low, upper(o_orderpriority) AS up, lower(o_orderstatus) = lower('f') AS same FROM orders")
def string_trim_case(spark, d):
    p = F.col("o_orderpriority")
    return read(spark, d, "orders").select("o_orderkey", F.trim(F.concat(F.lit("  "), p, F.lit(" "))).alias("trimmed"), F.ltrim(F.concat(F.lit("  "), p)).alias("l"), F.rtrim(F.concat(p, F.lit("  "))).alias("r"), F.lower(p).alias("low"), F.upper(p).alias("up"), (F.lower("o_orderstatus") == "f").alias("same"))


@query("string_split_array", "SELECT o_orderkey, array_to_string(list_filter(string_split_regex(o_orderpriority || ',,' || o_orderstatus || '-x', '[,-]'), lambda x: x <> ''), '|') AS parts FROM orders")
def string_split_array(spark, d):
    s = F.concat("o_orderpriority", F.lit(",,"), "o_orderstatus", F.lit("-x"))
    return read(spark, d, "orders").select("o_orderkey", F.array_join(sc.split_any(s, ",-"), "|").alias("parts"))


@query("string_sanitise", "SELECT p_partkey, lower('q_' || regexp_replace(p_type, '[^A-Za-z0-9]', '_', 'g')) AS table_name FROM part".replace("p_type", "p_name"))
def string_sanitise(spark, d):
    return read(spark, d, "part").select("p_partkey", F.lower(F.concat(F.lit("q_"), F.regexp_replace("p_name", "[^A-Za-z0-9]", "_"))).alias("table_name"))


@query("string_integer_range", "SELECT p_partkey, CAST(list_sum(CASE WHEN p_partkey % 2 = 0 THEN range(p_size, p_size + 4) ELSE [p_size, p_size + 7] END) AS BIGINT) AS total FROM part")
def string_integer_range(spark, d):
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat_ws("..", "p_size", F.col("p_size") + 3)).otherwise(F.concat_ws(",", "p_size", F.col("p_size") + 7))
    return read(spark, d, "part").select("p_partkey", F.aggregate(sc.string_range(text), F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("json_map", "SELECT event_id, json_extract_string(props, '$.k') AS k, '{\"k\":\"' || json_extract_string(props, '$.k') || '\"}' AS back FROM events")
def json_map(spark, d):
    m = F.from_json("props", "map<string,string>")
    return read(spark, d, "events").select("event_id", m["k"].alias("k"), F.to_json(F.create_map(F.lit("k"), m["k"])).alias("back"))


@query("json_tick_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.absent') AS absent FROM events")
def json_tick_fields(spark, d):
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.absent").alias("absent"))


@query("date_rounding", "SELECT event_id, t - t % 1000 AS ms, t - t % 1000000 AS s, t - t % 60000000 AS m, t - t % 3600000000 AS h FROM {ticks}")
def date_rounding(spark, d):
    t = F.col("t")
    return ticks(spark, d).select("event_id", *(sc.rounded_down(t, u).alias(n) for n, u in (("ms", 1000), ("s", 10**6), ("m", 60 * 10**6), ("h", 3600 * 10**6))))


@query("duration_parse", "SELECT o_orderkey, o_orderkey % 5 * 86400 + 2 * 3600 + o_orderkey % 60 * 60 + 7 AS seconds, round((o_orderkey % 5 * 86400 + 7200 + o_orderkey % 60 * 60 + 7) / 3600, 6) AS ratio FROM orders")
def duration_parse(spark, d):
    k = F.col("o_orderkey")
    s = F.concat(k % 5, F.lit(",2:"), k % 60, F.lit(":7"))
    return read(spark, d, "orders").select("o_orderkey", sc.duration_seconds(s).alias("seconds"), r6(sc.duration_seconds(s) / 3600, "ratio"))


@query("date_format", "SELECT event_id, strftime(ts, '%Y.%m.%d %H:%M:%S') AS text FROM events")
def date_format(spark, d):
    return read(spark, d, "events").select("event_id", F.date_format("ts", "yyyy.MM.dd HH:mm:ss").alias("text"))


@query("frame_alignment", "SELECT o_orderkey, o_orderkey + ((64 - (o_orderkey - o_custkey) % 64) % 64 + 64) % 64 AS aligned FROM orders")
def frame_alignment(spark, d):
    return read(spark, d, "orders").select("o_orderkey", sc.aligned_end(F.col("o_custkey"), F.col("o_orderkey"), 64).alias("aligned"))


@query("time_zone_conversion", "SELECT event_id, epoch_us(timezone('America/New_York', timezone('UTC', ts))) AS local_us FROM events")
def time_zone_conversion(spark, d):
    from tidemark.operators.core import micros

    return read(spark, d, "events").select("event_id", micros(F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), "ts")).alias("local_us"))


@query("calendar_features", "SELECT event_id, round(hour(ts) / 24, 6) AS h, round(((t // 86400000000 + 3) % 7) / 7, 6) AS w, round(day(ts) / 31, 6) AS d, round(weekofyear(ts) / 52, 6) AS wk, round(month(ts) / 12, 6) AS m FROM (SELECT *, epoch_us(ts) AS t FROM events)")
def calendar_features(spark, d):
    from tidemark.operators.core import DAY, micros

    ts = F.col("ts")
    return read(spark, d, "events").select("event_id", r6(F.hour(ts) / 24, "h"), r6(F.pmod(F.floor(micros("ts") / DAY) + 3, F.lit(7)) / 7, "w"), r6(F.dayofmonth(ts) / 31, "d"), r6(F.weekofyear(ts) / 52, "wk"), r6(F.month(ts) / 12, "m"))


@query("sign_safe_math", "SELECT event_id, round(sign(price - 20) * ln(1 + abs(price - 20)), 6) AS sln, round(price - 20, 6) AS back, round(CASE WHEN abs(price) + abs(qty) = 0 THEN 0 ELSE abs(price - qty) / (abs(price) + abs(qty)) END, 6) AS ratio FROM {ticks}")
def sign_safe_math(spark, d):
    v = F.col("price") - 20
    return ticks(spark, d).select("event_id", r6(sc.sln(v), "sln"), r6(sc.sexp(sc.sln(v)), "back"), r6(sc.abs_diff_ratio(F.col("price"), F.col("qty")), "ratio"))


@query("modular_math", """SELECT event_id, ((qty - 50) % 7 + 7) % 7 AS modulo, CAST(ceil(qty / 7) AS BIGINT) AS cdiv, CASE WHEN qty % 20 <= 10 THEN qty % 20 ELSE 20 - qty % 20 END AS bounced, CAST(greatest(10, least(60, qty)) AS BIGINT) AS clamped,
  CASE WHEN qty <= 1 THEN 1 ELSE CAST(pow(2, ceil(log2(qty))) AS BIGINT) END AS pow2, qty > 0 AND bit_count(qty) = 1 AS is_pow2 FROM {ticks}""")
def modular_math(spark, d):
    q = F.col("qty")
    return ticks(spark, d).select("event_id", F.pmod(q - 50, F.lit(7)).alias("modulo"), sc.ceil_div(q, 7).alias("cdiv"), sc.bounce(q, 10).cast("long").alias("bounced"), sc.constrain(q, 10, 60).cast("long").alias("clamped"), sc.next_power_of_two(q).alias("pow2"), sc.is_power_of_two(q).alias("is_pow2"))


@query("normalise_columns", """WITH m AS (SELECT series, avg(price) AS mean FROM {ticks} GROUP BY series), d AS (SELECT series, any_value(mean) AS mean, median(abs(price - mean)) AS med FROM {ticks} JOIN m USING (series) GROUP BY series)
SELECT event_id, round(CASE WHEN med = 0 THEN 0 ELSE (price - mean) / med END, 4) AS z FROM {ticks} JOIN d USING (series)""")
def normalise_columns(spark, d):
    t = ticks(spark, d)
    mean = t.groupBy("series").agg(F.avg("price").alias("mean"))
    med = t.join(mean, "series").groupBy("series").agg(F.first("mean").alias("mean"), F.median(F.abs(F.col("price") - F.col("mean"))).alias("med"))
    return t.join(med, "series").select("event_id", F.round(F.when(F.col("med") == 0, 0.0).otherwise((F.col("price") - F.col("mean")) / F.col("med")), 4).alias("z"))


@query("vector_arithmetic", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 4) AS dot, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) + x)), 4) AS sum2, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / len(embedding), 6) AS mean FROM embeddings")
def vector_arithmetic(spark, d):
    e = F.transform("embedding", lambda x: x.cast("double"))
    total = F.aggregate(sc.vector(lambda a, b: a + b, e, e), F.lit(0.0), lambda s, x: s + x)
    return read(spark, d, "embeddings").select("vec_id", F.round(sc.dot(e, e), 4).alias("dot"), F.round(total, 4).alias("sum2"), r6(sc.mean_of(e), "mean"))


@query("transpose_vectors", "SELECT label, i AS place, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY ALL".replace("avg(x)", "avg(CAST(x AS DOUBLE))"))
def transpose_vectors(spark, d):
    flat = read(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("place", "x"))
    return flat.groupBy("label", F.col("place").cast("long").alias("place")).agg(r6(F.avg(F.col("x").cast("double")), "mean"))


@query("insert_means_into_level", "WITH m AS (SELECT vec_id, label AS level, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / len(embedding) AS v FROM embeddings), o AS (SELECT vec_id, 0 AS level, CAST(embedding[1] AS DOUBLE) AS v FROM embeddings) SELECT vec_id, CAST(level AS INTEGER) AS level, round(sum(v), 6) AS v FROM (SELECT * FROM m UNION ALL SELECT * FROM o) GROUP BY ALL")
def insert_means_into_level(spark, d):
    e = read(spark, d, "embeddings")
    means = e.select("vec_id", F.col("label").cast("int").alias("level"), sc.mean_of(F.col("embedding")).alias("v"))
    old = e.select("vec_id", F.lit(0).alias("level"), F.col("embedding")[0].cast("double").alias("v"))
    return means.unionByName(old).groupBy("vec_id", "level").agg(r6(F.sum("v"), "v"))


@query("deterministic_permutation", "SELECT event_id, (event_id * 6700417 + 42) % 1000003 AS place FROM events")
def deterministic_permutation(spark, d):
    return read(spark, d, "events").select("event_id", sc.permuted(F.col("event_id"), 1000003).alias("place"))


@query("parameter_grid", "SELECT p_partkey, j, round(fr * fr * 9.0 + 1.0, 6) AS x FROM (SELECT p_partkey, j, pow(2, j) * (p_partkey % 17) / 16 - floor(pow(2, j) * (p_partkey % 17) / 16) AS fr FROM part CROSS JOIN (SELECT unnest(range(4)) AS j))")
def parameter_grid(spark, d):
    g = read(spark, d, "part").select("p_partkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("j"))
    x = F.pow(F.lit(2.0), F.col("j")) * (F.col("p_partkey") % 17) / 16
    return g.select("p_partkey", "j", r6(F.pow(x - F.floor(x), F.lit(2.0)) * 9.0 + 1.0, "x"))
