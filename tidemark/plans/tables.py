"""How the given tables stand in for series: events as ticks and quotes, orders as a slow main series."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.core import micros

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query (spark, sf_dir) and its DuckDB twin."""

    def put(f):
        if name in Q:
            raise ValueError(name)
        Q[name] = f
        if sql is not None:
            SQL[name] = sql.replace("{ticks}", TICKS).replace("{main}", MAIN)
        return f

    return put


TICKS = "(SELECT event_id, user_id AS series, epoch_us(ts) AS t, value AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) AS qty, event_type AS kind FROM events)"
MAIN = "(SELECT o_custkey AS series, epoch_us(o_orderdate) AS t, sum(o_totalprice) AS price, count(*) AS n FROM orders GROUP BY ALL)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def instant(us: int):
    """A time in microseconds as a timestamp without zone."""
    return F.lit((datetime(1970, 1, 1) + timedelta(microseconds=us)).isoformat(sep=" ")).cast("timestamp_ntz")


def ticks(spark: SparkSession, sf_dir: str, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """event_id, series, t (microseconds), price, qty, kind; of [lo, hi] if given, a filter on the stored column."""
    rows = read(spark, sf_dir, "events")
    if lo is not None:
        rows = rows.filter(F.col("ts") >= instant(lo))
    if hi is not None:
        rows = rows.filter(F.col("ts") <= instant(hi))
    return rows.select("event_id", F.col("user_id").alias("series"), micros("ts").alias("t"), F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("long").alias("qty"), F.col("event_type").alias("kind"))


def main_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, t, price, n: a customer's orders by day."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("series"), micros("o_orderdate").alias("t"), "o_totalprice")
    return o.groupBy("series", "t").agg(F.sum("o_totalprice").alias("price"), F.count("*").alias("n"))


def r6(c, name: str):
    return F.round(c, 6).alias(name)
