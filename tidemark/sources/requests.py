"""Forecast requests as a stored table: open ones, marking done, closing overdue ones, pruning.

Rows are (request_id, user_id, dataset, start_t, end_t, processed). Changes go through files.replace_into, so each can be done again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .files import replace_into

KEY = ["request_id"]


def table(spark, path: str, schema) -> DataFrame:
    got = store.read(spark, path)
    return got.select(*schema.names) if got is not None else spark.createDataFrame([], schema)


def open_requests(requests: DataFrame) -> DataFrame:
    """The newest unprocessed request for each user, dataset and range, by end time."""
    row = F.struct(*requests.columns)
    newest = requests.filter("NOT processed").groupBy("user_id", "dataset", "start_t", "end_t").agg(F.max_by(row, "request_id").alias("r"))
    return newest.select("r.*").orderBy("end_t", "request_id")


def mark_done(path: str, requests: DataFrame, done: DataFrame) -> None:
    """Sets processed on the requests whose request_id is in `done`."""
    replace_into(path, requests.join(done.select("request_id").distinct(), "request_id", "left_semi").withColumn("processed", F.lit(True)), KEY)


def force_finalize(path: str, requests: DataFrame, before: int) -> None:
    """Sets processed on open requests that end before a time."""
    replace_into(path, requests.filter(~F.col("processed") & (F.col("end_t") < before)).withColumn("processed", F.lit(True)), KEY)


def pruned(requests: DataFrame, before: int) -> DataFrame:
    """The requests that pruning leaves: all but processed ones that end before a time. To be saved as a new table."""
    return requests.filter(~(F.col("processed") & (F.col("end_t") < before)))
