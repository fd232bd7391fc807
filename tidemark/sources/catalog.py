"""Series tables in Spark's catalog, named by owner, series and resolution."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def name_of(owner: str, series: str, seconds: int) -> str:
    return re.sub("[^A-Za-z0-9]", "_", f"q_{owner}_{series}_{seconds}").lower()


def create(spark: SparkSession, owner: str, series: str, seconds: int, columns: list[str], comment: str = "") -> str:
    """An empty table of (value_time, update_time, tick_volume, *columns double); its name. An existing one is left as it is."""
    name = name_of(owner, series, seconds)
    fields = ", ".join(["value_time TIMESTAMP_NTZ", "update_time TIMESTAMP_NTZ", "tick_volume DOUBLE", *(f"`{c}` DOUBLE" for c in columns)])
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({fields}) USING parquet COMMENT '{comment.replace(chr(39), '')}'")
    return name


def exists(spark: SparkSession, owner: str, series: str, seconds: int) -> bool:
    return spark.catalog.tableExists(name_of(owner, series, seconds))


def append(spark: SparkSession, owner: str, series: str, seconds: int, rows: DataFrame) -> None:
    rows.select(*spark.table(name_of(owner, series, seconds)).columns).write.insertInto(name_of(owner, series, seconds))


def remove(spark: SparkSession, owner: str, series: str, seconds: int) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name_of(owner, series, seconds)}")


def of_owner(spark: SparkSession, owner: str) -> list[str]:
    start = name_of(owner, "", 0).rsplit("_", 2)[0] + "_"
    return sorted(t.name for t in spark.catalog.listTables() if t.name.startswith(start))
