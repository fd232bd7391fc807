"""File sources and sinks of series tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.core import replace_keys

from . import store

TYPES = {"double": "double", "float": "double", "int": "long", "integer": "long", "long": "long", "time": "timestamp_ntz", "date": "timestamp_ntz", "string": "string"}


def header_fields(header: str) -> list[tuple[str, str]]:
    """(name, Spark type) of "name:type;name:type". Time and Volume are needed, in any case of letters."""
    fields = [(n.strip(), TYPES.get(t.strip().lower(), "string")) for n, _, t in (part.partition(":") for part in header.split(";") if part.strip())]
    names = {n.lower() for n, _ in fields}
    if not {"time", "volume"} <= names:
        raise ValueError("the header needs Time and Volume")
    return fields


def read_typed(spark: SparkSession, path: str, header: str, delimiter: str, columns: list[str]) -> DataFrame:
    """Delimited rows under a typed header, as (time, volume, *columns); a column that the header lacks is NaN. Rows of another width are left out."""
    fields = header_fields(header)
    lines = spark.read.text(path)
    parts = F.split("value", "[" + delimiter + "]", -1)
    rows = lines.filter(F.size(parts) == len(fields)).select(*(parts[i].cast(t).alias(n) for i, (n, t) in enumerate(fields)))
    have = {n.lower(): n for n, _ in fields}
    return rows.select(F.col(have["time"]).alias("time"), F.col(have["volume"]).cast("double").alias("volume"), *(F.col(have[c.lower()]).cast("double").alias(c) if c.lower() in have else F.lit(float("nan")).alias(c) for c in columns))


def parse_rows(lines: DataFrame, delimiter: str = ",") -> DataFrame:
    """(value_time, update_time, tick_volume, values array) of plain rows; "label: " before a value goes."""
    parts = F.transform(F.split("value", "[" + delimiter + "]"), lambda x: F.trim(F.regexp_replace(x, "^[^:]*[A-Za-z_][^:]*: ", "")))
    values = F.transform(F.slice(parts, 4, 100_000), lambda x: x.cast("double"))
    return lines.select(parts[0].cast("timestamp_ntz").alias("value_time"), parts[1].cast("timestamp_ntz").alias("update_time"), parts[2].cast("double").alias("tick_volume"), values.alias("values"))


def export(df: DataFrame, path: str) -> None:
    """Tab-separated text without header."""
    df.write.option("sep", "\t").mode("overwrite").csv(path)


def to_libsvm(df: DataFrame, label: str, features: str) -> DataFrame:
    """Lines "label index:value ..." with indices from 1; zeros are left out."""
    pairs = F.filter(F.transform(features, lambda x, i: F.when(x != 0, F.concat((i + 1).cast("string"), F.lit(":"), x.cast("string")))), lambda x: x.isNotNull())
    return df.select(F.concat_ws(" ", F.col(label).cast("string"), F.array_join(pairs, " ")).alias("value"))


def append_from(df: DataFrame, path: str, time: str, start) -> None:
    """Appends rows from `start` on, in folders by day."""
    df.filter(F.col(time) >= start).withColumn("day", F.floor(F.col(time) / 86_400_000_000).cast("long")).write.mode("append").partitionBy("day").parquet(path)


def upserted(old: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Old rows with changes by key; of several changes of one key the last version counts. All columns must be there."""
    if missing := set(old.columns) - set(changes.columns):
        raise ValueError(f"the rows lack {sorted(missing)}")
    newest = changes.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(version)))).filter("_r = 1").drop("_r")
    return replace_keys(old, newest.select(*old.columns), keys)


def replace_into(path: str, new: DataFrame, keys: list[str]) -> store.Saved:
    """Saves rows into a stored table (see store), which is made if it is not there: stored rows with the same keys go in the same step, so a save
    that is done again changes nothing, and readers see all of it or nothing."""
    return store.save(path, new, keys)


def upsert_into(path: str, changes: DataFrame, keys: list[str], version: str) -> None:
    """Saves the last version of each changed key into a stored table; all its columns must be there."""
    newest = changes.groupBy(*keys).agg(F.max_by(F.struct(*changes.columns), version).alias("r")).select("r.*")
    replace_into(path, newest, keys)


def exploded_messages(lines: DataFrame) -> DataFrame:
    """(table, time, volume, column, value) of JSON messages {table, columns, rows: [{time, volume, values}]}; works on streams too."""
    schema = "table string, columns array<string>, rows array<struct<time:long,volume:double,values:array<double>>>"
    m = lines.select(F.from_json("value", schema).alias("m")).select("m.table", "m.columns", F.explode("m.rows").alias("r"))
    return m.select("table", F.col("r.time").alias("time"), F.col("r.volume").alias("volume"), F.explode(F.arrays_zip("columns", "r.values")).alias("z")).select("table", "time", "volume", F.col("z.columns").alias("column"), F.col("z.values").alias("value"))
