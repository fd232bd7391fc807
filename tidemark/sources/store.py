"""A stored table with a log of versions.

Data files are never changed. A version is a manifest: a table of the live files, each with its number of rows, its range of keys and a Bloom filter of
them. A save looks up which files may hold its keys, writes the rows of those (less the replaced ones) and its own into new files in order of keys,
writes a manifest of the other files and the new ones, and then makes a marker file that names it; there is one marker a number, and the file system makes it or
refuses. So readers see a whole version or the one before, a save that dies leaves files that no version names, and of two saves at a time
the later one starts again from the version it has missed. clean() removes what the last versions don't name.

Spark jobs read and write all rows and look up all keys; names of files and manifests' folders go through the driver, as they do for any file source.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.core import overlay, replace_keys
from tidemark.shared import written

#: Rows of a data file at most.
FILE_ROWS = 100_000
#: Keys of a save that are looked up in a file's filter at most.
LOOKED_UP = 100_000
#: Bits of a Bloom filter for each row, and probes.
BITS, PROBES = 10, 7


@dataclass
class Saved:
    """What a save did: the version it made, and how many files it left, replaced and wrote."""

    version: int
    kept: int
    replaced: int
    written: int


class Conflict(Exception):
    """Another save made this version first."""


def _system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the versions that a table has, oldest first."""
    fs, at = _system(spark, f"{path}/log")
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n[1:]) for n in names if n.startswith("v"))


def manifest(spark: SparkSession, path: str, version: int) -> DataFrame:
    """(file, n, lo, hi, bloom) of a version's files."""
    fs, at = _system(spark, f"{path}/log/v{version:012d}")
    stream = fs.open(at)
    try:
        name = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return spark.read.parquet(f"{path}/manifests/{name}")


def publish(spark: SparkSession, path: str, version: int, name: str) -> None:
    """Makes the marker of a version, unless there is one."""
    fs, at = _system(spark, f"{path}/log/v{version:012d}")
    try:
        stream = fs.create(at, False)
    except Exception as e:
        if fs.exists(at):
            raise Conflict(version) from e
        raise
    stream.write(bytearray(name.encode()))
    stream.close()


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The table as it is, or as it was at a version that clean() has left; None if nothing has been saved."""
    known = versions(spark, path)
    if version is None:
        version = known[-1] if known else None
    if version is None:
        return None
    if version not in known:
        raise ValueError(f"no version {version} of {path}")
    found = manifest(spark, path, version)
    files = [f"{path}/data/{r['file']}" for r in found.select("file").collect()]
    return spark.read.schema(_schema(spark, path)).parquet(*files) if files else spark.createDataFrame([], _schema(spark, path))


def _schema(spark: SparkSession, path: str) -> T.StructType:
    return spark.read.parquet(f"{path}/schema").schema


def probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The places of each key's probes in a filter."""
    h = hashes.astype(np.int64).view(np.uint64)
    a, b = h >> np.uint64(32), (h & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    return ((a[:, None] + np.arange(PROBES, dtype=np.uint64) * b[:, None]) % np.uint64(bits)).astype(np.int64)


def bloom(hashes: np.ndarray) -> bytes:
    bits = max(64, BITS * len(hashes))
    out = np.zeros(bits, bool)
    out[probes(hashes, bits).ravel()] = True
    return np.packbits(out).tobytes()


def may_hold(data: bytes, n: int, hashes: np.ndarray) -> np.ndarray:
    """Which keys a filter made of n rows may hold."""
    bits = max(64, BITS * n)
    return np.unpackbits(np.frombuffer(data, np.uint8), count=bits)[probes(hashes, bits)].all(axis=1)


def _described(spark: SparkSession, path: str, folder: str, keys: list[str]) -> DataFrame:
    """Manifest rows of the files in a new folder: names, counts and ranges by an aggregate, filters of a file's keys by groups of FILE_ROWS rows at most."""
    name = F.concat(F.lit(f"{folder}/"), F.col("_metadata.file_name"))
    rows = spark.read.parquet(f"{path}/data/{folder}").select(name.alias("file"), F.struct(*keys).alias("key"), F.xxhash64(*keys).alias("h"))
    ranges = rows.groupBy("file").agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))

    def run(table: pa.Table) -> pa.Table:
        return pa.table({"file": table.column("file").slice(0, 1), "bloom": pa.array([bloom(table.column("h").to_numpy())], pa.binary())})

    return ranges.join(rows.select("file", "h").groupBy("file").applyInArrow(run, "file string, bloom binary"), "file").select("file", "n", "lo", "hi", "bloom")


def touched(rows: DataFrame, files: DataFrame, keys: list[str]) -> list[str]:
    """The files whose range and filter say that they may hold a key of rows, which carry `_part`, the number of their range of keys.

    Ranges of keys meet ranges of files first (a few rows each); keys meet only the files whose range holds them, and are looked up in the filters file by file.
    A file whose range holds more than LOOKED_UP of the keys counts as touched without a look, so no group is larger."""
    key = rows.select("_part", F.struct(*keys).alias("key"), F.xxhash64(*keys).alias("h"))
    parts = key.groupBy("_part").agg(F.min("key").alias("from"), F.max("key").alias("to"))
    near = parts.join(files.select("file", "lo", "hi"), (F.col("from") <= F.col("hi")) & (F.col("lo") <= F.col("to"))).select("_part", "file", "lo", "hi")
    asked = written(key.join(near, "_part").filter((F.col("key") >= F.col("lo")) & (F.col("key") <= F.col("hi"))).select("file", "h"), "asked")
    many = asked.groupBy("file").agg(F.count("*").alias("asked"))
    sure, unsure = (many.filter(c).select("file") for c in (F.col("asked") > LOOKED_UP, F.col("asked") <= LOOKED_UP))

    def looked_up(asked: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        hit = len(asked) and len(filters) and may_hold(filters["bloom"].iloc[0], int(filters["n"].iloc[0]), asked["h"].to_numpy()).any()
        return filters[["file"]] if hit else filters[["file"]].iloc[:0]

    few = asked.join(unsure, "file", "left_semi").groupBy("file").cogroup(files.join(unsure, "file", "left_semi").select("file", "n", "bloom").groupBy("file"))
    return [r["file"] for r in sure.unionByName(few.applyInPandas(looked_up, "file string")).collect()]


def behind(rows: DataFrame, files: DataFrame, key: str, time: str) -> list[str]:
    """The files that may hold rows of a key of `rows` (with `_part`) from its first new time on."""
    first = rows.groupBy("_part", key).agg(F.min(time).alias("_first"))
    parts = first.groupBy("_part").agg(F.min(key).alias("from"), F.max(key).alias("to"))
    near = parts.join(files.select("file", "lo", "hi"), (F.col("from") <= F.col(f"hi.{key}")) & (F.col(f"lo.{key}") <= F.col("to"))).select("_part", "file", "lo", "hi")
    reached = first.join(near, "_part").filter((F.col(key) >= F.col(f"lo.{key}")) & (F.struct(F.col(key), F.col("_first").alias(time)) <= F.col("hi")))
    return [r["file"] for r in reached.select("file").distinct().collect()]


def save(path: str, new: DataFrame, keys: list[str], file_rows: int = FILE_ROWS, attempts: int = 5, how: str = "replace") -> Saved:
    """Saves rows into the table at `path`, which is made if it is not there, in one step: readers see all of the save or nothing of it.

    how: "replace", stored rows with a key of the new ones go; "tail", with keys (series, time): stored rows of a series from its first new time on go; "append", all
    stay. Only files that may hold rows that go are written anew. A save that is done again changes nothing, unless it appends. Repeated keys among
    the new rows all stay. Keys with a null come first in their order and equal no other."""
    spark = new.sparkSession
    rows = None
    for _ in range(attempts):
        known = versions(spark, path)
        version = known[-1] + 1 if known else 0
        fresh = new
        if known:
            if rows is None:  # the rows are read several times, so they are made once
                rows = written(new.repartitionByRange(*[F.col(k) for k in keys]).withColumn("_part", F.spark_partition_id()), "save")
            fresh = rows.drop("_part")
            files = manifest(spark, path, known[-1])
            gone = touched(rows, files, keys) if how == "replace" else behind(rows, files, *keys) if how == "tail" else []
            if gone:
                old = spark.read.schema(fresh.schema).parquet(*(f"{path}/data/{f}" for f in gone))
                fresh = replace_keys(old, fresh, keys) if how == "replace" else overlay(old, fresh, *keys)
            left = files.filter(~F.col("file").isin(gone)) if gone else files
        else:
            gone, left = [], None
            spark.createDataFrame([], new.schema).write.mode("ignore").parquet(f"{path}/schema")
        folder, name = f"d{version:012d}-{uuid.uuid4().hex}", f"m{version:012d}-{uuid.uuid4().hex}"
        fresh.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys).write.option("maxRecordsPerFile", file_rows).parquet(f"{path}/data/{folder}")
        made = _described(spark, path, folder, keys)
        (made if left is None else left.unionByName(made)).coalesce(1 + len(gone) // 1000).write.parquet(f"{path}/manifests/{name}")
        try:
            publish(spark, path, version, name)
        except Conflict:
            continue
        sizes = spark.read.parquet(f"{path}/manifests/{name}").agg(F.count("*").alias("all"), F.count_if(F.col("file").startswith(f"{folder}/")).alias("new")).first()
        return Saved(version, sizes["all"] - sizes["new"], len(gone), sizes["new"])
    raise Conflict(f"{attempts} other saves came first")


def clean(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Removes the markers of all versions but the last `keep`, then manifests and data that no version left names; the number of files and folders removed.

    Readers of an older version, and saves that are under way, must be done: their files are not named yet."""
    known = versions(spark, path)
    fs, _ = _system(spark, path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    removed = 0
    for version in known[:-keep]:
        removed += bool(fs.delete(at(f"{path}/log/v{version:012d}"), False))
    live: set[str] = set()
    names: set[str] = set()
    for version in known[-keep:]:
        found = manifest(spark, path, version)
        live |= {r["file"] for r in found.select("file").collect()}
        names |= {f.rstrip("/").rsplit("/", 2)[-2] for f in found.inputFiles()}
    for status in fs.listStatus(at(f"{path}/manifests")):
        if status.getPath().getName() not in names:
            removed += bool(fs.delete(status.getPath(), True))
    folders = {f.split("/")[0] for f in live}
    for status in fs.listStatus(at(f"{path}/data")):
        folder = status.getPath().getName()
        if folder not in folders:
            removed += bool(fs.delete(status.getPath(), True))
            continue
        for file in fs.listStatus(status.getPath()):
            name = file.getPath().getName()
            if name.endswith(".parquet") and f"{folder}/{name}" not in live:
                removed += bool(fs.delete(file.getPath(), False))
    return removed
