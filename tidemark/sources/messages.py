"""Messages as a stream, and responses as a sink.

MessageSource reads files of JSON lines from a folder as a stream, `message` by name: one file is one offset, in order of names, so a query that is started again goes on behind the
last file of its checkpoint. Partitions are files; executors read them. The folder is one that Spark's executors and driver see as a path of their own (a mounted one);
where it is not, spark.readStream.text with exploded_messages does the same through Hadoop's file systems.

Responses wait in the state until all columns of a (key, time) are there; what the watermark passes before is an error, and so the query stops, unless the caller
takes incomplete rows apart. ResponseSink writes them with a commit for each epoch: files are written under a name that readers skip, and renamed at the commit; an epoch
that is done again replaces its own file.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage

from tidemark.streaming.jobs import Timed, with_state

MESSAGE = "file string, line long, value string"


@dataclass
class File(InputPartition):
    path: str


class MessageReader(DataSourceStreamReader):
    """Files of a folder in order of their names; the offset is the name of the last one taken."""

    def __init__(self, folder: str):
        self.folder = folder

    def _names(self, after: str = "") -> list[str]:
        return sorted(n for n in os.listdir(self.folder) if not n.startswith((".", "_")) and n > after)

    def initialOffset(self) -> dict:
        return {"file": ""}

    def latestOffset(self) -> dict:
        names = self._names()
        return {"file": names[-1] if names else ""}

    def partitions(self, start: dict, end: dict) -> list[File]:
        return [File(f"{self.folder}/{n}") for n in self._names(start["file"]) if n <= end["file"]]

    def commit(self, end: dict) -> None:
        pass

    def read(self, partition: File) -> Iterator[tuple]:
        with open(partition.path, encoding="utf-8") as lines:
            for i, line in enumerate(lines):
                if line.strip():
                    yield os.path.basename(partition.path), i, line.rstrip("\n")


class MessageSource(DataSource):
    """spark.readStream.format("message").load(folder): (file, line, value) of each message."""

    @classmethod
    def name(cls) -> str:
        return "message"

    def schema(self) -> str:
        return MESSAGE

    def streamReader(self, schema) -> MessageReader:
        return MessageReader(self.options["path"])


@dataclass
class Part(WriterCommitMessage):
    name: str | None


class ResponseWriter(DataSourceStreamWriter):
    """JSON lines of an epoch; hidden until the commit."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, rows: Iterator) -> Part:
        os.makedirs(self.folder, exist_ok=True)
        name, n = f"_{uuid.uuid4().hex}", 0
        with open(f"{self.folder}/{name}", "w", encoding="utf-8") as out:
            for row in rows:
                out.write(json.dumps(row.asDict(recursive=True), default=str) + "\n")
                n += 1
        if not n:
            os.remove(f"{self.folder}/{name}")
        return Part(name if n else None)

    def commit(self, messages: list, batchId: int) -> None:
        for old in Path(self.folder).glob(f"epoch-{batchId:012d}-*.json"):
            old.unlink()
        for i, part in enumerate(p for p in messages if p is not None and p.name):
            os.rename(f"{self.folder}/{part.name}", f"{self.folder}/epoch-{batchId:012d}-{i:05d}.json")

    def abort(self, messages: list, batchId: int) -> None:
        for part in messages:
            if part is not None and part.name:
                Path(self.folder, part.name).unlink(missing_ok=True)


class ResponseSink(DataSource):
    """stream.writeStream.format("response").start(folder)."""

    @classmethod
    def name(cls) -> str:
        return "response"

    def streamWriter(self, schema, overwrite: bool) -> ResponseWriter:
        return ResponseWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MessageSource)
    spark.dataSource.register(ResponseSink)


def message_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The messages of a folder as a stream."""
    register(spark)
    return spark.readStream.format("message").load(folder)


class IncompleteResponse(ValueError):
    """A response lacks a column."""


def complete(results: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row for each key with a value of every column, of rows (keys, column, value); several values of one column count as the greatest. A key without
    one of them is an error when the rows are read."""
    wide = results.groupBy(*keys).agg(*(F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in columns))
    lacking = F.filter(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in columns)), lambda x: x.isNotNull())
    said = F.concat(F.lit("incomplete response "), F.to_json(F.struct(*keys)), F.lit(": no "), F.array_join(lacking, ", "))
    checked = F.when(F.size(lacking) > 0, F.raise_error(said).cast("double")).otherwise(F.col(columns[0]))
    return wide.withColumn(columns[0], checked)


class Pairs(Timed):
    """See response_stream. Each key of the stream's is a bucket of the results' keys. State: the values of pairs that lack a column, and nothing of others."""

    def __init__(self, columns: list[str], strict: bool):
        self.columns, self.strict, self.new = columns, strict, []

    def set_up(self, handle) -> None:
        self.values = handle.getMapState("values", "key string, t long", "value array<double>, there array<boolean>")

    def take(self, key, rows: pd.DataFrame) -> None:
        self.new.append(rows[["key", "t", "place", "value"]])

    def due(self, key, watermark: int) -> tuple[pd.DataFrame, int | None]:
        k = len(self.columns)
        rows, self.new = pd.concat(self.new, ignore_index=True) if self.new else None, []
        held = dict(self.values.iterator()) if self.values.exists() else {}
        if rows is not None:
            pair = rows.groupby(["key", "t"], sort=False, dropna=False).ngroup().to_numpy()
            first = np.unique(pair, return_index=True)[1]
            names = rows["key"].to_numpy(object)[first]
            names[pd.isna(names)] = None
            t = rows["t"].to_numpy(np.int64)[first]
            values, there = np.zeros((len(first), k)), np.zeros((len(first), k), bool)
            values[pair, rows["place"].to_numpy()] = rows["value"].to_numpy()
            there[pair, rows["place"].to_numpy()] = True
        else:
            names, t, values, there = np.empty(0, object), np.empty(0, np.int64), np.empty((0, k)), np.empty((0, k), bool)
        fresh = len(names)
        if held:
            at = {p: i for i, p in enumerate(zip(names, t.tolist(), strict=True))}
            for p, (value, was) in held.items():
                if (i := at.get(p)) is not None:
                    old = np.array(was) & ~there[i]
                    values[i, old], there[i] = np.array(value)[old], there[i] | old
            alone = [p for p in held if p not in at]
            if alone:
                names, t = np.concatenate([names, np.array([p[0] for p in alone], object)]), np.concatenate([t, np.array([p[1] for p in alone], np.int64)])
                values, there = np.concatenate([values, [held[p][0] for p in alone]]), np.concatenate([there, np.array([held[p][1] for p in alone], bool)])
        whole = there.all(axis=1)
        out = whole | (t < watermark)
        if self.strict and (bad := np.flatnonzero(out & ~whole)).size:
            i = bad[np.argmin(t[bad])]
            raise IncompleteResponse(f"{names[i]} at {t[i]}: no {', '.join(c for c, has in zip(self.columns, there[i], strict=True) if not has)}")
        for i in np.flatnonzero(~out[:fresh]):
            self.values.updateValue((names[i], int(t[i])), (values[i].tolist(), there[i].tolist()))
        for p in [p for p, leaves in zip(zip(names, t.tolist(), strict=True), out, strict=True) if leaves and p in held] if held else ():
            self.values.removeKey(p)
        got = pd.DataFrame({"bucket": key[0], "key": names[out], "t": t[out]} | {c: np.where(there[out, i], values[out, i], np.nan) for i, c in enumerate(self.columns)})
        return got, int(t[~out].min()) + 1000 if not out.all() else None


def response_stream(results: DataFrame, key: str, time: str, columns: list[str], late: str, strict: bool = True, buckets: int = 1024):
    """(key, time, columns) of a stream (key, time timestamp, column, value), each as soon as all columns are there.

    A pair that the watermark passes without one of the columns is an error (strict) or comes out with what it has. Nothing of a pair is left in the state
    once it is out; a repeated value of a pair that is out begins a new one. Keys share `buckets` states, so that a batch is worked on in as many parts and not one
    key at a time; a pair that comes whole in one batch is never put into the state. Rows without a time belong to no response and are left out."""
    kind = results.schema[key].dataType
    place = F.array_position(F.array(*map(F.lit, columns)), F.col("column")) - 1
    rows = results.withWatermark(time, late).filter(F.col("column").isin(columns) & F.col("value").isNotNull() & F.col(time).isNotNull())
    rows = rows.select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket"), F.col(key).cast("string").alias("key"), time, F.unix_micros(time).alias("t"), place.alias("place"), F.col("value").cast("double").alias("value"))
    got = with_state(rows, ["bucket"], Pairs(columns, strict), ", ".join(["key string", "t long", *(f"`{c}` double" for c in columns)]))
    return got.select(F.col("key").cast(kind).alias(key), "t", *(F.col(f"`{c}`") for c in columns))
