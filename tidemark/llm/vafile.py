"""Exact top-k search by inner product in a vector-approximation file.

The file is a table of blocks. Of each vector it holds a cell (one byte a dimension, equal steps between the block's smallest
and largest component) beside the exact vector. A query scans the cells first: they give a lower and an upper bound of every score.
Exact vectors are then read in descending order of upper bound (the order of lower distance bounds) until the k-th best
exact score is above the next upper bound. Queries come in blocks too; each of their blocks meets each block of vectors, and a task
keeps k results a query of the last HELD ones. Equal vectors of a block are read once: of their identifiers
the k+1 smallest can be in a result, so no others are kept there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mapped, written

BLOCK = 4096
QUERY_BYTES = 1 << 20
#: Queries whose best vectors a task holds at a time.
HELD = 32_768
CELLS = 256


def quantised(vectors: DataFrame, key: str, vector: str, scale: int = 1024) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component. Rows with a null key, vector or component, or one that isn't finite, go."""
    x = F.transform(vector, lambda c: c.cast("double"))
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & F.coalesce(whole, F.lit(False))).select(F.col(key).cast("long").alias("vec_id"), F.transform(x, lambda c: F.when(F.abs(c * scale) <= float(1 << 53), F.floor(c * scale).cast("long")).otherwise(F.raise_error(F.lit("a component beyond 2^53 after scaling")).cast("long"))).alias("v"))


def _blocks(k: int):
    def pack(ids: np.ndarray, v: np.ndarray) -> dict:
        order = np.argsort(ids, kind="stable")
        ids, v = ids[order], v[order]
        if v.shape[1]:
            _, first, group = np.unique(v, axis=0, return_index=True, return_inverse=True)
        else:
            first, group = np.zeros(1, np.int64), np.zeros(len(ids), np.int64)
        by = np.argsort(group, kind="stable")
        nth = np.arange(len(ids)) - np.searchsorted(group[by], group[by])
        keep = by[nth <= k]
        distinct = v[first]
        low = distinct.min(axis=0)
        step = (distinct.max(axis=0) - low) // CELLS + 1
        return {"dim": v.shape[1], "low": low.tolist(), "step": step.tolist(), "cells": ((distinct - low) // step).astype(np.uint8).tobytes(), "exact": distinct.tobytes(), "ids": ids[keep].tobytes(), "owner": group[keep].astype(np.int64).tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("dim", pa.int64()), ("low", pa.list_(pa.int64())), ("step", pa.list_(pa.int64())), ("cells", pa.binary()), ("exact", pa.binary()), ("ids", pa.binary()), ("owner", pa.binary())])
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                ids, lists = part.column(0).to_numpy(zero_copy_only=False), part.column(1)
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
                flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(sizes)]
                rows = []
                for dim in np.unique(sizes):
                    at = np.flatnonzero(sizes == dim)
                    v = flat[(ends[at][:, None] + np.arange(dim)).ravel().astype(np.int64)].reshape(len(at), dim).astype(np.int64)
                    rows.append(pack(ids[at], v))
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def build(vectors: DataFrame, k: int) -> DataFrame:
    """The vector-approximation file of a table (vec_id, v): a row for each block, written to the shared folder."""
    return written(mapped(vectors, _blocks(k), "dim long, low array<long>, step array<long>, cells binary, exact binary, ids binary, owner binary"), "vafile")


def score_of(a: np.ndarray, b: np.ndarray) -> int:
    """The inner product in whole numbers; an error if 64 bits can't hold it."""
    s = sum(x * y for x, y in zip(a.tolist(), b.tolist(), strict=True))
    if not -(1 << 63) <= s < 1 << 63:
        raise OverflowError("an inner product beyond 64 bits")
    return s


@dataclass
class Block:
    """A block of the file: cells' middles and half widths, exact vectors, identifiers by distinct vector, and the largest size of each component."""

    mid: np.ndarray
    half: np.ndarray
    exact: np.ndarray
    members: list[np.ndarray]
    most: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Block:
        dim, ids = row["dim"], np.frombuffer(row["ids"], np.int64)
        owner = np.frombuffer(row["owner"], np.int64)
        exact = np.frombuffer(row["exact"], np.int64).reshape(-1, dim) if dim else np.zeros((1, 0), np.int64)
        cells = np.frombuffer(row["cells"], np.uint8).reshape(len(exact), dim)
        low, step = (np.array(row[c], np.float64) for c in ("low", "step"))
        mid = low + cells * step + (step - 1) / 2
        return cls(mid, (step - 1) / 2, exact, np.split(ids, np.flatnonzero(np.diff(owner)) + 1), np.abs(exact).max(axis=0, initial=0).astype(np.float64))


def best_of_block(q: np.ndarray, qid: int, block: Block, floor: tuple | None, k: int) -> tuple[list[tuple[int, int]], int]:
    """(score, vec_id) of the k best of one block for one query of whole numbers, and how many exact vectors were read."""
    x, size = q.astype(np.float64), np.abs(q).astype(np.float64)
    upper = block.mid @ x + float(size @ block.half) + 1e-6 * float(size @ (block.most + block.half))
    found, read, kth = [], 0, floor[0] if floor else -(1 << 63)
    n, narrow = len(upper), float(size @ block.most) < 2.0**62  # in 64 bits unless a sum could leave them
    take = min(n, 4 * k)
    while True:
        order = np.argpartition(-upper, take - 1)[:take] if take < n else np.arange(n)
        order = order[np.argsort(-upper[order], kind="stable")][read:]
        for i in order:
            if upper[i] < kth:
                return found, read
            read += 1
            s = int(block.exact[i] @ q) if narrow else score_of(block.exact[i], q)
            if s >= kth:
                found += [(s, int(x)) for x in block.members[i] if x != qid]
                if len(found) >= k:
                    found = sorted(found, key=lambda x: (-x[0], x[1]))[:k]
                    kth = max(kth, found[-1][0])
        if take >= n:
            return found, read
        take = min(n, take * 4)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries in blocks of QUERY_BYTES at most, one number of components each."""
    for batch in batches:
        held: dict[int, list[tuple[int, list[int]]]] = {}
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.setdefault(len(v), []).append((i, v))
        for dim, rows in held.items():
            for part in batched(rows, max(1, QUERY_BYTES // (8 * max(1, dim)))):
                ids, v = (np.array(x, np.int64) for x in zip(*part, strict=True))
                yield pa.RecordBatch.from_pylist([{"q_dim": dim, "q_ids": ids.tobytes(), "q": v.tobytes()}], pa.schema([("q_dim", pa.int64()), ("q_ids", pa.binary()), ("q", pa.binary())]))


def _search(k: int):
    """Of rows (block of queries, block of vectors) the k best of each query, or fewer where better ones came before in this task."""
    schema = ["query_id", "vec_id", "score"]

    def rows_of(best: dict) -> pa.RecordBatch | None:
        rows = [(qid, i, s) for (_, qid), found in best.items() for s, i in found]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=schema) if rows else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for batch in batches:
            for row in (batch.slice(at, 1).to_pylist()[0] for at in range(batch.num_rows)):
                dim, block = row["dim"], Block.of(row)
                asked = np.frombuffer(row["q_ids"], np.int64)
                for qid, q in zip(asked.tolist(), np.frombuffer(row["q"], np.int64).reshape(len(asked), dim), strict=True):
                    known = best.get((dim, qid), [])
                    found, _ = best_of_block(q, qid, block, known[-1] if len(known) == k else None, k)
                    if found:
                        best[dim, qid] = sorted({*known, *found}, key=lambda x: (-x[0], x[1]))[:k]
                if len(best) > HELD:  # the last step puts all tasks' rows in order anyway
                    yield rows_of(best)
                    best = {}
        if (rest := rows_of(best)) is not None:
            yield rest

    return run


def top_k(vectors: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", every: int = 100, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query with every other row, ties to the smaller vec_id.

    Queries are rows whose key is divisible by `every`. Vectors are compared with those of as many components. Rows with a null
    key, or a null, broken or infinite vector take no part; rows of one key and one vector count once, and a query is not compared with rows
    of its own key. Fewer than k others give fewer rows; an empty table none. Other columns are not read. Scores are exact: a component of over
    2^53 after scaling, or an inner product beyond 64 bits, is an error. Each block of queries meets each block of vectors in one job: a row
    is a pair of blocks, not of vectors, and no query goes through the driver unless all blocks are below Spark's broadcast threshold."""
    rows = quantised(vectors, key, vector, scale)
    file = build(rows, k)
    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).distinct()
    blocks = written(mapped(asked, _packed, "q_dim long, q_ids binary, q binary"), "queries")
    pairs = blocks.crossJoin(file).filter("q_dim = dim").drop("q_dim")
    found = mapped(pairs, _search(k), "query_id long, vec_id long, score long").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_vafile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of every hundredth vector."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 10)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 10
"""
