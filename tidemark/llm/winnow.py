"""Document fingerprints by winnowing.

Every run of K characters gets a rolling hash; of each window of W neighbouring hashes the smallest is chosen, the rightmost on
a tie, and kept with its position. Any shared passage of W+K-1 characters shares a chosen hash, wherever it stands. Texts
shorter than that have one window over all their hashes (or one hash of the whole text).

Each document needs the one behind it, so documents are dealt out by ranges of doc_id, one task each, sorted and read as a stream;
the first document of a range goes to the range before it as well, and the very first to the last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, mapped

K, W = 24, 32
_BASE = np.uint32(0x01000193)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


def rolling(codes: np.ndarray, k: int = K) -> np.ndarray:
    """32-bit hashes of all runs of k code points, by doubling: a run's hash is that of its halves, shifted and added."""
    if not len(codes):
        return np.empty(0, np.uint32)
    k = min(k, len(codes))
    block, size, out, done = codes.astype(np.uint32) + np.uint32(1), 1, None, 0
    n = len(codes)
    while True:
        if k >> (size.bit_length() - 1) & 1:
            part = block[done : done + n - k + 1]
            out = part.copy() if out is None else out * np.uint32(pow(int(_BASE), size, 2**32)) + part
            done += size
        if done == k:
            return _mixed(out)
        block = block[:-size] * np.uint32(pow(int(_BASE), size, 2**32)) + block[size:]
        size *= 2


def winnowed(codes: np.ndarray, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """The chosen hashes and their positions, ascending."""
    h = rolling(codes, k)
    n = len(h)
    if not n:
        return h, np.empty(0, np.int64)
    v = h.astype(np.uint64) << np.uint64(32) | np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64)
    w, size = min(w, n), 1
    while size * 2 <= w:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    if w > size:
        v = np.minimum(v[: n - w + 1], v[w - size : w - size + n - w + 1])
    v = v[np.r_[True, v[1:] != v[:-1]]]
    at = (np.uint64(0xFFFFFFFF) - (v & np.uint64(0xFFFFFFFF))).astype(np.int64)
    return (v >> np.uint64(32)).astype(np.uint32), at


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared distinct hashes over all distinct hashes; two empty fingerprints are alike."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def as_text(hashes: np.ndarray, at: np.ndarray) -> str:
    """hash:position pairs, joined by a space."""
    return " ".join([f"{h:x}:{p}" for h, p in zip(hashes.tolist(), at.tolist(), strict=True)])


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def fingerprint(text: str | None, k: int = K, w: int = W) -> list[tuple[int, int]]:
    """(hash, position) of a text's chosen runs."""
    return [(int(h), int(p)) for h, p in zip(*winnowed(codes_of(text or ""), k, w), strict=True)]


def edited(text: str, following: str) -> str:
    """text with its last quarter (floor) of code points replaced by the first as many (or all) of the following text."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def _pairs(k: int, w: int):
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = None  # range, doc_id, text, its fingerprint
        size = 0
        for batch in batches:
            for part, doc_id, text, ahead in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                text = text.as_py() or ""
                own = winnowed(codes_of(text), k, w)
                if held is not None and held[0] == part:
                    _, before, t, f = held
                    e = edited(t, text)
                    fe = winnowed(codes_of(e), k, w)
                    out.append((before, len(t), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), as_text(*f), as_text(*fe), likeness(f[0], fe[0]), likeness(f[0], own[0])))
                    size += len(t)
                # the first row that looks ahead is all that a range needs of the next one
                held = (None if ahead else part, doc_id, text, own)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)
                    out, size = [], 0
        if out:
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c) for c in columns[1:])], names)

    return run


def _placed(bounds: list[int], firsts: dict[int, int]):
    """pandas UDF of k: its range by binary search in the bounds, and the range before it if k is the first of its own (else null)."""
    edges = np.array(bounds, np.int64)
    starts = np.array(sorted(firsts), np.int64)
    before = np.array([firsts[k] for k in sorted(firsts)], np.int32)

    def run(k: pd.Series) -> pd.DataFrame:
        v = k.to_numpy(np.int64)
        part = np.searchsorted(edges, v).astype(np.int32)
        if not len(starts):
            return pd.DataFrame({"part": part, "ahead": pd.array([None] * len(v), "Int32")})
        at = np.minimum(np.searchsorted(starts, v), len(starts) - 1)
        return pd.DataFrame({"part": part, "ahead": pd.array(np.where(starts[at] == v, before[at], -1), "Int32").copy()})

    run.__annotations__ = {"k": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "part int, ahead int")


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """(part, k, doc_id, text, ahead): documents in ranges of doc_id, each range with the first rows of the next one (ahead).

    Bounds come from an approximate quantile over all identifiers, the first identifier of each range from an exact
    aggregate over that one column; both are as long as there are ranges."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bounds = rows.agg(F.percentile_approx("k", F.lit([i / ranges for i in range(1, ranges)]), F.lit(10_000)).alias("b")).first()["b"] if ranges > 1 else []
    bounds = sorted(set(bounds or []))
    firsts = sorted((r["part"], r["k"]) for r in rows.select("k").withColumn("part", _placed(bounds, {})("k")["part"]).groupBy("part").agg(F.min("k").alias("k")).collect())
    placed = rows.withColumn("p", _placed(bounds, {k: firsts[i - 1][0] for i, (_, k) in enumerate(firsts)})("k"))
    own, other = (F.struct(F.col(c).alias("part"), F.lit(ahead).alias("ahead")) for c, ahead in (("p.part", False), ("p.ahead", True)))
    both = F.when(F.coalesce("p.ahead", F.lit(-1)) < 0, F.array(own)).otherwise(F.array(own, other))
    return placed.select("k", "doc_id", "text", F.explode(both).alias("p")).select("p.part", "k", "doc_id", "text", "p.ahead")


def fingerprint_pairs(docs: DataFrame, k: int = K, w: int = W, ranges: int | None = None) -> DataFrame:
    """Of every document: its fingerprint, that of its edited text, and its likeness to that and to the next document's.

    Null texts are empty; null doc_ids come first; rows of one doc_id follow each other by text. A single document is its
    own next one. Other columns are not read. An empty table gives an empty one."""
    n = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = with_next(docs, n).repartitionById(n, "part").sortWithinPartitions("part", "ahead", "k", "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return mapped(dealt.select("part", "doc_id", "text", "ahead"), _pairs(k, w), schema)


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, next to its edited text's and the next document's."""
    return fingerprint_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
