"""Ranked lexical search with bag deduplication.

A document counts only by its bag: how often it holds each term of the items, and its length factor m. Documents of one bag have one
score with every item. So documents are cut down to the items' vocabulary, met by a hash of bag and m, and grouped by the whole bag
and m, which verifies the hash; each class is scored once, and its members stand for it in ascending order of doc_id. No result takes more
than the first k members of a class, so k are kept.

Items come in blocks of BLOCK_TERMS terms: a block's vocabulary and postings are sent to all tasks, and each block is a search of its own, so memory has
a bound whatever the number of items. A task scores its classes by adding up postings and keeps k classes an item.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mapped, written

TOP = 10
B = 75
#: Item terms (repeats counted once) that are sent to all tasks at a time: some 50 MB in a worker.
BLOCK_TERMS = 400_000
# A term is a run of ASCII letters, ASCII digits and characters beyond ASCII; A-Z are lower-cased.
_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_APART = bytes(c for c in range(128) if not chr(c).isalnum())
TERMS = bytes.maketrans(_LETTERS + _APART, _LETTERS.lower() + b" " * len(_APART))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order; none of a null one."""
    return (text or b"").translate(TERMS).split()


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(i, t, n) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for t, n in Counter(terms(text)).items()]
        if rows:
            item, term, n = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array([t.decode() for t in term], pa.string()), pa.array(n, pa.int64())], names=["item_id", "term", "n"])


def item_terms(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, term, n): how often an item has a term. Rows of one item_id (null is one, too) are one item."""
    rows = items.select(F.col(item).cast("long").alias("item_id"), F.make_valid_utf8(F.col(text).cast("string")).cast("binary").alias("text"))
    return mapped(rows, _item_terms, "item_id long, term string, n long").groupBy("item_id", "term").agg(F.sum("n").alias("n"))


def _bags(vocabulary: dict[bytes, int]):
    """doc_id, number of terms, and the bag: places in the vocabulary, ascending, with their counts, as 32-bit pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = vocabulary.get
        for batch in batches:
            sizes, bags = [], []
            for text in batch.column(1):
                found = terms(text.as_py())
                held = Counter(map(place, found))
                held.pop(None, None)
                sizes.append(len(found))
                bags.append(np.array(sorted(held.items()), "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(bags, pa.binary())], names=["doc_id", "n", "bag"])

    return run


def bags(docs: DataFrame, vocabulary: dict[bytes, int], doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, bag) of every row, over whole texts."""
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.make_valid_utf8(F.col(text).cast("string")).cast("binary").alias("text"))
    return mapped(rows, _bags(vocabulary), "doc_id long, n long, bag binary")


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many of a task's documents each term stands."""
    seen: Counter = Counter()
    for batch in batches:
        for bag in batch.column(0):
            seen.update(np.frombuffer(bag.as_py(), "<u4")[::2].tolist())
    if seen:
        place, n = zip(*seen.items(), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(n, pa.int64())], names=["place", "df"])


def classes(found: DataFrame, k: int = TOP) -> DataFrame:
    """(m, bag, members): one row for each bag with each m, and the k smallest doc_id of its documents.

    Rows meet by a hash of bag and m and are grouped by both in full. Of a class, each task passes k rows on at most."""
    keyed = found.select(F.xxhash64("m", "bag").alias("hash"), "m", "bag", "doc_id")
    place = Window.partitionBy("hash", "m", "bag").orderBy("doc_id")
    first = keyed.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k)
    return first.groupBy("hash", "m", "bag").agg(F.array_sort(F.collect_list("doc_id")).alias("members")).drop("hash")


def _scored(item_ids: list[int | None], starts: np.ndarray, items: np.ndarray, weights: np.ndarray, k: int):
    """For each item the documents of the k best classes of a task, k documents of each at most. Postings: of each term the items and their weights."""
    most = float(weights.sum()) * 1e6 if len(weights) else 0.0
    kind = np.float64 if most < 2.0**53 else np.int64  # sums in doubles are exact below 2^53

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int, int]]] = [[] for _ in item_ids]  # heaps of (score, -first member, class)
        floor = np.zeros(len(item_ids), np.int64)
        members: dict[int, list[int]] = {}
        n = 0
        for batch in batches:
            for m, bag, docs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                pairs = np.frombuffer(bag.as_py(), "<u4").reshape(-1, 2).astype(np.int64)
                place, tf = pairs[:, 0], pairs[:, 1]
                value = (1_000_000_000 * tf) // (1000 * tf + 8 * m)
                lengths = starts[place + 1] - starts[place]
                at = np.repeat(starts[place] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
                added = weights[at] * np.repeat(value, lengths)
                if kind is np.float64:
                    score = np.bincount(items[at], added, len(item_ids)).astype(np.int64)
                else:
                    score = np.zeros(len(item_ids), np.int64)
                    np.add.at(score, items[at], added)
                for i in np.flatnonzero((score >= floor) & (score > 0)).tolist():
                    entry = (int(score[i]), -docs[0], n)
                    if len(best[i]) < k:
                        heapq.heappush(best[i], entry)
                    elif entry > best[i][0]:
                        heapq.heapreplace(best[i], entry)
                    else:
                        continue
                    members[n] = docs
                    if len(best[i]) == k:
                        floor[i] = best[i][0][0]
                n += 1
                if len(members) > 4 * k * len(item_ids) + 1000:
                    members = {c: members[c] for heap in best for _, _, c in heap}
        rows = [(item_ids[i], d, s) for i, heap in enumerate(best) for s, _, c in heap for d in members[c]]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["item_id", "doc_id", "score"])

    return run


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _block(docs: DataFrame, rows: list, k: int, doc: str, text: str) -> DataFrame:
    """(item_id, doc_id, score) of one block of items: of each task its best, among them the k best of all."""
    vocabulary = {t.encode(): i for i, t in enumerate(sorted({r["term"] for r in rows}))}
    # a document whose bag is empty scores nothing, but counts in N and L
    found = written(bags(docs, vocabulary, doc, text), "bags")
    n, total = found.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict(mapped(found.select("bag"), _held, "place long, df long").groupBy("place").agg(F.sum("df").alias("df")).collect())  # a row for each term of the block
    ids = sorted({r["item_id"] for r in rows}, key=lambda i: (i is not None, i or 0))
    at = {i: p for p, i in enumerate(ids)}
    postings = sorted((vocabulary[r["term"].encode()], at[r["item_id"]], r["n"]) for r in rows)
    place, items, repeats = (np.array(c, np.int64) for c in zip(*postings, strict=True))
    weights = np.array([r * weight(n, df.get(p, 0)) for p, r in zip(place.tolist(), repeats.tolist(), strict=True)], np.int64)
    starts = np.searchsorted(place, np.arange(len(vocabulary) + 1))
    m = F.lit(100 - B) + F.expr(f"cast((cast({B} as decimal(38,0)) * n * {n}) div {max(1, total)} as long)")
    scored = classes(found.filter((F.length("bag") > 0) & F.col("doc_id").isNotNull()).select("doc_id", m.alias("m"), "bag"), k)
    return mapped(scored.select("m", "bag", "members"), _scored(ids, starts, items, weights, k), "item_id long, doc_id long, score long")


def top_documents(docs: DataFrame, items: DataFrame, k: int = TOP, doc: str = "doc_id", item: str = "item_id", text: str = "text", item_text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents with the highest score above 0 of each item, equal scores by ascending doc_id.

    Whole texts count. Null and empty texts hold no term; documents without a term count neither in N nor L. Rows of one item_id (a null one
    too) are one item with the terms of all. Repeated documents rank one by one; those with a null doc_id have none to be named by and take part in the
    counts alone. Items without a term that a document holds have no rows, and so have empty tables. Other columns are not read. A term's weight takes
    N and df of all documents. What goes through the driver is a block of items and the df of its terms: block_terms rows, or one item's if that is more."""
    rows = written(item_terms(items, item, item_text), "item-terms")
    blocks = max(1, math.ceil(rows.count() / block_terms))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    parts = [part for b in range(blocks) if (part := dealt.filter(F.col("block") == b).collect())]
    found = None
    for part in parts:
        best = _block(docs, part, k, doc, text)
        found = best if found is None else found.union(best)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op13_bag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return top_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), i AS (
  SELECT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), asked AS (
  SELECT item_id, term, count(*) AS repeats FROM i GROUP BY ALL
), total AS (
  SELECT count(*) AS n, CAST(sum(len(terms)) AS BIGINT) AS l FROM d WHERE len(terms) > 0
), tf AS (
  SELECT row, doc_id, n, term, count(*) AS tf
  FROM (SELECT row, doc_id, len(terms) AS n, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * t.n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, total t GROUP BY term, t.n
), s AS (
  SELECT item_id, row, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * tf.n * t.n) // t.l)))) AS BIGINT) AS score
  FROM tf JOIN w USING (term) JOIN asked USING (term), total t GROUP BY ALL
), r AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
"""
