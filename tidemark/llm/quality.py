"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature of a text is cut into bins. Boosting goes round the features in turn; each step fits a shallow tree (two levels
of cuts over the bins of one feature) to the gradient of the log loss, and adds its shrunken leaves to that feature's
look-up table. Then the pairs whose best quadrants explain most of what is left get tables of their own, boosted the
same way. A score adds one entry of each table, for whole batches at once, and goes through the logistic function.

The model is fitted on the driver from at most FIT_ROWS labelled rows (those whose hash is smallest); features,
scores and decisions cover every document in full.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, mapped

FIT_ROWS = 20_000
BINS, COARSE, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, RIDGE, LEAST_HESSIAN = 32, 8, 150, 80, 8, 0.15, 1.0, 1.0
THRESHOLD = 0.3

_GROUPS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"!", b"?", b"|", b"*#$%&@^~=+<>", b".", b",;:", b"\"'()[]{}", b"_/\\-"]
NAMES = ["log_bytes", "log_words", "word_length", "upper", "lower", "digits", "shouts", "questions", "pipes", "symbols", "stops", "commas", "brackets", "joins", "beyond_ascii", "distinct", "top_word", "log_lines", "line_words", "repeated_lines", "upper_of_letters", "long_words", "log_longest_word"]


def features(text: str | None) -> list[float]:
    """NAMES of a whole text: shares are of bytes, words or lines; a text without words has zeros."""
    b = (text or "").encode("utf-8", "surrogatepass")
    words = b.split()
    n, w = len(b), len(words)
    if not w:
        return [float(np.log1p(n)), *[0.0] * (len(NAMES) - 1)]
    counts = [n - len(b.translate(None, g)) for g in _GROUPS]
    seen = Counter(words)
    lines = [x for x in b.split(b"\n") if x]
    lengths = [len(x) for x in seen]
    return [
        float(np.log1p(n)), float(np.log1p(w)), (n - w) / w, *(c / n for c in counts), (n - len(b.decode("utf-8", "surrogatepass"))) / n,
        len(seen) / w, max(seen.values()) / w, float(np.log1p(len(lines))), w / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)),
        counts[0] / max(1, counts[0] + counts[1]), sum(x > 12 for x in lengths) / len(seen), float(np.log1p(max(lengths))),
    ]


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Best gain and place of one cut of a histogram."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    gain = np.where((hl >= LEAST_HESSIAN) & (hr >= LEAST_HESSIAN), gain, -np.inf)
    if not len(gain):
        return -np.inf, 0
    i = int(np.argmax(gain))
    return float(gain[i]), i + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, levels: int = 2) -> np.ndarray:
    """Leaf values over the bins of one feature, from histograms of gradient and hessian."""
    gain, at = _cut(g, h) if levels else (-np.inf, 0)
    if gain <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + RIDGE))
    return np.r_[shallow_tree(g[:at], h[:at], levels - 1), shallow_tree(g[at:], h[at:], levels - 1)]


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best pair of cuts of a two-dimensional histogram."""

    def parts(x):
        c = x.cumsum(0).cumsum(1)
        a, rows, columns = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1]
        return np.stack([a, rows - a, columns - a, c[-1, -1] - rows - columns + a])

    pg, ph = parts(g), parts(h)
    gain = (pg**2 / (ph + RIDGE)).sum(0) - g.sum() ** 2 / (h.sum() + RIDGE)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    leaf = pg[:, i, j] / (ph[:, i, j] + RIDGE)
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaf
    return float(gain[i, j]), out


@dataclass
class Model:
    start: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1) if self.edges else np.zeros((len(x), 0), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.start)
        for j, t in enumerate(self.tables):
            z += t[b[:, j]]
        for i, j, t in self.pairs:
            z += t[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """The model of rows x and labels y (0 or 1). Without rows it scores 0.5, with one class that class's smoothed rate."""
    rate = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(rate / (1 - rate))))
    if len(y) < 2 or y.min() == y.max():
        return model
    model.edges = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    model.coarse = [np.arange(len(e) + 1) * COARSE // (len(e) + 1) for e in model.edges]
    b, z = model.bins(x), np.full(len(y), model.start)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, t in enumerate(model.tables):
            g, h = slopes()
            step = RATE * shallow_tree(np.bincount(b[:, j], g, len(t)), np.bincount(b[:, j], h, len(t)))
            t += step
            z += step[b[:, j]]
    cells = {(i, j): model.coarse[i][b[:, i]] * COARSE + model.coarse[j][b[:, j]] for i, j in combinations(range(x.shape[1]), 2)}
    square = lambda c, v: np.bincount(c, v, COARSE * COARSE).reshape(COARSE, COARSE)
    g, h = slopes()
    strength = {p: quadrants(square(c, g), square(c, h))[0] for p, c in cells.items()}
    model.pairs = [(*p, np.zeros((COARSE, COARSE))) for p in sorted(strength, key=lambda p: (-strength[p], p))[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, t in model.pairs:
            g, h = slopes()
            step = RATE * quadrants(square(cells[i, j], g), square(cells[i, j], h))[1]
            t += step
            z += step.ravel()[cells[i, j]]
    return model


def held_out(key: str = "doc_id") -> Column:
    """Rows that no model learns from: crc32 of the key as text is divisible by 5. Null keys are not among them."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t.as_py()) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "y", "x"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS) -> Model:
    """The model of at most `rows` labels (doc_id, `label`) outside the held-out fifth: those whose hash is smallest.

    Labels that are null or neither 0 nor 1, and those without a document, are left out; a document labelled 0 and 1 counts as both, and of
    several documents of one identifier the one with the smallest features counts, so the model hangs on no order of tasks."""
    usable = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    chosen = usable.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")  # `rows` rows at most
    got = sorted(mapped(joined, _features, "doc_id long, y int, x array<double>").groupBy("doc_id", "y").agg(F.min("x").alias("x")).collect())
    x = np.array([r["x"] for r in got]).reshape(len(got), len(NAMES))
    return fit(x, np.array([r["y"] for r in got], float))


def _scores(model: Model, at: int, keep: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                x = np.array([features(t.as_py()) for t in part.column(at)]).reshape(part.num_rows, len(NAMES))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(model.score(x))], names=[*(f"c{k}" for k in keep), "score"])

    return run


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Rows of docs (columns `keep`, all by default) with the score (0 to 1) of the whole text; nothing but the text counts.

    Null and empty texts get the score of a text without words. Rows stay as they come; a column named like the result is
    kept, and the result takes the name with "_" before it."""
    kept = [docs.columns.index(c) for c in (docs.columns if keep is None else keep)]
    (out,) = fresh(docs.select(*(docs.columns[k] for k in kept)), out)
    schema = ", ".join([*(f"c{k} {docs.schema.fields[k].dataType.simpleString()}" for k in kept), "score double"])
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return mapped(rows, _scores(model, docs.columns.index(text), kept), schema).toDF(*(docs.columns[k] for k in kept), out)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score and decision."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
