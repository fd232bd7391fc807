"""Kernel regression by chunks of any size, and prediction by blocks of rows and support rows.

A chunk's forecast of a row is the mean over its n support rows of w_j (K(x, x_j) + y_j); its weights make that equal the chunk's own labels with a
small sum of absolute errors (least squares reweighted by the error of the round before). Labels are centred and scaled for each chunk, forecasts scaled back.

fit_exact solves for the weights of small chunks. In fit_large random Fourier features z(x) stand in for the kernel, K(x, y) = E z(x) z(y), which turns the
forecast into z(x) b + c: normal equations of the features, summed in Spark, are all that a round needs, so a chunk may have any number of rows. predict multiplies
packed blocks of rows by packed blocks of support rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.shared import written

#: Rows of a packed block.
BLOCK = 2048
#: Chunks whose sums a task holds at a time.
HELD = 32
#: Parts in which a chunk's sums are added up before the last step.
SALTS = 32
#: Errors below this share of a label's scale weigh as much as this.
LEAST_ERROR = 1e-3

_MODEL = "kind string, n long, dc double, sf double, gamma double, score double, block int, dim int, x binary, y binary, w binary"


def scaled_labels(frame: DataFrame, keys: list[str], label: str) -> DataFrame:
    """frame with n, dc, sf of its chunk (rows, mean label, mean distance from it, 1 where that is 0) and t, the scaled label."""
    mean = frame.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(label).alias("dc"))
    spread = frame.join(mean, keys).groupBy(*keys).agg(F.first("n").alias("n"), F.first("dc").alias("dc"), F.avg(F.abs(F.col(label) - F.col("dc"))).alias("sf"))
    factors = spread.withColumn("sf", F.when(F.col("sf") > 0, F.col("sf")).otherwise(1.0))
    return frame.join(factors, keys).withColumn("t", (F.col(label) - F.col("dc")) / F.col("sf"))


def rbf(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    """exp(-gamma |a_i - b_j|^2), by one matrix product."""
    d2 = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.exp(-gamma * np.maximum(d2, 0))


def reweighted(a: np.ndarray, t: np.ndarray, ridge: float, rounds: int) -> np.ndarray:
    """w with a small sum of |t - a w|: ridge least squares whose rows weigh 1 / |error| from the second round on."""
    r, w = np.ones(len(t)), np.zeros(a.shape[1])
    for _ in range(rounds):
        w = np.linalg.solve(a.T @ (a * r[:, None]) + ridge * np.eye(a.shape[1]), a.T @ (r * t))
        r = 1 / np.maximum(np.abs(t - a @ w), LEAST_ERROR)
    return w


def fit_exact(frame: DataFrame, keys: list[str], gamma: float, ridge: float = 1e-3, rounds: int = 4, features: str = "x", label: str = "y", item: str | None = None) -> DataFrame:
    """Models of chunks (keys): blocks of support rows with their weights. A chunk's kernel matrix is solved in one group, so chunks are small (a few thousand rows);
    fit_large takes others. `item` orders a chunk's rows (by features where there is none). score: mean absolute error on the chunk, in units of the label."""
    named = scaled_labels(frame.select(*keys, F.col(features).alias("x"), F.col(label).cast("double").alias("y"), *([F.col(item).alias("_o")] if item else [])), keys, "y")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, t = np.array(pdf["x"].tolist(), float), pdf["t"].to_numpy(float)
        order = np.argsort(pdf["_o"].to_numpy(), kind="stable") if item else np.lexsort(np.c_[t, x].T)
        x, t, n = x[order], t[order], len(t)
        a = (rbf(x, x, gamma) + t[None, :]) / n
        w = reweighted(a, t, ridge / n, rounds)
        sf = float(pdf["sf"].iloc[0])
        score = float(np.abs(t - a @ w).mean()) * sf
        rows = [(*(pdf[c].iloc[0] for c in keys), "kernel", n, float(pdf["dc"].iloc[0]), sf, gamma, score, i // BLOCK, x.shape[1], x[i : i + BLOCK].tobytes(), t[i : i + BLOCK].tobytes(), w[i : i + BLOCK].tobytes()) for i in range(0, n, BLOCK)]
        return pd.DataFrame(rows, columns=[*keys, *(c.split()[0] for c in _MODEL.split(", "))])

    head = ", ".join(f"{c} {frame.schema[c].dataType.simpleString()}" for c in keys)
    return named.groupBy(*keys).applyInPandas(fit, f"{head}, {_MODEL}")


def waves(dim: int, gamma: float, features: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and phases of random Fourier features of exp(-gamma |x - y|^2)."""
    rng = np.random.default_rng(seed)
    return rng.normal(0, np.sqrt(2 * gamma), (features, dim)), rng.uniform(0, 2 * np.pi, features)


def lifted(x: np.ndarray, gamma: float, features: int, seed: int) -> np.ndarray:
    """z(x), and a last column of ones."""
    w, b = waves(x.shape[1], gamma, features, seed)
    return np.c_[np.sqrt(2 / features) * np.cos(x @ w.T + b), np.ones(len(x))]


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of equal length as rows."""
    rows = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1)


def fit_large(frame: DataFrame, keys: list[str], gamma: float, features: int = 256, ridge: float = 1e-3, rounds: int = 4, seed: int = 1, x: str = "x", label: str = "y") -> DataFrame:
    """Models of chunks (keys) of any size over random Fourier features.

    Each round adds up the chunk's normal equations, rows weighted by their last error: a task keeps one matrix for each of HELD chunks, and matrices are summed
    in SALTS parts before the last step, so no step holds rows of a chunk. score: mean absolute error of the last round's model on the chunk."""
    spark, size = frame.sparkSession, features + 1
    rows = written(scaled_labels(frame.select(*keys, F.col(x).alias("x"), F.col(label).cast("double").alias("y")), keys, "y").select(*keys, "x", "t", "n", "dc", "sf"), "kernel-rows")
    k, head = len(keys), [rows.schema[c] for c in keys]
    summed = T.StructType([*head, T.StructField("salt", T.IntegerType()), T.StructField("data", T.BinaryType())])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each chunk Z'RZ, Z'Rt, the sum of absolute errors and the number of rows."""
        held: dict[tuple, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            columns = [pa.array(c, schema.field(i).type) for i, c in enumerate(zip(*held, strict=True))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([v.tobytes() for v in held.values()], pa.binary())], names=[*keys, "data"])

        for batch in batches:
            schema = batch.schema
            z, t = lifted(_matrix(batch.column(k)), gamma, features, seed), batch.column(k + 1).to_numpy()
            ids = list(zip(*(batch.column(i).to_pylist() for i in range(k)), strict=True)) if k else [()] * len(t)
            places: dict[tuple, list[int]] = {}
            for i, key in enumerate(ids):
                places.setdefault(key, []).append(i)
            for key, at in places.items():
                zk, tk = z[at], t[at]
                if batch.num_columns > k + 2:
                    error = np.abs(tk - zk @ np.frombuffer(batch.column(k + 2)[at[0]].as_py()))
                    r = 1 / np.maximum(error, LEAST_ERROR)
                else:
                    error, r = np.zeros(len(tk)), np.ones(len(tk))
                flat = np.r_[(zk.T @ (zk * r[:, None])).ravel(), zk.T @ (r * tk), error.sum(), len(tk)]
                held[key] = held[key] + flat if key in held else flat
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(d) for d in pdf["data"])
        return pdf.iloc[:1].assign(data=[total.tobytes()])

    def solved(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(d) for d in pdf["data"])
        a, v, n = total[: size * size].reshape(size, size), total[size * size : -2], total[-1]
        beta = np.linalg.solve(a + ridge * n * np.eye(size), v)
        return pdf.iloc[:1][keys].assign(beta=[beta.tobytes()])

    betas = None
    for _ in range(rounds):
        source = rows.select(*keys, "x", "t") if betas is None else rows.select(*keys, "x", "t").join(betas, keys)
        each = source.mapInArrow(sums, T.StructType([*head, T.StructField("data", T.BinaryType())])).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).select(*keys, "salt", "data")
        part = each.groupBy(*keys, "salt").applyInPandas(added, summed)
        betas = written(part.groupBy(*keys).applyInPandas(solved, T.StructType([*head, T.StructField("beta", T.BinaryType())])), "kernel-weights")

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, t = lifted(_matrix(batch.column(k)), gamma, features, seed), batch.column(k + 1).to_numpy()
            weights: dict[bytes, np.ndarray] = {}
            got = [float(abs(t[i] - z[i] @ weights.setdefault(b, np.frombuffer(b)))) for i, b in enumerate(batch.column(k + 2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(k)), pa.array(got)], names=[*keys, "e"])

    error = rows.select(*keys, "x", "t").join(betas, keys).mapInArrow(errors, T.StructType([*head, T.StructField("e", T.DoubleType())])).groupBy(*keys).agg(F.avg("e").alias("e"))
    facts = rows.groupBy(*keys).agg(F.first("n").alias("n"), F.first("dc").alias("dc"), F.first("sf").alias("sf"), F.first(F.size("x")).alias("dim"))
    none = F.lit(b"").cast("binary")
    model = facts.join(betas, keys).join(error, keys)
    return model.select(*keys, F.lit(f"waves {features} {seed}").alias("kind"), "n", "dc", "sf", F.lit(float(gamma)).alias("gamma"), (F.col("e") * F.col("sf")).alias("score"), F.lit(0).alias("block"), "dim", none.alias("x"), none.alias("y"), F.col("beta").alias("w"))


def contribution(kind: str, n: int, gamma: float, dim: int, x: bytes, y: bytes, w: bytes, rows: np.ndarray) -> np.ndarray:
    """What one block of a model adds to the scaled forecasts of rows."""
    weights = np.frombuffer(w)
    if kind == "kernel":
        return (rbf(rows, np.frombuffer(x).reshape(-1, dim), gamma) @ weights + np.frombuffer(y) @ weights) / n
    _, features, seed = kind.split()
    return lifted(rows, gamma, int(features), int(seed)) @ weights


def chosen(models: DataFrame, on: list[str], best: int | None) -> DataFrame:
    """models with `share`, the weight of a model among those of its `on`: scores turned round their extremes, over their mean and number. Only the
    `best` models of the least errors take part (of equals the first by their numbers)."""
    one = models.filter("block = 0")
    rank = F.row_number().over(Window.partitionBy(*on).orderBy("score", "n", "dc"))
    named = one.withColumn("_rank", rank).filter(F.col("_rank") <= best).drop("_rank") if best else one
    identity = [c for c in models.columns if c not in ("block", "x", "y", "w")]
    extremes = one.groupBy(*on).agg((F.max("score") + F.min("score")).alias("_ends"), F.avg("score").alias("_mean"))  # the mean of turned scores is ends - mean
    used = named.groupBy(*on).agg(F.count("*").alias("_used"))
    share = F.when(F.col("_ends") > F.col("_mean"), (F.col("_ends") - F.col("score")) / (F.col("_ends") - F.col("_mean"))).otherwise(1.0) / F.col("_used")
    shares = named.join(extremes, on).join(used, on).select(*identity, share.alias("share"))
    return models.join(shares.dropDuplicates(identity), identity)


def packed_rows(frame: DataFrame, on: list[str], row: list[str], features: str) -> DataFrame:
    """(on, ids, rows binary): blocks of about BLOCK rows of each `on`. ids is a list of the rows' names."""
    sizes = frame.groupBy(*on).agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("_blocks"))
    dealt = frame.select(*on, F.struct(*row).alias("_id"), F.col(features).alias("_x")).join(sizes, on).withColumn("_block", F.pmod(F.xxhash64("_id"), "_blocks"))
    blocks = dealt.groupBy(*on, "_block").agg(F.collect_list(F.struct("_id", "_x")).alias("_rows"))
    return blocks.select(*on, F.transform("_rows", lambda r: r["_id"]).alias("_ids"), F.transform("_rows", lambda r: r["_x"]).alias("_xs"))


def predict(frame: DataFrame, models: DataFrame, on: list[str], row: list[str], features: str = "x", best: int | None = None) -> DataFrame:
    """(on, row, prediction): the weighted mean of the forecasts of the models that share the keys `on`, in units of the label.

    Each pair of a block of rows and a block of a model is one matrix product in a task; contributions are summed by row and model, scaled back, then weighted."""
    k = len(on)
    blocks = packed_rows(frame, on, row, features)
    model = chosen(models, on, best).withColumn("_model", F.xxhash64(*[c for c in models.columns if c not in ("block", "x", "y", "w")]))
    joined = blocks.join(model, on).select(*on, "_ids", "_xs", "_model", "n", "dc", "sf", "gamma", "share", "dim", "kind", F.col("x").alias("_mx"), F.col("y").alias("_my"), F.col("w").alias("_mw"))
    names = ["_ids", "_xs", "_model", "n", "dc", "sf", "gamma", "share", "dim", "kind", "_mx", "_my", "_mw"]
    head = [joined.schema[c] for c in on]
    id_type = joined.schema["_ids"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                m = {c: one.column(k + j)[0] for j, c in enumerate(names)}
                value = {c: m[c].as_py() for c in names if c not in ("_ids", "_xs")}
                ids, lists = m["_ids"].values, m["_xs"].values
                got = contribution(value["kind"], value["n"], value["gamma"], value["dim"], value["_mx"], value["_my"], value["_mw"], _matrix(lists))
                size = len(got)
                keys = [pa.repeat(one.column(j)[0], size) for j in range(k)]
                yield pa.RecordBatch.from_arrays([*keys, ids, *(pa.repeat(m[c], size) for c in ("_model", "dc", "sf", "share")), pa.array(got)], names=[*on, "_id", "_model", "dc", "sf", "share", "p"])

    out = T.StructType([*head, T.StructField("_id", id_type), T.StructField("_model", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("dc", "sf", "share", "p"))])
    parts = joined.mapInArrow(run, out).groupBy(*on, "_id", "_model").agg(F.sum("p").alias("p"), F.first("dc").alias("dc"), F.first("sf").alias("sf"), F.first("share").alias("share"))
    total = parts.groupBy(*on, "_id").agg(F.sum((F.col("p") * F.col("sf") + F.col("dc")) * F.col("share")).alias("prediction"))
    return total.select(*on, *(F.col(f"_id.{c}").alias(c) for c in row), "prediction")
