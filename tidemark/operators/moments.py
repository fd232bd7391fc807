"""Walk-forward fits from running moments.

A window's ridge fit needs the sums X'X and X'y of its rows alone. Rows are cut into blocks of the greatest common divisor of step, length and hold; each block's sums
are taken once, prefix sums run over blocks (inside groups of blocks, with a carry from one row a group), and a window's sums are the difference of two prefixes. No row is copied
into a window, whatever the overlap.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.shared import written

#: Blocks whose prefix sums run in one group.
GROUP = 256


def flat(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """X'X, X'y and the number of rows, with a column of ones behind x."""
    x = np.c_[x, np.ones(len(x))]
    return np.r_[(x.T @ x).ravel(), x.T @ y, len(y)]


def solved(sums: np.ndarray, lam: float) -> np.ndarray:
    """The ridge fit of such sums."""
    k = (math.isqrt(4 * len(sums) - 3) - 1) // 2  # there are k * k + k + 1
    return np.linalg.solve(sums[: k * k].reshape(k, k) + lam * np.eye(k), sums[k * k : -1])


def block_sums(rows: DataFrame, key: str, size: int) -> DataFrame:
    """(k, b, data): the sums of each block of `size` rows by place."""
    kind = rows.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        return pd.DataFrame({"k": pdf["k"].iloc[:1], "b": pdf["b"].iloc[:1], "data": [flat(np.array(pdf["x"].tolist(), float), pdf["y"].to_numpy(float)).tobytes()]})

    dealt = rows.select(F.col(key).alias("k"), F.floor(F.col("place") / size).cast("long").alias("b"), "place", "x", "y")
    return written(dealt.groupBy("k", "b").applyInPandas(run, f"k {kind}, b long, data binary"), "moments")


def prefixes(sums: DataFrame) -> DataFrame:
    """(k, b, upto): the sums of all blocks of a key up to and with b."""
    kind = sums.schema["k"].dataType.simpleString()
    rows = sums.withColumn("g", F.floor(F.col("b") / GROUP).cast("long"))
    add = lambda d: np.cumsum([np.frombuffer(x) for x in d], axis=0)

    def totals(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": pdf["k"].iloc[:1], "g": pdf["g"].iloc[:1], "total": [add(pdf["data"])[-1].tobytes()]})

    def carried(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("g")
        run = add(pdf["total"])
        return pd.DataFrame({"k": pdf["k"], "g": pdf["g"], "before": [x.tobytes() for x in np.r_[np.zeros((1, run.shape[1])), run[:-1]]]})

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("b")
        run = add(pdf["data"]) + np.frombuffer(pdf["before"].iloc[0])
        return pd.DataFrame({"k": pdf["k"], "b": pdf["b"], "upto": [x.tobytes() for x in run]})

    before = rows.groupBy("k", "g").applyInPandas(totals, f"k {kind}, g long, total binary").groupBy("k").applyInPandas(carried, f"k {kind}, g long, before binary")
    return written(rows.join(before, ["k", "g"]).groupBy("k", "g").applyInPandas(inside, f"k {kind}, b long, upto binary"), "prefixes")


def walk_forward(rows: DataFrame, key: str, train: int, step: int, lam: float, hold: int | None = None) -> DataFrame:
    """(key, fold, n, mae): of rows (key, place, x array, y), place counting a key's rows from 0, fold f fits on rows f * step to f * step + train, and is
    held against the `hold` (step) rows behind them, as far as there are any. Rows are read for the blocks' sums and once more for their errors."""
    hold = hold or step
    size = math.gcd(train, step, hold)
    kind = rows.schema[key].dataType.simpleString()
    upto = prefixes(block_sums(rows, key, size))
    per, length = step // size, train // size
    # a window ends before block f * per + length and starts at block f * per
    ends = upto.filter((F.col("b") + 1 >= length) & (F.pmod(F.col("b") + 1 - length, F.lit(per)) == 0)).select("k", F.floor((F.col("b") + 1 - length) / per).cast("long").alias("fold"), F.col("upto").alias("hi"))
    starts = upto.filter(F.pmod(F.col("b") + 1, F.lit(per)) == 0).select("k", F.floor((F.col("b") + 1) / per).cast("long").alias("fold"), F.col("upto").alias("lo"))

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [solved(np.frombuffer(hi) - (np.frombuffer(lo) if lo is not None else 0), lam).tobytes() for hi, lo in zip(pdf["hi"], pdf["lo"], strict=True)]
            yield pd.DataFrame({"k": pdf["k"], "fold": pdf["fold"], "w": got})

    weights = ends.join(starts, ["k", "fold"], "left").mapInPandas(fitted, f"k {kind}, fold long, w binary")
    later = F.col("place") - train
    lowest, highest = F.greatest(F.lit(0).cast("long"), F.ceil((later - hold + 1) / F.lit(step)).cast("long")), F.floor(later / F.lit(step)).cast("long")
    # a row is held out by one fold where hold = step
    held = rows.filter((later >= 0) & (lowest <= highest)).select(F.col(key).alias("k"), F.explode(F.sequence(lowest, highest)).alias("fold"), "x", "y")

    def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [abs(float(np.r_[x, 1.0] @ np.frombuffer(w)) - y) for x, y, w in zip(pdf["x"], pdf["y"], pdf["w"], strict=True)]
            yield pd.DataFrame({"k": pdf["k"], "fold": pdf["fold"], "e": got})

    each = held.join(weights, ["k", "fold"]).mapInPandas(errors, f"k {kind}, fold long, e double")
    return each.groupBy(F.col("k").alias(key), "fold").agg(F.count("*").alias("n"), F.avg("e").alias("mae"))
