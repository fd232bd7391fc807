"""Filters over blocks of a series with their halo, in numpy.

A series is cut into blocks of row_ix. A block also gets the rows before it that its first outputs reach back to; in a circular series
these may be the last rows. Blocks are dealt out once and sorted; a task takes one after the other from its Arrow batches, so it holds
one batch and one block. Whatever chain of filters a function applies inside a block costs one exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 4096
#: Masks of more taps are applied by Fourier transforms.
DIRECT = 64


class Mask:
    """A causal mask: sum of taps[l] * x[i - stretch * l]."""

    def __init__(self, taps, stretch: int = 1):
        self.taps, self.stretch = np.asarray(taps, float), stretch
        self.reach = (len(taps) - 1) * stretch
        self.sums = np.cumsum(self.taps)
        self.transforms: dict[int, np.ndarray] = {}

    def __getstate__(self):
        return self.taps, self.stretch

    def __setstate__(self, state):
        self.__init__(*state)

    def over(self, x: np.ndarray) -> np.ndarray:
        """The sums over one run of rows; rows before it count as 0. Long masks go by the product of transforms of run and mask."""
        n = len(x)
        used = min(len(self.taps), (n - 1) // self.stretch + 1) if n else 0
        if used <= DIRECT:
            y = np.zeros(n)
            for k, t in enumerate(self.taps[:used]):
                at = k * self.stretch
                y[at:] += t * x[: n - at]
            return y
        size = 1 << (n + self.reach).bit_length()
        if size not in self.transforms:
            wide = np.zeros(self.reach + 1)
            wide[:: self.stretch] = self.taps
            self.transforms = {size: np.fft.rfft(wide, size)}
        return np.fft.irfft(np.fft.rfft(x, size) * self.transforms[size], size)[:n]

    def headed(self, x: np.ndarray, head: bool) -> np.ndarray:
        """The sums over one run; at the head of a series, where taps reach back over its start, over that of the taps in use."""
        y = self.over(x)
        if head:
            at = np.arange(min(self.reach, len(y)))
            y[: len(at)] /= self.sums[at // self.stretch]
        return y

    def circular(self, x: np.ndarray) -> np.ndarray:
        """The sums over a whole circular series; a mask longer than it is folded."""
        n = len(x)
        if self.reach >= n:
            folded = np.zeros(n)
            np.add.at(folded, np.arange(len(self.taps)) * self.stretch % n, self.taps)
            return Mask(folded).circular(x)
        return self.over(np.r_[x[n - self.reach :], x])[self.reach :]


class Run:
    """What a function is told of a block: whether its first row is the series' first, and whether it is a whole circular series."""

    def __init__(self, head: bool, whole: bool):
        self.head, self.whole = head, whole

    def apply(self, mask: Mask, x: np.ndarray) -> np.ndarray:
        return mask.circular(x) if self.whole else mask.headed(x, self.head)


def dealt(df: DataFrame, key: str, reach: int, circular: bool, block: int) -> DataFrame:
    """df's rows in the blocks they belong to (_own) or reach into, with their place _ix in it (before 0: wrapped round)."""
    own, last = F.floor(F.col("row_ix") / block).cast("long"), F.floor((F.col("row_ix") + reach) / block).cast("long")
    place = lambda b, ix: F.struct(b.alias("b"), ix.cast("long").alias("ix"))
    ahead = F.transform(F.sequence(own, last), lambda b: place(b, F.col("row_ix")))
    if circular:
        wrapped = F.array(place(F.lit(0).cast("long"), F.col("row_ix") - F.col("n_rows")))
        ahead = F.when(F.col("n_rows") <= block, F.array(place(F.lit(0).cast("long"), F.col("row_ix")))).otherwise(F.when(F.col("row_ix") >= F.col("n_rows") - reach, F.concat(ahead, wrapped)).otherwise(ahead))
    spread = df.withColumn("_at", F.explode(ahead)).withColumn("_own", own)
    return spread.select(*df.columns, F.xxhash64(F.col(key)).alias("_run"), F.col("_at.b").alias("_b"), F.col("_at.ix").alias("_ix"), "_own")


def over_blocks(df: DataFrame, key: str, columns: list[str], reach: int, compute: Callable[..., list[np.ndarray]], outs: list[str], circular: bool = False, block: int | None = None) -> DataFrame:
    """df with the columns `outs`: compute(run, *arrays of `columns`) of each block and its halo of `reach` rows, less the halo.

    row_ix counts the rows of each key from 0; a circular series has n_rows. Nulls are not a number."""
    block = max(block or max(BLOCK, 4 * reach), reach + 1)
    names = df.columns
    rows = dealt(df, key, reach, circular, block)
    n_at = names.index("n_rows") if circular else -1
    at = [names.index(c) for c in columns]

    def of_block(part: pa.Table) -> pa.Table:
        ix = part.column("_ix").to_numpy()
        whole = circular and part.column(n_at)[0].as_py() <= block
        own = (part.column("_own").to_numpy() == part.column("_b").to_numpy()) & (ix >= 0)
        got = compute(Run(not circular and ix[0] == 0, whole), *(part.column(i).to_numpy().astype(float) for i in at))
        kept = part.select(range(len(names))).filter(pa.array(own))
        for name, values in zip(outs, got, strict=True):
            kept = kept.append_column(name, pa.array(values[own], pa.float64()))
        return kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            h, b, ix = (table.column(c).to_numpy() for c in ("_run", "_b", "_ix"))
            starts = np.flatnonzero((h[1:] != h[:-1]) | (b[1:] != b[:-1]) | (ix[1:] <= ix[:-1])) + 1
            bounds = [0, *starts.tolist()]
            for i, j in zip(bounds, bounds[1:], strict=False):
                yield from of_block(table.slice(i, j - i)).to_batches()
            held = table.slice(bounds[-1]).combine_chunks().to_batches()
        if held and held[0].num_rows:
            yield from of_block(pa.Table.from_batches(held)).to_batches()

    ordered = rows.repartition(F.col(key), F.col("_b")).sortWithinPartitions(key, "_b", "_ix")
    return ordered.mapInArrow(run, T.StructType([*df.schema.fields, *(T.StructField(o, T.DoubleType()) for o in outs)]))
