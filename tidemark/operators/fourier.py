"""Spectra of whole series, however long.

A series of up to LIMIT rows is transformed in one group. A longer one goes by the chirp method: its transform of n rows is a
circular convolution of M = 2^p rows, M >= 2n - 1, and each transform of M rows is made in four steps: M = R * C rows stand in a table of R rows and C columns;
blocks of columns are transformed and turned by twiddle factors, then blocks of rows are transformed. The product with the chirp's
transform and the first half of the way back need the same blocks of rows, so all of it costs three shuffles of bounded blocks: the rows, and two
rounds of tiles (binary complex numbers). The chirp itself is made where it is needed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.shared import written

from .core import in_order

#: Rows that one group transforms at most.
LIMIT = 1 << 16
#: Bins of a block in the search for peaks.
PEAK_BLOCK = 1 << 14


def _chirp(m: np.ndarray, n: int) -> np.ndarray:
    """exp(-pi i m^2 / n) for whole numbers m, of which the square is reduced first."""
    return np.exp(-1j * np.pi / n * (m.astype(np.int64) ** 2 % (2 * n)))


class Layout:
    """The table of a long series: M = R * C places, and how many columns or rows a block has."""

    def __init__(self, n: int, limit: int):
        p = (2 * n - 2).bit_length()
        self.n, self.size, self.rows = n, 1 << p, 1 << p // 2
        self.columns = self.size // self.rows
        self.wide = max(1, min(self.columns, limit // self.rows))  # columns of a block
        self.high = max(1, min(self.rows, limit // self.columns))  # rows of a block
        self.back = max(1, min(self.columns, limit // self.rows))  # rows of a block on the way back, where the table is turned

    def turned(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Twiddle factors exp(-2 pi i a b / M)."""
        return np.exp(-2j * np.pi / self.size * (np.multiply.outer(a, b) % self.size))

    def chirp_at(self, j: np.ndarray) -> np.ndarray:
        """The filter of the convolution at places 0..M-1."""
        m = np.minimum(j, self.size - j)
        return np.where(m < self.n, np.conj(_chirp(m, self.n)), 0)


def _bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, np.complex128).tobytes()


def _tiles(key_type: pa.DataType, key, n: int, tiles: list[tuple[int, int, bytes]]) -> pa.Table:
    block, at, data = zip(*tiles, strict=True)
    return pa.table({"k": pa.array([key] * len(tiles), key_type), "n": pa.array([n] * len(tiles), pa.int64()), "block": pa.array(block, pa.int64()), "at": pa.array(at, pa.int64()), "data": pa.array(data, pa.binary())})


def _spectrum_table(key_type: pa.DataType, key, n: int, bins: np.ndarray, x: np.ndarray) -> pa.Table:
    size = len(bins)
    return pa.table({"k": pa.array([key] * size, key_type), "bin": pa.array(bins, pa.int64()), "re": x.real.copy(), "im": x.imag.copy(), "n": pa.array([n] * size, pa.int64())})


def _short(table: pa.Table) -> pa.Table:
    """The spectrum of one series."""
    n = table.column("n")[0].as_py()
    x = np.zeros(n)
    x[table.column("j").to_numpy()] = table.column("x").to_numpy()
    return _spectrum_table(table.schema.field("k").type, table.column("k")[0].as_py(), n, np.arange(n // 2 + 1), np.fft.rfft(x))


def _columns(limit: int):
    """A block of columns: series and chirp, transformed along the columns and turned; a tile for each block of rows."""

    def run(table: pa.Table) -> pa.Table:
        n, block = table.column("n")[0].as_py(), table.column("block")[0].as_py()
        at = Layout(n, limit)
        c = np.arange(block * at.wide, (block + 1) * at.wide)
        j = table.column("j").to_numpy()
        x = np.zeros((at.rows, at.wide), complex)
        x[j // at.columns, j % at.columns - c[0]] = table.column("x").to_numpy() * _chirp(j, n)
        b = at.chirp_at(np.arange(at.rows)[:, None] * at.columns + c[None, :])
        turn = at.turned(np.arange(at.rows), c)
        both = np.stack([np.fft.fft(y, axis=0) * turn for y in (x, b)])
        return _tiles(table.schema.field("k").type, table.column("k")[0].as_py(), n, [(i // at.high, block, _bytes(both[:, i : i + at.high])) for i in range(0, at.rows, at.high)])

    return run


def _rows(limit: int):
    """A block of rows: both transformed along the rows and multiplied; the first half of the way back follows on the same rows."""

    def run(table: pa.Table) -> pa.Table:
        n, block = table.column("n")[0].as_py(), table.column("block")[0].as_py()
        at = Layout(n, limit)
        both = np.empty((2, at.high, at.columns), complex)
        for i, data in zip(table.column("at").to_pylist(), table.column("data"), strict=True):
            both[:, :, i * at.wide : (i + 1) * at.wide] = np.frombuffer(data.as_py(), complex).reshape(2, at.high, at.wide)
        x, b = np.fft.fft(both, axis=2)
        k = np.arange(block * at.high, (block + 1) * at.high)
        y = np.fft.fft(np.conj(x * b), axis=1) * at.turned(k, np.arange(at.columns))
        return _tiles(table.schema.field("k").type, table.column("k")[0].as_py(), n, [(i // at.back, block, _bytes(y[:, i : i + at.back])) for i in range(0, at.columns, at.back)])

    return run


def _bins(limit: int):
    """A block on the way back: the last transform, and the bins of the spectrum up to n/2."""

    def run(table: pa.Table) -> pa.Table:
        n, block = table.column("n")[0].as_py(), table.column("block")[0].as_py()
        at = Layout(n, limit)
        y = np.empty((at.rows, at.back), complex)
        for i, data in zip(table.column("at").to_pylist(), table.column("data"), strict=True):
            y[i * at.high : (i + 1) * at.high] = np.frombuffer(data.as_py(), complex).reshape(at.high, at.back)
        got = np.conj(np.fft.fft(y, axis=0)) / at.size
        place = np.arange(at.rows)[:, None] * at.columns + block * at.back + np.arange(at.back)[None, :]
        keep = place <= n // 2
        return _spectrum_table(table.schema.field("k").type, table.column("k")[0].as_py(), n, place[keep], got[keep] * _chirp(place[keep], n))

    return run


def spectrum(df: DataFrame, key: str, value: str, limit: int = LIMIT) -> DataFrame:
    """(key, bin, re, im, n): the Fourier transform of each whole series at bins 0..n/2, where n is its number of rows, less one if that is odd.

    row_ix counts a series' rows from 0. Null values count as 0; series of one row have no spectrum. No group holds more than `limit` rows or places (or the square
    root of four times a series' rows, if that is more)."""
    kind = df.schema[key].dataType
    n = df.groupBy(key).agg((F.floor((F.max("row_ix") + 1) / 2) * 2).cast("long").alias("n"))
    rows = df.select(key, F.col("row_ix").alias("j"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("x")).join(n, key).filter("j < n").select(F.col(key).alias("k"), "j", "x", "n")
    out = T.StructType([T.StructField("k", kind), *(T.StructField(c, t) for c, t in (("bin", T.LongType()), ("re", T.DoubleType()), ("im", T.DoubleType()), ("n", T.LongType())))])
    tiles = T.StructType([T.StructField("k", kind), *(T.StructField(c, T.LongType()) for c in ("n", "block", "at")), T.StructField("data", T.BinaryType())])
    short = rows.filter(F.col("n") <= limit).groupBy("k").applyInArrow(_short, out)
    # M is the least power of two from 2n - 1 on; its square root or half of that is R
    p = F.length(F.bin(2 * F.col("n") - 2)).cast("int")
    r = F.expr("shiftleft(1L, cast(floor(p / 2) as int))")
    c = F.expr("shiftleft(1L, cast(p - floor(p / 2) as int))")
    long = rows.filter(F.col("n") > limit).withColumn("p", p).withColumn("c", c)
    wide = F.greatest(F.lit(1), F.least(F.col("c"), F.floor(F.lit(limit) / r))).cast("long")
    dealt = long.withColumn("block", F.floor(F.pmod("j", "c") / wide).cast("long")).select("k", "j", "x", "n", "block")
    first = dealt.groupBy("k", "block").applyInArrow(_columns(limit), tiles)
    second = first.groupBy("k", "block").applyInArrow(_rows(limit), tiles)
    third = second.groupBy("k", "block").applyInArrow(_bins(limit), out)
    return short.unionByName(third).withColumnRenamed("k", key)


def magnitudes(spectra: DataFrame, digits: int | None = None) -> DataFrame:
    """spectra with m = |re| + |im|, rounded if asked."""
    m = F.abs("re") + F.abs("im")
    return spectra.withColumn("m", m if digits is None else F.round(m, digits))


def _local(table: pa.Table) -> pa.Table:
    """Of each bin of a block the nearest one before and behind in it that is as high or higher (null where there is none)."""
    table = table.sort_by("bin")
    bins, m = table.column("bin").to_numpy(), table.column("m").to_numpy()

    def nearest(values: list[float]) -> list[int]:
        stack, out = [], []
        for i, v in enumerate(values):
            while stack and values[stack[-1]] < v:
                stack.pop()
            out.append(stack[-1] if stack else -1)
            stack.append(i)
        return out

    size = len(m)
    before = np.array(nearest(m.tolist()), int)
    behind = size - 1 - np.array(nearest(m[::-1].tolist()), int)[::-1]
    put = lambda at, no: pa.array(bins[np.clip(at, 0, size - 1)], pa.int64(), mask=no)
    return table.append_column("before", put(before, before < 0)).append_column("behind", put(behind, behind >= size))


def higher_neighbours(df: DataFrame, key: str, block: int = PEAK_BLOCK) -> DataFrame:
    """df (key, bin, m, ...) with `before` and `behind`: the nearest bins at either side that are as high or higher (null: none).

    Blocks of bins look among themselves. A bin that finds none there is the highest so far in its block; for those, which are few as a rule, the nearest
    block with a maximum as high is looked up, and in it the nearest bin among the steps of its running maximum."""
    rows = df.withColumn("_b", F.floor(F.col("bin") / block).cast("long"))
    local = rows.groupBy(key, "_b").applyInArrow(_local, T.StructType([*rows.schema.fields, T.StructField("before", T.LongType()), T.StructField("behind", T.LongType())]))
    local = written(local, "peaks")
    tops = local.groupBy(key, "_b").agg(F.max("m").alias("m"))
    listed = tops.groupBy(key).agg(F.collect_list(F.struct("_b", "m")).alias("_tops"))
    out = local
    for side, sign in (("before", 1), ("behind", -1)):
        # the highest bins of a block seen from the other side: a step of its running maximum has nothing as high behind it
        other = "behind" if sign == 1 else "before"
        steps = local.filter(F.col(other).isNull()).groupBy(key, F.col("_b").alias("_t")).agg(F.collect_list(F.struct("bin", "m")).alias("_steps"))
        asked = local.filter(F.col(side).isNull()).select(key, "bin", "m", "_b").join(listed, key)
        found = F.transform(F.filter("_tops", lambda x: (x["_b"] * sign < F.col("_b") * sign) & (x["m"] >= F.col("m"))), lambda x: x["_b"] * sign)
        target = asked.withColumn("_t", F.array_max(found) * sign).filter(F.col("_t").isNotNull()).select(key, "bin", "m", "_t")
        near = F.array_max(F.transform(F.filter("_steps", lambda x: x["m"] >= F.col("m")), lambda x: x["bin"] * sign)) * sign
        got = target.join(steps, [key, "_t"]).select(key, "bin", near.alias("_far"))
        out = out.join(got, [key, "bin"], "left").withColumn(side, F.coalesce(side, "_far")).drop("_far")
    return out.drop("_b")


def broad_peaks(spectra: DataFrame, key: str, block: int = PEAK_BLOCK) -> DataFrame:
    """(key, bin, m, n, width, score) of the peaks of |spectrum| (column m): a bin's width counts the lower bins at both sides, going outwards until one
    side is as high, or as far as the spectrum goes behind it; score = width + m. Bins without a lower neighbour are no peaks."""
    size = F.floor(F.col("n") / 2) + 1
    rows = higher_neighbours(spectra.select(key, "bin", "m", "n"), key, block)
    none = F.lit(1 << 62)
    left, right = F.coalesce(F.col("bin") - F.col("before"), none), F.coalesce(F.col("behind") - F.col("bin"), none)
    reach = F.least(left, right, size - 1 - F.col("bin"))
    width = F.greatest(F.lit(0), F.least(reach, F.col("bin"), left - 1)) + F.greatest(F.lit(0), F.least(reach, right - 1))
    return rows.select(key, "bin", "m", "n", width.alias("width")).filter("width > 0").withColumn("score", F.col("width") + F.col("m"))


def nth_peak(peaks: DataFrame, key: str, percentile: float) -> DataFrame:
    """(key, bin, m, n, width, score): of each key's peaks by score (of equals the first bin) the one at this share (0 to 1) of their number less one."""
    one = peaks.groupBy(key, "score").agg(F.min_by(F.struct("bin", "m", "n", "width"), "bin").alias("p")).select(key, "p.*", "score")
    placed = in_order(one, key, [F.col("score")], "_place")
    return placed.filter(F.col("_place") - 1 == F.floor(F.lit(percentile) * (F.col("_place_of") - 1))).drop("_place", "_place_of")


def dominant_frequency(df: DataFrame, key: str, value: str, percentile: float = 1.0, sample_rate: float = 1.0, limit: int = LIMIT, block: int = PEAK_BLOCK, digits: int | None = None) -> DataFrame:
    """(key, bin, frequency): half the frequency of the n-th percentile peak of each whole series' spectrum, in units of the sample rate."""
    found = nth_peak(broad_peaks(magnitudes(spectrum(df, key, value, limit), digits), key, block), key, percentile)
    return found.select(key, "bin", (0.5 * F.col("bin") * F.lit(sample_rate) / F.col("n")).alias("frequency"))
