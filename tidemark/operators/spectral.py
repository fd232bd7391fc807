"""Spectral transforms as table operators.

A linear filter reads the rows behind each row. Series are cut into blocks of row_ix; a block also gets the rows its first outputs
reach back to (its halo), so a row moves once, with its halo copies, for all filters of a transform (see blocks). Circular filters let the halo
wrap round the series' ends.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.shared import written

from .blocks import BLOCK, Mask, over_blocks
from .core import grid


def _array(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def with_size(df: DataFrame, key: str) -> DataFrame:
    """df with n_rows, the rows of its series. Steps that need it carry it along, so a chain of them reads its source once."""
    return df.join(df.groupBy(key).agg((F.max("row_ix") + 1).alias("n_rows")), key)


def behind(df: DataFrame, key: str, value: str, reach: int, circular: bool = False, block: int = BLOCK) -> DataFrame:
    """df with `_x`: the value and those of up to `reach` rows before it, oldest first."""
    block = max(block, reach + 1)
    rows = df.withColumn("_ix", F.col("row_ix"))
    if circular:
        rows = (rows if "n_rows" in df.columns else with_size(rows, key)).withColumn("_rows", F.col("n_rows")).withColumn("_turn", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("row_ix") + reach) / F.col("_rows")).cast("long"))))
        rows = rows.withColumn("_ix", F.col("row_ix") - F.col("_turn") * F.col("_rows")).drop("_rows", "_turn")
    own = F.floor(F.col("_ix") / block).cast("long")
    last = F.floor((F.col("_ix") + reach) / block).cast("long")
    dealt = rows.withColumn("_own", own).withColumn("_b", F.explode(F.sequence(own, last)))
    w = Window.partitionBy(key, "_b").orderBy("_ix").rowsBetween(-reach, 0)
    return dealt.withColumn("_x", F.collect_list(value).over(w)).filter((F.col("_own") == F.col("_b")) & (F.col("_ix") >= 0)).drop("_own", "_b", "_ix")


def bank(df: DataFrame, key: str, value: str, masks: dict[str, Mask], circular: bool = False, block: int | None = None) -> DataFrame:
    """df with a column for each mask: its sums over the value. All masks read a row and its halo in one exchange."""
    df = with_size(df, key) if circular and "n_rows" not in df.columns else df
    reach = max(m.reach for m in masks.values())
    return over_blocks(df, key, [value], reach, lambda run, x: [run.apply(m, x) for m in masks.values()], [*masks], circular, block)


def fir(df: DataFrame, key: str, value: str, taps: list[float], stretch: int = 1, out: str = "filtered", circular: bool = False, block: int | None = None, keep_size: bool = False) -> DataFrame:
    """df with `out` = sum of taps[l] * value[row_ix - stretch * l] (keep_size: and with n_rows, for circular filters).

    At the head of a series, where taps reach back over its start, the sum is divided by that of the taps in use. Masks of
    more than blocks.DIRECT taps go by Fourier transforms of a block and the mask (overlap-save)."""
    got = bank(df, key, value, {out: Mask(taps, stretch)}, circular, block)
    return got if keep_size or "n_rows" in df.columns else got.select(*df.columns, out)


def low_pass(length: int, f: float) -> list[float]:
    """Taps 2f sinc(2f (i - length/2)) under a Blackman window, not normalised."""
    out = []
    for i in range(length):
        x = 2 * f * (i - length / 2)
        sinc = 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x)
        out.append(2 * f * sinc * (0.42 - 0.5 * math.cos(2 * math.pi * i / (length - 1)) + 0.08 * math.cos(4 * math.pi * i / (length - 1))))
    return out


#: Rows that a pass of emd may reach back at most, unless one mask does.
HALO = 16_384


def sifted(masks: list[Mask], siftings: int):
    """The modes of a block by these masks, and the rest."""

    def run(run, x):
        rest, modes = x, []
        for mask in masks:
            mode = rest
            for _ in range(siftings):
                mode = mode - run.apply(mask, mode)
            modes.append(mode)
            rest = rest - mode
        return [*modes, rest]

    return run


def emd(df: DataFrame, key: str, value: str, masks: list[list[float]], siftings: int, cut=None, block: int | None = None, halo: int = HALO) -> DataFrame:
    """(key, row_ix, level, value): for each mask the rest loses its mode, the last rest is level 0.

    A mode starts as the rest and loses its own filtered self `siftings` times. All siftings of all masks that together reach back `halo` rows at most
    run in one pass over the blocks. cut: what cuts the plan between passes, a table in the shared folder by default, which its caller may remove."""
    cut = cut or (lambda df: written(df, "emd"))
    rest = df.select(key, "row_ix", F.col(value).cast("double").alias("_rest"))
    ready, levels, at = [Mask(m) for m in masks], None, 0
    while at < len(ready):
        upto = at + 1
        while upto < len(ready) and siftings * sum(m.reach for m in ready[at : upto + 1]) <= halo:
            upto += 1
        part = ready[at:upto]
        names = [f"_m{i}" for i in range(at, upto)]
        got = over_blocks(rest, key, ["_rest"], siftings * sum(m.reach for m in part), sifted(part, siftings), [*names, "_left"], block=block)
        got = cut(got) if upto < len(ready) else got
        each = [F.struct(F.lit(len(masks) - i).alias("level"), F.col(f"_m{i}").alias("value")) for i in range(at, upto)]
        each += [F.struct(F.lit(0).alias("level"), F.col("_left").alias("value"))] if upto == len(ready) else []
        level = got.select(key, "row_ix", F.explode(F.array(*each)).alias("_l")).select(key, "row_ix", "_l.level", "_l.value")
        levels = level if levels is None else levels.unionByName(level)
        rest, at = got.select(key, "row_ix", F.col("_left").alias("_rest")), upto
    return levels if levels is not None else rest.select(key, "row_ix", F.lit(0).alias("level"), F.col("_rest").alias("value"))


def recompose(levels: DataFrame, keys: list[str], product: bool = False, skip: int | None = None, factors: DataFrame | None = None) -> DataFrame:
    """(keys, value): the sum of levels, or their product. `skip`, the transitional level, takes no part; `factors` (level, dc, sf) scale the levels' values back first."""
    used = levels if skip is None else levels.filter(F.col("level") != skip)
    if factors is not None:
        used = used.join(factors, "level").withColumn("value", F.col("value") * F.col("sf") + F.col("dc"))
    return used.groupBy(*keys).agg((F.product if product else F.sum)("value").alias("value"))


HAAR = [math.sqrt(0.5), math.sqrt(0.5)]


def high_of(taps: list[float]) -> list[float]:
    """The wavelet filter that belongs to a scaling filter (quadrature mirror)."""
    n = len(taps)
    return [(-1) ** i * taps[n - 1 - i] for i in range(n)]


def daubechies4() -> list[float]:
    """The scaling filter of two vanishing moments, in closed form."""
    r, d = math.sqrt(3), 4 * math.sqrt(2)
    return [(1 + r) / d, (3 + r) / d, (3 - r) / d, (1 - r) / d]


def _cascade(low: list[Mask], high: list[Mask]):
    """w1..wJ and v of a block: each level filters what the one before left."""

    def run(run, v):
        out = []
        for lo, hi in zip(low, high, strict=True):
            out.append(run.apply(hi, v))
            v = run.apply(lo, v)
        return [*out, v]

    return run


def _cascaded(df: DataFrame, key: str, value: str, taps: list[float], levels: int, scale: float, block: int | None = None) -> DataFrame:
    """(key, row_ix, n_rows, w1..wJ, v) by circular filters whose taps are 2^(j-1) rows apart at level j, all levels in one pass."""
    low, high = ([Mask([t * scale for t in f], 2**j) for j in range(levels)] for f in (taps, high_of(taps)))
    rows = with_size(df.select(key, "row_ix", F.col(value).cast("double").alias("_x")), key)
    outs = [*(f"w{j}" for j in range(1, levels + 1)), "v"]
    return over_blocks(rows, key, ["_x"], sum(m.reach for m in low), _cascade(low, high), outs, True, block).drop("_x")


def _recascaded(df: DataFrame, key: str, taps: list[float], levels: int, scale: float, block: int | None = None) -> DataFrame:
    """(key, row_ix, value) from w1..wJ and v: the same filters reaching forward, from the last level to the first. The series is turned round for it."""
    low, high = ([Mask([t * scale for t in f], 2**j) for j in range(levels)] for f in (taps, high_of(taps)))
    columns = [*(f"w{j}" for j in range(1, levels + 1)), "v"]

    def run(run, *x):
        v = x[-1]
        for j in range(levels - 1, -1, -1):
            v = run.apply(high[j], x[j]) + run.apply(low[j], v)
        return [v]

    turn = F.col("n_rows") - 1 - F.col("row_ix")
    rows = (df if "n_rows" in df.columns else with_size(df, key)).select(key, turn.alias("row_ix"), "n_rows", *columns)
    return over_blocks(rows, key, columns, sum(m.reach for m in low), run, ["value"], True, block).select(key, turn.alias("row_ix"), "value")


def modwt(df: DataFrame, key: str, value: str, taps: list[float], levels: int, block: int | None = None) -> DataFrame:
    """df's (key, row_ix) with w1..wJ and v: maximal-overlap wavelet transform, circular, filters over sqrt(2)."""
    return _cascaded(df, key, value, taps, levels, math.sqrt(0.5), block)


def imodwt(df: DataFrame, key: str, taps: list[float], levels: int, block: int | None = None) -> DataFrame:
    """(key, row_ix, value) from modwt's table."""
    return _recascaded(df, key, taps, levels, math.sqrt(0.5), block)


def dwt(df: DataFrame, key: str, value: str, taps: list[float]) -> DataFrame:
    """(key, row_ix, low, high) of half as many rows: circular filters, every second row kept. Series have an even length."""
    rows = df.select(key, "row_ix", F.col(value).cast("double").alias("x"), *(["n_rows"] if "n_rows" in df.columns else []))
    got = bank(rows, key, "x", {"low": Mask(taps), "high": Mask(high_of(taps))}, True)
    return got.filter("row_ix % 2 = 1").select(key, F.floor(F.col("row_ix") / 2).cast("long").alias("row_ix"), "low", "high", F.floor(F.col("n_rows") / 2).cast("long").alias("n_rows"))


def idwt(df: DataFrame, key: str, taps: list[float]) -> DataFrame:
    """(key, row_ix, value): the inverse of dwt. Each coefficient spreads over the rows its taps came from."""
    spread = df.select(key, (2 * F.col("n_rows")).alias("_n"), F.col("row_ix").alias("_r"), "low", "high", F.posexplode(F.arrays_zip(_array(taps), _array(high_of(taps)))).alias("_l", "_t"))
    at = F.pmod(2 * F.col("_r") + 1 - F.col("_l"), F.col("_n"))
    return spread.groupBy(key, at.alias("row_ix")).agg(F.sum(F.col("low") * F.col("_t")["0"] + F.col("high") * F.col("_t")["1"]).alias("value"))


def swt(df: DataFrame, key: str, value: str, taps: list[float], levels: int, block: int | None = None) -> DataFrame:
    """(key, row_ix, w1..wJ, v): the undecimated transform, circular; the filters of level j reach 2^(j-1) rows a tap. A series whose length is no multiple
    of 2^levels is filled up with its last value (see padded)."""
    return _cascaded(df, key, value, taps, levels, 1.0, block)


def iswt(df: DataFrame, key: str, taps: list[float], levels: int, block: int | None = None) -> DataFrame:
    """(key, row_ix, value) from swt's table: of both filters turned forward, half the sum at each level."""
    return _recascaded(df, key, taps, levels, 0.5, block)


def padded(df: DataFrame, key: str, value: str, levels: int) -> DataFrame:
    """(key, row_ix, value, n_own): rows up to the next multiple of 2^levels, those behind the series' own n_own with its last value."""
    own = df.select(key, "row_ix", F.col(value).cast("double").alias("value"))
    ends = own.groupBy(key).agg((F.max("row_ix") + 1).alias("n_own"), F.max_by("value", "row_ix").alias("value"))
    full = F.ceil(F.col("n_own") / 2**levels).cast("long") * 2**levels
    more = grid(ends.withColumn("_full", full).filter("_full > n_own"), "n_own", "_full", 1, "row_ix").select(key, "row_ix", "value", "n_own")
    return own.join(ends.select(key, "n_own"), key).select(key, "row_ix", "value", "n_own").unionByName(more)


def dwt_symmetric(df: DataFrame, key: str, value: str, taps: list[float]) -> DataFrame:
    """(key, row_ix, low, high, n_rows): the transform of a series mirrored at both ends (its edge rows twice), floor((n + L - 1) / 2) coefficients.

    Series have as many rows as taps at least."""
    size = len(taps)
    n = df.groupBy(key).agg((F.max("row_ix") + 1).alias("n_rows")).withColumn("_to", F.floor((F.col("n_rows") + size - 1) / 2).cast("long"))
    asked = grid(n.withColumn("_from", F.lit(0).cast("long")), "_from", "_to", 1, "k").select(key, "n_rows", "k", F.posexplode(F.arrays_zip(_array(taps), _array(high_of(taps)))).alias("_l", "_t"))
    at = 2 * F.col("k") + 1 - F.col("_l")
    source = F.when(at < 0, -1 - at).when(at >= F.col("n_rows"), 2 * F.col("n_rows") - 1 - at).otherwise(at)
    rows = df.select(key, F.col("row_ix").alias("_s"), F.col(value).cast("double").alias("_x"))
    both = asked.withColumn("_s", source).join(rows, [key, "_s"])
    return both.groupBy(key, F.col("k").alias("row_ix"), "n_rows").agg(F.sum(F.col("_x") * F.col("_t")["0"]).alias("low"), F.sum(F.col("_x") * F.col("_t")["1"]).alias("high")).select(key, "row_ix", "low", "high", "n_rows")


def idwt_symmetric(df: DataFrame, key: str, taps: list[float]) -> DataFrame:
    """(key, row_ix, value): the inverse of dwt_symmetric, for orthonormal taps."""
    spread = df.select(key, "n_rows", F.col("row_ix").alias("_r"), "low", "high", F.posexplode(F.arrays_zip(_array(taps), _array(high_of(taps)))).alias("_l", "_t"))
    rows = spread.withColumn("at", 2 * F.col("_r") + 1 - F.col("_l")).filter("at >= 0 AND at < n_rows")
    return rows.groupBy(key, F.col("at").alias("row_ix")).agg(F.sum(F.col("low") * F.col("_t")["0"] + F.col("high") * F.col("_t")["1"]).alias("value"))


def best_basis(df: DataFrame, key: str, value: str, taps: list[float], depth: int) -> DataFrame:
    """(key, node, cost): the nodes of the packet tree whose Shannon costs together are least; a node stays whole where its own cost is no larger
    than that of the best below it. node is the path from the root ("")."""
    x2 = F.col("value") * F.col("value")
    levels = [df.select(key, F.lit("").alias("node"), F.col(value).cast("double").alias("value"))] + [packets(df, key, value, taps, d) for d in range(1, depth + 1)]
    costs = [t.groupBy(key, "node").agg(F.round(F.sum(F.when(x2 > 0, -x2 * F.log(x2)).otherwise(0.0)), 9).alias("cost")) for t in levels]
    best = written(costs[-1].select(key, "node", "cost", F.col("cost").alias("least"), F.lit(False).alias("split")), "basis")
    tree = [best]
    for level in reversed(costs[:-1]):
        below = best.groupBy(key, F.expr("left(node, length(node) - 1)").alias("node")).agg(F.sum("least").alias("below"))
        best = written(level.join(below, [key, "node"]).select(key, "node", "cost", F.least("cost", "below").alias("least"), (F.col("below") < F.col("cost")).alias("split")), "basis")
        tree.append(best)
    out, reached = None, tree[-1]
    for under in [*reversed(tree[:-1]), None]:
        whole = reached.filter("NOT split").select(key, "node", "cost")
        out = whole if out is None else out.unionByName(whole)
        if under is not None:
            opened = reached.filter("split").select(key, F.explode(F.array(F.concat("node", F.lit("0")), F.concat("node", F.lit("1")))).alias("node"))
            reached = under.join(opened, [key, "node"], "left_semi")
    return out


def packets(df: DataFrame, key: str, value: str, taps: list[float], depth: int) -> DataFrame:
    """(key, node, row_ix, value): DWT applied to both branches `depth` times; node is the path, 1 for high."""
    now = with_size(df.select(key, F.lit("").alias("node"), "row_ix", F.col(value).cast("double").alias("value")), key)
    for _ in range(depth):
        both = now.withColumn("_k", F.struct(key, "node"))
        halves = dwt(both, "_k", "value", taps)
        branch = F.explode(F.array(F.struct(F.lit("0").alias("bit"), F.col("low").alias("value")), F.struct(F.lit("1").alias("bit"), F.col("high").alias("value")))).alias("_h")
        now = halves.select(F.col(f"_k.{key}").alias(key), "_k.node", "row_ix", "n_rows", branch).select(key, F.concat("node", "_h.bit").alias("node"), "row_ix", "n_rows", "_h.value")
    return now.drop("n_rows")


def morlet(scale: float, omega: float = 5.0, width: float = 4.0) -> list[float]:
    """Real Morlet taps at a scale, cut off at `width` deviations, of unit energy."""
    half = max(1, int(width * scale))
    raw = [math.exp(-0.5 * (i / scale) ** 2) * math.cos(omega * i / scale) for i in range(-half, half + 1)]
    size = math.sqrt(sum(x * x for x in raw))
    return [x / size for x in raw]


def by_scale(got: DataFrame, key: str, scales: list[float], columns: dict[str, list[str]]) -> DataFrame:
    """(key, row_ix, scale, columns) of a table with a column for each scale."""
    each = [F.struct(F.lit(float(s)).alias("scale"), *(F.col(names[i]).alias(c) for c, names in columns.items())) for i, s in enumerate(scales)]
    return got.select(key, "row_ix", "n_rows", F.explode(F.array(*each)).alias("_s")).select(key, "row_ix", "n_rows", "_s.*")


def cwt(df: DataFrame, key: str, value: str, scales: list[float]) -> DataFrame:
    """(key, row_ix, scale, value): a causal, circular filter of Morlet taps for each scale, all in one exchange."""
    names = [f"_c{i}" for i in range(len(scales))]
    got = bank(df.select(key, "row_ix", value), key, value, {n: Mask(morlet(s)) for n, s in zip(names, scales, strict=True)}, True)
    return by_scale(got, key, scales, {"value": names}).drop("n_rows")


#: Mother wavelets at zero and their reconstruction factors, of a published table for these three (fixed values).
MOTHERS = {"morlet": (math.pi**-0.25, 0.776), "paul": (1.079, 1.132), "dog": (0.867, 3.541)}


def complex_mother(kind: str, scale: float, width: float = 4.0) -> list[complex]:
    """Taps of a mother wavelet at a scale, from -half to half and of unit energy in the continuum: Morlet (frequency 6), Paul (order 4) or the
    second derivative of a Gaussian (real). They end at `width` scales; below a scale of 2 rows, Morlet and Paul waves are too short for the rows."""
    shape = {
        "morlet": lambda x: math.pi**-0.25 * math.exp(-0.5 * x * x) * complex(math.cos(6 * x), math.sin(6 * x)),
        "paul": lambda x: 2**4 * math.factorial(4) / math.sqrt(math.pi * math.factorial(8)) * (1 - 1j * x) ** -5,
        "dog": lambda x: complex((1 - x * x) * math.exp(-0.5 * x * x) / math.sqrt(math.gamma(2.5))),
    }[kind]
    half = max(1, math.ceil(width * scale))
    return [shape(i / scale) / math.sqrt(scale) for i in range(-half, half + 1)]


def mother(kind: str, scale: float, width: float = 4.0) -> list[float]:
    """The real parts of the taps."""
    return [t.real for t in complex_mother(kind, scale, width)]


def cwt_complex(df: DataFrame, key: str, value: str, kind: str, scales: list[float], width: float = 4.0) -> DataFrame:
    """(key, row_ix, scale, value, im): real and imaginary part of the transform by a mother wavelet centred at each row; series are circular. All
    scales and both parts are filtered in one exchange.

    A coefficient is the sum of the series with the conjugate wave: a filter of its taps turned round, and of a wave with a real even and an
    imaginary odd part those are the taps themselves."""
    taps = [complex_mother(kind, s, width) for s in scales]
    names = {part: [f"_{part}{i}" for i in range(len(scales))] for part in ("re", "im")}
    masks = {n: Mask([t.real for t in ts]) for n, ts in zip(names["re"], taps, strict=True)} | {n: Mask([t.imag for t in ts]) for n, ts in zip(names["im"], taps, strict=True)}
    got = by_scale(bank(df.select(key, "row_ix", value), key, value, masks, True), key, scales, {"value": names["re"], "im": names["im"]})
    half = F.greatest(F.lit(1), F.ceil(F.col("scale") * width)).cast("long")
    return got.select(key, F.pmod(F.col("row_ix") - half, F.col("n_rows")).alias("row_ix"), "scale", "value", "im")


def cwt_centred(df: DataFrame, key: str, value: str, kind: str, scales: list[float], width: float = 4.0) -> DataFrame:
    """(key, row_ix, scale, value): the real part of the transform by a mother wavelet centred at each row; series are circular."""
    return cwt_complex(df, key, value, kind, scales, width).drop("im")


def icwt(coefficients: DataFrame, key: str, kind: str, step: float) -> DataFrame:
    """(key, row_ix, value): the series from cwt_centred at scales s0 * 2^(step * j), less its mean and what lies outside these scales."""
    at_zero, factor = MOTHERS[kind]
    total = F.sum(F.col("value") / F.sqrt("scale")) * F.lit(step / (factor * at_zero))
    return coefficients.groupBy(key, "row_ix").agg(total.alias("value"))


def stft(df: DataFrame, key: str, value: str, size: int, step: int = 1) -> DataFrame:
    """(key, frame, bin, re, im): the DFT of every full frame of `size` rows that starts at a multiple of `step`; bins 0..size/2."""
    got = behind(df.select(key, "row_ix", F.col(value).cast("double").alias("v")), key, "v", size - 1, False, BLOCK).filter(F.size("_x") == size)
    got = got.withColumn("frame", F.col("row_ix") - size + 1).filter(F.pmod("frame", F.lit(step)) == 0)
    basis = lambda f, s: F.array(*[_array([s * f(2 * math.pi * k * i / size) for i in range(size)]) for k in range(size // 2 + 1)])
    part = lambda b: F.aggregate(F.zip_with("_x", b[F.col("bin")], lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    bins = got.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(size // 2))))
    return bins.select(key, "frame", "bin", part(basis(math.cos, 1)).alias("re"), part(basis(math.sin, -1)).alias("im"))


def istft(frames: DataFrame, key: str, size: int) -> DataFrame:
    """(key, row_ix, value): each frame turned back; where frames overlap the later one counts."""
    place = frames.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    angle = F.lit(2 * math.pi) * F.col("bin") * F.col("i") / size
    twice = F.when((F.col("bin") == 0) | (F.col("bin") == size // 2), 1.0).otherwise(2.0)
    rows = place.groupBy(key, "frame", "i").agg((F.sum(twice * (F.col("re") * F.cos(angle) - F.col("im") * F.sin(angle))) / size).alias("x"))
    return rows.groupBy(key, (F.col("frame") + F.col("i")).alias("row_ix")).agg(F.max_by("x", "frame").alias("value"))


def centroid(dft: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Power-weighted mean frequency of DFT tables, in cycles a row."""
    p = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    return dft.groupBy(*keys).agg((F.sum(F.col("bin") / size * p) / F.sum(p)).alias("centroid"))


def peaks(dft: DataFrame, keys: list[str], percentile: float) -> DataFrame:
    """Local maxima of |re| + |im| over bins, ranked by height over their neighbours; those at or over the percentile."""
    m = F.abs("re") + F.abs("im")
    w = Window.partitionBy(*keys).orderBy("bin")
    rows = dft.withColumn("m", m).withColumn("_a", F.lag("m").over(w)).withColumn("_b", F.lead("m").over(w)).filter("m > _a AND m > _b")
    scored = rows.withColumn("score", F.col("m") - (F.col("_a") + F.col("_b")) / 2)
    return scored.withColumn("rank", F.percent_rank().over(Window.partitionBy(*keys).orderBy("score"))).filter(F.col("rank") >= percentile).select(*keys, "bin", "m", "score")


def rotation_bank(df: DataFrame, key: str, value: str, omegas: list[float], alpha: float = 0.5, block: int = BLOCK) -> DataFrame:
    """(key, row_ix, modes array): complex mode pairs that turn by their frequency each row and are then corrected so that their real parts sum
    to the sample: s_t = A s_{t-1} + b x_t with a constant A, in two passes over blocks.

    Pass one runs each block from a zero state; the few block states are carried on with A^length; pass two adds the carried state.
    alpha: share of the error that each row corrects (1: at once)."""
    import numpy as np
    import pandas as pd

    k = len(omegas)
    turn = np.zeros((2 * k, 2 * k))
    for i, o in enumerate(omegas):
        turn[2 * i : 2 * i + 2, 2 * i : 2 * i + 2] = [[math.cos(o), -math.sin(o)], [math.sin(o), math.cos(o)]]
    even = np.zeros(2 * k)
    even[::2] = 1.0
    a = (np.eye(2 * k) - alpha * np.outer(even / k, even)) @ turn
    b = alpha * even / k

    def run(pdf: pd.DataFrame, start: np.ndarray) -> np.ndarray:
        out, s = np.empty((len(pdf), 2 * k)), start
        for i, x in enumerate(pdf["v"].to_numpy()):
            s = a @ s + b * x
            out[i] = s
        return out

    def final_state(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_ix")
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "b": [pdf["b"].iloc[0]], "n": [len(pdf)], "s": [run(pdf, np.zeros(2 * k))[-1].tolist()]})

    def carried(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, s, out = pdf.sort_values("b"), np.zeros(2 * k), []
        for n, own in zip(pdf["n"], pdf["s"], strict=True):
            out.append(s.tolist())
            s = np.linalg.matrix_power(a, int(n)) @ s + np.array(own)
        return pdf[["k", "b"]].assign(start=out)

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_ix")
        return pd.DataFrame({"k": pdf["k"], "row_ix": pdf["row_ix"], "modes": run(pdf, np.array(pdf["start"].iloc[0])).tolist()})

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("k"), "row_ix", F.col(value).cast("double").alias("v"), F.floor(F.col("row_ix") / block).cast("long").alias("b"))
    states = rows.groupBy("k", "b").applyInPandas(final_state, f"k {kind}, b long, n long, s array<double>")
    starts = states.groupBy("k").applyInPandas(carried, f"k {kind}, b long, start array<double>")
    return rows.join(starts, ["k", "b"]).groupBy("k", "b").applyInPandas(replay, f"k {kind}, row_ix long, modes array<double>").withColumnRenamed("k", key)
