"""Filters over blocks against plain numpy, at any block size, for short and long masks and series."""

import numpy as np
import pytest

from tidemark.operators import spectral as sp
from tidemark.operators.blocks import Mask

RNG = np.random.default_rng(5)
SERIES = {0: RNG.normal(size=700), 1: RNG.normal(size=37), 2: RNG.normal(size=1), 3: RNG.normal(size=300)}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(k, i, float(x)) for k, v in SERIES.items() for i, x in enumerate(v)], "series long, row_ix long, price double").repartition(3)


def values(df, *columns):
    out = {}
    for r in df.orderBy("series", "row_ix").collect():
        out.setdefault(r["series"], []).append([r[c] for c in columns])
    return {k: np.array(v) for k, v in out.items()}


def plain(x, taps, stretch=1, circular=False):
    """Loops over taps and rows."""
    y = np.zeros(len(x))
    for i in range(len(x)):
        used = [(t, x[(i - k * stretch) % len(x)] if circular else x[i - k * stretch]) for k, t in enumerate(taps) if circular or i - k * stretch >= 0]
        y[i] = sum(t * v for t, v in used) / (1 if circular or len(used) == len(taps) else sum(t for t, _ in used))
    return y


@pytest.mark.parametrize("block", [1, 8, 64, None])
@pytest.mark.parametrize("stretch", [1, 3])
@pytest.mark.parametrize("circular", [False, True])
def test_short_masks(rows, block, stretch, circular):
    taps = [0.5, 0.25, 0.75, 0.1]
    got = values(sp.fir(rows, "series", "price", taps, stretch, "y", circular, block), "y")
    for k, x in SERIES.items():
        np.testing.assert_allclose(got[k][:, 0], plain(x, taps, stretch, circular), atol=1e-12)


@pytest.mark.parametrize("block", [256, None])
@pytest.mark.parametrize("circular", [False, True])
def test_long_masks_by_transforms(rows, block, circular):
    """200 taps: longer than some series, folded where they are circular."""
    taps = RNG.uniform(0.1, 1, 200).tolist()
    got = values(sp.fir(rows, "series", "price", taps, 1, "y", circular, block), "y")
    for k, x in SERIES.items():
        np.testing.assert_allclose(got[k][:, 0], plain(x, taps, 1, circular), atol=1e-9)


def test_mask_by_transforms_equals_sums():
    x = RNG.normal(size=5000)
    for n, stretch in ((65, 1), (1000, 3), (4096, 1)):
        mask = Mask(RNG.normal(size=n), stretch)
        wide = np.zeros(mask.reach + 1)
        wide[::stretch] = mask.taps
        np.testing.assert_allclose(mask.over(x), np.convolve(x, wide)[: len(x)], atol=1e-9)
    assert len(Mask([1.0]).over(np.zeros(0))) == 0


def test_bank_reads_rows_once(rows):
    masks = {"a": Mask([1.0, -1.0]), "b": Mask([0.5] * 100, 2)}
    got = sp.bank(rows, "series", "price", masks)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange hashpartitioning") == 1
    found = values(got, "a", "b")
    for k, x in SERIES.items():
        np.testing.assert_allclose(found[k], np.c_[plain(x, [1.0, -1.0]) if len(x) > 1 else x, plain(x, [0.5] * 100, 2)], atol=1e-9)


@pytest.mark.parametrize(("block", "halo"), [(16, 10_000), (None, 10_000), (None, 20)])
def test_emd_in_one_pass_or_several(rows, block, halo):
    masks, siftings = [[0.6, 0.4], [0.4, 0.3, 0.2, 0.1], [1 / 90] * 90], 2
    got = sp.emd(rows, "series", "price", masks, siftings, block=block, halo=halo)
    found = {}
    for r in got.collect():
        found[r["series"], r["level"], r["row_ix"]] = r["value"]
    assert len(found) == 4 * sum(map(len, SERIES.values()))
    for k, x in SERIES.items():
        rest = x
        for level, mask in zip((3, 2, 1), masks, strict=True):
            mode = rest
            for _ in range(siftings):
                mode = mode - plain(mode, mask)
            np.testing.assert_allclose([found[k, level, i] for i in range(len(x))], mode, atol=1e-9)
            rest = rest - mode
        np.testing.assert_allclose([found[k, 0, i] for i in range(len(x))], rest, atol=1e-9)


@pytest.mark.parametrize("block", [64, None])
def test_modwt_levels_in_one_pass(rows, block):
    taps, levels = sp.daubechies4(), 4
    table = sp.modwt(rows, "series", "price", taps, levels, block)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    got = values(table, "w1", "w2", "w3", "w4", "v")
    low, high = ([t / np.sqrt(2) for t in f] for f in (taps, sp.high_of(taps)))
    for k, x in SERIES.items():
        v, want = x, []
        for j in range(levels):
            want.append(plain(v, high, 2**j, True))
            v = plain(v, low, 2**j, True)
        np.testing.assert_allclose(got[k], np.array([*want, v]).T, atol=1e-9)
    back = values(sp.imodwt(table, "series", taps, levels, block), "value")
    for k, x in SERIES.items():
        np.testing.assert_allclose(back[k][:, 0], x, atol=1e-9)


def test_stationary_transform_and_back(rows):
    full = sp.padded(rows, "series", "price", 3)
    back = values(sp.iswt(sp.swt(full, "series", "value", sp.daubechies4(), 3), "series", sp.daubechies4(), 3), "value")
    for k, x in SERIES.items():
        np.testing.assert_allclose(back[k][: len(x), 0], x, atol=1e-9)


@pytest.mark.parametrize("kind", ["morlet", "paul", "dog"])
def test_complex_wavelets(rows, kind):
    scales = [2.0, 3.0]
    got = {(r["series"], r["row_ix"], r["scale"]): complex(r["value"], r["im"]) for r in sp.cwt_complex(rows, "series", "price", kind, scales).collect()}
    for k, x in SERIES.items():
        for s in scales:
            taps = np.array(sp.complex_mother(kind, s))
            half = len(taps) // 2
            for at in {0, len(x) // 2, len(x) - 1}:
                want = sum(np.conj(taps[u + half]) * x[(at + u) % len(x)] for u in range(-half, half + 1))
                assert abs(got[k, at, s] - want) < 1e-9


def test_keys_of_any_type_other_columns_and_no_rows(spark, rows):
    from pyspark.sql import functions as F

    odd = rows.withColumn("series", F.struct(F.col("series").alias("a"), F.lit("x").alias("b"))).withColumn("note", F.array(F.lit("kept")))
    got = sp.fir(odd, "series", "price", [1.0, 1.0])
    assert got.columns == ["series", "row_ix", "price", "note", "filtered"] and got.count() == rows.count()
    assert sp.fir(rows.limit(0), "series", "price", [1.0, 1.0]).count() == 0
    assert sp.emd(rows.limit(0), "series", "price", [[1.0]], 1).count() == 0
