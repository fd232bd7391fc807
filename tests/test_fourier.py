"""Spectra of whole series and their peaks against numpy and plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import fourier

RNG = np.random.default_rng(9)
SERIES = {0: RNG.normal(size=1000), 1: RNG.normal(size=37), 2: RNG.normal(size=1), 3: np.sin(np.arange(2 * 331) / 5), 4: RNG.normal(size=2), 5: np.zeros(64)}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(k, i, float(x)) for k, v in SERIES.items() for i, x in enumerate(v)], "series long, row_ix long, price double").repartition(3)


@pytest.mark.parametrize("limit", [8, 64, 512, 1 << 16])
def test_spectrum_in_four_steps(rows, limit):
    """With a small limit long series go through tiles; 662 = 2 * 331 rows have no factors to speak of."""
    got = {}
    for r in fourier.spectrum(rows, "series", "price", limit).collect():
        got.setdefault(r["series"], {})[r["bin"]] = (complex(r["re"], r["im"]), r["n"])
    assert set(got) == {0, 1, 3, 4, 5}
    for k, found in got.items():
        x = SERIES[k][: len(SERIES[k]) // 2 * 2]
        assert sorted(found) == list(range(len(x) // 2 + 1)) and {n for _, n in found.values()} == {len(x)}
        np.testing.assert_allclose([found[b][0] for b in sorted(found)], np.fft.rfft(x), atol=1e-9 * len(x))


def plain_peaks(m):
    """Outwards step by step from each bin, as far as there are bins behind it."""
    m = m.tolist()
    out = {}
    for i, v in enumerate(m):
        width = 0
        for j in range(1, len(m) - i):
            left = i < j or v > m[i - j]
            right = i + j >= len(m) or v > m[i + j]
            width += (i >= j and left) + (i + j < len(m) and right)
            if not (left and right):
                break
        if width:
            out[i] = width
    return out


@pytest.mark.parametrize("block", [1, 5, 64, 1 << 14])
def test_broad_peaks(spark, block):
    tables = {0: RNG.integers(0, 30, 200).astype(float), 1: np.arange(90.0), 2: np.arange(90.0)[::-1], 3: np.r_[100, np.tile(np.arange(20.0), 5)], 4: np.zeros(50), 5: np.array([3.0])}
    rows = [(k, i, float(v), 2 * (len(m) - 1)) for k, m in tables.items() for i, v in enumerate(m)]
    got = {}
    for r in fourier.broad_peaks(spark.createDataFrame(rows, "series long, bin long, m double, n long"), "series", block).collect():
        got.setdefault(r["series"], {})[r["bin"]] = r["width"]
        assert r["score"] == r["width"] + r["m"]
    assert got == {k: p for k, m in tables.items() if (p := plain_peaks(m))}


@pytest.mark.parametrize("percentile", [0.0, 0.4, 1.0])
def test_dominant_frequency(rows, percentile):
    got = {r["series"]: (r["bin"], r["frequency"]) for r in fourier.dominant_frequency(rows, "series", "price", percentile, 60.0, 128, 16, 9).collect()}
    for k, x in SERIES.items():
        x = x[: len(x) // 2 * 2]
        if len(x) < 2:
            continue
        f = np.fft.rfft(x)
        m = np.round(np.abs(f.real) + np.abs(f.imag), 9)
        by_score = {}
        for i, w in plain_peaks(m).items():
            by_score.setdefault(w + m[i], i)
        if not by_score:
            assert k not in got
            continue
        scores = sorted(by_score)
        bin_ = by_score[scores[int(percentile * (len(scores) - 1))]]
        assert got[k] == (bin_, pytest.approx(0.5 * bin_ * 60 / len(x)))


def test_pure_wave_is_found(spark):
    n = 4096
    rows = spark.range(n).select(F.lit("a").alias("series"), F.col("id").alias("row_ix"), F.sin(F.lit(2 * np.pi * 300 / n) * F.col("id")).alias("v"))
    got = fourier.dominant_frequency(rows, "series", "v", limit=256).collect()
    assert [(r["series"], r["bin"]) for r in got] == [("a", 300)] and got[0]["frequency"] == pytest.approx(150 / n)


def test_no_rows(rows):
    assert fourier.dominant_frequency(rows.limit(0), "series", "price").count() == 0
