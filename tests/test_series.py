"""Small cases with known results, and invariants."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bars, core, frames, joins, scans, spectral, stats, windows
from tidemark.sources import files


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_snap_to_grid(spark):
    got = [r[0] for r in table(spark, [(s,) for s in (3, 5, 6, 54, 55, 56)], "s long").orderBy("s").select(scans.snapped(F.col("s"), 60, 5)).collect()]
    assert got == [0, 0, None, None, 60, 60]


def test_snap_needs_half_a_step():
    with pytest.raises(ValueError):
        scans.snapped(F.lit(1), 60, 31)


def test_nearest_tie_goes_to_the_later_row(spark):
    data = table(spark, [(1, 0, 1.0), (1, 10, 2.0)], "k long, t long, v double")
    got = core.nearest(table(spark, [(1, 5)], "k long, p long"), data, "k", "p", "t", ["v"]).first()
    assert got["found"]["t"] == 10


def test_strict_before(spark):
    data = table(spark, [(1, 0, 1.0), (1, 10, 2.0)], "k long, t long, v double")
    probe = table(spark, [(1, 10)], "k long, p long")
    assert core.asof(probe, data, "k", "p", "t", ["v"], equal=False).first()["found"]["t"] == 0
    assert core.asof(probe, data, "k", "p", "t", ["v"]).first()["found"]["t"] == 10


@pytest.mark.parametrize("width", [1, 7, 50, 10**6])
def test_asof_does_not_depend_on_the_bucket_width(spark, width):
    rnd = random.Random(width)
    data = [(k, t, float(t)) for k in (1, 2) for t in rnd.sample(range(200), 30)]
    probes = [(k, p) for k in (1, 2, 3) for p in range(0, 220, 7)]
    for direction, equal in (("before", True), ("before", False), ("after", True)):
        got = core.asof(table(spark, probes, "k long, p long"), table(spark, data, "k long, t long, v double"), "k", "p", "t", ["v"], direction, equal, width)
        ok = (lambda t, p: t <= p if equal else t < p) if direction == "before" else (lambda t, p: t >= p)  # noqa: B023
        pick = max if direction == "before" else min
        want = {(k, p): pick((t for j, t, _ in data if j == k and ok(t, p)), default=None) for k, p in probes}
        assert {(r["k"], r["p"]): r["found"] and r["found"]["t"] for r in got.collect()} == want


@pytest.mark.parametrize("width", [3, 40, 10**6])
def test_row_index_and_gaps_over_buckets(spark, width):
    df = table(spark, [(1, t) for t in (0, 1, 2, 5, 6, 20)], "k long, t long")
    assert [r["row_ix"] for r in core.row_index(df, "k", "t", width).orderBy("t").collect()] == [0, 1, 2, 3, 4, 5]
    assert sorted(tuple(r) for r in core.gaps(df, "k", "t", 1, width).collect()) == [(1, 3, 5), (1, 7, 20)]


def test_twap_weighs_by_time_and_carries_the_price(spark):
    ticks = table(spark, [(1, 0, 1.0), (1, 30, 3.0), (1, 150, 5.0)], "k long, t long, v double")
    got = {r["bar"]: (r["twap"], r["ticks"], r["close"]) for r in bars.twap_bars(ticks, "k", "t", "v", 60).collect()}
    assert got == {0: (2.0, 2, 3.0), 60: (3.0, 0, 3.0), 120: (pytest.approx(4.0), 1, 5.0)}


@pytest.mark.parametrize("width", [7, 100, 10**9])
def test_filled_grid_against_brute_force(spark, width):
    import random

    deal = random.Random(5)
    rows = [(k, deal.randrange(0, 900) if k else deal.choice([3, 4, 500]), float(deal.randrange(50))) for k in (0, 1, 2) for _ in range(25)]
    rows += [(3, 0, 1.0), (3, 10 * 9000, 2.0)]  # a silence longer than one list of the grid
    want = set()
    for k in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == k]
        for t in range(min(r[1] for r in own) // 10 * 10, max(r[1] for r in own) + 1, 10):
            want.add((k, t, max((r[1], r[2]) for r in own if r[1] < t + 10)[1], sum(t <= r[1] < t + 10 for r in own)))
    got = bars.filled_grid(spark.createDataFrame(rows, "k long, t long, v double"), "k", "t", "v", 10, width).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_bars_through_a_long_silence(spark):
    ticks = spark.createDataFrame([("a", 30, 1.0), ("a", 60 * 9000 + 30, 2.0)], "k string, t long, v double")
    got = {r["bar"]: (r["twap"], r["ticks"], r["close"]) for r in bars.twap_bars(ticks, "k", "t", "v", 60).collect()}
    assert set(got) == set(range(0, 60 * 9000 + 1, 60))
    assert got[0] == (1.0, 1, 1.0) and got[60] == (1.0, 0, 1.0) and got[60 * 9000] == (1.5, 1, 2.0)


def test_range_join_over_many_buckets(spark):
    spans = spark.createDataFrame([("a", 0, 50_000), ("a", 5, 5), ("b", 7, 9)], "k string, lo long, hi long")
    points = spark.createDataFrame([("a", 0), ("a", 49_999), ("a", 50_000), ("b", 8)], "k string, t long")
    got = core.range_join(spans, points, "k", "lo", "hi", "t", 5)
    assert sorted((r["k"], r["lo"], r["t"]) for r in got.collect()) == [("a", 0, 0), ("a", 0, 49_999), ("b", 7, 8)]


def test_trapezoid_of_one_quote_is_that_quote(spark):
    got = bars.trapezoid(table(spark, [(1, 5, 1.5, 7)], "k long, t long, p double, q long"), "k", "t", ["p"], ["q"], 10).first()
    assert (got["p"], got["q"]) == (1.5, 7)


def test_pair_sample(spark):
    rows = table(spark, [(1, i, float(i)) for i in range(4)], "k long, row_ix long, v double")
    got = joins.kept_pairs(rows, "k", 3, ["v"]).select((F.col("i") * 4 + F.col("j")).alias("p")).collect()
    assert sorted(r["p"] for r in got) == [0, 3, 6, 9, 12, 15]


def test_fir_head_is_renormalised(spark):
    x = table(spark, [(1, i, float(i + 1)) for i in range(5)], "k long, row_ix long, v double")
    got = [r["filtered"] for r in spectral.fir(x, "k", "v", [0.7, 0.3], block=2).orderBy("row_ix").collect()]
    assert got[0] == 1.0
    assert got[1:] == [pytest.approx(0.7 * (i + 1) + 0.3 * i) for i in range(1, 5)]


@pytest.mark.parametrize("block", [2, 5, 4096])
def test_circular_fir_does_not_depend_on_the_block(spark, block):
    n, taps = 11, [0.5, 0.25, 0.2, 0.05]
    x = [math.sin(i) for i in range(n)]
    df = table(spark, [(1, i, v) for i, v in enumerate(x)], "k long, row_ix long, v double")
    got = [r["filtered"] for r in spectral.fir(df, "k", "v", taps, 4, circular=True, block=block).orderBy("row_ix").collect()]
    assert got == [pytest.approx(sum(w * x[(i - 4 * j) % n] for j, w in enumerate(taps))) for i in range(n)]


def test_packets_keep_the_energy(spark):
    x = [math.cos(i * i) for i in range(16)]
    df = table(spark, [(1, i, v) for i, v in enumerate(x)], "k long, row_ix long, v double")
    got = spectral.packets(df, "k", "v", spectral.daubechies4(), 2).collect()
    assert len(got) == 16 and {r["node"] for r in got} == {"00", "01", "10", "11"}
    assert sum(r["value"] ** 2 for r in got) == pytest.approx(sum(v * v for v in x))


def test_rotation_bank_does_not_depend_on_the_block(spark):
    df = table(spark, [(1, i, math.sin(0.3 * i)) for i in range(50)], "k long, row_ix long, v double")
    one, many = ({r["row_ix"]: r["modes"] for r in spectral.rotation_bank(df, "k", "v", [0.3, 1.0], block=b).collect()} for b in (1000, 7))
    assert all(one[i] == pytest.approx(many[i], abs=1e-9) for i in one)


def test_worst_rows_by_prefix_sums(spark):
    labels = [3.0, 100.0, 1.0, 2.0, -50.0]
    got = windows.worst_rows(table(spark, [(1, i, v) for i, v in enumerate(labels)], "k long, row_ix long, v double"), "k", "v", 2).collect()
    assert sorted(r["row_ix"] for r in got) == [0, 2, 3]
    assert all(r["score"] == pytest.approx(sum(abs(r["v"] - x) for x in labels)) for r in got)


def test_scale_and_unscale(spark):
    df = table(spark, [(1, 1.0), (1, 3.0), (2, 5.0)], "k long, v double")
    got = stats.scaled(df, stats.scaling(df, ["k"], "v"), ["k"], "v").withColumn("back", F.col("scaled") * F.col("sf") + F.col("dc")).collect()
    assert all(r["back"] == pytest.approx(r["v"]) for r in got)
    assert {r["sf"] for r in got if r["k"] == 2} == {1.0}


def test_sequence_kernels_of_equal_sequences(spark):
    df = table(spark, [([0.1, 0.5, 0.2], [0.1, 0.5, 0.2])], "a array<double>, b array<double>")
    assert df.select(frames.sequence_kernel("gak")("a", "b")).first()[0] == pytest.approx(1.0)
    assert df.select(frames.sequence_kernel("path")("a", "b")).first()[0] == pytest.approx(0.0)


def test_kernel_fit_learns_its_chunk(spark):
    rows = [(1, i, [i / 10.0], math.sin(i / 3.0)) for i in range(30)]
    df = table(spark, rows, "chunk long, i long, x array<double>, y double")
    got = frames.predict_chunks(df, frames.fit_chunks(df, ["chunk"], 5.0, 1e-6), ["chunk"], ["i"])
    assert all(r["prediction"] == pytest.approx(math.sin(r["i"] / 3.0), abs=0.01) for r in got.collect())


def test_cross_validation_holds_no_fold_in_one_group(spark):
    import numpy as np

    from tidemark.plans import models

    rnd = random.Random(1)
    rows = [(i % 3, x, 2 * x[0] - x[1] + rnd.gauss(0, 0.1)) for i in range(200) for x in [[rnd.random(), rnd.random()]]]
    got = models.cross_validated(table(spark, rows, "own int, x array<double>, y double").repartition(5), [0.1, 10.0])
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()
    x, y, own = np.array([[*r[1], 1.0] for r in rows]), np.array([r[2] for r in rows]), np.array([r[0] for r in rows])
    found = {(r["lam"], r["fold"]): (r["n"], r["mae"]) for r in got.collect()}
    assert len(found) == 6
    for (lam, fold), (n, mae) in found.items():
        a, b = x[own != fold], y[own != fold]
        w = np.linalg.solve(a.T @ a + lam * np.eye(3), a.T @ b)
        assert n == (own == fold).sum() and mae == pytest.approx(np.abs(x[own == fold] @ w - y[own == fold]).mean())
    alone = models.cross_validated(table(spark, rows, "own int, x array<double>, y double").filter("own = 0"), [0.1])
    assert alone.count() == 0


def test_typed_header():
    assert files.header_fields("Time:time;VOLUME:double;p:double") == [("Time", "timestamp_ntz"), ("VOLUME", "double"), ("p", "double")]
    with pytest.raises(ValueError):
        files.header_fields("p:double")


def test_upsert_refuses_missing_columns(spark):
    with pytest.raises(ValueError):
        files.upserted(table(spark, [(1, 2, 3)], "k long, t long, v long"), table(spark, [(1, 2)], "k long, t long"), ["k"], "t")


def test_empty_series(spark):
    none = table(spark, [], "k long, t long, v double")
    assert core.row_index(none, "k", "t").count() == core.gaps(none, "k", "t", 1).count() == bars.twap_bars(none, "k", "t", "v", 60).count() == 0


def test_merged_intervals_against_brute_force(spark):
    rnd = random.Random(5)
    spans = [(rnd.choice([1, 1, 2]), a := rnd.randint(0, 3000), a + rnd.randint(0, 30)) for _ in range(300)] + [(1, 10, 900), (1, 10, 12)]
    got = {tuple(r) for r in joins.merged_intervals(table(spark, spans, "k long, lo long, hi long"), "k", "lo", "hi", 100).collect()}
    want = set()
    for k in (1, 2):
        now = None
        for _, lo, hi in sorted(s for s in spans if s[0] == k):
            if now and lo <= now[1]:
                now = (now[0], max(now[1], hi))
            else:
                want |= {(k, *now)} if now else set()
                now = (lo, hi)
        want.add((k, *now))
    assert got == want


def test_reconciled_steps(spark):
    s, d = core.SECOND, core.DAY
    asked = table(spark, [(1, 0, 100 * d), (2, 0, 100 * d), (3, 90 * d, 100 * d)], "k long, since long, until long")
    covered = table(spark, [(2, 80 * d, 100 * d - 9 * s), (3, 95 * d, 99 * d)], "k long, lo long, hi long")
    got = {r["k"]: tuple(r)[1:] for r in joins.reconciled(covered, asked, "k").collect()}
    assert got[1] == (70 * d, 100 * d, None, None, 70 * d, 100 * d)
    assert got[2] == (50 * d, 100 * d - 9 * s, None, None, 50 * d, 80 * d)
    assert got[3] == (90 * d, 100 * d, 99 * d, 100 * d, 90 * d, 95 * d)
    book = table(spark, [(1, 5), (2, 20)], "k long, asked long")
    assert [r["k"] for r in joins.retained(book, "asked", 10, F.lit(16)).collect()] == [2]


@pytest.mark.parametrize("kind", sorted(spectral.MOTHERS))
def test_centred_transform_and_its_inverse(spark, kind):
    n = 256
    x = [math.sin(2 * math.pi * i * 4 / n) + 0.5 * math.cos(2 * math.pi * i * 8 / n) for i in range(n)]
    df = table(spark, [("k", i, v) for i, v in enumerate(x)], "k string, row_ix long, v double")
    scales = [2 ** (j / 2) for j in range(2, 15)]
    got = spectral.cwt_centred(df, "k", "v", kind, scales, 6.0)
    half = len(spectral.mother(kind, 2.0, 6.0)) // 2
    one = {r["row_ix"]: r["value"] for r in got.filter("scale = 2").collect()}
    taps = spectral.mother(kind, 2.0, 6.0)
    for i in (0, 17, 255):
        assert one[i] == pytest.approx(sum(w * x[(i + m - half) % n] for m, w in enumerate(taps)), abs=1e-9)
    back = {r["row_ix"]: r["value"] for r in spectral.icwt(got, "k", kind, 0.5).collect()}
    error = math.sqrt(sum((back[i] - x[i]) ** 2 for i in range(n)) / sum(v * v for v in x))
    assert error < 0.15


def test_model_validation_against_numpy(spark):
    import numpy as np

    from tidemark.plans import models

    rnd = np.random.default_rng(2)
    x = rnd.random((200, 3))
    y = x @ [1.0, -2.0, 0.5] + rnd.normal(0, 0.05, 200)
    df = table(spark, [(i, x[i].tolist(), float(y[i])) for i in range(200)], "vec_id long, x array<double>, y double").repartition(5)
    got = {r["source"]: r for r in models.validated(df, 4).collect()}
    xs = np.c_[x, np.ones(200)]
    fit = lambda m: np.linalg.solve(xs[:m].T @ xs[:m] + np.eye(4), xs[:m].T @ y[:m])
    online = np.concatenate([xs[120 + 20 * k : 140 + 20 * k] @ fit(120 + 20 * k) for k in range(4)])
    for name, p in {"batch": xs[120:] @ fit(120), "online": online, "known": y[119:199]}.items():
        assert got[name]["n"] == 80 and got[name]["mae"] == pytest.approx(np.abs(p - y[120:]).mean())
        assert got[name]["better"] == pytest.approx(100 * (np.abs(p - y[120:]) < np.abs(y[119:199] - y[120:])).mean())
    assert got["tree"]["mae"] < got["known"]["mae"]


def test_recombined(spark):
    parts = table(spark, [(1, "a", 1.0), (1, "a", 2.0), (1, "b", 4.0), (2, "a", 8.0)], "k long, level string, prediction double")
    known = table(spark, [(1, "a", 3.0), (2, "a", None)], "k long, level string, known double")
    assert {r["k"]: r["value"] for r in frames.recombined(parts, known, ["k"], "level", 2).collect()} == {1: 5.0, 2: 4.0}
