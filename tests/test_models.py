"""Numbers of the queries that SQL cannot express, against numpy and plain loops on the smallest tables."""

import itertools
import math

import duckdb
import numpy as np
import pytest
from compare import DATA
from pyspark.sql import functions as F

from tidemark.functions import tables
from tidemark.operators import core, moments, spectral
from tidemark.plans import registry


@pytest.fixture(scope="module")
def vectors():
    rows = duckdb.sql(f"SELECT vec_id, embedding, label FROM '{DATA}/embeddings.parquet' ORDER BY vec_id").fetchall()
    return [r[0] for r in rows], np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)


@pytest.fixture(scope="module")
def series():
    rows = duckdb.sql(f"SELECT user_id, epoch_us(ts) AS t, event_id, value FROM '{DATA}/events.parquet' ORDER BY user_id, t, event_id").fetchall()
    return {k: np.array([r[3] for r in part]) for k, part in itertools.groupby(rows, key=lambda r: r[0])}


def result(spark, name):
    return registry.QUERIES[name](spark, DATA).collect()


def ridge(x, y, lam):
    x = np.c_[x, np.ones(len(x))]
    return np.linalg.solve(x.T @ x + lam * np.eye(x.shape[1]), x.T @ y)


def rbf_model(x, y, gamma, lam):
    k = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(-1))
    w = np.linalg.solve(k + lam * np.eye(len(y)), y)
    return x, w, np.abs(k @ w - y).mean(), gamma


def rbf_forecast(model, rows):
    x, w, _, gamma = model
    return np.exp(-gamma * ((rows[:, None] - x[None]) ** 2).sum(-1)) @ w


def test_walk_forward(spark, vectors):
    _, x, y = vectors
    got = {r["fold"]: (r["n"], r["mae"]) for r in result(spark, "walk_forward_backtest")}
    want = {}
    for f in range(len(y)):
        a, b = f * 25, f * 25 + 100
        if b >= len(y):
            break
        w = ridge(x[a:b], y[a:b], 1.0)
        held = slice(b, b + 25)
        want[f] = (len(y[held]), np.abs(np.c_[x[held], np.ones(len(y[held]))] @ w - y[held]).mean())
    assert got.keys() == want.keys()
    for f, (n, mae) in want.items():
        assert got[f] == (n, pytest.approx(mae, abs=2e-6))


@pytest.mark.parametrize(("train", "step", "hold"), [(60, 20, 30), (35, 10, None), (7, 7, 1), (50, 3, 5)])
def test_walk_forward_of_any_window_with_ragged_ids(spark, train, step, hold):
    rng = np.random.default_rng(train)
    data = {k: (np.sort(rng.choice(10_000, n, replace=False)), rng.normal(size=(n, 2)), rng.normal(size=n)) for k, n in (("a", 157), ("b", 40), ("c", 5))}
    table = spark.createDataFrame([(k, int(i), v.tolist(), float(t)) for k, (ids, x, y) in data.items() for i, v, t in zip(ids, x, y, strict=True)], "k string, id long, x array<double>, y double").repartition(4)
    got = {(r["k"], r["fold"]): (r["n"], r["mae"]) for r in moments.walk_forward(core.row_index(table, "k", "id", 1000, "place"), "k", train, step, 0.5, hold).collect()}
    want = {}
    for k, (_, x, y) in data.items():
        for f in range(len(y)):
            a, b = f * step, f * step + train
            if b >= len(y):
                break
            held = slice(b, b + (hold or step))
            want[k, f] = (len(y[held]), np.abs(np.c_[x[held], np.ones(len(y[held]))] @ ridge(x[a:b], y[a:b], 0.5) - y[held]).mean())
    assert got.keys() == want.keys()
    for key, (n, mae) in want.items():
        assert got[key] == (n, pytest.approx(mae, rel=1e-6))


def test_grid_search(spark, vectors):
    ids, x, y = vectors
    fold = np.array(ids) % 4
    got = {r["lam"]: (r["n"], r["mae"]) for r in result(spark, "grid_search_cv")}
    for lam in (0.01, 1.0, 100.0):
        maes = []
        for f in range(4):
            w = ridge(x[fold != f], y[fold != f], lam)
            maes.append(np.abs(np.c_[x[fold == f], np.ones((fold == f).sum())] @ w - y[fold == f]).mean())
        assert got[lam] == (len(y), pytest.approx(np.mean(maes), abs=2e-6))


def test_chunk_fit_prediction_and_residuals(spark, vectors):
    ids, x, y = vectors
    ids, chunk = np.array(ids), np.array(ids) // 25
    got = {r["chunk"]: (r["score"], r["support"]) for r in result(spark, "chunked_kernel_fit")}
    assert got == {c: (pytest.approx(rbf_model(x[chunk == c], y[chunk == c], 0.5, 1e-3)[2], abs=2e-6), (chunk == c).sum()) for c in set(chunk)}
    got = {r["vec_id"]: r["prediction"] for r in result(spark, "chunked_prediction")}
    learn = ids % 5 != 0
    models = {c: rbf_model(x[learn & (chunk == c)], y[learn & (chunk == c)], 0.5, 1e-3) for c in set(chunk)}
    for i in np.flatnonzero(~learn):
        mine = [m for c, m in models.items() if c // 4 == chunk[i] // 4]
        weights = [1 / (m[2] + 1e-6) for m in mine]
        assert got[ids[i]] == pytest.approx(sum(w * rbf_forecast(m, x[[i]])[0] for w, m in zip(weights, mine, strict=True)) / sum(weights), abs=1e-5)
    got = {r["vec_id"]: (r["first"], r["total"]) for r in result(spark, "residual_models")}
    for c in set(chunk):
        own = chunk == c
        even, odd = own & (ids % 2 == 0), own & (ids % 2 == 1)
        first = rbf_model(x[even], y[even], 0.1, 1.0)
        second = rbf_model(x[odd], y[odd] - rbf_forecast(first, x[odd]), 1.0, 0.1)
        for i in np.flatnonzero(own):
            p = rbf_forecast(first, x[[i]])[0]
            assert got[ids[i]] == (pytest.approx(p, abs=1e-5), pytest.approx(p + rbf_forecast(second, x[[i]])[0], abs=1e-5))


def path(a, b, tau=0.5, h=0.5, d=0.5, v=0.5):
    n = len(a)
    c = [[0.0] * n for _ in range(n)]
    for i, j in itertools.product(range(n), repeat=2):
        own = (a[i] - b[j]) * ((i + j + 1) / (2 * n - 1)) ** tau
        options = ([(v, c[i - 1][j])] if i else []) + ([(h, c[i][j - 1])] if j else []) + ([(d, c[i - 1][j - 1])] if i and j else [])
        if options:
            f, x = min(options, key=lambda o: abs(o[1]))
            own += f * x
        c[i][j] = own
    return c[-1][-1] / n


def kdtw(a, b, tau=2.0, sigma=1.0, eps=1e-3):
    n, k = len(a), lambda x, y: (math.exp(-(abs(x - y) ** tau) / sigma) + eps) / (3 * (1 + eps))
    d, e = ([[0.0] * (n + 1) for _ in range(n + 1)] for _ in range(2))
    d[0][0] = e[0][0] = 1.0
    for i, j in itertools.product(range(1, n + 1), repeat=2):
        d[i][j] = (d[i - 1][j] + d[i][j - 1] + d[i - 1][j - 1]) * k(a[i - 1], b[j - 1])
        e[i][j] = e[i - 1][j] * k(a[i - 1], b[i - 1]) + e[i][j - 1] * k(a[j - 1], b[j - 1]) + (e[i - 1][j - 1] * k(a[i - 1], b[j - 1]) if i == j else 0)
    return d[n][n] + e[n][n]


def gak(a, b, sigma=1.0, band=4):
    n = len(a)

    def log_kernel(a, b):
        m = [[-math.inf] * (n + 1) for _ in range(n + 1)]
        m[0][0] = 0.0
        for i, j in itertools.product(range(1, n + 1), repeat=2):
            if abs(i - j) < band:
                g = -abs(a[i - 1] - b[j - 1]) / (2 * sigma * sigma) + math.log(1 - abs(i - j) / band)
                m[i][j] = float(np.logaddexp(np.logaddexp(m[i - 1][j], m[i][j - 1]), m[i - 1][j - 1])) + g - math.log(2 - math.exp(g))
        return m[n][n]

    return math.exp(log_kernel(a, b) - 0.5 * (log_kernel(a, a) + log_kernel(b, b)))


@pytest.mark.parametrize(("name", "kernel"), [("path_kernel", path), ("kdtw_kernel", kdtw), ("global_alignment_kernel", gak)])
def test_sequence_kernels(spark, vectors, name, kernel):
    ids, x, _ = vectors
    at = {i: n for n, i in enumerate(ids)}
    got = registry.QUERIES[name](spark, DATA).filter("i < 4 AND j IN (0, 5, 11, 24) OR i = 30 AND j = 41").collect()
    assert len(got) == 17
    for r in got:
        assert r["k"] == pytest.approx(kernel(x[at[r["i"]]], x[at[r["j"]]]), abs=2e-6)


def test_feature_tuning(spark):
    got = {r["series"]: (r["score"], r["quantum"], r["shift"]) for r in result(spark, "feature_tuning")}
    rows = duckdb.sql(f"SELECT user_id, epoch_us(ts) AS t, event_id, value, CAST(json_extract_string(props, '$.k') AS BIGINT) FROM '{DATA}/events.parquet' ORDER BY user_id, t, event_id").fetchall()
    for k, part in itertools.groupby(rows, key=lambda r: r[0]):
        part = list(part)
        label, feature = [r[3] for r in part], [float(r[4]) for r in part]
        label, feature = feature_columns(label, feature)
        best = []
        for q, shift in ((q, s * q) for q in (1, 2, 4) for s in (0, 1, 2)):
            slots = {i // q * q: np.mean(feature[i // q * q : i // q * q + q]) for i in range(len(feature))}
            errors = [abs(label[i] - slots[i - shift]) for i in range(0, len(label), q) if i - shift in slots]
            if errors:
                best.append((round(float(np.mean(errors)), 6), q, shift))
        if best:
            score, q, shift = min(best)
            assert got[k][0] == pytest.approx(score, abs=2e-6)


def feature_columns(price, qty):
    """As plans.models pairs them: the price as label, the quantity as feature."""
    return price, qty


def test_boosted_trees_learn(spark, vectors):
    """Trees have no second version; they must fit better than a constant and repeat themselves."""
    ids, _, y = vectors
    got = {r["vec_id"]: r["prediction"] for r in result(spark, "boosted_tree_baseline")}
    assert set(got) == set(ids) and got == {r["vec_id"]: r["prediction"] for r in result(spark, "boosted_tree_baseline")}
    p = np.array([got[i] for i in ids])
    assert ((p - y) ** 2).mean() < 0.9 * y.var() and y.min() - 1 <= p.min() and p.max() <= y.max() + 1
    pairs = result(spark, "pairwise_boosted_kernel")
    label = dict(zip(ids, y, strict=True))
    z, k = np.array([label[r["i"]] - label[r["j"]] for r in pairs]), np.array([r["k"] for r in pairs])
    assert len(pairs) == sum((np.array(ids) // 25 == c).sum() ** 2 for c in set(np.array(ids) // 25)) and ((k - z) ** 2).mean() < 0.95 * z.var()


def modes_of(x, omegas, alpha=0.5):
    """The recurrence row by row with complex numbers: turn, then share the error out over the real parts."""
    z, out = np.zeros(len(omegas), complex), []
    for v in x:
        z = z * np.exp(1j * np.array(omegas))
        z = z + alpha * (v - z.real.sum()) / len(omegas)
        out.append([c for m in z for c in (m.real, m.imag)])
    return out


def test_filter_bank_and_online_modes(spark, series):
    got = {(r["series"], r["row_ix"]): r["modes"] for r in result(spark, "vmd_filter_bank")}
    assert len(got) == sum(map(len, series.values()))
    for k, x in series.items():
        for i, modes in enumerate(modes_of(x, [0.1, 0.7, 1.9])):
            assert got[k, i] == pytest.approx(modes, abs=2e-5)
    online = {}
    for r in result(spark, "stream_online_modes"):
        online.setdefault(r["series"], []).append((r["t"], r["modes"]))
    assert sum(map(len, online.values())) > 0.9 * len(got)
    for k, found in online.items():
        for (_, modes), want in zip(sorted(found), modes_of(series[k], [0.1, 0.7]), strict=False):
            assert modes == pytest.approx(want, abs=2e-5)


def test_self_requests(spark):
    day, horizon = 86_400_000_000, 3 * 3_600_000_000
    got = {}
    for r in result(spark, "stream_self_requests"):
        got.setdefault(r["series"], []).append(r["main_t"])
    last = dict(duckdb.sql(f"SELECT user_id, max(epoch_us(ts)) FROM '{DATA}/events.parquet' GROUP BY 1").fetchall())
    assert got
    for k, times in got.items():
        times.sort()
        assert times == list(range(times[0], times[-1] + 1, day)) and all(t % day == 0 for t in times)
        assert times[-1] == (last[k] + horizon) // day * day


def test_model_validation(spark, vectors):
    """The linear sources recomputed from rows; trees are there with as many rows."""
    ids, x, y = vectors
    got = {r["source"]: r for r in result(spark, "model_validation")}
    lo, span, steps = ids[0], ids[-1] - ids[0] + 1, 10
    own = np.array([max(0, (i - lo) * 5 * steps // (2 * span) - 3 * steps // 2 + 1) for i in ids])
    design, later = np.c_[x, np.ones(len(y))], own > 0
    batch = design[later] @ ridge(x[own == 0], y[own == 0], 1.0)
    online = np.array([design[i] @ ridge(x[own < own[i]], y[own < own[i]], 1.0) for i in np.flatnonzero(later)])
    known = y[np.flatnonzero(later) - 1]
    assert set(got) == {"batch", "online", "tree", "known"} and {r["n"] for r in got.values()} == {later.sum()}
    for name, p in (("batch", batch), ("online", online), ("known", known)):
        assert got[name]["mae"] == pytest.approx(np.abs(p - y[later]).mean(), abs=2e-6), name


def test_best_packet_basis_of_every_series(spark, series):
    got = {}
    for r in result(spark, "best_packet_basis"):
        got.setdefault(r["series"], []).append((r["node"], r["cost"]))

    def cost(v):
        return sum(-x * x * math.log(x * x) if x * x > 0 else 0.0 for x in v)

    def least(v, depth):
        if not depth:
            return cost(v)
        n = len(v)
        low = [(v[i] + v[i - 1]) * spectral.HAAR[0] for i in range(1, n, 2)]
        high = [(v[i] - v[i - 1]) * spectral.HAAR[0] for i in range(1, n, 2)]
        return min(cost(v), least(low, depth - 1) + least(high, depth - 1))

    for k, nodes in got.items():
        assert sum(c for _, c in nodes) == pytest.approx(least(series[k][: len(series[k]) // 4 * 4].tolist(), 2), rel=1e-6)
        names = [n for n, _ in nodes]
        assert sum(2.0 ** -len(n) for n in names) == 1 and not any(a != b and b.startswith(a) for a in names for b in names)


def test_gap_table_function(spark):
    tables.register(spark)
    spark.createDataFrame([("a", t) for t in (0, 1, 5, 6, 9)] + [("b", 4)] + [("c", None)], "series string, t long").createOrReplaceTempView("rows_with_gaps")
    run = lambda *x: sorted(map(tuple, spark.sql(f"SELECT * FROM gap_intervals(TABLE(SELECT * FROM rows_with_gaps) PARTITION BY series ORDER BY (t), 1, {', '.join(x)})").collect()))
    assert run("NULL", "NULL") == [("a", 2, 5), ("a", 7, 9)]
    assert run("-2", "12") == [("a", -2, 0), ("a", 2, 5), ("a", 7, 9), ("a", 10, 12), ("b", -2, 4), ("b", 5, 12)]
    inner = core.gaps(spark.table("rows_with_gaps").filter("t IS NOT NULL"), "series", "t", 1, 4).select(F.col("series"), "gap_start", "gap_end")
    assert sorted(map(tuple, inner.collect())) == run("NULL", "NULL")
