"""Kernel fits and blocked predictions against numpy."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import kernels

RNG = np.random.default_rng(11)
GAMMA = 0.3


def frame_of(spark, chunks, size, dim=3, noise=0.05):
    x = RNG.normal(size=(chunks * size, dim))
    y = 50 + 10 * np.sin(x[:, 0]) + 5 * x[:, 1] ** 2 + noise * RNG.normal(size=len(x))
    pdf = pd.DataFrame({"id": range(len(x)), "chunk": np.arange(len(x)) // size, "group": np.arange(len(x)) // (2 * size), "x": x.tolist(), "y": y})
    return pdf, spark.createDataFrame(pdf, "id long, chunk long, group long, x array<double>, y double").repartition(3)


def plain_fit(x, y, rounds=4, ridge=1e-3):
    """The chunk's weights by loops over pairs."""
    n, dc = len(y), y.mean()
    sf = np.abs(y - dc).mean() or 1.0
    t = (y - dc) / sf
    a = np.array([[(np.exp(-GAMMA * ((x[i] - x[j]) ** 2).sum()) + t[j]) / n for j in range(n)] for i in range(n)])
    r = np.ones(n)
    for _ in range(rounds):
        w = np.linalg.solve(a.T @ np.diag(r) @ a + ridge / n * np.eye(n), a.T @ (r * t))
        r = 1 / np.maximum(np.abs(t - a @ w), kernels.LEAST_ERROR)
    return {"x": x, "t": t, "w": w, "dc": dc, "sf": sf, "n": n, "score": np.abs(t - a @ w).mean() * sf}


def plain_forecast(m, x):
    return m["dc"] + m["sf"] * np.mean([w * (np.exp(-GAMMA * ((x - s) ** 2).sum()) + t) for s, t, w in zip(m["x"], m["t"], m["w"], strict=True)])


@pytest.mark.parametrize("block", [7, 2048])
@pytest.mark.parametrize("best", [None, 1])
def test_exact_fit_and_blocked_prediction(spark, monkeypatch, block, best):
    monkeypatch.setattr(kernels, "BLOCK", block)
    pdf, frame = frame_of(spark, 4, 30)
    models = kernels.fit_exact(frame, ["group", "chunk"], GAMMA, item="id")
    assert models.count() == 4 * -(-30 // block)
    plain = {c: plain_fit(np.array(part["x"].tolist()), part["y"].to_numpy()) for c, part in pdf.groupby("chunk")}
    for r in models.collect():
        assert r["score"] == pytest.approx(plain[r["chunk"]]["score"], rel=1e-6)
    asked, table = frame_of(spark, 4, 10)
    got = {r["id"]: r["prediction"] for r in kernels.predict(table.withColumn("group", table["group"] % 2), models, ["group"], ["id"], best=best).collect()}
    assert len(got) == 40
    for _, row in asked.iterrows():
        group = row["group"] % 2
        ms = [plain[c] for c in (2 * group, 2 * group + 1)]
        scores = np.array([m["score"] for m in ms])
        turned = scores.max() + scores.min() - scores
        weight = turned / turned.mean()
        used = range(2) if best is None else [int(np.argmin(scores))]
        want = sum(weight[i] * plain_forecast(ms[i], np.array(row["x"])) for i in used) / len(used)
        assert got[row["id"]] == pytest.approx(want, rel=1e-6)


def test_large_fit_equals_its_normal_equations(spark):
    """Any number of partitions and chunks gives what one solve in numpy gives."""
    pdf, frame = frame_of(spark, 3, 200)
    models = {r["chunk"]: r for r in kernels.fit_large(frame.repartition(7), ["chunk"], GAMMA, 50, rounds=3).collect()}
    for c, part in pdf.groupby("chunk"):
        y = part["y"].to_numpy()
        dc, sf = y.mean(), np.abs(y - y.mean()).mean()
        z, t, r = kernels.lifted(np.array(part["x"].tolist()), GAMMA, 50, 1), (y - dc) / sf, np.ones(len(y))
        for _ in range(3):
            b = np.linalg.solve(z.T @ (z * r[:, None]) + 1e-3 * len(y) * np.eye(51), z.T @ (r * t))
            r = 1 / np.maximum(np.abs(t - z @ b), kernels.LEAST_ERROR)
        np.testing.assert_allclose(np.frombuffer(models[c]["w"]), b, rtol=1e-6, atol=1e-9)
        assert models[c]["score"] == pytest.approx(np.abs(t - z @ b).mean() * sf) and models[c]["n"] == 200
    asked, table = frame_of(spark, 3, 5)
    got = {r["id"]: r["prediction"] for r in kernels.predict(table, kernels.fit_large(frame, ["chunk"], GAMMA, 50, rounds=3), ["chunk"], ["id"]).collect()}
    for _, row in asked.iterrows():
        m = models[row["chunk"]]
        assert got[row["id"]] == pytest.approx(m["dc"] + m["sf"] * float((kernels.lifted(np.array([row["x"]]), GAMMA, 50, 1) @ np.frombuffer(m["w"]))[0]), rel=1e-6)


def test_features_stand_in_for_the_kernel(spark):
    """On small chunks many features forecast like the exact kernel ridge."""
    pdf, frame = frame_of(spark, 1, 150)
    x = np.array(pdf["x"].tolist())
    z = kernels.lifted(x, GAMMA, 4000, 1)[:, :-1]
    assert np.abs(z @ z.T - kernels.rbf(x, x, GAMMA)).max() < 0.12
    asked, table = frame_of(spark, 1, 40)
    truth = asked["y"].to_numpy()
    error = {}
    for name, models in (("exact", kernels.fit_exact(frame, ["chunk"], GAMMA, 1e-4)), ("large", kernels.fit_large(frame, ["chunk"], GAMMA, 400, 1e-4))):
        got = {r["id"]: r["prediction"] for r in kernels.predict(table, models, ["chunk"], ["id"]).collect()}
        error[name] = np.median(np.abs(np.array([got[i] for i in range(40)]) - truth))
    spread = np.abs(truth - np.median(truth)).mean()
    assert error["large"] < 0.3 * spread and error["exact"] < 0.5 * spread


def test_absolute_errors_ignore_a_few_wild_labels(spark):
    pdf, frame = frame_of(spark, 1, 400, noise=0.0)
    wild = pdf.assign(y=[y + (5000 if i % 40 == 0 else 0) for i, y in enumerate(pdf["y"])])
    table = spark.createDataFrame(wild, frame.schema)
    asked, clean = frame_of(spark, 1, 30, noise=0.0)
    error = {}
    for rounds in (1, 12):
        got = {r["id"]: r["prediction"] for r in kernels.predict(clean, kernels.fit_large(table, ["chunk"], GAMMA, 60, 1e-4, rounds), ["chunk"], ["id"]).collect()}
        error[rounds] = np.median(np.abs(np.array([got[i] for i in range(30)]) - asked["y"].to_numpy()))
    assert error[12] < 0.2 * error[1]


def test_equal_labels_one_row_and_no_rows(spark):
    frame = spark.createDataFrame([(0, 0, [1.0], 5.0), (1, 0, [2.0], 5.0), (2, 1, [3.0], 7.0)], "id long, chunk long, x array<double>, y double")
    for models in (kernels.fit_exact(frame, ["chunk"], GAMMA), kernels.fit_large(frame, ["chunk"], GAMMA, 20)):
        got = {r["id"]: r["prediction"] for r in kernels.predict(frame, models, ["chunk"], ["id"]).collect()}
        assert got == {0: pytest.approx(5.0), 1: pytest.approx(5.0), 2: pytest.approx(7.0)}
    assert kernels.predict(frame, kernels.fit_exact(frame.limit(0), ["chunk"], GAMMA), ["chunk"], ["id"]).count() == 0
    assert kernels.fit_large(frame.limit(0), ["chunk"], GAMMA, 20).count() == 0
