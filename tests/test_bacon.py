"""Outlier nomination and medians against plain numpy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import frames, stats

RNG = np.random.default_rng(21)


def plain(x, alpha=0.01, start=4):
    """Subset by loops until it stands still."""
    n, p = x.shape
    middle = np.sort(x, axis=0)[(n - 1) // 2]
    d = np.round(((x - middle) ** 2).sum(1), 9)
    size = start * p
    while True:
        inside = d <= np.sort(d)[min(n, size) - 1]
        if np.linalg.matrix_rank(np.corrcoef(x[inside].T)) == p:
            break
        size *= 2
    for _ in range(100):
        off = x - x[inside].mean(0)
        d2 = np.einsum("ij,jk,ik->i", off, np.linalg.inv(np.cov(x[inside].T)), off)
        r, h = inside.sum(), (n + p + 1) // 2
        cut = frames.chi_square_quantile(p, alpha / n) * (1 + (p + 1) / (n - p) + 2 / (n - 1 - 3 * p) + max(0, (h - r) / (h + r))) ** 2
        new = d2 < cut
        if (new == inside).all():
            break
        inside = new
    return ~inside


@pytest.fixture(scope="module")
def table():
    parts = []
    for g, (n, bad) in enumerate([(3000, 90), (500, 0), (400, 40)]):
        x = RNG.multivariate_normal([5, -3, 100], [[4, 1, 0], [1, 2, 0.5], [0, 0.5, 9]], n)
        x[:bad] += RNG.choice([-1, 1], (bad, 3)) * RNG.uniform(30, 60, (bad, 3))
        parts.append(pd.DataFrame(x, columns=["a", "b", "c"]).assign(g=g, id=range(n), planted=np.arange(n) < bad))
    return pd.concat(parts)


def test_planted_outliers_are_found_and_clean_rows_stay(spark, table):
    got = frames.bacon(spark.createDataFrame(table).repartition(5), ["g"], ["a", "b", "c"]).toPandas()
    for g, part in got.groupby("g"):
        part = part.sort_values("id")
        assert part.loc[part["planted"], "outlier"].all()
        assert part.loc[~part["planted"], "outlier"].mean() < 0.01
        assert (part["outlier"].to_numpy(bool) == plain(part[["a", "b", "c"]].to_numpy())).all(), g


def test_more_rounds_change_nothing(spark, table):
    rows = spark.createDataFrame(table)
    flags = [{(r["g"], r["id"]) for r in frames.bacon(rows, ["g"], ["a", "b", "c"], rounds=n).filter("outlier").collect()} for n in (12, 20)]
    assert flags[0] == flags[1] and flags[0]


def test_nulls_equal_rows_and_no_rows(spark, table):
    rows = spark.createDataFrame(table[table["g"] == 1]).select("g", "a", "b", "c")
    odd = rows.unionByName(spark.createDataFrame([(1, None, 1.0, 1.0)] + [(7, 2.0, 3.0, 4.0)] * 30, "g long, a double, b double, c double"))
    got = frames.bacon(odd, ["g"], ["a", "b", "c"])
    assert got.filter("a IS NULL").collect()[0]["outlier"] is None
    assert got.filter("g = 7 AND outlier").count() == 0 and got.count() == odd.count()
    assert frames.bacon(rows.limit(0), ["g"], ["a", "b", "c"]).count() == 0


@pytest.mark.parametrize(("p", "x"), [(1, 3.841459), (2, 5.991465), (3, 7.814728), (10, 18.307038), (25, 37.652484)])
def test_quantiles_of_the_chi_square_distribution(p, x):
    assert math.isclose(frames.chi_square_quantile(p, 0.05), x, rel_tol=1e-6)


def test_medians_by_places(spark):
    rows = [(k, float(v)) for k, n in ((0, 501), (1, 500), (2, 1), (3, 2)) for v in RNG.integers(0, 40, n)] + [(4, None), (5, None), (5, 2.5)]
    got = {r["k"]: r["median"] for r in stats.median(spark.createDataFrame(rows, "k long, v double").repartition(4), "k", F.col("v")).collect()}
    want = {k: float(np.median([v for j, v in rows if j == k and v is not None])) for k in (0, 1, 2, 3, 5)}
    assert got == want


def test_only_rows_near_the_least_are_ranked(spark):
    """Of 20,000 rows of a group few are left to rank, and all ties of the last place are among them; small groups come whole."""
    values = RNG.permutation(np.r_[[0.5] * 3, [1.0] * 6, RNG.uniform(2, 1e6, 19_991)])
    rows = spark.createDataFrame([(1, float(v)) for v in values] + [(2, 3.0)] * 5, "g long, v double").repartition(3)
    left = frames.least_rows(rows, "g", "v", 8).collect()
    ones = sorted(r["v"] for r in left if r["g"] == 1)
    assert ones[:9] == [0.5] * 3 + [1.0] * 6 and len(ones) < 200
    assert sum(r["g"] == 2 for r in left) == 5


def test_groups_by_several_keys_and_without_a_key(spark, table):
    """Keys of any type, also some that are not there (those rows are in no subset) and columns that are keys."""
    rows = spark.createDataFrame(table.assign(k="x")).withColumn("k", F.when(F.col("g") != 2, F.col("k")).when(F.col("id") > 200, F.lit("y")))
    got = frames.bacon(rows.repartition(5), ["k", "g"], ["a", "b", "c"]).toPandas()
    assert got[got["k"].isna()]["outlier"].isna().all() and got["k"].isna().sum() == 201
    for g, part in got[got["k"].notna()].groupby(["k", "g"]):
        assert (part["outlier"].to_numpy(bool) == plain(part[["a", "b", "c"]].to_numpy())).all(), g
