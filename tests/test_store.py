"""The stored table: replaced keys, versions, saves that die, saves at a time, and how many files a save rewrites."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.sources import store


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/table"


def rows(spark, pairs):
    return spark.createDataFrame(list(pairs), "k long, v string")


def stored(spark, path, version=None):
    return sorted((r["k"], r["v"]) for r in store.read(spark, path, version).collect())


def test_saves_against_a_dictionary(spark, path):
    rnd, table = random.Random(2), {}
    assert store.read(spark, path) is None and store.versions(spark, path) == []
    for n in range(6):
        new = {rnd.randrange(-50, 400): f"{n}" for _ in range(rnd.choice([1, 40, 120]))}
        table |= new
        for _ in range(2 if n == 3 else 1):  # a save that is done again changes nothing
            store.save(path, rows(spark, new.items()), ["k"], file_rows=20)
            assert stored(spark, path) == sorted(table.items())
    assert store.versions(spark, path) == list(range(7))


def test_old_versions_and_clean(spark, path, tmp_path):
    store.save(path, rows(spark, ((i, "a") for i in range(100))), ["k"], file_rows=10)
    store.save(path, rows(spark, [(5, "b")]), ["k"], file_rows=10)
    store.save(path, rows(spark, [(6, "c")]), ["k"], file_rows=10)
    assert dict(stored(spark, path, 0))[5] == "a" and dict(stored(spark, path, 1)) == dict(stored(spark, path, 0)) | {5: "b"}
    now, count = stored(spark, path), lambda: len(list((tmp_path / "table" / "data").rglob("*.parquet")))
    before = count()
    assert store.clean(spark, path, keep=1) > 0 and count() < before
    assert stored(spark, path) == now and store.versions(spark, path) == [2]
    assert store.clean(spark, path, keep=1) == 0
    with pytest.raises(ValueError, match="no version 0"):
        store.read(spark, path, 0)


def test_a_save_that_dies_leaves_the_old_version(spark, path, monkeypatch):
    store.save(path, rows(spark, ((i, "a") for i in range(50))), ["k"])
    before = stored(spark, path)

    def dies(*_):
        raise KeyboardInterrupt

    for step in ("_described", "publish"):
        with monkeypatch.context() as m:
            m.setattr(store, step, dies)
            with pytest.raises(KeyboardInterrupt):
                store.save(path, rows(spark, [(1, "b"), (99, "b")]), ["k"])
        assert stored(spark, path) == before and store.versions(spark, path) == [0]
    store.clean(spark, path)
    store.save(path, rows(spark, [(1, "b"), (99, "b")]), ["k"])
    assert dict(stored(spark, path)) == dict(before) | {1: "b", 99: "b"}


def test_of_two_saves_the_later_starts_again(spark, path, monkeypatch):
    store.save(path, rows(spark, ((i, "a") for i in range(20))), ["k"])
    publish, between = store.publish, []

    def slow(*args):
        if not between:  # another save is done before this one is published
            between.append(1)
            store.save(path, rows(spark, [(2, "other"), (3, "other")]), ["k"])
        publish(*args)

    monkeypatch.setattr(store, "publish", slow)
    assert store.save(path, rows(spark, [(3, "mine"), (4, "mine")]), ["k"]).version == 2
    found = dict(stored(spark, path))
    assert (found[2], found[3], found[4], found[5]) == ("other", "mine", "mine", "a")
    with pytest.raises(store.Conflict):
        store.publish(spark, path, 2, "again")


def test_clustered_keys_rewrite_few_files(spark, path):
    table = spark.range(20_000).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    first = store.save(path, table, ["k"], file_rows=200)
    assert first.written >= 100
    one = store.save(path, table.filter("k >= 7000 AND k < 7200").withColumn("v", F.lit("b")), ["k"], file_rows=200)
    assert one.replaced <= 0.05 * first.written and one.kept == first.written - one.replaced
    assert store.read(spark, path).filter("v = 'b'").count() == 200 and store.read(spark, path).count() == 20_000
    # keys that the ranges hold but the filters don't touch next to nothing
    odd = store.save(f"{path}-even", table.filter("k % 2 = 0"), ["k"], file_rows=200)
    new = store.save(f"{path}-even", table.filter("k % 100 = 51"), ["k"], file_rows=200)
    assert new.replaced <= 0.1 * odd.written and store.read(spark, f"{path}-even").count() == 10_200


def test_two_columns_nulls_and_no_rows(spark, path):
    schema = "a string, t timestamp_ntz, x double"
    day = "2024-01-0{}T00:00:00"
    make = lambda *r: spark.createDataFrame([(a, t, x) for a, t, x in r], "a string, t string, x double").withColumn("t", F.col("t").cast("timestamp_ntz"))
    store.save(path, make(("p", day.format(1), 1.0), ("q", day.format(1), 2.0), (None, day.format(2), 3.0)), ["a", "t"])
    store.save(path, make(("p", day.format(1), 9.0), ("p", day.format(2), 4.0)), ["a", "t"])
    assert store.read(spark, path).schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString()
    assert sorted((r["x"] for r in store.read(spark, path).collect())) == [2.0, 3.0, 4.0, 9.0]
    store.save(path, make().limit(0), ["a", "t"])
    assert store.read(spark, path).count() == 4


def test_filters_have_no_false_negatives():
    h = np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 5000)
    data = store.bloom(h[:2500])
    assert store.may_hold(data, 2500, h[:2500]).all() and store.may_hold(data, 2500, h[2500:]).mean() < 0.03
