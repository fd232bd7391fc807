"""Stored tables that are saved over and again, and streams whose results hang on no split into batches."""

import pytest
from compare import DATA, duck
from pyspark.sql import functions as F

from tidemark.operators import core, frames, spectral
from tidemark.plans import registry, streams
from tidemark.sources import files, requests, store
from tidemark.streaming import jobs


def test_replace_into(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    read = lambda: sorted((r["k"], r["v"]) for r in store.read(spark, path).select("k", "v").collect())
    files.replace_into(path, rows(*((i, "a") for i in range(100))), ["k"])
    for _ in range(2):  # a save that is done again changes nothing
        files.replace_into(path, rows((3, "b"), (200, "b")), ["k"])
        assert read() == [(i, "b" if i == 3 else "a") for i in range(100)] + [(200, "b")]
    files.upsert_into(path, rows((5, "x"), (5, "z"), (5, "y")), ["k"], "v")
    assert dict(read())[5] == "z" and len(read()) == 101


def test_tail_overwriting_against_brute_force(spark, tmp_path):
    import random

    deal, table, schema = random.Random(3), [], "k long, t long, v long"
    put = jobs.tail_overwriting(f"file://{tmp_path}/tail", "k", "t")
    for number in range(6):
        low = number * core.DAY - (number % 2) * 2 * core.DAY  # odd batches reach back over stored days
        batch = [(deal.randrange(3), low + deal.randrange(3 * core.DAY), number) for _ in range(20)] if number != 3 else []
        first = {k: min(t for x, t, _ in batch if x == k) for k, _, _ in batch}
        table = [r for r in table if r[0] not in first or r[1] < first[r[0]]] + batch
        for _ in range(2):  # a batch that is done again changes nothing
            put(spark.createDataFrame([*batch, (0, None, number)], schema), number)
        got = jobs.tail_table(spark, f"file://{tmp_path}/tail", spark.createDataFrame([], schema).schema)
        assert sorted(map(tuple, got.collect())) == sorted(table)


def test_requests(spark, tmp_path):
    schema = "request_id long, user_id long, dataset string, start_t long, end_t long, processed boolean"
    rows = [(1, 1, "a", 0, 10, False), (2, 1, "a", 0, 10, False), (3, 1, "a", 0, 20, False), (4, 2, "a", 0, 5, True), (5, 2, "b", 0, 4, False)]
    new, path = spark.createDataFrame(rows, schema), f"file://{tmp_path}/r"
    assert [r["request_id"] for r in requests.open_requests(new).collect()] == [5, 2, 3]
    assert requests.table(spark, path, new.schema).count() == 0
    files.replace_into(path, new, requests.KEY)
    requests.mark_done(path, requests.table(spark, path, new.schema), spark.createDataFrame([(2,)], "request_id long"))
    requests.force_finalize(path, requests.table(spark, path, new.schema), 5)
    now = requests.table(spark, path, new.schema)
    assert {r["request_id"] for r in now.filter("processed").collect()} == {2, 4, 5}
    assert {r["request_id"] for r in requests.pruned(now, 6).collect()} == {1, 2, 3}


@pytest.mark.parametrize("build", [lambda s: jobs.last_good(s, core.HOUR, 10), lambda s: jobs.tumbling_bars(s, "1 hour", "1 hour"), lambda s: jobs.online_modes(s, [0.1, 0.7])])
def test_any_split_gives_the_same(spark, build):
    def rows(ranges):
        to, out = streams.folder(spark, "split"), []
        jobs.replay(spark, f"{DATA}/events.parquet", to, lambda s: out.append(jobs.run_once(build(s), to)), ranges)
        price = [F.round(c, 6).alias(c) if c == "price" else F.transform(c, lambda x: F.round(x, 6)).alias(c) if c == "modes" else F.col(c) for c in out[-1].columns]
        return sorted(map(repr, out[-1].select(*price).collect()))

    assert rows(1) == rows(4)


def test_self_requests_come_once(spark):
    got = registry.QUERIES["stream_self_requests"](spark, DATA)
    want = duck().sql("SELECT count(*) FROM (SELECT user_id, max(epoch_us(ts)) AS hi FROM events GROUP BY 1)").fetchall()[0][0]
    assert got.count() == got.distinct().count() and got.select("series").distinct().count() <= want


def test_best_basis(spark):
    import math

    table = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate([4, 4, 4, 4, 1, -1, 1, -1])], "k string, row_ix long, v double")
    cost = lambda xs: sum(-x * x * math.log(x * x) if abs(x) > 1e-9 else 0.0 for x in xs)

    def tree(node, xs, depth):
        if not depth:
            return cost(xs), [node]
        low = [(xs[i] + xs[i + 1]) * math.sqrt(0.5) for i in range(0, len(xs), 2)]
        high = [(xs[i + 1] - xs[i]) * math.sqrt(0.5) for i in range(0, len(xs), 2)]
        parts = [tree(node + b, x, depth - 1) for b, x in (("0", low), ("1", high))]
        below = sum(p[0] for p in parts)
        return (cost(xs), [node]) if cost(xs) <= below + 1e-9 else (below, parts[0][1] + parts[1][1])

    got = spectral.best_basis(table, "k", "v", spectral.HAAR, 2).collect()
    least, nodes = tree("", [4, 4, 4, 4, 1, -1, 1, -1], 2)
    assert sorted(r["node"] for r in got) == sorted(nodes) and sum(r["cost"] for r in got) == pytest.approx(least, abs=1e-6)


def test_bacon_sees_what_each_column_hides(spark):
    rows = [(i, float(i % 50), float(i % 50) + 0.1 * (i % 7)) for i in range(500)] + [(1000, 5.0, 45.0)]
    got = frames.bacon(spark.createDataFrame(rows, "i long, x double, y double").withColumn("k", F.lit(1)), ["k"], ["x", "y"])
    assert [r["i"] for r in got.filter("outlier").collect()] == [1000]


def test_places_in_order(spark):
    rows = [(0 if i % 3 else i, float(i * 7919 % 1000), i) for i in range(1000)]
    table = spark.createDataFrame(rows, "k long, v double, i long")
    got = core.in_order(table, "k", [F.desc("v"), F.col("i")], sums={"run": F.col("v")}).collect()
    for k in {r[0] for r in rows}:
        order = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2]))
        mine = sorted((r for r in got if r["k"] == k), key=lambda r: r["place"])
        assert [r["i"] for r in mine] == [r[2] for r in order] and {r["place_of"] for r in mine} == {len(order)}
        assert [r["place"] for r in mine] == [*range(1, len(order) + 1)] and mine[-1]["run"] == sum(r[1] for r in order)


def test_chunk_models_predict_rows_they_have_not_seen(spark):
    ids = {r["vec_id"] for r in registry.QUERIES["chunked_prediction"](spark, DATA).collect()}
    assert ids == {r[0] for r in duck().sql("SELECT vec_id FROM embeddings WHERE vec_id % 5 = 0").fetchall()}
