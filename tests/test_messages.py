"""Messages as a stream that is started again half-way, responses that wait for their parts, and the sink's commits."""

import json
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.sources import files, messages
from tidemark.streaming import jobs


def drop(folder, name, *values):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(v) + "\n" for v in values))


def message(table, time, *values):
    return {"table": table, "columns": ["bid", "ask"][: len(values)], "rows": [{"time": time, "volume": 1.0, "values": list(values)}]}


def test_each_message_comes_once_over_a_restart(spark, tmp_path):
    inbox, folder = tmp_path / "in", f"file://{tmp_path}/job"
    drop(inbox, "m-001.json", message("a", 1, 1.0, 2.0), message("a", 2, 1.5, 2.5))
    drop(inbox, "m-002.json", message("b", 1, 3.0))
    drop(inbox, ".hidden", message("x", 1, 9.0))
    run = lambda: jobs.run_once(files.exploded_messages(messages.message_stream(spark, str(inbox))), folder)
    first = sorted(map(tuple, run().select("table", "time", "column", "value").collect()))
    assert first == [("a", 1, "ask", 2.0), ("a", 1, "bid", 1.0), ("a", 2, "ask", 2.5), ("a", 2, "bid", 1.5), ("b", 1, "bid", 3.0)]
    drop(inbox, "m-003.json", message("b", 2, 4.0), message("b", 2, 4.0))  # equal messages are two
    again = run().select("table", "time", "column", "value").collect()
    assert sorted(map(tuple, again)) == sorted([*first, ("b", 2, "bid", 4.0), ("b", 2, "bid", 4.0)])
    assert run().count() == 7


def test_an_incomplete_response_is_an_error(spark):
    rows = spark.createDataFrame([(1, "x", 1.0), (1, "y", 2.0), (2, "x", 3.0)], "k long, column string, value double")
    assert [tuple(r) for r in messages.complete(rows.filter("k = 1"), ["k"], ["x", "y"]).collect()] == [(1, 1.0, 2.0)]
    with pytest.raises(Exception, match='incomplete response .*"k":2.*no y'):
        messages.complete(rows, ["k"], ["x", "y"]).collect()


START = datetime(2024, 1, 1)


def results(spark, tmp_path, *batches, strict=True, sink=False):
    """What response_stream gives of batches of (series, seconds, column, value)."""
    schema, folder = "series string, ts timestamp, column string, value double", f"file://{tmp_path}/job"
    for rows in batches:
        spark.createDataFrame([(s, START + timedelta(seconds=t), c, v) for s, t, c, v in rows], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = messages.response_stream(spark.readStream.schema(schema).parquet(f"{folder}/in"), "series", "ts", ["x", "y"], "1 minute", strict)
        if sink:
            messages.register(spark)
            stream.writeStream.format("response").option("checkpointLocation", f"{folder}/marks").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
        else:
            got = jobs.run_once(stream, folder)
    return None if sink else sorted((tuple(r) for r in got.withColumn("t", (F.col("t") / 1_000_000 - F.lit(START.timestamp())).cast("int")).collect()), key=repr)


def test_parts_meet_over_batches(spark, tmp_path):
    got = results(spark, tmp_path, [("a", 1, "x", 1.0), ("b", 1, "y", 5.0)], [("a", 1, "y", 2.0), ("a", 2, "x", 3.0), ("a", 2, "y", 4.0), ("a", 2, "z", 9.0)], [("b", 1, "x", 6.0)])
    assert [(s, x, y) for s, _, x, y in got] == [("a", 1.0, 2.0), ("a", 3.0, 4.0), ("b", 6.0, 5.0)]


def test_a_missing_partner_stops_the_stream_or_comes_apart(spark, tmp_path):
    batches = [[("a", 1, "x", 1.0)], [("b", 600, "x", 1.0), ("b", 600, "y", 1.0)]]
    assert [(s, x, y) for s, _, x, y in results(spark, tmp_path / "loose", *batches, strict=False)] == [("a", 1.0, None), ("b", 1.0, 1.0)]
    with pytest.raises(Exception, match="a at .*: no y"):
        results(spark, tmp_path / "strict", *batches)


def test_sink_shows_committed_epochs(spark, tmp_path):
    results(spark, tmp_path, [("a", 1, "x", 1.0), ("a", 1, "y", 2.0)], [("a", 2, "x", 3.0), ("a", 2, "y", 4.0)], sink=True)
    out = tmp_path / "out"
    read = lambda: sorted((r["series"], r["x"], r["y"]) for p in out.glob("epoch-*.json") for r in map(json.loads, p.read_text().splitlines()))
    assert read() == [("a", 1.0, 2.0), ("a", 3.0, 4.0)] and not list(out.glob("_*"))
    writer = messages.ResponseWriter(str(out))

    class Row:
        def __init__(self, **values):
            self.values = values

        def asDict(self, recursive):
            return self.values

    for _ in range(2):  # an epoch that is done again replaces its own file
        part = writer.write(iter([Row(series="b", x=7.0, y=8.0)]))
        assert ("b", 7.0, 8.0) not in read() or _ == 1
        writer.commit([part], 99)
    assert read().count(("b", 7.0, 8.0)) == 1
    writer.abort([writer.write(iter([Row(series="c", x=0.0, y=0.0)]))], 100)
    assert len(read()) == 3 and not list(out.glob("_*"))


class Kept(dict):
    """A map state that counts the calls that change it or read one entry."""

    calls = 0

    def exists(self):
        return bool(self)

    def iterator(self):
        return iter(list(self.items()))

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self[key]


def test_whole_responses_stay_out_of_the_state():
    """Only pairs that lack a column are put into the state and taken from it, in whatever key and batch they come."""
    pairs, state = messages.Pairs(["x", "y"], True), Kept()
    pairs.values = state
    table = lambda rows: pd.DataFrame(rows, columns=["key", "t", "place", "value"])
    pairs.take((0,), table([(str(n), t, c, n + t + c / 4) for n in range(50) for t in range(20) for c in (0, 1)]))
    pairs.take((0,), table([("7", 99, 1, 5.0), (None, 100, 0, 6.0)]))
    got, again = pairs.due((0,), 0)
    assert len(got) == 1000 and (got["y"] - got["x"] == 0.25).all() and (got["x"] == got["key"].astype(int) + got["t"]).all()
    assert state.calls == 2 and set(state) == {("7", 99), (None, 100)} and again == 99 + 1000
    pairs.take((0,), table([("7", 99, 0, 4.0), ("8", 3, 1, 1.0), ("8", 3, 0, 2.0)]))
    got, again = pairs.due((0,), 50)
    assert sorted(zip(got["key"], got["t"], got["x"], got["y"], strict=True)) == [("7", 99, 4.0, 5.0), ("8", 3, 2.0, 1.0)]
    assert state.calls == 3 and set(state) == {(None, 100)} and again == 100 + 1000
    with pytest.raises(messages.IncompleteResponse, match="None at 100: no y"):
        pairs.due((0,), 101)


@pytest.mark.parametrize("kind", ["long", "string", "date"])
def test_response_keys_keep_their_type(spark, tmp_path, kind):
    keys = {"long": [2**60 + 1, None], "string": ["a", None], "date": [datetime(2024, 2, 29).date(), None]}[kind]
    rows = [(k, START, c, v) for k in keys for c, v in (("x", 1.0), ("y", 2.0))] + [(keys[0], None, "x", 3.0)]
    schema = f"series {kind}, ts timestamp, column string, value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = messages.response_stream(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"), "series", "ts", ["x", "y"], "1 minute")
    got = jobs.run_once(stream, f"file://{tmp_path}").collect()
    assert {(r["series"], r["x"], r["y"]) for r in got} == {(k, 1.0, 2.0) for k in keys} and len(got) == 2
