"""Streams with event-time timers: silent series, late ticks, eviction, state that goes."""

from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators.core import HOUR, SECOND
from tidemark.streaming import jobs

START = datetime(2002, 1, 20, 23, 59, 59)
US = int((START - datetime(1970, 1, 1)).total_seconds() * 1e6)


def feed(spark, folder, build, batches):
    """What build(stream) gives of batches of (series, seconds after START, price, asked), one file each."""
    got = []
    for n, rows in enumerate(batches):
        table = [(s, START + timedelta(seconds=t), p, a) for s, t, p, a in rows]
        spark.createDataFrame(table, "series string, ts timestamp, price double, asked boolean").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("series string, ts timestamp, price double, asked boolean").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        got = jobs.run_once(build(stream), folder)
        assert n < len(batches)
    return sorted((tuple(r) for r in got.collect()), key=repr)


def tick(series, t, price):
    return series, t, price, False


def ask(series, t):
    return series, t, None, True


def test_a_series_that_stops_gives_its_fallbacks_and_then_nothing(spark, tmp_path):
    hours = lambda *xs: [tick("live", 3600 * x + 5, float(x)) for x in xs]
    batches = [[tick("stops", 10, 4.0), tick("stops", 20, 6.0), *hours(0, 1)], hours(2, 3), hours(*range(4, 40))]
    got = feed(spark, f"file://{tmp_path}", lambda s: jobs.last_good(s, HOUR, 10), batches)
    first = US // HOUR
    mine = [(slot - first, price, fresh) for s, slot, price, fresh in got if s == "stops"]
    own = next(slot for slot, _, fresh in mine if fresh)
    assert sorted(mine) == [(own, 5.0, True)] + [(own + i, 5.0, False) for i in range(1, 11)]


@pytest.mark.parametrize("cuts", [[], [3], [1, 2, 4]])
def test_order_and_batches_do_not_matter(spark, tmp_path, cuts):
    """Ticks that are late by less than the watermark allows count as if they had come in time."""
    rows = [tick("a", 10, 1.0), tick("a", 3700, 4.0), tick("a", 30, 3.0), tick("b", 7300, 8.0), tick("a", 3800, 6.0), tick("b", 40_000, 9.0)]
    ends = [0, *cuts, len(rows)]
    got = feed(spark, f"file://{tmp_path}", lambda s: jobs.last_good(s, HOUR, 2, "2 hours"), [rows[i:j] for i, j in zip(ends, ends[1:], strict=False)])
    first = US // HOUR
    assert [(s, slot - first, p, f) for s, slot, p, f in sorted(got, key=lambda r: (r[0], r[1]))] == [
        ("a", 0, 2.0, True) if US % HOUR < 3590 * SECOND else ("a", 1, 2.0, True),
        *[("a", x, *y) for x, y in zip((1, 2, 3) if US % HOUR < 3590 * SECOND else (2, 3, 4), ((5.0, True), (5.0, False), (5.0, False)), strict=True)],
        *[("b", x, 8.0, f) for x, f in zip((2, 3, 4) if US % HOUR < 3590 * SECOND else (3, 4, 5), (True, False, False), strict=True)],
    ]


def test_means_of_quotes_evict_and_last(spark, tmp_path):
    """Averages over a second: three quotes, eviction of faded ones, and the last answer until exactly ten seconds later."""
    first = [tick("basic", 0, 1.0), ask("basic", 0), tick("basic", 0.1, 1.1), ask("basic", 0.1), tick("basic", 0.2, 1.1), ask("basic", 0.2)]
    faded = [tick("evict", 0, 1.0), tick("evict", 0.1, 1.1), ask("evict", 0.1), tick("evict", 0.3, 0.9), tick("evict", 0.4, 1.0), ask("evict", 0.4)]
    faded += [tick("evict", 0.5 + i / 10, 1.1) for i in range(10)] + [ask("evict", 1.4)]
    last = [tick("last", 1, 1.0), ask("last", 1), ask("last", 11), ask("last", 11.001)]
    got = feed(spark, f"file://{tmp_path}", lambda s: jobs.answered(s, SECOND, 10, "1 second"), [first, faded, last, [tick("end", 60, 0.0)]])
    found = {(s, round((t - US) / 1e6, 6)): (p, fresh) for s, t, p, fresh in got}
    assert len(found) == 9, found
    want = {("basic", 0): 1.0, ("basic", 0.1): 1.05, ("basic", 0.2): 1.075, ("evict", 0.1): 1.05, ("evict", 0.4): 1.0, ("evict", 1.4): 1.1, ("last", 1): 1.0}
    for key, price in want.items():
        assert found[key] == (pytest.approx(price), True), key
    assert found["last", 11.0] == (1.0, False) and found["last", 11.001] == (None, False) and len(found) == 9


def test_dead_series_leave_no_state(spark, tmp_path):
    """After the last fallback a series has no rows in the state store."""
    folder = f"file://{tmp_path}"
    feed(spark, folder, lambda s: jobs.last_good(s, HOUR, 3), [[tick("dead", 10, 1.0)], [tick("live", 3600 * 30, 1.0)], [tick("live", 3600 * 60, 1.0)]])
    for name, keys in (("open", {"live"}), ("last", {"live"})):
        state = spark.read.format("statestore").option("stateVarName", name).load(f"{folder}/marks")
        assert {r["series"] for r in state.select(F.col("key.series").alias("series")).distinct().collect()} <= keys


def test_retained_quotes_fade(spark, tmp_path):
    got = feed(spark, f"file://{tmp_path}", lambda s: jobs.retained(s, 2, HOUR), [[tick("a", 0, 1.0), tick("a", 3600, 1.0)], [tick("a", 3600 * 2.5, 1.0), tick("a", 3600 * 2.6, 1.0)], [tick("b", 3600 * 50, 1.0)], [tick("a", 3600 * 50, 1.0)]])
    assert sorted((s, kept) for s, _, kept in got) == [("a", 1), ("a", 2), ("a", 3), ("b", 1)]


class Kept:
    """A handle, and a value state, that count the calls."""

    def __init__(self):
        self.calls, self.value, self.timers, self.states = 0, None, set(), {}

    def getValueState(self, name, schema):
        return self.states.setdefault(name, Kept())

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


def test_calls_to_the_state_do_not_grow_with_the_slots():
    """A batch of a series costs a read, a write and a timer, however many slots its ticks are in, and as much when they come out."""

    class Now:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    handle, hours = Kept(), 200
    good = jobs.LastGood(HOUR, 3)
    good.init(handle)
    calls = lambda: handle.calls + sum(s.calls for s in handle.states.values())
    ticks = pd.DataFrame({"t": [h * HOUR + 1 for h in range(0, hours, 2) for _ in range(2)], "price": [float(h + i) for h in range(0, hours, 2) for i in (0, 2)]})
    assert not list(good.handleInputRows(("a",), iter([ticks[:50], ticks[50:]]), Now(0))) and calls() == 3
    assert handle.timers == {HOUR // 1000 - 1}
    (got,) = good.handleExpiredTimer(("a",), Now(100 * HOUR // 1000), Now(handle.timers.pop()))
    slots = [(x, p, f and x == a) for a, b, p, f in got[["slot", "upto", "price", "fresh"]].itertuples(index=False) for x in range(a, b)]
    assert slots == [(x, x // 2 * 2 + 1.0, x % 2 == 0) for x in range(100)] and calls() == 3 + 5
    ends = [g for g in good.handleExpiredTimer(("a",), Now(1000 * HOUR // 1000), Now(handle.timers.pop()))]
    assert [(r.slot, r.upto) for r in ends[0].itertuples()][-1] == (hours - 2, hours + 2)
    assert not handle.timers and handle.states["open"].value is None and handle.states["last"].value is None


def test_periods_of_unknown_prices_are_as_in_sql(spark, tmp_path):
    """Prices that are not there don't count; a period without others has no price, and it is what the next ones get."""
    got = feed(spark, f"file://{tmp_path}", lambda s: jobs.last_good(s, HOUR, 1), [[tick("a", 10, None), tick("a", 20, 3.0), tick("a", 7300, None), tick(None, 7300, 4.0), tick("b", 40_000, 9.0)]])
    first = min(slot for _, slot, _, _ in got)
    want = [(None, 2, 4.0, True), (None, 3, 4.0, False), ("a", 0, 3.0, True), ("a", 1, 3.0, False), ("a", 2, None, True), ("a", 3, None, False)]
    assert [(s, slot - first, p, f) for s, slot, p, f in got if s != "b"] == sorted([(s, x, p, f) for s, x, p, f in want], key=repr)
