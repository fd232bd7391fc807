"""Structured Streaming twins of the series operators.

Streams carry (series, ts timestamp, price, ...). Watermarks bound the state; rows later than that are for the batch repair job, which
overwrites the tail.
"""

from __future__ import annotations

import itertools
import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.core import micros
from tidemark.sources import store
from tidemark.sources.files import replace_into


def tick_stream(spark: SparkSession, path: str) -> DataFrame:
    """Ticks of an events folder as a stream; a trigger takes all files that are new."""
    raw = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    return raw.select("event_id", F.col("user_id").alias("series"), F.timestamp_micros(micros("ts")).alias("ts"), F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("long").alias("qty"))


def run_once(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """What the stream gives for all that is there now, written under `folder` with its checkpoint, as a table."""
    out, marks = f"{folder}/out", f"{folder}/marks"
    stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def replay(spark: SparkSession, path: str, folder: str, step, ranges: int = 3) -> None:
    """Feeds an events table to a stream in `ranges` ranges of time, oldest first, each as one micro-batch.

    step(stream) runs the stream over what is there; its checkpoint goes on where the range before left it. So batches come in order of time, as a live
    feed brings them, however many files the table has."""
    events = spark.read.parquet(path)
    ends = events.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    if ends["lo"] is None:
        events.write.mode("append").parquet(f"{folder}/in")
        step(tick_stream(spark, f"{folder}/in"))
        return
    cuts = [ends["lo"] + (ends["hi"] - ends["lo"]) * i / ranges for i in range(1, ranges)]
    place = sum((F.col("ts") >= F.lit(c).cast("timestamp_ntz")).cast("int") for c in cuts) if cuts else F.lit(0)
    for i in range(ranges):
        events.filter(place == i).write.mode("append").parquet(f"{folder}/in")
        step(tick_stream(spark, f"{folder}/in"))


def run_batches(stream: DataFrame, folder: str, each) -> None:
    """Calls each(batch, number) for all that is there now."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/marks").trigger(availableNow=True).start().awaitTermination()


def tail_overwriting(folder: str, key: str, time: str):
    """foreachBatch: each batch overwrites what is stored of its series from its first time on; the table is read by tail_table.

    A batch writes only files anew that hold rows it overwrites; it is one version of the stored table (see sources.store). A batch that is done again changes
    nothing. Rows without a time have no place in a series and are left out."""

    def put(batch: DataFrame, number: int) -> None:
        new = batch.filter(F.col(time).isNotNull())
        if not new.isEmpty():
            store.save(folder, new, [key, time], how="tail")

    return put


def tail_table(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The table that tail_overwriting keeps in `folder`."""
    rows = store.read(spark, folder)
    return spark.createDataFrame([], schema) if rows is None else rows.select(*schema.names)


def key_replacing(folder: str, keys: list[str]):
    """foreachBatch: rows of a batch win over stored ones with their keys; only files that hold such keys are written anew."""
    return lambda batch, number: replace_into(folder, batch, keys)


def tumbling_bars(stream: DataFrame, period: str, late: str, offset: str = "0 seconds") -> DataFrame:
    """Averages, extremes and counts of each period once its watermark has passed."""
    w = F.window("ts", period, None, offset)
    return stream.withWatermark("ts", late).groupBy("series", w).agg(F.avg("price").alias("price"), F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.count("*").alias("n")).select("series", F.col("window.start").alias("start"), "price", "open", "high", "low", "close", "n")


def trailing_twap(stream: DataFrame, period: str, slide: str, late: str) -> DataFrame:
    """Trapezoid average over each (end - period, end], as one array of a window's quotes, sorted."""
    w = F.window("ts", period, slide)
    quotes = F.array_sort(F.collect_list(F.struct(F.unix_micros("ts").alias("t"), "price")))
    got = stream.withWatermark("ts", late).groupBy("series", w).agg(quotes.alias("q"))
    steps = F.zip_with(F.slice("q", 1, F.size("q") - 1), F.slice("q", 2, F.size("q")), lambda a, b: F.struct(((b["t"] - a["t"]) * (a["price"] + b["price"]) / 2).alias("area"), (b["t"] - a["t"]).alias("dt")))
    area, dt = (F.aggregate(F.transform(steps, lambda s: s[c].cast("double")), F.lit(0.0), lambda a, b: a + b) for c in ("area", "dt"))  # noqa: B023
    return got.select("series", F.col("window.end").alias("until"), F.when(dt > 0, area / dt).otherwise(F.element_at("q", -1)["price"]).alias("twap"))


def with_state(rows: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str) -> DataFrame:
    """(keys, schema): rows (a stream with a watermark) through a processor with states and event-time timers. The stream's session keeps such states in RocksDB."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    names = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, f"{names}, {schema}", "Append", "EventTime")


class Timed(StatefulProcessor):
    """A processor that is told of new rows and of the watermark: `take` puts rows into the state, `due` gives what the watermark (microseconds) lets out and
    names the time it is to be asked at again (None: no more). Each key has one timer."""

    def init(self, handle) -> None:
        self.handle = handle
        self.set_up(handle)

    def _let_out(self, key, watermark: int) -> Iterator[pd.DataFrame]:
        out, again = self.due(key, watermark)
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        if again is not None:
            # a timer fires once the watermark is past its millisecond; one that isn't ahead of the watermark would not
            self.handle.registerTimer(max(again // 1000 - 1, watermark // 1000 + 1))
        if len(out):
            yield out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            self.take(key, part)
        yield from self._let_out(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._let_out(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


class LastGood(StatefulProcessor):
    """See last_good. State: sums of the slots that may still get ticks, with the timer that is set; the last good slot, its price, and the first slot after what
    has come out. Each is one value, as every call to the state is a message to the JVM; ticks that no slot is due with cost a read and a write. Sums lie packed,
    a slot (long), its total (double) and number of prices (long) each."""

    SUMS = struct.Struct("<qdq")

    def __init__(self, period: int, valid: int):
        self.period, self.valid = period, valid

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "sums binary, timer long")
        self.last = handle.getValueState("last", "slot long, price double, upto long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        packed, timer = self.open.get() or (b"", None)
        sums = {slot: (total, n) for slot, total, n in self.SUMS.iter_unpack(packed)}
        for part in rows:
            for slot, price in zip((part["t"].to_numpy() // self.period).tolist(), part["price"].tolist(), strict=True):
                total, n = sums.get(slot, (0.0, 0))
                sums[slot] = (total, n) if math.isnan(price) else (total + price, n + 1)
        if timer is not None and timer <= watermark or sums and min(sums) < watermark * 1000 // self.period:
            yield from self._let_out(key, watermark, sums, timer, None)
        elif sums:
            self._keep(sums, timer, min([self._timer(min(sums) + 1, watermark), *([] if timer is None else [timer])]), None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        packed, timer = self.open.get() or (b"", None)
        sums = {slot: (total, n) for slot, total, n in self.SUMS.iter_unpack(packed)}
        yield from self._let_out(key, timerValues.getCurrentWatermarkInMs(), sums, timer, expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass

    def _timer(self, slot: int, watermark: int) -> int:
        """The millisecond after which the watermark has reached a slot's begin; one that isn't ahead of the watermark would not fire."""
        return max(slot * self.period // 1000 - 1, watermark + 1)

    def _keep(self, sums: dict, old: int | None, timer: int, fired: int | None) -> None:
        """Open slots and one timer instead of the old one; one that has fired goes by itself."""
        if old != timer:
            if old is not None and old != fired:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timer)
        self.open.update((b"".join(self.SUMS.pack(slot, total, n) for slot, (total, n) in sums.items()), timer))

    def _let_out(self, key, watermark: int, sums: dict, timer: int | None, fired: int | None) -> Iterator[pd.DataFrame]:
        """Each row stands for a run of slots, of which the first is a good one (fresh) or none is."""
        last, end, out = self.last.get(), watermark * 1000 // self.period, []
        was = last
        for slot in [*sorted(sums), None]:
            until = end if slot is None else min(slot, end)
            if last is not None:
                upto = min(until, last[0] + 1 + self.valid)
                if upto > last[2]:
                    if out and out[-1][1] == last[2]:
                        out[-1][1] = upto
                    else:
                        out.append([last[2], upto, last[1], False])
                    last = last[0], last[1], upto
            if slot is None or slot >= end:
                break
            total, n = sums.pop(slot)
            last = slot, total / n if n else None, slot + 1
            out.append([slot, slot + 1, last[1], True])
        again = [min(sums) + 1] if sums else []
        if last is not None and last[2] < last[0] + 1 + self.valid:
            again.append(last[2] + 1)
        if again:
            if last is not None and tuple(last) != (None if was is None else tuple(was)):
                self.last.update(tuple(last))
            self._keep(sums, timer, self._timer(min(again), watermark), fired)
        else:
            if was is not None:
                self.last.clear()
            if timer is not None and timer != fired:
                self.handle.deleteTimer(timer)
            self.open.clear()
        if out:
            first, upto, price, fresh = zip(*out, strict=True)
            yield pd.DataFrame({"series": [key[0]] * len(out), "slot": np.array(first), "upto": np.array(upto), "price": np.array(price, float), "fresh": np.array(fresh)})


def last_good(stream: DataFrame, period_us: int, valid: int, late: str = "1 hour") -> DataFrame:
    """(series, slot, price, fresh): the average of each period once the watermark is past it; an empty one gets the last good one, for up to `valid` periods.

    Timers bring the fallbacks of a series that has gone silent; after the last of them it leaves no state. Results hang on ticks and watermark alone, not
    on batches or the order of ticks. State is as large as the periods that ticks may be late for. Python gives a row for each run of equal slots; Spark makes rows of them."""
    rows = stream.withWatermark("ts", late).filter(F.col("ts").isNotNull()).select("series", "ts", F.unix_micros("ts").alias("t"), F.col("price").cast("double").alias("price"))
    runs = with_state(rows, ["series"], LastGood(period_us, valid), "slot long, upto long, price double, fresh boolean")
    each = runs.withColumn("at", F.explode(F.sequence(F.col("slot"), F.col("upto") - 1)))
    return each.select("series", F.col("at").alias("slot"), "price", (F.col("fresh") & (F.col("at") == F.col("slot"))).alias("fresh"))


class Retained(Timed):
    """See retained. State: the times of each period, and the newest of all."""

    def __init__(self, periods: int, period: int):
        self.periods, self.period, self.came = periods, period, False

    def set_up(self, handle) -> None:
        self.times = handle.getMapState("times", "period long", "times array<long>")
        self.newest = handle.getValueState("newest", "t long, kept long")

    def take(self, key, rows: pd.DataFrame) -> None:
        newest, kept = self.newest.get() if self.newest.exists() else (-(1 << 62), 0)
        for period, part in rows["t"].groupby(rows["t"] // self.period):
            at = (int(period),)
            old = list(self.times.getValue(at)[0]) if self.times.containsKey(at) else []
            self.times.updateValue(at, (old + part.tolist(),))
        self.newest.update((max(newest, int(rows["t"].max())), kept + len(rows)))
        self.came = True

    def due(self, key, watermark: int) -> tuple[pd.DataFrame, int | None]:
        came, self.came = self.came, False
        newest, kept = self.newest.get()
        faded = max(newest, watermark) - self.periods * self.period if watermark > newest + self.periods * self.period else newest - self.periods * self.period
        for at in [k for k in self.times.keys() if k[0] * self.period <= faded]:  # noqa: SIM118
            times = list(self.times.getValue(at)[0])
            left = [t for t in times if t > faded]
            kept -= len(times) - len(left)
            self.times.updateValue(at, (left,)) if left else self.times.removeKey(at)
        if kept:
            self.newest.update((newest, kept))
        else:
            self.newest.clear()
        out = pd.DataFrame({"series": [key[0]], "t": [newest], "kept": [kept]}) if came else pd.DataFrame({"series": [], "t": [], "kept": []})
        return out, newest + self.periods * self.period + 1000 if kept else None


def retained(stream: DataFrame, periods: int, period_us: int, late: str = "1 hour") -> DataFrame:
    """(series, t, kept): how many quotes of the last `periods` periods each batch leaves in a series' state; older ones are dropped.

    Quotes lie in the state by period, so a batch reads those it adds to and those that fade. A series without quotes for `periods` periods leaves no state."""
    rows = stream.withWatermark("ts", late).select("series", "ts", F.unix_micros("ts").alias("t"))
    return with_state(rows, ["series"], Retained(periods, period_us), "t long, kept long")


class Answers(Timed):
    """See answered. State: quotes and questions that the watermark has not passed, the quotes of the last period, and the last answer."""

    def __init__(self, period: int, valid: int):
        self.period, self.valid = period, valid

    def set_up(self, handle) -> None:
        self.rows = handle.getListState("rows", "t long, price double, asked boolean")
        self.last = handle.getValueState("last", "t long, price double")

    def take(self, key, rows: pd.DataFrame) -> None:
        self.rows.appendList([(int(t), float(p), bool(a)) for t, p, a in zip(rows["t"], rows["price"].fillna(0.0), rows["asked"], strict=True)])

    def due(self, key, watermark: int) -> tuple[pd.DataFrame, int | None]:
        rows = sorted(map(tuple, self.rows.get()), key=lambda r: (r[0], r[2], r[1]))
        last, quotes, out = (tuple(self.last.get()) if self.last.exists() else None), [], []
        for t, price, asked in rows:
            if not asked:
                quotes.append((t, price))
                continue
            if t >= watermark:
                break
            inside = [q for q in quotes if q[0] > t - self.period]
            if inside:
                span = inside[-1][0] - inside[0][0]
                area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in itertools.pairwise(inside))
                last = t, area / span if span else inside[-1][1]
                out.append((key[0], t, last[1], True))
            elif last is not None and t <= last[0] + self.valid * self.period:
                out.append((key[0], t, last[1], False))
            else:
                out.append((key[0], t, None, False))
        left = [r for r in rows if r[0] >= watermark or not r[2] and r[0] > watermark - self.period]
        self.rows.put(left) if left else self.rows.clear()
        if last is not None:
            faded = watermark > last[0] + self.valid * self.period
            self.last.clear() if faded and not left else self.last.update(last)
        questions = [r[0] for r in left if r[2]]
        times = [min(questions) + 1000] if questions else [left[-1][0] + self.period + 1000] if left else []
        if last is not None and not left and watermark <= last[0] + self.valid * self.period:
            times.append(last[0] + self.valid * self.period + 1000)
        return pd.DataFrame(out, columns=["series", "t", "price", "fresh"]), min(times) if times else None


def answered(stream: DataFrame, period_us: int, valid: int, late: str) -> DataFrame:
    """(series, t, price, fresh) for each row that asks (`asked`): the trapezoid average over (t - period, t] of the series' quotes; without quotes there, the last
    answer with quotes, for up to `valid` periods after its time (fresh = false); then null. Answers come once the watermark is past t."""
    rows = stream.withWatermark("ts", late).select("series", "ts", F.unix_micros("ts").alias("t"), "price", "asked")
    return with_state(rows, ["series"], Answers(period_us, valid), "t long, price double, fresh boolean")


def self_requests(stream: DataFrame, resolution_us: int, horizon_us: int) -> DataFrame:
    """(series, main_t): one request for each main time t, as soon as the series' time reaches t - horizon."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest = max(int(b["t"].max()) for b in batches)
        done = state.get[0] if state.exists else (newest // resolution_us) * resolution_us
        due = (newest + horizon_us) // resolution_us * resolution_us
        out = list(range(done + resolution_us, due + 1, resolution_us))
        state.update((max(done, due),))
        if out:
            yield pd.DataFrame({"series": [key[0]] * len(out), "main_t": out})

    rows = stream.select("series", F.unix_micros("ts").alias("t"))
    return rows.groupBy("series").applyInPandasWithState(step, "series long, main_t long", "done long", "append", GroupStateTimeout.NoTimeout)


class OnlineModes(Timed):
    """See online_modes. State: the modes, and the rows that the watermark has not passed."""

    def __init__(self, turn: np.ndarray, gain: np.ndarray):
        self.turn, self.gain = turn, gain

    def set_up(self, handle) -> None:
        self.rows = handle.getListState("rows", "t long, price double")
        self.modes = handle.getValueState("modes", "s array<double>")

    def take(self, key, rows: pd.DataFrame) -> None:
        self.rows.appendList([(int(t), float(p)) for t, p in zip(rows["t"], rows["price"], strict=True)])

    def due(self, key, watermark: int) -> tuple[pd.DataFrame, int | None]:
        rows = sorted(map(tuple, self.rows.get()))
        ready, left = [r for r in rows if r[0] < watermark], [r for r in rows if r[0] >= watermark]
        s, out = np.array(self.modes.get()[0]) if self.modes.exists() else np.zeros(len(self.gain)), []
        for t, x in ready:
            s = self.turn @ s + self.gain * x
            out.append((key[0], t, s.tolist()))
        if ready:
            self.modes.update((s.tolist(),))
            self.rows.put(left) if left else self.rows.clear()
        return pd.DataFrame(out, columns=["series", "t", "modes"]), left[0][0] + 1000 if left else None


def online_modes(stream: DataFrame, omegas: list[float], alpha: float = 0.5, late: str = "1 hour") -> DataFrame:
    """(series, t, modes): the rotation bank's recurrence, its state carried from batch to batch. Rows go through it in order of time once the watermark is
    past them, whatever batch brings them; those of one time by price. State is as large as what may be late."""
    k = len(omegas)
    turn = np.zeros((2 * k, 2 * k))
    for i, o in enumerate(omegas):
        turn[2 * i : 2 * i + 2, 2 * i : 2 * i + 2] = [[math.cos(o), -math.sin(o)], [math.sin(o), math.cos(o)]]
    even = np.zeros(2 * k)
    even[::2] = 1.0
    a, b = (np.eye(2 * k) - alpha * np.outer(even / k, even)) @ turn, alpha * even / k
    rows = stream.withWatermark("ts", late).select("series", "ts", F.unix_micros("ts").alias("t"), "price")
    return with_state(rows, ["series"], OnlineModes(a, b), "t long, modes array<double>")
