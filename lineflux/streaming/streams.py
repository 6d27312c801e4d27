"""Structured Streaming forms: landed event files, windowed counts and sessions with late data, interval joins of two streams, and ordered
keyed state: presence and stints.

Keyed state is ordered: events wait in the key's buffer until the watermark has passed them, whatever order they came in, and are then read in
order of time. A key that has been idle is closed and its state removed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..shipping import ship

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"

NOBODY = -1

#: Events of a key that are put into its buffer at once.
APPENDED = 10_000


def landed_events(spark: SparkSession, folder: str, pattern: str = "events.parquet", files: int | None = None) -> DataFrame:
    """What lands in the folder under the pattern: files, or folders of files."""
    s = spark.readStream.schema(EVENTS)
    s = s.option("maxFilesPerTrigger", files) if files else s
    if not set("*?[{") & set(pattern):
        spark.read.schema(EVENTS).parquet(f"{folder}/{pattern}")  # raises what a stream does not, if there is none
    # a stream takes a path without wildcards for the base of its columns by folder, which no file can be
    return s.option("basePath", folder).parquet(f"{folder}/{{{pattern}}}").withColumn("ts", F.col("ts").cast("timestamp"))


def end_of_stream(spark: SparkSession, folder: str, day: str = "2100-01-01") -> None:
    """Land a last event, of user NOBODY and far ahead, so that the watermark passes all others."""
    row = spark.range(1).select(F.lit(NOBODY).cast("long").alias("event_id"), F.to_timestamp_ntz(F.lit(day)).alias("ts"), F.lit(NOBODY).cast("long").alias("user_id"), F.lit("signup").alias("event_type"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("props"))
    row.coalesce(1).write.mode("append").parquet(folder)


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events and their value by window and type; the watermark drops state, not rows within it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, keys: list[str], gap: Column, late: str | None = None) -> DataFrame:
    """(keys, start, end, n, value): an event holds its session open for its gap; one that falls into two sessions makes them one.

    A null key has sessions of its own. The same call serves tables (late None) and streams, whose sessions come out when the watermark has
    passed their end."""
    e = events.withWatermark("ts", late) if late else events
    s = e.groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return s.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "value")


def interval_join(points: DataFrame, spans: DataFrame, keys: list[str], time: str, start: str, end: str, longest: str, late: str) -> DataFrame:
    """points × spans with start <= time <= end by key, of two streams. No span lasts more than `longest`, which is how long the watermarks let
    either side wait for the other; both sides' state beyond that goes."""
    p = points.withWatermark(time, late)
    s = spans.withWatermark(start, late).withColumnsRenamed({k: f"_{k}" for k in keys})
    on = (F.col(time) >= F.col(start)) & (F.col(time) <= F.col(end)) & (F.col(time) <= F.col(start) + F.expr(f"INTERVAL {longest}"))
    for k in keys:
        on &= F.col(k) == F.col(f"_{k}")
    return p.join(s, on).drop(*(f"_{k}" for k in keys))


class Ordered(StatefulProcessor):
    """Reads each key's events in order. Events have ts (event time), us (its microseconds), seq (the order of equal times) and `fields`, all numbers, texts
    or booleans; they wait in the state as JSON, many to a row.

    Subclasses give step(machine, event) and closed(machine), which return output rows without the key; machine is a dict that survives in the
    state as JSON. Rows of a key may come in any number of batches: they are only read once the watermark has passed them."""

    fields = ""

    def __init__(self, keys: int, output: str, idle_ms: int):
        self.keys, self.output, self.idle_ms = keys, output, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("buffer", "events string")
        self.machine = handle.getValueState("machine", "state string, last_us long")

    def frame(self, key, rows):
        import pandas as pd

        return pd.DataFrame([(*key[: self.keys], *r) for r in rows], columns=self.output.split(","))

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        # each call to the state and each row in it costs more than an event does, so there are as few as can be: here one row for up to APPENDED
        # events and one timer, when these are complete
        names, last, got = ["us", "seq", *self.fields.split(", ")], None, []
        for f in rows:
            if len(f):
                got += zip(*(f[n].tolist() for n in names))
                last = max(int(f["us"].max()), last or 0)
            if len(got) >= APPENDED:
                self.buffer.appendValue((json.dumps(got),))
                got = []
        if got:
            self.buffer.appendValue((json.dumps(got),))
        if last is not None:
            self.handle.registerTimer(last // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        known = timerValues.getCurrentWatermarkInMs() * 1000
        held = [r for some in self.buffer.get() for r in json.loads(some[0])]
        ready = sorted((r for r in held if r[0] <= known), key=lambda r: r[:2])
        rest = [r for r in held if r[0] > known]
        state = self.machine.get()
        machine, last = (json.loads(state[0]), state[1]) if state else ({}, None)
        out = []
        for r in ready:
            out += self.step(machine, *r)
        if ready:
            self.buffer.put([(json.dumps(rest),)]) if rest else self.buffer.clear()
            last = ready[-1][0]
        if not rest and last is not None and last // 1000 + self.idle_ms < known // 1000:
            out += self.closed(machine)
            if state:
                self.machine.clear()
        elif ready:
            self.machine.update((json.dumps(machine), last))
            # and one when the key has been idle since
            self.handle.registerTimer(last // 1000 + 1 + self.idle_ms)
        if out:
            yield self.frame(key, out)

    def close(self) -> None:
        pass

    def step(self, machine: dict, *event) -> list[tuple]:
        raise NotImplementedError

    def closed(self, machine: dict) -> list[tuple]:
        return []


class Presence(Ordered):
    fields = "enters"

    def step(self, machine, us, seq, enters):
        if enters:
            machine.setdefault("on", seq)
            return []
        return [(machine.pop("on"), seq)] if "on" in machine else []


class Stints(Ordered):
    """Two sides' line-ups told record by record: what the batch operator two_sided_stints does for each game and period."""

    fields = "side, id, what, at, begin, end"

    def step(self, m, us, seq, side, id_, what, at, begin, end):
        if not m:
            m |= {"home": [], "away": [], "dirty": True, "at": begin, "no": 0}
        m["end"] = end
        if what:
            on = set(m[side]) | {id_} if what > 0 else set(m[side]) - {id_}
            m[side], m["dirty"], m["at"] = sorted(on), True, at
            return []
        out = []
        if m["dirty"]:
            line = [m["home"], m["away"]]
            if not m["no"] or line != m["line"]:
                start = m["at"] if m["no"] else begin
                out = self.ended(m, start)
                m |= {"line": line, "start": start, "no": m["no"] + 1}
            m["dirty"] = False
        return out

    def ended(self, m, end):
        return [(m["no"], m["start"], end, *m["line"])] if m.get("no") else []

    def closed(self, m):
        return self.ended(m, m["end"]) if m else []


def keyed(events: DataFrame, keys: list[str], processor: Ordered, late: str, out: str) -> DataFrame:
    """events by key through the processor, with event-time timers; late events that the watermark has passed are dropped, and
    events of a null key, of which no state can be kept."""
    ship(events.sparkSession)
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = events.dropna(subset=keys)
    e = events.withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    return e.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="EventTime")


def presence(events: DataFrame, late: str = "1 day", idle_days: int = 30) -> DataFrame:
    """(user_id, from_id, to_id) whenever a user that entered (signup) leaves (error). A user idle for so long is forgotten, present or not."""
    e = events.where(F.col("event_type").isin("signup", "error")).select("user_id", "ts", F.col("event_id").alias("seq"), (F.col("event_type") == "signup").alias("enters"))
    return keyed(e, ["user_id"], Presence(1, "user_id,from_id,to_id", idle_days * 86_400_000), late, "user_id long, from_id long, to_id long")


def stints(events: DataFrame, late: str = "1 day", idle_days: int = 30) -> DataFrame:
    """(game, period, stint, start, end, home, away) of events with game, period, ts, seq, side, id, what (1 enters, -1 leaves, 0 neither), at,
    begin and end (clocks of the event and of its period). The last stint of a period comes out when the period has been idle for so long."""
    out = "game long, period int, stint int, start double, end double, home array<long>, away array<long>"
    return keyed(events, ["game", "period"], Stints(2, "game,period,stint,start,end,home,away", idle_days * 86_400_000), late, out)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Read what has landed, once, into a Parquet table; a rerun takes up only new files. Returns the query, which has ended."""
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    else:
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
