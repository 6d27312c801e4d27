"""Streams against their batch forms and plain loops: shuffled and late files, many events of a key, reruns, bounded state."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lineflux.operators import intervals
from lineflux.plans import streamed
from lineflux.streaming import streams

START = datetime(2024, 1, 1)
TYPES = ["signup", "error", "view", "click", "purchase"]


def landed(spark, folder, rows, files, late):
    """The rows in files, each up to `late` rows out of order and the files overlapping as much."""
    rng = random.Random(1)
    rows = [r for _, r in sorted(enumerate(rows), key=lambda x: x[0] + rng.uniform(0, late))]
    size = -(-len(rows) // files)
    for k in range(0, len(rows), size):
        spark.createDataFrame(rows[k : k + size], streams.EVENTS).coalesce(1).write.mode("append").parquet(str(folder))


def events(n, users, seed=0):
    rng = random.Random(seed)
    return [(i, START + timedelta(seconds=60 * i), rng.randrange(users), rng.choice(TYPES), float(i), None) for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame(rows, streams.EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))


def stream(spark, folder, files=None):
    return streams.landed_events(spark, str(folder), "*.parquet", files)


def by_batch(spark, rows):
    e = streamed.game_log(table(spark, rows)).withColumn("pos", F.row_number().over(Window.partitionBy("game", "period").orderBy("ts", "seq")))
    return intervals.two_sided_stints(e, "game", "period", "side", "id", F.col("what") != 0, F.col("what") > 0, "pos", "at", F.lit(0.0), F.lit(2_678_400.0))


def test_stints_of_shuffled_late_files_equal_the_batch(spark, tmp_path):
    rows = events(3000, 25)
    landed(spark, tmp_path / "in", rows, 6, 120)
    s = streams.stints(streamed.game_log(stream(spark, tmp_path / "in", 1)), late="3 hours", idle_days=1)
    streams.run_to_table(s, str(tmp_path / "out"), str(tmp_path / "log"))
    some = spark.read.parquet(str(tmp_path / "out")).count()
    streams.end_of_stream(spark, str(tmp_path / "in"))
    streams.run_to_table(s, str(tmp_path / "out"), str(tmp_path / "log"))
    got = spark.read.parquet(str(tmp_path / "out"))
    same = lambda d: sorted((r.game, r.period, r.start, r.end, tuple(r.home), tuple(r.away)) for r in d.collect())
    want = same(by_batch(spark, rows))
    assert 0 < some < len(want) and same(got) == want


def test_thirty_thousand_events_of_a_user(spark, tmp_path):
    rows = [(i, START + timedelta(seconds=i), 0, ["signup", "error"][i % 2], 0.0, None) for i in range(30_000)]
    random.Random(2).shuffle(rows)
    spark.createDataFrame(rows, streams.EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    streams.end_of_stream(spark, str(tmp_path / "in"))
    streams.run_to_table(streams.presence(stream(spark, tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "log"))
    got = sorted((r.from_id, r.to_id) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(i, i + 1) for i in range(0, 30_000, 2)]


def test_idle_keys_leave_no_state(spark, tmp_path):
    rows = events(600, 5)
    landed(spark, tmp_path / "in", rows, 2, 10)
    streams.end_of_stream(spark, str(tmp_path / "in"))
    q = streams.run_to_table(streams.stints(streamed.game_log(stream(spark, tmp_path / "in")), idle_days=1), str(tmp_path / "out"), str(tmp_path / "log"))
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4  # what the last event itself left


def plain_sessions(rows, gap):
    out = {}
    for r in sorted(rows, key=lambda r: r[1]):
        s = out.setdefault(r[2], [])
        if s and r[1] <= s[-1][1]:
            s[-1] = (s[-1][0], max(s[-1][1], r[1] + gap(r)), s[-1][2] + 1)
        else:
            s.append((r[1], r[1] + gap(r), 1))
    return sorted((k, *x) for k, v in out.items() for x in v)


@pytest.mark.parametrize("streamed_", [False, True])
def test_sessions_equal_a_plain_loop(spark, tmp_path, streamed_):
    rng = random.Random(4)
    rows = [(i, START + timedelta(minutes=10 * rng.randrange(3000)), rng.randrange(9), rng.choice(TYPES), 1.0, None) for i in range(800)]
    gap = F.when(F.col("event_type") == "purchase", F.lit("6 hours")).otherwise(F.lit("2 hours"))
    if streamed_:
        landed(spark, tmp_path / "in", sorted(rows, key=lambda r: r[1]), 4, 40)
        streams.end_of_stream(spark, str(tmp_path / "in"))
        streams.run_to_table(streams.sessions(stream(spark, tmp_path / "in"), ["user_id"], gap, "5 days"), str(tmp_path / "out"), str(tmp_path / "log"))
        s = spark.read.parquet(str(tmp_path / "out")).where(f"user_id <> {streams.NOBODY}")
    else:
        s = streams.sessions(table(spark, rows), ["user_id"], gap)
    naive = s.select("user_id", F.col("start").cast("timestamp_ntz"), F.col("end").cast("timestamp_ntz"), "n").collect()
    assert sorted(map(tuple, naive)) == plain_sessions(rows, lambda r: timedelta(hours=6 if r[3] == "purchase" else 2))


def test_interval_join_of_streams_keeps_bounded_state(spark, tmp_path):
    rows = events(3000, 3, seed=6)
    landed(spark, tmp_path / "in", rows, 10, 20)
    points = stream(spark, tmp_path / "in", 1).select("event_id", "user_id", "ts")
    spans = stream(spark, tmp_path / "in", 1).where("event_type = 'signup'").select("user_id", F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("end"), F.col("event_id").alias("span_id"))
    q = streams.run_to_table(streams.interval_join(points, spans, ["user_id"], "ts", "start", "end", "30 MINUTES", "1 hour"), str(tmp_path / "out"), str(tmp_path / "log"))
    got = sorted((r.event_id, r.span_id) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((p[0], s[0]) for s in rows if s[3] == "signup" for p in rows[s[0] : s[0] + 31] if p[2] == s[2])
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(held) < 3000 * 1.2 * 0.5 and held[-1] < 900


def test_a_table_of_many_files_is_read_whole(spark, tmp_path):
    rows = events(400, 5)
    spark.createDataFrame(rows, streams.EVENTS).repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    streams.run_to_table(streamed.with_end(spark, str(tmp_path), str(tmp_path)).select("event_id"), str(tmp_path / "out"), str(tmp_path / "log"))
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [-1, *range(400)]


@pytest.mark.parametrize("folders", [None, [], ["event_type"]])
def test_a_table_is_one_file_or_a_folder_of_files_or_of_folders(spark, tmp_path, folders):
    rows = events(300, 5)
    made = spark.createDataFrame(rows, streams.EVENTS).repartition(1 if folders is None else 3)
    made.write.partitionBy(*folders or []).parquet(str(tmp_path / ("one" if folders is None else "events.parquet")))
    if folders is None:
        next((tmp_path / "one").glob("part-*")).rename(tmp_path / "events.parquet")
    for k, s in enumerate([streams.landed_events(spark, str(tmp_path)), streamed.with_end(spark, str(tmp_path), str(tmp_path)).where("user_id >= 0")]):
        streams.run_to_table(s.select("event_id", "event_type"), str(tmp_path / f"out{k}"), str(tmp_path / f"log{k}"))
        assert sorted((r.event_id, r.event_type) for r in spark.read.parquet(str(tmp_path / f"out{k}")).collect()) == [(r[0], r[3]) for r in rows]


def test_a_missing_table_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        streams.landed_events(spark, str(tmp_path))


def test_events_of_a_key_take_few_calls_to_the_state(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(streams, "APPENDED", 500)
    calls = []

    class State:
        def __init__(self):
            self.rows = []

        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name == "get":
                    return iter(list(self.rows))
                self.rows = {"appendValue": lambda v: [*self.rows, v], "appendList": lambda v: [*self.rows, *v], "put": list, "clear": lambda: []}[name](*args)

            return call

    class Handle:
        def registerTimer(self, ms):
            calls.append(ms)

    p = streams.Presence(1, "user_id,from_id,to_id", 0)
    p.buffer, p.handle = State(), Handle()
    frame = pd.DataFrame({"us": range(1000), "seq": range(1000), "enters": [i % 2 == 0 for i in range(1000)]})
    list(p.handleInputRows((1,), iter([frame] * 2), None))
    assert calls == ["appendValue", "appendValue", 1] and len(p.buffer.rows) == 2
