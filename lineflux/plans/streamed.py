"""Streaming queries, run over what has landed."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import intervals
from ..operators.joins import shared_folder
from ..streaming import streams
from .registry import query, table


def scratch(spark) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"


def with_end(spark, d, to):
    """The landed events and, once it has landed, the end of the stream."""
    streams.end_of_stream(spark, f"{to}/end")
    return streams.landed_events(spark, d).unionByName(streams.landed_events(spark, f"{to}/end", "*.parquet"))


@query("SELECT epoch_us(date_trunc('day', ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def stream_windowed_counts(spark, d):
    to = scratch(spark)
    streams.run_to_table(streams.windowed_counts(streams.landed_events(spark, d)), f"{to}/out", f"{to}/log", "complete")
    return spark.read.parquet(f"{to}/out").select(F.unix_micros("start").alias("start_us"), "event_type", "n", F.round("value", 4).alias("value"))


@query("""
WITH e AS (SELECT user_id, event_id, event_type, ts FROM events WHERE event_type IN ('signup', 'error')),
c AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM e),
r AS (SELECT * FROM c WHERE prev IS NULL OR prev <> event_type),
p AS (SELECT *, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS to_id FROM r)
SELECT user_id, event_id AS from_id, to_id FROM p WHERE event_type = 'signup' AND to_id IS NOT NULL""")
def stream_presence(spark, d):
    to = scratch(spark)
    streams.run_to_table(streams.presence(with_end(spark, d, to)), f"{to}/out", f"{to}/log")
    return spark.read.parquet(f"{to}/out")


def game_log(events):
    """Events of games of ten users, odd ones against even ones, in four periods with one clock."""
    what = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return events.select(
        F.floor(F.col("user_id") / 10).alias("game"), (F.col("event_id") % 4 + 1).cast("int").alias("period"), "ts", F.col("event_id").alias("seq"), F.when(F.col("user_id") % 2 == 0, "home").otherwise("away").alias("side"),
        F.col("user_id").alias("id"), what.alias("what"), ((F.unix_micros("ts") - 1_704_067_200_000_000) / 1e6).alias("at"), F.lit(0.0).alias("begin"), F.lit(2_678_400.0).alias("end"))


STINTS_SQL = """
WITH log AS (SELECT user_id // 10 AS game, CAST(event_id % 4 + 1 AS INTEGER) AS period, CASE WHEN user_id % 2 = 0 THEN 'home' ELSE 'away' END AS side, user_id AS id, event_type IN ('signup', 'error') AS is_sub, event_type = 'signup' AS enters,
             (epoch_us(ts) - 1704067200000000) / 1e6 AS t, row_number() OVER (PARTITION BY user_id // 10, event_id % 4 ORDER BY ts, event_id) AS pos FROM events),
p AS (SELECT game, period, side, id, pos AS f, enters, lead(pos) OVER (PARTITION BY game, period, id ORDER BY pos) AS u FROM log WHERE is_sub),
o AS (SELECT l.game, l.period, l.pos, coalesce(string_agg(CAST(p.id AS VARCHAR), '|' ORDER BY p.id) FILTER (WHERE p.side = 'home'), '') AS home, coalesce(string_agg(CAST(p.id AS VARCHAR), '|' ORDER BY p.id) FILTER (WHERE p.side = 'away'), '') AS away
      FROM log l LEFT JOIN p ON p.game = l.game AND p.period = l.period AND p.enters AND p.f < l.pos AND (p.u IS NULL OR p.u > l.pos) WHERE NOT l.is_sub GROUP BY ALL),
c AS (SELECT *, row_number() OVER w AS r, lag(home || '/' || away) OVER w AS prev FROM o WINDOW w AS (PARTITION BY game, period ORDER BY pos)),
i AS (SELECT *, sum(CASE WHEN r = 1 OR prev <> home || '/' || away THEN 1 ELSE 0 END) OVER (PARTITION BY game, period ORDER BY pos) AS stint FROM c),
g AS (SELECT game, period, stint, any_value(home) AS home, any_value(away) AS away, min(pos) AS first_pos FROM i GROUP BY 1, 2, 3),
s AS (SELECT g.*, CASE WHEN stint = 1 THEN 0.0 ELSE (SELECT arg_max(l.t, l.pos) FROM log l WHERE l.game = g.game AND l.period = g.period AND l.is_sub AND l.pos < g.first_pos) END AS start FROM g)
SELECT game, period, row_number() OVER (PARTITION BY game ORDER BY period, stint) AS stint_no, CAST(start AS DOUBLE) AS start_s, CAST(coalesce(lead(start) OVER (PARTITION BY game, period ORDER BY stint), 2678400.0) AS DOUBLE) AS end_s, home AS home_ids, away AS away_ids FROM s"""


def listed(c):
    return F.array_join(F.col(c).cast("array<string>"), "|").alias(f"{c}_ids")


@query(STINTS_SQL)
def stream_stints(spark, d):
    """Two-sided stints from keyed state, in two runs on one checkpoint: the events, then the end of the stream."""
    to = scratch(spark)
    spark.read.schema(streams.EVENTS).parquet(f"{d}/events.parquet").limit(0).write.parquet(f"{to}/end")
    events = streams.landed_events(spark, d).unionByName(streams.landed_events(spark, f"{to}/end", "*.parquet"))
    s = streams.stints(game_log(events))
    streams.run_to_table(s, f"{to}/out", f"{to}/log")
    streams.end_of_stream(spark, f"{to}/end")
    streams.run_to_table(s, f"{to}/out", f"{to}/log")
    no = F.row_number().over(Window.partitionBy("game").orderBy("period", "stint"))
    return spark.read.parquet(f"{to}/out").select("game", "period", no.alias("stint_no"), F.col("start").alias("start_s"), F.col("end").alias("end_s"), listed("home"), listed("away"))


@query(STINTS_SQL)
def stints_by_game(spark, d):
    """The same stints by the batch operator."""
    e = game_log(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    e = e.withColumn("pos", F.row_number().over(Window.partitionBy("game", "period").orderBy("ts", "seq")))
    s = intervals.two_sided_stints(e, "game", "period", "side", "id", F.col("what") != 0, F.col("what") > 0, "pos", "at", F.lit(0.0), F.lit(2_678_400.0))
    return s.select("game", "period", "stint_no", F.col("start").alias("start_s"), F.col("end").alias("end_s"), listed("home"), listed("away"))


#: A purchase holds a session for three days, other events for one.
SESSIONS_SQL = """
WITH e AS (SELECT user_id, ts, value, ts + CASE WHEN event_type = 'purchase' THEN INTERVAL 3 DAY ELSE INTERVAL 1 DAY END AS until FROM events),
m AS (SELECT *, max(until) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM e),
s AS (SELECT *, sum(CASE WHEN held IS NULL OR ts > held THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM m)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(until)) AS end_us, count(*) AS n, round(sum(value), 4) AS value FROM s GROUP BY user_id, session"""


def session_rows(s):
    return s.where(f"user_id <> {streams.NOBODY}").select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n", F.round("value", 4).alias("value"))


def gap():
    return F.when(F.col("event_type") == "purchase", F.lit("3 days")).otherwise(F.lit("1 day"))


@query(SESSIONS_SQL)
def stream_sessions(spark, d):
    to = scratch(spark)
    streams.run_to_table(streams.sessions(with_end(spark, d, to), ["user_id"], gap(), "1 day"), f"{to}/out", f"{to}/log")
    return session_rows(spark.read.parquet(f"{to}/out"))


@query(SESSIONS_SQL)
def sessions(spark, d):
    return session_rows(streams.sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), ["user_id"], gap()))


@query("""
WITH s AS (SELECT user_id, ts AS start_ts, event_id AS span_id, ts + INTERVAL 12 HOUR AS end_ts FROM events WHERE event_type = 'signup')
SELECT e.event_id, e.user_id, s.span_id FROM events e JOIN s ON e.user_id = s.user_id AND e.ts BETWEEN s.start_ts AND s.end_ts""")
def stream_intervals(spark, d):
    """Events and the half days after signups, joined as two streams."""
    to = scratch(spark)
    points = streams.landed_events(spark, d).select("event_id", "user_id", "ts")
    spans = streams.landed_events(spark, d).where("event_type = 'signup'").select("user_id", F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL 12 HOURS")).alias("end"), F.col("event_id").alias("span_id"))
    streams.run_to_table(streams.interval_join(points, spans, ["user_id"], "ts", "start", "end", "12 HOURS", "1 day"), f"{to}/out", f"{to}/log")
    return spark.read.parquet(f"{to}/out").select("event_id", "user_id", "span_id")
