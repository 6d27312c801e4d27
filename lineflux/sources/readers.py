"""Readers with fixed schemas; ids are strings unless said otherwise."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = "struct<order:long,quarter:int,event_quarter_time:long,event_type:string,event_outcome:string,shoot_action:string,team:struct<id:string>,player:struct<id:string>,offense_basket:int>"
BROADCAST = f"rounds array<struct<round:int,events:array<{EVENT}>>>, score_events array<struct<order:long,event_point_X:double,event_point_Y:double,offense_basket:int>>"


def schema_of(strings: Iterable[str] = (), longs: Iterable[str] = (), doubles: Iterable[str] = (), **others: str) -> T.StructType:
    """A schema from column names by type."""
    s = T.StructType()
    for names, kind in ((strings, "string"), (longs, "bigint"), (doubles, "double")):
        for n in names:
            s.add(n, kind)
    for n, kind in others.items():
        s.add(n, kind)
    return s


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header in any column order; a byte order mark is no part of the first name."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    names = {c.lstrip("﻿"): c for c in raw.columns}
    return raw.select(*((F.col(f"`{names[f.name]}`") if f.name in names else F.lit(None)).try_cast(f.dataType).alias(f.name) for f in schema.fields))


def load_inputs(spark: SparkSession, paths: dict[str, tuple[str, str]], views: bool = True) -> dict[str, DataFrame]:
    """name -> (path, schema) to DataFrames, also registered as views."""
    found = {n: read_csv(spark, p, s) for n, (p, s) in paths.items()}
    if views:
        for n, df in found.items():
            df.createOrReplaceTempView(n)
    return found


def read_broadcasts(spark: SparkSession, path: str) -> DataFrame:
    """Nested broadcasts, one file per game in a folder named by its id, as an event table.

    The quarter is the event's own or else its round's; coordinates come from score_events by order, the last duplicate winning.
    """
    raw = spark.read.schema(BROADCAST).option("multiLine", True).json(path).withColumn("game_id", F.regexp_extract(F.col("_metadata.file_path"), r"([0-9]+)/[^/]*$", 1))
    e = raw.select("game_id", F.explode("rounds").alias("r")).select("game_id", "r.round", F.explode("r.events").alias("e"))
    e = e.select("game_id", "e.order", F.coalesce("e.quarter", "round").alias("quarter"), F.col("e.event_quarter_time").alias("clock_ms"), "e.event_type", "e.event_outcome", "e.shoot_action",
                 F.col("e.team.id").alias("team_id"), F.col("e.player.id").alias("player_id"), "e.offense_basket")
    s = raw.select("game_id", F.posexplode("score_events").alias("pos", "s")).groupBy("game_id", F.col("s.order").alias("order"))
    s = s.agg(F.max_by("s.event_point_X", "pos").alias("x_mm"), F.max_by("s.event_point_Y", "pos").alias("y_mm"))
    return e.join(s, ["game_id", "order"], "left")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(number, name, text) of whole text files, the number from the file's name, and the columns of the folders' names."""
    t = spark.read.text(path, wholetext=True).select("*", F.col("_metadata.file_name").alias("name")).withColumnRenamed("value", "text")
    return t.withColumn("number", F.regexp_extract("name", r"([0-9]+)", 1).try_cast("long"))


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of what write_texts() wrote."""
    return spark.read.schema("name string, text string").json(path)


def read_dictionary(spark: SparkSession, path: str, drop: str = "__REMOVE__") -> DataFrame:
    """(key, value) of a JSON object; empty values and those that begin with the mark are left out."""
    t = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))
    return t.where((F.col("value") != "") & ~F.startswith("value", F.lit(drop)))


def select_ids(games: DataFrame, team: str | None = None, logs: DataFrame | None = None, player: str | None = None) -> DataFrame:
    """Distinct game ids by scope (all, a team at home or away, games in which a player appeared), in numeric order."""
    g = games
    if team is not None:
        g = g.where((F.col("home_team_id") == team) | (F.col("away_team_id") == team))
    if player is not None:
        g = g.join(logs.where((F.col("player_id") == player) & F.col("appearance")), "game_id", "left_semi")
    return g.select("game_id").distinct().orderBy(F.col("game_id").cast("long"))


def probe_ids(spark: SparkSession, first: int, last: int, titles: DataFrame, part: str) -> DataFrame:
    """Ids of a range whose landed title holds a text."""
    return spark.range(first, last + 1).join(titles.where(F.contains("title", F.lit(part))), "id", "left_semi")


def described(df: DataFrame) -> DataFrame:
    """(column, type, nullable) of a table."""
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields], "column string, type string, nullable boolean")
