"""Intervals from ordered enter / leave logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import islands, over


def presence(log: DataFrame, keys: list[str], entity: str, enters: Column, pos: str) -> DataFrame:
    """(keys, entity, from_pos, to_pos): an entity is present after its entering row up to its next row; null to_pos is open."""
    w = Window.partitionBy(*keys, entity).orderBy(pos)
    return log.withColumn("to_pos", F.lead(pos).over(w)).where(enters).select(*keys, entity, F.col(pos).alias("from_pos"), "to_pos")


def record_lineups(log: DataFrame, keys: list[str], entity: str, is_sub: Column, enters: Column, pos: str, time: str) -> DataFrame:
    """Line-up intervals attributed record by record.

    Rows between two runs of substitutions share a line-up, so presence is spread over the batches it covers, a row for each member of a
    batch's line-up and none besides. A run that gives the line-up it found opens no interval. Returns keys, stint, lineup (sorted array), start_time, first_pos, n_rows.
    """
    w = over(keys, [pos])
    sub = is_sub.cast("int")
    log = log.withColumn("_sub", sub).withColumn("_opens", ((F.col("_sub") == 0) & (F.coalesce(F.lag("_sub").over(w), F.lit(1)) == 1)).cast("int"))
    log = log.withColumn("_sub_time", F.last(F.when(F.col("_sub") == 1, F.col(time)), True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    log = log.withColumn("_batch", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    batches = log.where("_sub = 0").groupBy(*keys, "_batch").agg(F.min(pos).alias("first_pos"), F.min(time).alias("_first_time"), F.count("*").alias("n_rows"), F.max("_sub_time").alias("_sub_time"))
    # of a batch's point of view an entity is present if its last substitution row before it enters
    last = log.where("_sub = 1").withColumn("_in", enters).groupBy(*keys, entity, F.col("_batch").alias("_b")).agg(F.max_by("_in", pos).alias("_in"))
    until = F.lead("_b").over(Window.partitionBy(*keys, entity).orderBy("_b"))
    ends = batches.groupBy(*keys).agg(F.max("_batch").alias("_last"))
    last = last.withColumn("_until", until).where("_in").join(ends, keys)
    first, to = F.col("_b") + 1, F.least(F.coalesce("_until", "_last"), F.col("_last"))
    on = last.where(first <= to).select(*keys, F.col(entity).alias("_e"), F.explode(F.sequence(first, to)).alias("_batch"))
    lineups = on.groupBy(*keys, "_batch").agg(F.sort_array(F.collect_set("_e")).alias("lineup"))
    empty = F.array().cast(lineups.schema["lineup"].dataType)
    b = batches.join(lineups, [*keys, "_batch"], "left").withColumn("lineup", F.coalesce("lineup", empty))
    before = F.lag("lineup").over(over(keys, ["_batch"]))
    b = b.withColumn("_new", before.isNull() | (before != F.col("lineup"))).withColumn("stint", islands(F.col("_new"), keys, ["_batch"]))
    return b.groupBy(*keys, "stint").agg(
        F.min_by("lineup", "_batch").alias("lineup"), F.min_by(F.coalesce("_sub_time", "_first_time"), "_batch").alias("start_time"),
        F.min("first_pos").alias("first_pos"), F.sum("n_rows").alias("n_rows"),
    )


def batch_lineups(log: DataFrame, keys: list[str], entity: str, enters: Column, time: str, pos: str, last: DataFrame | None = None) -> DataFrame:
    """Line-up intervals from substitutions batched by equal time: the line-up after a batch holds to the next batch's time.

    In a batch an entity that enters at all ends present. Returns keys, start_time, end_time, lineup; after the last time there is an
    interval only with `last` (keys, time), the log's final times. Presence is spread over the batches it covers.
    """
    times = log.select(*keys, F.col(time).alias("start_time")).distinct().withColumn("_k", F.row_number().over(over(keys, ["start_time"])))
    times = times.withColumn("end_time", F.lead("start_time").over(over(keys, ["start_time"])))
    if last is not None:
        times = times.join(last.select(*keys, F.col(time).alias("_final")), keys, "left").withColumn("end_time", F.coalesce("end_time", "_final")).drop("_final")
    b = log.groupBy(*keys, F.col(time).alias("start_time"), entity).agg(F.max(enters.cast("int")).alias("_in")).join(times.select(*keys, "start_time", "_k"), [*keys, "start_time"])
    w = Window.partitionBy(*keys, entity).orderBy("_k")
    ends = times.groupBy(*keys).agg(F.max("_k").alias("_last"))
    on = b.withColumn("_until", F.lead("_k").over(w) - 1).where("_in = 1").join(ends, keys)
    on = on.select(*keys, entity, F.explode(F.sequence("_k", F.coalesce("_until", "_last"))).alias("_k"))
    lineups = on.groupBy(*keys, "_k").agg(F.sort_array(F.collect_set(entity)).alias("lineup"))
    empty = F.array().cast(lineups.schema["lineup"].dataType)
    out = times.where("end_time is not null").join(lineups, [*keys, "_k"], "left")
    return out.select(*keys, "start_time", "end_time", F.coalesce("lineup", empty).alias("lineup"))


def side_of(lineup: str, which: str) -> Column:
    """The members of one side in a line-up of (side, id)."""
    return F.transform(F.filter(lineup, lambda x: x["side"] == which), lambda x: x["id"])


def two_sided_stints(log: DataFrame, game: str, period: str, side: str, entity: str, is_sub: Column, enters: Column, pos: str, time: str, begin: Column, end: Column) -> DataFrame:
    """Stints of two sides, told record by record and begun anew in each period.

    begin and end: a period's times, from its column. The first stint of a period begins with it, a later one at its substitutions' time; a
    stint ends where the next begins, or with the period. Returns game, period, stint_no (by game), stint_id, start, end, duration and the
    sides' line-ups, home and away (side 'home' or 'away')."""
    who = log.withColumn("_who", F.struct(F.col(side).alias("side"), F.col(entity).alias("id")))
    keys = [game, period]
    s = record_lineups(who, keys, "_who", is_sub, enters, pos, time)
    s = s.withColumn("start", F.when(F.col("stint") == 1, begin).otherwise(F.col("start_time")))
    s = s.withColumn("end", F.coalesce(F.lead("start").over(over(keys, ["stint"])), end)).withColumn("duration", F.col("end") - F.col("start"))
    s = s.withColumn("stint_no", F.row_number().over(over([game], [period, "stint"])))
    return s.select(*keys, "stint_no", F.format_string("%s_%03d", F.col(game).cast("string"), F.col("stint_no")).alias("stint_id"), "start", "end", "duration", side_of("lineup", "home").alias("home"), side_of("lineup", "away").alias("away"))


def valid_stints(stints: DataFrame, stint: str, size: int, known: DataFrame, entity: str) -> DataFrame:
    """stints with valid: `size` members a side, a positive duration, and members that `known` lists."""
    unknown = stints.select(stint, F.explode(F.array_union("home", "away")).alias(entity)).join(known.select(entity), entity, "left_anti").select(stint).distinct()
    s = stints.join(unknown.withColumn("_unknown", F.lit(True)), stint, "left")
    return s.withColumn("valid", (F.size("home") == size) & (F.size("away") == size) & (F.col("duration") > 0) & F.col("_unknown").isNull()).drop("_unknown")


def single_presence(log: DataFrame, keys: list[str], is_in: Column, is_out: Column, pos: str, start, end: Column) -> DataFrame:
    """(keys, from_pos, to_pos) of one entity per key: it starts present unless its first in / out row is an in; an open
    interval ends at `end`, a column of the key's rows."""
    rows = log.withColumn("_end", F.max(end).over(Window.partitionBy(*keys))).where(is_in | is_out).withColumn("_in", is_in)
    w = over(keys, [pos])
    first = F.row_number().over(w) == 1
    rows = rows.withColumn("_to", F.coalesce(F.lead(pos).over(w), F.col("_end"))).withColumn("_first", first)
    begun = rows.where("_first and not _in").select(*keys, F.lit(start).cast("long").alias("from_pos"), F.col(pos).alias("to_pos"))
    return rows.where("_in").select(*keys, F.col(pos).alias("from_pos"), F.col("_to").alias("to_pos")).unionAll(begun)
