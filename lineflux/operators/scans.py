"""Ordered scans, as-of joins, islands and percentiles whose work is spread however large one key is.

Rows are dealt by ranges of (keys, order), so a hot key fills many parts. Each part is scanned by itself; what it begins with (a sum, a last
value, a maximum) comes from the summaries of the parts before it, one row for each part and key that it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import joins
from .joins import asof_sides, checkpointed


def dealt(df: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """df with _part, the range of (keys, order) that a row falls into. Rows equal in both share a part."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(df.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()))


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equal keys, nulls among them; right's carry a leading underscore."""
    on = F.lit(True)
    for k in keys:
        on &= left[k].eqNullSafe(right[f"_{k}"])
    return on


def scanned(df: DataFrame, keys: list[str], order: list[str], *, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, highs: dict[str, Column] | None = None,
            before: bool = False, parts: int | None = None) -> DataFrame:
    """df with, by key and in order, running sums, last values that aren't null and running maxima, up to each row or only of the rows before.

    As windows over the keys give them: nulls don't count, and of nothing comes null. A null key is one of its own."""
    sums, lasts, highs = sums or {}, lasts or {}, highs or {}
    named = {**{f"_s_{k}": c for k, c in sums.items()}, **{f"_l_{k}": c for k, c in lasts.items()}, **{f"_h_{k}": c for k, c in highs.items()}}
    d = dealt(df.withColumns(named), keys, order, parts)
    place = F.struct(*order)
    # where a part stands: only keys that go on from one part to the next have anything carried
    whole = d.groupBy("_part", *keys).agg(
        *(F.sum(f"_s_{k}").alias(f"_s_{k}") for k in sums), *(F.max_by(f"_l_{k}", F.when(F.col(f"_l_{k}").isNotNull(), place)).alias(f"_l_{k}") for k in lasts), *(F.max(f"_h_{k}").alias(f"_h_{k}") for k in highs),
        F.count("*").alias("_n"))
    so_far = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    over = lambda k: {"s": F.sum(k), "l": F.last(k, True), "h": F.max(k)}[k[1]].over(so_far)
    carried = whole.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_part").alias("__part"), F.count("*").over(so_far).alias("_earlier"), *(over(k).alias(f"_from{k}") for k in named)).where("_earlier > 0").drop("_earlier")
    # a part's first key at most, so as many rows as parts
    d = d.join(F.broadcast(carried), same(d, carried, [*keys, "_part"]), "left").drop("__part", *(f"_{k}" for k in keys))
    w = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    out = {}
    for k in sums:
        x, c = F.sum(f"_s_{k}").over(w), F.col(f"_from_s_{k}")
        out[k] = F.when(x.isNull(), c).when(c.isNull(), x).otherwise(x + c)
    out |= {k: F.coalesce(F.last(f"_l_{k}", True).over(w), f"_from_l_{k}") for k in lasts}
    out |= {k: F.greatest(F.max(f"_h_{k}").over(w), F.col(f"_from_h_{k}")) for k in highs}
    return d.withColumns(out).drop("_part", *named, *(f"_from{k}" for k in named))


def asof(left: DataFrame, right: DataFrame, keys: list[str], time: str, order: list[str], values: list[str], parts: int | None = None) -> DataFrame:
    """joins.asof() by a scan in parts, for keys that may hold a large share of all rows."""
    both = asof_sides(left, right, keys, time, order, values)
    out = scanned(both, keys, ["_t", "_side", "_o"], lasts={"_found": F.col("_v")}, parts=parts)
    return out.where("_l is not null").select("_l.*", *(F.col(f"_found.{v}").alias(v) for v in values))


def islands(spans: DataFrame, keys: list[str], low: str, high: str, order: list[str], name: str = "island", parts: int | None = None) -> DataFrame:
    """spans with their island's number: spans [low, high] that overlap or touch, by key, are one island."""
    by = [low, high, *order]
    s = scanned(spans, keys, by, highs={"_reach": F.col(high)}, before=True, parts=parts)
    new = (F.col("_reach").isNull() | (F.col(low) > F.col("_reach"))).cast("long")
    return scanned(s.withColumn("_new", new), keys, by, sums={name: F.col("_new")}, parts=parts).drop("_reach", "_new")


def greedy_match(candidates: DataFrame, group: list[str], a: str, b: str, cost: str, parts: int | None = None) -> DataFrame:
    """joins.greedy_match() of positions a and b within reach of each other: candidates that no chain of overlapping ones joins can't compete, so
    each island is matched in order by itself and a group of any size takes the same few shuffles."""
    spans = candidates.select(*group, a, b, cost, F.least(a, b).alias("_low"), F.greatest(a, b).alias("_high"))
    spans = checkpointed(islands(spans, group, "_low", "_high", [a, b, cost], "_island", parts).drop("_low", "_high"))
    return joins.greedy_match(spans, [*group, "_island"], a, b, cost).drop("_island")


def percentiles(df: DataFrame, keys: list[str], value: str, shares: list[float], parts: int | None = None) -> DataFrame:
    """(keys, share, value): exact percentiles by linear interpolation, nulls left out.

    Counts of the parts tell which part holds a rank, so only those parts' rows are numbered and no task sees a whole group."""
    d = dealt(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v")), keys, ["_v"], parts)
    by_part = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = d.groupBy("_part", *keys).agg(F.count("*").alias("_n"))
    counts = counts.withColumns({"_start": F.coalesce(F.sum("_n").over(by_part), F.lit(0)), "_all": F.sum("_n").over(Window.partitionBy(*keys))})
    want = counts.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).withColumn("_rank", F.col("share") * (F.col("_all") - 1))
    want = want.withColumn("_at", F.explode(F.array_distinct(F.array(F.floor("_rank"), F.ceil("_rank"))))).where("_at >= _start and _at < _start + _n")
    want = want.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_part").alias("__part"), "share", "_rank", (F.col("_at") - F.col("_start") + 1).alias("_row"))
    held = want.select("__part", *(f"_{k}" for k in keys)).distinct()
    d = d.join(held, same(d, held, [*keys, "_part"]), "left_semi").withColumn("_nr", F.row_number().over(Window.partitionBy("_part", *keys).orderBy("_v")))
    found = d.join(want, same(d, want, [*keys, "_part"]) & (F.col("_nr") == F.col("_row")))
    low, high = F.min("_v"), F.max("_v")
    return found.groupBy(*keys, "share").agg((low + (high - low) * (F.max("_rank") - F.floor(F.max("_rank")))).alias(value))
