"""Ordered and interval joins, pair generation and matching."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode, where the session names none."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lineflux-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def asof_sides(left: DataFrame, right: DataFrame, keys: list[str], time: str, order: list[str], values: list[str]) -> DataFrame:
    """Both sides in one table: keys, _t, _side (right rows first), _o (the order of equal times), _v (right's values) and _l (the left row)."""
    payload = F.struct(*values)
    kind = right.select(payload.alias("v")).schema["v"].dataType
    l_cols = left.columns
    l_kind = left.select(F.struct(*l_cols).alias("l")).schema["l"].dataType
    a = right.select(*keys, F.col(time).alias("_t"), F.lit(0).alias("_side"), F.struct(*order).alias("_o"), payload.alias("_v"), F.lit(None).cast(l_kind).alias("_l"))
    b = left.select(*keys, F.col(time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(a.schema["_o"].dataType).alias("_o"), F.lit(None).cast(kind).alias("_v"), F.struct(*l_cols).alias("_l"))
    return a.unionAll(b)


def asof(left: DataFrame, right: DataFrame, keys: list[str], time: str, order: list[str], values: list[str]) -> DataFrame:
    """left plus right's values at the last right row at or before each left row's time, by key; ties go to the last in `order`.

    A union and one window: one shuffle, no blow-up. A key is one task's; scans.asof() spreads keys that may be hot."""
    w = Window.partitionBy(*keys).orderBy("_t", "_side", "_o").rowsBetween(Window.unboundedPreceding, 0)
    both = asof_sides(left, right, keys, time, order, values).withColumn("_v", F.last("_v", True).over(w))
    return both.where("_l is not null").select("_l.*", *(F.col(f"_v.{v}").alias(v) for v in values))


def within_intervals(points: DataFrame, spans: DataFrame, keys: list[str], time: str, start: str, end: str, width: int) -> DataFrame:
    """points × spans with start <= time <= end by key. Equal buckets of `width` bound what the join compares."""
    p = points.withColumn("_b", F.floor(F.col(time) / width))
    s = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return p.join(s, [*keys, "_b"]).where((F.col(time) >= F.col(start)) & (F.col(time) <= F.col(end))).drop("_b")


def band(left: DataFrame, right: DataFrame, keys: list[str], l_pos: str, r_pos: str, reach: int) -> DataFrame:
    """left × right with |l_pos - r_pos| <= reach by key; positions are bucketed by the reach."""
    l = left.withColumn("_b", F.floor(F.col(l_pos) / (reach + 1)))
    near = F.floor(F.col(r_pos) / (reach + 1))
    r = right.withColumn("_b", F.explode(F.array(near - 1, near, near + 1)))
    return l.join(r, [*keys, "_b"]).where(F.abs(F.col(l_pos) - F.col(r_pos)) <= reach).drop("_b")


def numbered(df: DataFrame, order: list[Column], name: str = "nr") -> DataFrame:
    """df with its rows' numbers from 1 in the given order: rows are dealt by range and numbered within, so no task sees them all."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    before = F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = dealt.groupBy("_part").count().select("_part", F.coalesce(before, F.lit(0)).alias("_start"))  # a row per partition
    return dealt.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.row_number().over(Window.partitionBy("_part").orderBy(*order))).drop("_part", "_start")


#: Candidates of a group that one task may match in order.
SEQUENTIAL = 100_000


def greedy_match(candidates: DataFrame, group: list[str], a: str, b: str, cost: str) -> DataFrame:
    """One-to-one matching: ascending (cost, a, b), each side once.

    Groups are independent, and one of SEQUENTIAL candidates at most is matched in order by one task. In larger ones a pair that is the
    best of both its sides is in the matching whatever else happens, so rounds of such pairs shrink them until they are small. Where a and b
    are positions, scans.greedy_match() needs no rounds.
    """
    left, matched = candidates.select(*group, a, b, cost), None
    best = F.struct(cost, a, b)
    while True:
        largest, total = left.groupBy(*group).count().agg(F.max("count"), F.sum("count")).first()
        if (largest or 0) <= SEQUENTIAL:
            break
        won = left.withColumn("_a", F.min(best).over(Window.partitionBy(*group, a))).withColumn("_b", F.min(best).over(Window.partitionBy(*group, b)))
        won = checkpointed(won.where((F.col("_a") == best) & (F.col("_b") == best)).select(*group, a, b, cost))
        matched = won if matched is None else matched.unionAll(won)
        left = checkpointed(left.join(won.select(*group, a), [*group, a], "left_anti").join(won.select(*group, b), [*group, b], "left_anti"))

    def in_order(rows):
        import numpy as np

        rows = rows.sort_values([cost, a, b])
        sides = [rows.groupby([*group, c], dropna=False, sort=False).ngroup().to_numpy() for c in (a, b)]
        used = [np.zeros(len(rows), bool) for _ in sides]
        keep = np.zeros(len(rows), bool)
        for k, (x, y) in enumerate(zip(*(c.tolist() for c in sides))):
            if not used[0][x] and not used[1][y]:
                used[0][x] = used[1][y] = keep[k] = True
        return rows[keep].drop(columns="_bundle")

    # small groups share a task
    n = max(int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions")), (total or 0) // SEQUENTIAL + 1)
    bundle = F.pmod(F.xxhash64(*group) if group else F.lit(0), F.lit(n))
    rest = left.withColumn("_bundle", bundle).groupBy("_bundle").applyInPandas(in_order, left.schema).select(*group, a, b, cost)
    return rest if matched is None else matched.unionAll(rest)


def looked_up(rows: DataFrame, values: DataFrame, keys: list[str], value: str, default: Column | None = None) -> DataFrame:
    """rows with the value of their keys: the default where there is none, or an error if no default is given."""
    found = rows.join(values.select(*keys, F.col(value)).withColumn("_hit", F.lit(True)), keys, "left")
    missing = F.raise_error(F.concat(F.lit("no value for "), F.to_json(F.struct(*keys)))) if default is None else default
    return found.withColumn(value, F.when(F.col("_hit").isNull(), missing).otherwise(F.col(value))).drop("_hit")


def nearest(candidates: DataFrame, keys: list[str], cost: Column, tie: list[str], most: int = 1) -> DataFrame:
    """The `most` cheapest candidates of each key."""
    w = Window.partitionBy(*keys).orderBy(cost, *tie)
    return candidates.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


#: Members of a group from which its pairs are dealt out block by block, and pairs that a task makes or counts.
PAIR_BLOCK, TASK_PAIRS = 512, 1 << 18


def tasks_for(spark: SparkSession, pairs: int) -> int:
    """Tasks for so many pairs: the session's shuffle partitions, at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pairs // TASK_PAIRS))


def group_sizes(members: DataFrame, group: list[str]) -> DataFrame:
    """(group, count), counted in tasks that grow in number with the rows."""
    m = members.dropna(subset=group).select(*group)
    return m.repartition(tasks_for(members.sparkSession, m.count()), *group).groupBy(*group).count()


def pair_tasks(members: DataFrame, group: list[str]) -> int:
    """How many tasks the groups' pairs take, from the groups' sizes (repeated members count, so it may be more than needed)."""
    n = group_sizes(members, group).agg(F.sum(F.col("count") * (F.col("count") - 1))).first()[0]
    return tasks_for(members.sparkSession, (n or 0) // 2)


def placed_pairs(members: DataFrame, group: list[str], member: str, carry: list[str], tasks: int) -> DataFrame:
    """The group, its carried columns, a < b, and _task, which tells the rows that one task makes."""
    m = members.dropna(subset=[*group, member]).select(*group, *carry, F.col(member).alias("a"))
    # few groups are that large, so what their rows are joined with is small
    large = group_sizes(m, group).select(*group, F.ceil(F.col("count") / PAIR_BLOCK).cast("int").alias("_blocks")).where("_blocks > 1")
    blocks = F.coalesce("_blocks", F.lit(1))
    if not large.isEmpty():
        m = m.join(large, group, "left")
    else:
        m = m.withColumn("_blocks", F.lit(1))
    m = m.withColumn("_blocks", blocks).withColumn("_mine", F.pmod(F.xxhash64("a"), F.col("_blocks")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    # two blocks meet in one place, the lower one first
    place = ["_task", *group, "_low", "_high"]
    m = m.select(*group, *carry, "a", F.least("_mine", "_other").alias("_low"), F.greatest("_mine", "_other").alias("_high"), (F.col("_mine") > F.col("_other")).alias("_upper"))
    m = m.withColumn("_task", F.pmod(F.xxhash64(*group, "_low", "_high"), F.lit(tasks))).repartition(tasks, "_task")
    sides = m.groupBy(*place).agg(*(F.max(c).alias(c) for c in carry), F.sort_array(F.collect_set(F.when(~F.col("_upper"), F.col("a")))).alias("_x"), F.sort_array(F.collect_set(F.when(F.col("_upper"), F.col("a")))).alias("_y"))
    rest = F.when(F.col("_low") == F.col("_high"), F.slice("_x", F.col("_k") + 2, F.greatest(F.size("_x"), F.lit(1)))).otherwise(F.col("_y"))
    p = sides.select("_task", *group, *carry, "_x", "_y", "_low", "_high", F.posexplode("_x").alias("_k", "a"))
    p = p.select("_task", *group, *carry, "a", F.explode(rest).alias("b"))
    return p.select(*group, *carry, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "_task")


def pairs_within(members: DataFrame, group: list[str], member: str, *, directed: bool = False, carry: list[str] | None = None, tasks: int | None = None) -> DataFrame:
    """Pairs of different members of a group: a < b, or both directions, with the group's carried columns, of which it has one value.

    The pairs are the result, so their number can't shrink; but a group of more than PAIR_BLOCK members is dealt into blocks, and
    every two blocks meet in a place of their own, so no task makes all pairs of a large group. There are as many tasks as the pairs take."""
    carry = carry or []
    p = placed_pairs(members, group, member, carry, tasks or pair_tasks(members, group)).drop("_task")
    return p if not directed else both_ways(p, [*group, *carry])


def both_ways(pairs: DataFrame, others: list[str]) -> DataFrame:
    both = F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return pairs.select(*others, both)


def bipartite(left: DataFrame, right: DataFrame, group: list[str]) -> DataFrame:
    return left.join(right, group)
