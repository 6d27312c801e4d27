"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame operations only."""

from __future__ import annotations

from math import inf

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import numbered
from .common import SPACE_WORD, store, table

#: Key ranges per source for the coarse prefix sums; only the rows of one range per source are ever sorted.
RANGES = 4096
#: Per-source tables of up to so many rows (about 100 bytes each) are broadcast; larger ones are joined by shuffle.
FEW_SOURCES = 10_000


def word_count(text: Column) -> Column:
    """Number of words of the text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, most_epochs: int = 3) -> DataFrame:
    """Targets by water-filling for the per-source table (source, source_size).

    Sources in code-point order, null last, weigh 1, 2, 3, repeating. All sizes are shared out by weight; a target stops at
    most_epochs times its source's size and the excess goes to the others by weight until none is above. Each round is one aggregate,
    so many sources need no single task; sums of sizes and weights are exact, so the order of tasks doesn't matter.
    """
    s = numbered(sizes, [F.col("source").isNull(), F.col("source")])
    s = s.withColumn("weight", ((F.col("nr") - 1) % 3 + 1).cast("double")).withColumn("cap", F.lit(float(most_epochs)) * F.col("source_size"))
    s = store(s, "sources")
    total = float(s.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level, closed = 0.0, -1
    while True:
        full = F.col("cap") < F.col("weight") * level
        n, capped, open_ = s.agg(F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if n == closed:
            break
        closed, level = n, (total - capped) / open_ if open_ else inf
    return s.select("source", "source_size", F.when(full, F.col("cap")).otherwise(F.least("cap", F.col("weight") * level)).alias("target"))


def spread(docs: DataFrame, q: Column) -> Column:
    """A rising function of the key that is uniform on (0, 1) over docs: the mixture of the qualities' exponential distributions.
    Qualities are counted in bins of a quarter of their logarithm, put together to 64 at most; they only even out the ranges."""
    bins = sorted((r[0], r[1]) for r in docs.groupBy(F.round(F.log2(q) * 4).cast("int").alias("bin")).count().collect() if r[0] is not None)
    every = -(-len(bins) // 64) or 1
    groups = [bins[i : i + every] for i in range(0, len(bins), every)] or [[(0, 1)]]
    total = sum(k for _, k in bins) or 1
    out = F.lit(0.0)
    for g in groups:
        share = sum(k for _, k in g) / total
        out = out + F.lit(share) * (1 - F.exp(-F.col("_key") * F.lit(2.0 ** (sum(b * k for b, k in g) / max(1, sum(k for _, k in g)) / 4))))
    return out


def sized(docs: DataFrame) -> DataFrame:
    """docs with size, the number of words, in place of the text: what follows moves no text."""
    return docs.withColumn("size", word_count(F.col("text"))).drop("text")


def mix(docs: DataFrame, *, quality: Column | None = None, most_epochs: int = 3, ranges: int = RANGES) -> DataFrame:
    """docs (from sized()) plus source_size, target and taken.

    docs needs doc_id, size and source; other columns stay, whatever their names. quality is a positive weight from docs' columns
    (default 1). Each document gets the key -ln(u) / quality, u from md5 of its id, so reruns agree. Within a source, complete epochs come
    first; for the rest of the target documents are taken in key order while their prefix sum fits, and one more document, the
    one that brings the source nearest to its target, closes the gap. taken counts words with repeats. Whole documents only.
    Empty and null texts have size 0 and take 0; equal ids are told apart by their row; an empty table gives no rows; a null
    source is a source of its own. Columns of docs named like the new ones are replaced.

    A source's rows are never gathered: sums by key range locate the one range in which the budget ends, and only its rows
    are ordered. Ranges hold equal shares of all rows by spread(), whatever the qualities are.
    """
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    u = (F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    q = F.coalesce(quality, F.lit(1.0)) if quality is not None else F.lit(1.0)
    key = (-F.log(u) / q).alias("_key")
    base = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("own"), "doc_id", "source", "size", key, F.monotonically_increasing_id().alias("_row"))
    base = store(base.withColumn("_range", F.least(F.floor(spread(docs, q) * ranges), F.lit(ranges - 1)).cast("int")), "mix")
    by_range = store(base.groupBy("source", "_range").agg(F.sum("size").alias("range_size")), "ranges")
    goal = targets(by_range.groupBy("source").agg(F.sum("range_size").alias("source_size")), most_epochs)
    goal = goal.withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = store(goal.withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size")).withColumnRenamed("source", "_source"), "goal")

    small = goal.count() <= FEW_SOURCES

    def with_goal(df: DataFrame, right: DataFrame) -> DataFrame:
        right = F.broadcast(right) if small else right
        return df.join(right, df["source"].eqNullSafe(right["_source"]), "left")

    order = Window.partitionBy("source").orderBy("_range")
    edges = with_goal(by_range, goal).withColumn("_before", F.sum("range_size").over(order) - F.col("range_size"))
    edge = edges.where(F.col("_before") + F.col("range_size") > F.col("_rest")).groupBy("source").agg(F.min(F.struct("_range", "_before")).alias("e"))
    edge = edge.select(F.col("source").alias("_source"), F.col("e._range").alias("_edge"), F.col("e._before").alias("_before"))
    goal = store(goal.join(edge.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s"), "goal")

    within = Window.partitionBy("source").orderBy("_key", "doc_id", "_row").rowsBetween(Window.unboundedPreceding, 0)
    inner = (
        with_goal(base.drop("own"), goal).where(F.col("_range") == F.col("_edge"))
        .withColumn("_sum", F.sum("size").over(within) + F.col("_before"))
        .where(F.col("_sum") <= F.col("_rest"))
    )
    inner = inner.groupBy("source").agg(F.max(F.struct("_key", "doc_id", "_row")).alias("_last"), F.max("_sum").alias("_full"))
    inner = inner.withColumnRenamed("source", "_s")
    goal = goal.join(inner, F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s")
    goal = store(goal.withColumn("_gap", F.col("_rest") - F.coalesce("_full", "_before", F.lit(0))), "goal")

    # _edge null: every range fits (or the source has no words)
    chosen = F.coalesce((F.col("_range") < F.col("_edge")) | ((F.col("_range") == F.col("_edge")) & (F.struct("_key", "doc_id", "_row") <= F.col("_last"))), F.col("_edge").isNull() & (F.col("_rest") > 0))
    miss = F.abs(F.col("_gap") - F.col("size"))
    last = with_goal(base.drop("own"), goal).withColumn("_in", F.coalesce(chosen, F.lit(False))).where(~F.col("_in") & F.col("_edge").isNotNull() & (miss < F.col("_gap"))).groupBy("source")
    last = last.agg(F.min(F.struct(miss.alias("miss"), "_key", F.col("_row").alias("row"))).alias("_close"))
    last = last.select(F.col("source").alias("_s"), F.col("_close.row").alias("_top"))
    goal = goal.join(last, F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s")
    out = with_goal(base, goal).withColumn("_in", F.coalesce(chosen, F.lit(False)) | F.coalesce(F.col("_row") == F.col("_top"), F.lit(False)))
    return out.withColumn("taken", (F.col("_epochs") + F.col("_in").cast("long")) * F.col("size")).select("own.*", "size", "source_size", "target", "taken")


def quality_weights(docs: DataFrame, labels: DataFrame, name: str = "_quality") -> DataFrame:
    """docs with a quality weight: 1 where the document's label says good, 0.25 where bad, 0.5 without a label."""
    best = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("labelled")).agg(F.max("quality").alias("best"))
    weight = F.when(best["best"] > 0, 1.0).when(best["best"].isNotNull(), 0.25).otherwise(0.5).alias(name)
    return docs.join(best, docs["doc_id"] == best["labelled"], "left").select(*(docs[f"`{c}`"] for c in docs.columns if c != name), weight)


def op6_mix(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(quality_weights(sized(docs), table(spark, sf_dir, "labels")), quality=F.col("_quality")).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH base AS (
  SELECT d.doc_id, d.source,
         CAST(coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         -ln((CAST(('0x' || substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0)
           / CASE WHEN l.q > 0 THEN 1.0 WHEN l.q IS NOT NULL THEN 0.25 ELSE 0.5 END AS key
  FROM documents d
  LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) l ON l.doc_id = d.doc_id
), s0 AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source
), s1 AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS nr, 3.0 * CAST(source_size AS DOUBLE) AS cap,
         CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s0
), s2 AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, nr) AS rank,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS capped,
         sum(weight) OVER (ORDER BY cap / weight, nr ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM s1
), s3 AS (
  SELECT *, (total - capped) / open AS level FROM s2
), s4 AS (
  SELECT *, (SELECT min(rank) FROM s3 WHERE cap >= weight * level) AS first FROM s3
), s5 AS (
  SELECT source, source_size,
         CASE WHEN first IS NULL OR rank < first THEN cap ELSE weight * (SELECT max(level) FROM s4 x WHERE x.rank = x.first) END AS target FROM s4
), s6 AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM s5
), s7 AS (
  SELECT *, target - epochs * source_size AS rest FROM s6
), o AS (
  SELECT b.*, s.source_size, s.target, s.epochs, s.rest,
         sum(b.size) OVER (PARTITION BY b.source ORDER BY b.key, b.doc_id ROWS UNBOUNDED PRECEDING) AS run
  FROM base b JOIN s7 s ON b.source IS NOT DISTINCT FROM s.source
), g AS (
  SELECT source, max(rest) - coalesce(max(CASE WHEN run <= rest THEN run END), 0) AS gap FROM o GROUP BY source
), c AS (
  SELECT source, doc_id FROM (
    SELECT o.source, o.doc_id, row_number() OVER (PARTITION BY o.source ORDER BY abs(g.gap - o.size), o.key) AS r
    FROM o JOIN g ON o.source IS NOT DISTINCT FROM g.source WHERE o.run > o.rest AND abs(g.gap - o.size) < g.gap) WHERE r = 1
)
SELECT o.doc_id, o.size, o.source_size, o.target,
       CAST((o.epochs + CASE WHEN (o.run <= o.rest AND o.rest > 0) OR c.doc_id IS NOT NULL THEN 1 ELSE 0 END) * o.size AS BIGINT) AS taken
FROM o LEFT JOIN c ON c.doc_id = o.doc_id
"""


def pipeline_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their texts, size, target, taken and the number of copies it takes of each.

    The choice moves rows without text; only the kept row keys are joined back. The keys are stored with the rows, so they
    are the same on both sides of the join. Empty and null texts have no words to take and go; null ids, null sources and repeated
    rows are documents of their own; an empty table gives no rows; columns named like the new ones are replaced, others stay.
    """
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken", "copies")]
    keyed = store(docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("own"), F.monotonically_increasing_id().alias("row")), "mixing")
    slim = sized(keyed.select("row", "own.doc_id", "own.source", "own.text"))
    mixed = mix(quality_weights(slim, table(spark, sf_dir, "labels")), quality=F.col("_quality")).where("taken > 0").withColumn("copies", F.expr("taken div size"))
    return keyed.join(mixed.select("row", "size", "source_size", "target", "taken", "copies"), "row").select("own.*", "size", "source_size", "target", "taken", "copies")
