"""Weighted edge lists from co-presence, and their exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import both_ways, pair_tasks, pairs_within, placed_pairs
from .stats import jaccard, overlap


def co_membership(members: DataFrame, group: list[str], member: str, weight: str | None = None, least: int = 1, *, directed: bool = False, tasks: int | None = None) -> DataFrame:
    """(a, b, shared) with a < b, or both ways: groups that both are in; with a weight column, which is one value per group, also weight, its sum
    over them.

    What a task makes it counts before it sends it on, and the counts meet in as many tasks (pair_tasks(), unless given)."""
    tasks = tasks or pair_tasks(members, group)
    p = placed_pairs(members, group, member, [weight] if weight else [], tasks)
    sums = lambda n: [n.alias("shared"), *([F.sum(weight).alias("weight")] if weight else [])]
    own = p.groupBy("_task", "a", "b").agg(*sums(F.count("*"))).drop("_task")
    if weight:
        own = own.withColumnRenamed("weight", weight)
    e = own.repartition(tasks, "a", "b").groupBy("a", "b").agg(*sums(F.sum("shared"))).where(F.col("shared") >= least)
    return both_ways(e, e.columns[2:]).select(e.columns) if directed else e


def ranked_edges(edges: DataFrame, by: list[str], most: int) -> DataFrame:
    """The `most` heaviest edges by falling columns, ties by their ends, with their rank."""
    order = [*(F.desc(c) for c in by), "a", "b"]
    return edges.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # `most` rows


def normalised(edges: DataFrame, totals: DataFrame, node: str, total: str, tasks: int | None = None) -> DataFrame:
    """edges (a, b, shared) with both ends' totals, overlap and jaccard; many edges meet the totals in so many tasks."""
    ta = totals.select(F.col(node).alias("a"), F.col(total).alias("total_a"))
    tb = totals.select(F.col(node).alias("b"), F.col(total).alias("total_b"))
    dealt = lambda df, end: df.repartition(tasks, end) if tasks else df
    e = dealt(dealt(edges, "a").join(dealt(ta, "a"), "a"), "b").join(dealt(tb, "b"), "b")
    return e.withColumn("overlap", overlap(F.col("shared"), F.col("total_a"), F.col("total_b"))).withColumn("jaccard", jaccard(F.col("shared"), F.col("total_a"), F.col("total_b")))


def sparse_negatives(nodes: DataFrame, edges: DataFrame, group: str, node: str, most: int, tasks: int = 1) -> DataFrame:
    """Pairs of one group whose shared weight is `most` or less, absent counting as 0. They meet the edges in so many tasks as they take, or as the
    edges do if those are more."""
    tasks = max(tasks, pair_tasks(nodes, [group]))
    p = pairs_within(nodes, [group], node, tasks=tasks).repartition(tasks, "a", "b")
    return p.join(edges.select("a", "b", "shared").repartition(tasks, "a", "b"), ["a", "b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0))).where(F.col("shared") <= most)


def graphml_lines(nodes: DataFrame, edges: DataFrame, node: str, directed: bool) -> DataFrame:
    """GraphML as (part, id, line): header, used nodes, edges, footer. Attributes are typed, null ones left out."""
    kinds = {"string": "string", "double": "double", "float": "double", "int": "int", "bigint": "long", "boolean": "boolean"}
    escape = lambda c: F.replace(F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    n_attr = [c for c in nodes.columns if c != node]
    e_attr = [c for c in edges.columns if c not in ("a", "b")]
    data = lambda p, c: F.coalesce(F.concat(F.lit(f'<data key="{p}_{c}">'), escape(F.col(c)), F.lit("</data>")), F.lit(""))
    keys = [f'<key id="{p}_{c}" for="{k}" attr.name="{c}" attr.type="{kinds.get(t, "string")}"/>' for p, k, df, cs in (("n", "node", nodes, n_attr), ("e", "edge", edges, e_attr)) for c, t in df.dtypes if c in cs]
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *keys, f'<graph edgedefault="{"directed" if directed else "undirected"}">']
    spark = nodes.sparkSession
    used = edges.select(F.col("a").alias(node)).union(edges.select(F.col("b").alias(node))).distinct()
    body_n = nodes.join(used, node, "left_semi").select(F.lit(1).alias("part"), F.col(node).cast("string").alias("id"), F.concat(F.lit('<node id="'), escape(F.col(node)), F.lit('">'), *(data("n", c) for c in n_attr), F.lit("</node>")).alias("line"))
    body_e = edges.select(F.lit(2).alias("part"), F.concat_ws("-", "a", "b").alias("id"), F.concat(F.lit('<edge source="'), escape(F.col("a")), F.lit('" target="'), escape(F.col("b")), F.lit('">'), *(data("e", c) for c in e_attr), F.lit("</edge>")).alias("line"))
    top = spark.createDataFrame([(0, f"{i:03d}", x) for i, x in enumerate(head)], "part int, id string, line string")
    end = spark.createDataFrame([(3, "0", "</graph>"), (3, "1", "</graphml>")], "part int, id string, line string")
    return top.unionAll(body_n).unionAll(body_e).unionAll(end)
