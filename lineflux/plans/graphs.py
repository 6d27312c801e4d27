"""Queries of pair and graph operators: orders are groups, parts and suppliers their members."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, joins, stats
from .registry import query, table

MEMBERS = "m AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)"
EDGES = f"{MEMBERS}, e AS (SELECT x.l_partkey AS a, y.l_partkey AS b, count(*) AS shared FROM m x JOIN m y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey GROUP BY 1, 2)"
TOTALS = "t AS (SELECT l_partkey AS p, count(*) AS total FROM m GROUP BY 1)"


def members(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()


def edges(spark, d, tasks=None):
    return graph.co_membership(table(spark, d, "lineitem"), ["l_orderkey"], "l_partkey", tasks=tasks)


def normalised_edges(spark, d):
    tasks = joins.pair_tasks(table(spark, d, "lineitem"), ["l_orderkey"])
    return graph.normalised(edges(spark, d, tasks), totals(spark, d, tasks), "l_partkey", "total", tasks)


def totals(spark, d, tasks):
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey").repartition(tasks, "l_orderkey", "l_partkey").distinct().repartition(tasks, "l_partkey").groupBy("l_partkey").agg(F.count("*").alias("total"))


@query(f"WITH {EDGES} SELECT a, b, shared FROM e")
def co_membership_edges(spark, d):
    return edges(spark, d)


@query("""
WITH l AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A'), r AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R')
SELECT l_suppkey, l_partkey, count(*) AS shared FROM l JOIN r USING (l_orderkey) GROUP BY 1, 2""")
def bipartite_edges(spark, d):
    li = table(spark, d, "lineitem")
    l = li.where("l_returnflag = 'A'").select("l_orderkey", "l_suppkey").distinct()
    r = li.where("l_returnflag = 'R'").select("l_orderkey", "l_partkey").distinct()
    return joins.bipartite(l, r, ["l_orderkey"]).groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("shared"))


@query("""
WITH m AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)
SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS shared FROM m x JOIN m y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey <> y.l_suppkey GROUP BY 1, 2""")
def directed_pairs(spark, d):
    return graph.co_membership(table(spark, d, "lineitem"), ["l_orderkey"], "l_suppkey", directed=True)


@query(f"""
WITH {EDGES}, {TOTALS}
SELECT a, b, shared, x.total AS total_a, y.total AS total_b, shared / least(x.total, y.total) AS overlap, shared / (x.total + y.total - shared) AS jaccard
FROM e JOIN t x ON x.p = a JOIN t y ON y.p = b""")
def edge_overlap_jaccard(spark, d):
    return normalised_edges(spark, d).select("a", "b", "shared", "total_a", "total_b", "overlap", "jaccard")


@query("""
WITH m AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem),
e AS (SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS shared FROM m x JOIN m y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey GROUP BY 1, 2)
SELECT s.s_nationkey, s.s_suppkey AS a, u.s_suppkey AS b, coalesce(e.shared, 0) AS shared FROM supplier s JOIN supplier u ON s.s_nationkey = u.s_nationkey AND s.s_suppkey < u.s_suppkey
LEFT JOIN e ON e.a = s.s_suppkey AND e.b = u.s_suppkey WHERE coalesce(e.shared, 0) <= 25""")
def hard_negatives(spark, d):
    tasks = joins.pair_tasks(table(spark, d, "lineitem"), ["l_orderkey"])
    e = graph.co_membership(table(spark, d, "lineitem"), ["l_orderkey"], "l_suppkey", tasks=tasks)
    return graph.sparse_negatives(table(spark, d, "supplier"), e, "s_nationkey", "s_suppkey", 25, tasks).select("s_nationkey", "a", "b", "shared")


@query(f"""
WITH {EDGES}, {TOTALS}, s AS (SELECT a, b, shared, x.total AS total_a, y.total AS total_b FROM e JOIN t x ON x.p = a JOIN t y ON y.p = b),
q AS (SELECT sum(shared) / sum(total_a + total_b - shared) AS prior FROM s)
SELECT a, b, shared, shared / least(total_a, total_b) AS overlap, (shared + 50.0 * prior) / (total_a + total_b - shared + 50.0) AS strength FROM s, q""")
def shrunk_edges(spark, d):
    """Co-membership edges with overlap and shrunk strength."""
    e = normalised_edges(spark, d).withColumn("union", F.col("total_a") + F.col("total_b") - F.col("shared"))
    e = stats.with_prior(e, "shared", "union", "prior")
    return e.select("a", "b", "shared", "overlap", stats.shrunk(F.col("shared"), F.col("union"), F.col("prior"), 50.0).alias("strength"))


@query(f"""
WITH {MEMBERS}, w AS (SELECT o.l_orderkey, o_totalprice AS v FROM (SELECT DISTINCT l_orderkey FROM m) o JOIN orders ON o_orderkey = o.l_orderkey),
t AS (SELECT count(*) AS n, sum(v) AS v FROM w), g AS (SELECT l_partkey, count(*) AS on_n, sum(v) AS on_v FROM m JOIN w USING (l_orderkey) GROUP BY 1)
SELECT l_partkey, CAST(on_n AS BIGINT) AS on_n, round(on_v, 2) AS on_v, CAST(t.n - on_n AS BIGINT) AS off_n, round(t.v - on_v, 2) AS off_v FROM g, t""")
def on_off_split(spark, d):
    """Orders with a part against all others: off is the total less on."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("v"))
    m = members(spark, d).join(o, "l_orderkey")
    on = m.groupBy("l_partkey").agg(F.count("*").alias("on_n"), F.sum("v").alias("on_v"))
    all_ = m.select("l_orderkey", "v").distinct().agg(F.count("*").alias("all_n"), F.sum("v").alias("all_v"))
    out = on.crossJoin(F.broadcast(all_))  # one row
    return out.select("l_partkey", "on_n", F.round("on_v", 2).alias("on_v"), (F.col("all_n") - F.col("on_n")).alias("off_n"), F.round(F.col("all_v") - F.col("on_v"), 2).alias("off_v"))


@query("""
WITH m AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), w AS (SELECT o_orderkey AS l_orderkey, CAST(o_totalprice AS DECIMAL(18, 2)) AS v FROM orders),
f AS (SELECT l_orderkey, v FROM m JOIN w USING (l_orderkey) WHERE l_suppkey = 1), t AS (SELECT count(*) AS n, sum(v) AS v FROM f),
g AS (SELECT m.l_suppkey AS mate, count(*) AS n, sum(f.v) AS v FROM f JOIN m ON m.l_orderkey = f.l_orderkey AND m.l_suppkey <> 1 GROUP BY 1)
SELECT mate, g.n AS with_n, t.n - g.n AS without_n, CAST(g.v AS DOUBLE) / g.n AS with_mean, CAST(t.v - g.v AS DOUBLE) / (t.n - g.n) AS without_mean, CAST(g.v AS DOUBLE) / g.n - CAST(t.v - g.v AS DOUBLE) / (t.n - g.n) AS diff
FROM g, t WHERE t.n > g.n""")
def with_without(spark, d):
    """The focus supplier's orders with each other supplier against those without it."""
    m = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    w = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    focus = m.where("l_suppkey = 1").join(w, "l_orderkey").select("l_orderkey", "v")
    total = focus.agg(F.count("*").alias("n"), F.sum("v").alias("v_all"))
    g = focus.join(m.where("l_suppkey <> 1"), "l_orderkey").groupBy(F.col("l_suppkey").alias("mate")).agg(F.count("*").alias("with_n"), F.sum("v").alias("v"))
    g = g.crossJoin(F.broadcast(total)).withColumn("without_n", F.col("n") - F.col("with_n")).where("without_n > 0")
    a, b = F.col("v").cast("double") / F.col("with_n"), (F.col("v_all") - F.col("v")).cast("double") / F.col("without_n")
    return g.select("mate", "with_n", "without_n", a.alias("with_mean"), b.alias("without_mean"), (a - b).alias("diff"))


@query("""
WITH s AS (SELECT n_nationkey, n_name, n_regionkey FROM nation), h AS (SELECT * FROM (VALUES (0, '000', '<?xml version="1.0" encoding="UTF-8"?>'), (0, '001', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">'),
  (0, '002', '<key id="n_n_name" for="node" attr.name="n_name" attr.type="string"/>'), (0, '003', '<key id="e_region" for="edge" attr.name="region" attr.type="int"/>'), (0, '004', '<graph edgedefault="undirected">'),
  (3, '0', '</graph>'), (3, '1', '</graphml>')) t(part, id, line)), e AS (SELECT DISTINCT x.n_nationkey AS a, y.n_nationkey AS b, x.n_regionkey AS region FROM s x JOIN s y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey)
SELECT 1 AS part, CAST(n_nationkey AS VARCHAR) AS id, '<node id="' || n_nationkey || '"><data key="n_n_name">' || n_name || '</data></node>' AS line FROM s WHERE n_nationkey IN (SELECT a FROM e UNION SELECT b FROM e)
UNION ALL SELECT 2, a || '-' || b, '<edge source="' || a || '" target="' || b || '"><data key="e_region">' || region || '</data></edge>' FROM e
UNION ALL SELECT part, id, line FROM h""")
def graphml_export(spark, d):
    n = table(spark, d, "nation")
    e = joins.pairs_within(n, ["n_regionkey"], "n_nationkey").select("a", "b", F.col("n_regionkey").alias("region"))
    return graph.graphml_lines(n.select("n_nationkey", "n_name"), e, "n_nationkey", False)
