"""Queries of derived columns, perspective flips, flags and assembled summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import windows as Wn
from ..operators import joins, scans, stats
from .registry import query, table

C = F.col


@query("""
SELECT p_partkey, date_diff('day', DATE '1990-01-01' + CAST(p_partkey % 3000 AS INTEGER), DATE '2025-10-01') / 365.25 AS age, round(p_retailprice / power((150 + p_size) / 100.0, 2), 6) AS index_,
       round(ln(1 + p_size), 10) AS log_size, coalesce(p_size, 0) + coalesce(CASE WHEN p_size > 25 THEN p_size END, 0) AS wide_sum FROM part""")
def derived_columns(spark, d):
    """Age from a fixed date, a weight / height² index, log1p, row sums that skip nulls."""
    born = F.date_add(F.lit("1990-01-01").cast("date"), (C("p_partkey") % 3000).cast("int"))
    return table(spark, d, "part").select(
        "p_partkey", (F.datediff(F.lit("2025-10-01").cast("date"), born) / 365.25).alias("age"), F.round(C("p_retailprice") / F.pow((150 + C("p_size")) / 100.0, F.lit(2)), 6).alias("index_"),
        F.round(F.log1p("p_size"), 10).alias("log_size"), X.total_of(C("p_size"), F.when(C("p_size") > 25, C("p_size"))).alias("wide_sum"))


@query("""
WITH f AS (SELECT p_brand, min(p_partkey) AS first_key FROM part GROUP BY 1), c AS (SELECT p_brand, row_number() OVER (ORDER BY first_key) - 1 AS code FROM f)
SELECT p_partkey, CAST(code AS BIGINT) AS code, coalesce(CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE code END, -1) AS idx FROM part JOIN c USING (p_brand)""")
def categorical_code(spark, d):
    """Codes by first appearance; a missing look-up is -1."""
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    codes = joins.numbered(p.groupBy("p_brand").agg(F.min("p_partkey").alias("first_key")), [C("first_key")]).withColumn("code", C("nr") - 1)
    return p.join(codes, "p_brand").select("p_partkey", "code", F.coalesce(F.when(C("p_partkey") % 7 != 0, C("code")), F.lit(-1)).alias("idx"))


@query("""
WITH s AS (SELECT o_orderkey, o_orderpriority = '1-URGENT' AS home, o_totalprice AS a, o_totalprice * 0.5 AS b FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderstatus = 'F')
SELECT o_orderkey, CASE WHEN home THEN a ELSE b END AS own, CASE WHEN home THEN b ELSE a END AS other, CASE WHEN home THEN a - b ELSE b - a END AS margin FROM s""")
def perspective_flip(spark, d):
    s = table(spark, d, "orders").where((C("o_orderpriority") == "1-URGENT") | (C("o_orderstatus") == "F")).select("o_orderkey", (C("o_orderpriority") == "1-URGENT").alias("home"), C("o_totalprice").alias("a"), (C("o_totalprice") * 0.5).alias("b"))
    own, other = F.when(C("home"), C("a")).otherwise(C("b")), F.when(C("home"), C("b")).otherwise(C("a"))
    return s.select("o_orderkey", own.alias("own"), other.alias("other"), (own - other).alias("margin"))


@query("""
WITH e AS (SELECT event_id, user_id, row_number() OVER w AS pos, CASE WHEN event_type = 'purchase' THEN 3 WHEN event_type = 'error' THEN -3 ELSE 0 END AS p, ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
m AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS margin, (pos - 1) // 10 + 1 AS q, (pos - 1) * 72 AS start_s FROM e)
SELECT event_id, CAST(margin AS BIGINT) AS margin, q >= 4 AND abs(margin) >= 9 AS garbage_a, q >= 4 AND 2880 - start_s <= 300 AND abs(margin) >= 9 AS garbage_b FROM m""")
def garbage_flags(spark, d):
    """Two definitions of decided stretches, from the exclusive running margin."""
    p = F.when(C("event_type") == "purchase", 3).when(C("event_type") == "error", -3).otherwise(0)
    e = table(spark, d, "events").select("event_id", "user_id", "ts", p.cast("long").alias("p"), (Wn.sequence(["user_id"], ["ts", "event_id"]) + 1).alias("pos"))
    e = e.withColumn("margin", Wn.prior_sum(C("p"), ["user_id"], ["pos"])).withColumn("q", F.floor((C("pos") - 1) / 10) + 1)
    decided = (C("q") >= 4) & (F.abs("margin") >= 9)
    return e.select("event_id", "margin", decided.alias("garbage_a"), (decided & (X.REGULATION_S - (C("pos") - 1) * 72 <= 300)).alias("garbage_b"))


@query("""
WITH c AS (SELECT l_suppkey, sum(l_linenumber) AS fga, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS oreb, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS tov, sum(CASE WHEN l_tax > 0.05 THEN 1 ELSE 0 END) AS fta, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS pts FROM lineitem GROUP BY 1),
p AS (SELECT *, fga - oreb + tov + 0.44 * fta AS poss FROM c)
SELECT l_suppkey, round(CAST(poss AS DOUBLE), 6) AS poss, round(100 * pts / poss, 6) AS per_100, round(100 * (pts - 2 * poss) / (poss + 50), 6) AS shrunk_net FROM p""")
def possession_rates(spark, d):
    flag = lambda c: F.sum(F.when(c, 1).otherwise(0))
    c = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_linenumber").alias("fga"), flag(C("l_returnflag") == "R").alias("oreb"), flag(C("l_returnflag") == "A").alias("tov"), flag(C("l_tax") > 0.05).alias("fta"), F.sum(C("l_quantity").cast("decimal(18,2)")).cast("double").alias("pts"))
    c = c.withColumn("poss", X.possessions(C("fga"), C("oreb"), C("tov"), C("fta")).cast("double"))
    return c.select("l_suppkey", F.round("poss", 6).alias("poss"), F.round(X.safe_div(100 * C("pts"), C("poss")), 6).alias("per_100"), F.round(100 * (C("pts") - 2 * C("poss")) / (C("poss") + 50), 6).alias("shrunk_net"))


@query("""
WITH s AS (SELECT n_regionkey, n_nationkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2), o AS (SELECT * FROM (VALUES ('EUROPE', 1), ('ASIA', 2), ('AMERICA', 3)) t(r_name, place))
SELECT o.place, r.r_name, CAST(sum(s.n) AS BIGINT) AS n FROM s JOIN region r ON r.r_regionkey = s.n_regionkey JOIN o ON o.r_name = r.r_name GROUP BY 1, 2""")
def custom_order(spark, d):
    """Categories in a given order; others are dropped."""
    n = table(spark, d, "customer").join(table(spark, d, "nation"), C("c_nationkey") == C("n_nationkey")).groupBy("n_regionkey").agg(F.count("*").alias("n"))
    place = F.array_position(F.array(F.lit("EUROPE"), F.lit("ASIA"), F.lit("AMERICA")), C("r_name"))
    return n.join(table(spark, d, "region"), C("n_regionkey") == C("r_regionkey")).select(place.cast("int").alias("place"), "r_name", "n").where("place > 0").orderBy("place")


@query("""
WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_type, value FROM events)
SELECT a.user_id, a.event_id AS a_id, b.event_id AS shot_id, coalesce(b.value, 0) AS points FROM e a LEFT JOIN e b ON b.user_id = a.user_id AND b.pos = a.pos + 1 AND b.event_type = 'purchase' WHERE a.event_type = 'click'""")
def point_lookup(spark, d):
    """A click's next row if it's a purchase; 0 points otherwise."""
    e = table(spark, d, "events").withColumn("pos", Wn.sequence(["user_id"], ["ts", "event_id"]) + 1)
    a = e.where("event_type = 'click'").select("user_id", C("event_id").alias("a_id"), (C("pos") + 1).alias("pos"))
    b = e.where("event_type = 'purchase'").select("user_id", "pos", C("event_id").alias("shot_id"), "value")
    return a.join(b, ["user_id", "pos"], "left").select("user_id", "a_id", "shot_id", F.coalesce("value", F.lit(0.0)).alias("points"))


@query("""
WITH m AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), q AS (SELECT l_orderkey, l_suppkey, sum(l_quantity) AS own FROM lineitem GROUP BY 1, 2), t AS (SELECT l_orderkey, sum(own) AS total FROM q GROUP BY 1)
SELECT l_suppkey, sum(own) AS own, sum(total - own) AS others, count(*) AS n_orders FROM q JOIN t USING (l_orderkey) GROUP BY 1""")
def team_box(spark, d):
    """Own against all others' quantity in the orders that a supplier is in."""
    q = table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").alias("own"))
    total = F.sum("own").over(Window.partitionBy("l_orderkey"))
    return q.withColumn("others", total - C("own")).groupBy("l_suppkey").agg(F.sum("own").alias("own"), F.sum("others").alias("others"), F.count("*").alias("n_orders"))


@query("""
WITH c AS (SELECT label, round(avg(CAST(embedding[1] AS DOUBLE)), 3) AS x1, round(avg(CAST(embedding[2] AS DOUBLE)), 3) AS x2, round(avg(CAST(embedding[3] AS DOUBLE)), 3) AS x3 FROM embeddings GROUP BY 1),
r AS (SELECT label, rank() OVER (ORDER BY x1) + (count(*) OVER (PARTITION BY x1) - 1) / 2.0 + rank() OVER (ORDER BY x2 DESC) + (count(*) OVER (PARTITION BY x2) - 1) / 2.0
  + rank() OVER (ORDER BY x3 DESC) + (count(*) OVER (PARTITION BY x3) - 1) / 2.0 AS score FROM c)
SELECT label, CAST(score AS DOUBLE) AS score FROM r""")
def summed_ranks(spark, d):
    """Candidates by the sum of their average ranks on several criteria."""
    c = table(spark, d, "embeddings").groupBy("label").agg(*(F.round(F.avg(C("embedding")[i].cast("double")), 3).alias(f"x{i + 1}") for i in range(3)))
    rank = lambda n, o: F.rank().over(Window.orderBy(o)) + (F.count(F.lit(1)).over(Window.partitionBy(n)) - 1) / 2.0  # noqa: E731  one row per label
    return c.select("label", (rank("x1", C("x1")) + rank("x2", F.desc("x2")) + rank("x3", F.desc("x3"))).alias("score"))


@query("""
WITH g AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT CAST(n AS BIGINT) AS orders, count(*) AS customers FROM g GROUP BY 1)
SELECT orders, customers, CAST(sum(customers) OVER (ORDER BY orders) AS BIGINT) AS so_far FROM t""")
def count_of_counts(spark, d):
    t = stats.counters(table(spark, d, "orders"), ["o_custkey"], {"orders": F.lit(True)}).groupBy("orders").agg(F.count("*").alias("customers"))
    return scans.scanned(t, [], ["orders"], sums={"so_far": C("customers")})


@query("""
WITH e AS (SELECT *, epoch_us(ts) AS us FROM events), c AS (
  SELECT a.event_id AS a_id, b.event_id AS b_id, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.us - b.us), b.event_id) AS r FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND abs(a.us - b.us) <= 7200000000)
SELECT a_id, b_id FROM c WHERE r = 1""")
def nearest_in_time(spark, d):
    e = table(spark, d, "events").withColumn("us", X.micros(C("ts")))
    side = lambda k, p: e.where(C("event_type") == k).select("user_id", C("event_id").alias(f"{p}_id"), C("us").alias(f"{p}_us"))
    c = joins.band(side("view", "a"), side("purchase", "b"), ["user_id"], "a_us", "b_us", 7_200_000_000)
    return joins.nearest(c, ["a_id"], F.abs(C("a_us") - C("b_us")), ["b_id"]).select("a_id", "b_id")
