"""Queries of expressions, filters, joins and aggregates on the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import joins, scans, stats
from .registry import query, table

C = F.col


@query("""
SELECT l_suppkey, l_returnflag, count(*) AS n_rows, CAST(sum(CASE WHEN l_quantity >= 25 THEN 1 ELSE 0 END) AS BIGINT) AS n_large, CAST(sum(CASE WHEN l_discount = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_full_price,
       CAST(sum(CASE WHEN l_linestatus = 'F' AND l_tax > 0.04 THEN 1 ELSE 0 END) AS BIGINT) AS n_taxed_final, CAST(coalesce(sum(CASE WHEN l_quantity >= 25 THEN 3 WHEN l_quantity >= 10 THEN 2 ELSE 1 END), 0) AS DOUBLE) AS points
FROM lineitem GROUP BY 1, 2""")
def counter_vector(spark, d):
    tests = {"n_rows": F.lit(True), "n_large": C("l_quantity") >= 25, "n_full_price": C("l_discount") == 0, "n_taxed_final": (C("l_linestatus") == "F") & (C("l_tax") > 0.04)}
    points = F.when(C("l_quantity") >= 25, 3.0).when(C("l_quantity") >= 10, 2.0).otherwise(1.0)
    return stats.counters(table(spark, d, "lineitem"), ["l_suppkey", "l_returnflag"], tests, {"points": points})


ZONES, ACTIONS = ["rim", "short", "mid", "corner", "arc"], ["drive", "post", "jump", "cut", "tip"]
PLAYS_SQL = """
WITH p AS (SELECT user_id // 20 AS game, user_id % 2 AS team, CASE WHEN event_id % 11 <> 0 THEN user_id END AS player, event_id % 4 = 1 AS made, event_id % 3 = 0 AS assisted, value,
  CASE event_type WHEN 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN 'ThreePointer' ELSE 'TwoPointer' END WHEN 'click' THEN 'FreeThrow' WHEN 'view' THEN 'Rebound' WHEN 'error' THEN 'Turnover' ELSE CASE event_id % 4 WHEN 0 THEN 'Assist' WHEN 1 THEN 'Steal' WHEN 2 THEN 'Block' ELSE 'RosterFoul' END END AS kind,
  CASE WHEN event_id % 5 = 0 THEN 'Offensive' WHEN event_id % 5 < 4 THEN 'Defensive' END AS outcome, (['rim', 'short', 'mid', 'corner', 'arc', NULL])[event_id % 6 + 1] AS zone, (['drive', 'post', 'jump', 'cut', 'tip', NULL, NULL])[event_id % 7 + 1] AS action FROM events),
q AS (SELECT *, kind IN ('TwoPointer', 'ThreePointer') AS shot, CASE WHEN made THEN CASE kind WHEN 'TwoPointer' THEN 2 WHEN 'ThreePointer' THEN 3 WHEN 'FreeThrow' THEN 1 ELSE 0 END ELSE 0 END AS points FROM p),
c AS (SELECT game, team, player, GROUPING(player) AS whole, count(*) FILTER (shot) AS "FGA", count(*) FILTER (kind = 'TwoPointer') AS "2PA", count(*) FILTER (kind = 'ThreePointer') AS "3PA", count(*) FILTER (shot AND made) AS "FGM",
  count(*) FILTER (kind = 'TwoPointer' AND made) AS "2PM", count(*) FILTER (kind = 'ThreePointer' AND made) AS "3PM", count(*) FILTER (shot AND made AND assisted) AS "FGM_assisted", count(*) FILTER (shot AND made AND NOT assisted) AS "FGM_unassisted", """ + ", ".join(
    [f"""count(*) FILTER (shot AND zone = '{z}') AS "{z}_FGA", count(*) FILTER (shot AND made AND zone = '{z}') AS "{z}_FGM\"""" for z in ZONES] + [f"""count(*) FILTER (shot AND action = '{a}') AS "act_{a}_FGA\"""" for a in ACTIONS]) + """,
  count(*) FILTER (kind = 'FreeThrow') AS "FTA", count(*) FILTER (kind = 'FreeThrow' AND made) AS "FTM", count(*) FILTER (kind = 'Rebound' AND outcome = 'Offensive') AS "OREB", count(*) FILTER (kind = 'Rebound' AND outcome IS DISTINCT FROM 'Offensive') AS "DREB",
  count(*) FILTER (kind = 'Assist') AS "AST", count(*) FILTER (kind = 'Steal') AS "STL", count(*) FILTER (kind = 'Block') AS "BLK", count(*) FILTER (kind = 'Turnover') AS "TOV", count(*) FILTER (kind = 'RosterFoul') AS "PF", CAST(sum(points) AS DOUBLE) AS "PTS"
  FROM q GROUP BY GROUPING SETS ((game, team, player), (game, team)))
SELECT * EXCLUDE (whole), round(CAST("FGA" - "OREB" + "TOV" + 0.44 * "FTA" AS DOUBLE), 6) AS possessions FROM c WHERE whole = 1 OR player IS NOT NULL"""


@query(PLAYS_SQL)
def play_counters(spark, d):
    """All counters of players and teams; plays without a player count for the team only."""
    i, t = C("event_id"), C("event_type")
    at = lambda names, n: F.get(F.array(*map(F.lit, names), *[F.lit(None).cast("string")] * (n - len(names))), (i % n).cast("int"))
    kind = F.when(t == "purchase", F.when(i % 3 == 0, "ThreePointer").otherwise("TwoPointer")).when(t == "click", "FreeThrow").when(t == "view", "Rebound").when(t == "error", "Turnover").otherwise(at(["Assist", "Steal", "Block", "RosterFoul"], 4))
    e = table(spark, d, "events").select(
        F.floor(C("user_id") / 20).alias("game"), (C("user_id") % 2).alias("team"), F.when(i % 11 != 0, C("user_id")).alias("player"), kind.alias("kind"), F.when(i % 5 == 0, "Offensive").when(i % 5 < 4, "Defensive").alias("outcome"),
        (i % 4 == 1).alias("made"), (i % 3 == 0).alias("assisted"), at(ZONES, 6).alias("zone"), at(ACTIONS, 7).alias("action"))
    tests = stats.play_tests(C("kind"), C("outcome"), C("made"), C("assisted"), C("zone"), C("action"), ZONES, ACTIONS)
    worth = F.when(C("made"), F.when(C("kind") == "TwoPointer", 2.0).when(C("kind") == "ThreePointer", 3.0).when(C("kind") == "FreeThrow", 1.0))
    return stats.play_counters(e, ["game"], "team", "player", tests, F.coalesce(worth, F.lit(0.0))).withColumn("possessions", F.round("possessions", 6))


@query("""
SELECT c_mktsegment, round(sum(l_extendedprice * (1 - l_discount)) / sum(l_quantity), 6) AS revenue_per_unit, round(sum(l_extendedprice * l_discount) / sum(l_extendedprice), 6) AS discount_rate,
       round(100.0 * sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / (sum(l_quantity) + 50), 6) AS shrunk_returns
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def ratio_of_sums(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), C("l_orderkey") == C("o_orderkey")).join(table(spark, d, "customer"), C("o_custkey") == C("c_custkey"))
    q = F.sum("l_quantity")
    return j.groupBy("c_mktsegment").agg(
        F.round(X.safe_div(F.sum(C("l_extendedprice") * (1 - C("l_discount"))), q), 6).alias("revenue_per_unit"),
        F.round(X.safe_div(F.sum(C("l_extendedprice") * C("l_discount")), F.sum("l_extendedprice")), 6).alias("discount_rate"),
        F.round(100.0 * F.sum(F.when(C("l_returnflag") == "R", C("l_quantity")).otherwise(0.0)) / (q + 50), 6).alias("shrunk_returns"),
    )


@query("""
WITH o AS (SELECT o_custkey, o_totalprice, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey), n AS (SELECT c_nationkey, avg(o_totalprice) AS expected FROM o GROUP BY 1)
SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice - expected) / count(*), 4) AS adjusted FROM o JOIN n USING (c_nationkey) GROUP BY 1""")
def opponent_adjusted(spark, d):
    """Mean order value less what the customer's nation leads to expect."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), C("o_custkey") == C("c_custkey")).select("o_custkey", "o_totalprice", "c_nationkey")
    n = o.groupBy("c_nationkey").agg(F.avg("o_totalprice").alias("expected"))
    return o.join(n, "c_nationkey").groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.round(F.sum(C("o_totalprice") - C("expected")) / F.count("*"), 4).alias("adjusted"))


def supplier_returns(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum(F.when(C("l_returnflag") == "R", 1).otherwise(0)).alias("n"), F.count("*").alias("d"))


@query("""
WITH s AS (SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n, count(*) AS d FROM lineitem GROUP BY 1), p AS (SELECT sum(n) / sum(d) AS prior FROM s)
SELECT l_suppkey, CAST(n AS BIGINT) AS n, d, n / d AS raw, (n + 100.0 * prior) / (d + 100.0) AS shrunk FROM s, p""")
def shrunk_rates_global(spark, d):
    s = stats.with_prior(supplier_returns(spark, d), "n", "d", "prior")
    return s.select("l_suppkey", "n", "d", X.safe_div(C("n"), C("d")).alias("raw"), stats.shrunk(C("n"), C("d"), C("prior"), 100.0).alias("shrunk"))


@query("""
WITH s AS (SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n, count(*) AS d FROM lineitem GROUP BY 1),
p AS (SELECT sum(n) / sum(d) AS prior FROM s WHERE l_suppkey % 3 = 0)
SELECT l_suppkey, (n + 50.0 * prior) / (d + 50.0) AS shrunk FROM s, p""")
def shrunk_rates_pool(spark, d):
    """The prior comes of a sub-pool of suppliers and is applied to all."""
    s = stats.with_prior(supplier_returns(spark, d), "n", "d", "prior", C("l_suppkey") % 3 == 0)
    return s.select("l_suppkey", stats.shrunk(C("n"), C("d"), C("prior"), 50.0).alias("shrunk"))


@query("""
WITH o AS (SELECT o_orderkey, o_custkey, c_nationkey, CAST(o_orderdate AS DATE) AS day, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY c_nationkey, day), 6) AS share FROM o""")
def share_denominators(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), C("o_custkey") == C("c_custkey")).withColumn("day", F.to_date("o_orderdate"))
    return o.select("o_orderkey", F.round(X.safe_div(C("o_totalprice"), F.sum("o_totalprice").over(Window.partitionBy("c_nationkey", "day"))), 6).alias("share"))


@query("""
WITH q AS (SELECT o_custkey, l_partkey, sum(l_quantity) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT o_custkey, l_partkey, qty FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY qty DESC, l_partkey DESC) AS r FROM q) WHERE r = 1""")
def argmax_group(spark, d):
    q = table(spark, d, "lineitem").join(table(spark, d, "orders"), C("l_orderkey") == C("o_orderkey")).groupBy("o_custkey", "l_partkey").agg(F.sum("l_quantity").alias("qty"))
    return stats.argmax(q, ["o_custkey"], "l_partkey", "qty")


@query("""
WITH a AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 11 <> 0), b AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS v FROM lineitem WHERE l_orderkey % 7 <> 0 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS order_key, round(coalesce(a.v, 0), 2) AS order_value, round(coalesce(b.v, 0), 2) AS line_value, abs(coalesce(a.v, 0) - coalesce(b.v, 0)) <= 1000.0 AS close FROM a FULL JOIN b ON a.k = b.k""")
def reconcile_outer(spark, d):
    a = table(spark, d, "orders").where("o_orderkey % 11 <> 0").select(C("o_orderkey").alias("order_key"), C("o_totalprice").alias("v"))
    b = table(spark, d, "lineitem").where("l_orderkey % 7 <> 0").groupBy(C("l_orderkey").alias("order_key")).agg(F.sum("l_extendedprice").alias("v"))
    r = stats.reconcile(a, b, ["order_key"], "v", "v")
    return r.select("order_key", F.round("left_value", 2).alias("order_value"), F.round("right_value", 2).alias("line_value"), (F.abs("diff") <= 1000.0).alias("close"))


@query("""
SELECT count(*) AS n, count(*) FILTER (WHERE value IS NULL) AS n_null_value, count(*) FILTER (WHERE value < 0) AS n_negative, count(DISTINCT user_id) AS n_users, count(DISTINCT event_type) AS n_types,
       round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS error_share, count(*) - count(DISTINCT event_id) AS n_repeated FROM events""")
def validation_flags(spark, d):
    return table(spark, d, "events").agg(
        F.count("*").alias("n"), F.count_if(C("value").isNull()).alias("n_null_value"), F.count_if(C("value") < 0).alias("n_negative"), F.countDistinct("user_id").alias("n_users"), F.countDistinct("event_type").alias("n_types"),
        F.round(F.avg(F.when(C("event_type") == "error", 1.0).otherwise(0.0)), 6).alias("error_share"), (F.count("*") - F.countDistinct("event_id")).alias("n_repeated"))


@query("""
WITH s AS (SELECT avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS sd FROM part) SELECT p_partkey, round((p_retailprice - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 8) AS z FROM part, s""")
def zscore_population(spark, d):
    p = table(spark, d, "part")
    s = p.agg(F.avg("p_retailprice").alias("m"), F.stddev_pop("p_retailprice").alias("sd"))
    return p.crossJoin(F.broadcast(s)).select("p_partkey", F.round((C("p_retailprice") - C("m")) / F.when(C("sd") == 0, 1.0).otherwise(C("sd")), 8).alias("z"))


NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 8) AS r, abs(corr({a}, {b})) >= 0.7 AS strong FROM lineitem" for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1 :]))
def corr_matrix(spark, d):
    """All pairs in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1 :]]
    one = table(spark, d, "lineitem").agg(*(F.corr(a, b).alias(f"{a}:{b}") for a, b in pairs))
    rows = F.explode(F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), C(f"`{a}:{b}`").alias("r")) for a, b in pairs)))
    return one.select(rows.alias("p")).select("p.x", "p.y", F.round("p.r", 8).alias("r"), (F.abs("p.r") >= 0.7).alias("strong"))


@query("""
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.025), 4) AS low, round(quantile_cont(l_extendedprice, 0.975), 4) AS high, round(avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END), 8) AS p_above FROM lineitem GROUP BY 1""")
def percentile_ci(spark, d):
    lines = table(spark, d, "lineitem")
    q = scans.percentiles(lines, ["l_returnflag"], "l_extendedprice", [0.025, 0.975]).groupBy("l_returnflag")
    at = lambda share: F.round(F.max(F.when(C("share") == share, C("l_extendedprice"))), 4)
    above = lines.groupBy("l_returnflag").agg(F.round(F.avg(F.when(C("l_discount") > 0.05, 1.0).otherwise(0.0)), 8).alias("p_above"))
    return q.agg(at(0.025).alias("low"), at(0.975).alias("high")).join(above, "l_returnflag")


TYPES = ["click", "error", "purchase", "signup", "view"]


@query(f"""
WITH s AS (SELECT user_id, {", ".join(f"round(coalesce(sum(CASE WHEN event_type = '{t}' THEN value END), 0), 4) AS {t}" for t in TYPES)}, round(sum(value), 4) AS total FROM events GROUP BY 1)
SELECT * FROM s ORDER BY total DESC, user_id LIMIT 10""")
def pivot_minutes(spark, d):
    p = table(spark, d, "events").groupBy("user_id").pivot("event_type", TYPES).agg(F.sum("value"))
    p = p.select("user_id", *(F.round(F.coalesce(t, F.lit(0.0)), 4).alias(t) for t in TYPES))
    total = table(spark, d, "events").groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("total"))
    return p.join(total, "user_id").orderBy(F.desc("total"), "user_id").limit(10)


@query("""
SELECT p_brand, p_type, n FROM (SELECT p_brand, p_type, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS r FROM part WHERE p_type IS NOT NULL GROUP BY 1, 2) WHERE r <= 3""")
def value_counts_topk(spark, d):
    n = table(spark, d, "part").where("p_type is not null").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return joins.nearest(n, ["p_brand"], F.desc("n"), ["p_type"], 3)


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) AS n, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY 1")
def distinct_list_agg(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("n"), F.array_join(F.sort_array(F.collect_set("o_orderpriority")), "|").alias("priorities"))


@query("""
SELECT p_partkey, CASE WHEN list_contains(string_split(p_type, ' '), 'STEEL') THEN 1 ELSE 0 END AS steel, CASE WHEN list_contains(string_split(p_type, ' '), 'BRASS') THEN 1 ELSE 0 END AS brass,
       len(string_split(p_name, ' ')) AS n_words FROM part""")
def multi_hot(spark, d):
    hot = X.multi_hot(C("p_type"), " ", ["STEEL", "BRASS"])
    return table(spark, d, "part").select("p_partkey", hot["STEEL"].alias("steel"), hot["BRASS"].alias("brass"), F.size(F.split("p_name", " ")).cast("long").alias("n_words"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'browse' WHEN 'click' THEN 'browse' WHEN 'purchase' THEN 'buy' END AS grp FROM events")
def enum_map(spark, d):
    return table(spark, d, "events").select("event_id", X.mapped(C("event_type"), {"view": "browse", "click": "browse", "purchase": "buy"}).alias("grp"))


@query("""
WITH s AS (SELECT o_orderkey, list_sort(list(DISTINCT l_returnflag)) AS f FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT o_orderkey, CASE WHEN len(f) = 3 THEN 'all' WHEN list_contains(f, 'A') AND list_contains(f, 'R') THEN 'A+R' WHEN list_contains(f, 'A') THEN 'A only' WHEN list_contains(f, 'R') THEN 'R only' ELSE 'other(' || array_to_string(f, '|') || ')' END AS label FROM s""")
def label_case(spark, d):
    s = table(spark, d, "orders").join(table(spark, d, "lineitem"), C("o_orderkey") == C("l_orderkey")).groupBy("o_orderkey").agg(F.sort_array(F.collect_set("l_returnflag")).alias("f"))
    has = lambda x: F.array_contains("f", x)
    label = F.when(F.size("f") == 3, "all").when(has("A") & has("R"), "A+R").when(has("A"), "A only").when(has("R"), "R only").otherwise(F.concat(F.lit("other("), F.array_join("f", "|"), F.lit(")")))
    return s.select("o_orderkey", label.alias("label"))


@query("""
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 10 <> 0 THEN c_mktsegment END AS seg FROM customer), p AS (SELECT c_custkey, 'PATCHED' AS seg, c_custkey % 20 = 0 AS known FROM customer WHERE c_custkey % 5 = 0)
SELECT c.c_custkey, coalesce(c.seg, p.seg) AS seg, c.seg IS NOT NULL AND p.seg IS NOT NULL AS conflict FROM c LEFT JOIN p USING (c_custkey)""")
def null_patch(spark, d):
    """Only nulls are patched; a patch of a known value is flagged."""
    c = table(spark, d, "customer").select("c_custkey", F.when(C("c_custkey") % 10 != 0, C("c_mktsegment")).alias("own"))
    p = table(spark, d, "customer").where("c_custkey % 5 = 0").select("c_custkey", F.lit("PATCHED").alias("patch"))
    j = c.join(p, "c_custkey", "left")
    return j.select("c_custkey", F.coalesce("own", "patch").alias("seg"), (C("own").isNotNull() & C("patch").isNotNull()).alias("conflict"))


@query("""
WITH e AS (SELECT event_id, CAST((event_id * 9973) % 28000 AS DOUBLE) AS x, CAST((event_id * 7561) % 15000 AS DOUBLE) AS y, event_id % 2 = 0 AS lb, event_type = 'click' AS three, event_type = 'error' AS miss FROM events),
g AS (SELECT *, CASE WHEN lb THEN x ELSE 28000 - x END AS along, abs(y - 7500) AS off, sqrt(power(x - CASE WHEN lb THEN 1575 ELSE 26425 END, 2) + power(y - 7500, 2)) AS dist FROM e)
SELECT event_id, CASE WHEN NOT miss THEN round(dist / 1000.0, 6) END AS dist_m, CASE WHEN miss THEN NULL WHEN three THEN CASE WHEN along <= 2990 THEN 'c3' ELSE 'ab3' END
  WHEN dist <= 1250 THEN 'rim' WHEN along <= 5800 AND off <= 2450 THEN 'paint' ELSE 'mid' END AS zone FROM g""")
def geometry_zone(spark, d):
    hit = C("event_type") != "error"
    e = table(spark, d, "events").select("event_id", "event_type", F.when(hit, ((C("event_id") * 9973) % 28000).cast("double")).alias("x"), F.when(hit, ((C("event_id") * 7561) % 15000).cast("double")).alias("y"))
    left = C("event_id") % 2 == 0
    return e.select("event_id", F.round(X.shot_distance(C("x"), C("y"), left), 6).alias("dist_m"), X.shot_zone(C("event_type") == "click", C("x"), C("y"), left).alias("zone"))


@query("SELECT l_returnflag, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 6) AS mean_price FROM lineitem GROUP BY 1")
def weighted_mean(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(X.safe_div(F.sum(C("l_quantity") * C("l_extendedprice")), F.sum("l_quantity")), 6).alias("mean_price"))


@query("""
SELECT a.n_name AS customer_nation, b.n_name AS supplier_nation, count(*) AS n, round(sum(l_extendedprice), 2) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
LEFT JOIN nation a ON a.n_nationkey = c_nationkey LEFT JOIN nation b ON b.n_nationkey = s_nationkey GROUP BY 1, 2""")
def team_two_roles(spark, d):
    """One table joined twice in different roles."""
    n = table(spark, d, "nation")
    a = n.select(C("n_nationkey").alias("c_nationkey"), C("n_name").alias("customer_nation"))
    b = n.select(C("n_nationkey").alias("s_nationkey"), C("n_name").alias("supplier_nation"))
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), C("l_orderkey") == C("o_orderkey")).join(table(spark, d, "customer"), C("o_custkey") == C("c_custkey")).join(table(spark, d, "supplier"), C("l_suppkey") == C("s_suppkey"))
    return j.join(a, "c_nationkey", "left").join(b, "s_nationkey", "left").groupBy("customer_nation", "supplier_nation").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("value"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49) AND o_orderstatus IN ('F', 'O')")
def semi_filter(spark, d):
    big = table(spark, d, "lineitem").where("l_quantity > 49")
    return table(spark, d, "orders").where(C("o_orderstatus").isin("F", "O")).join(big, C("o_orderkey") == C("l_orderkey"), "left_semi").select("o_orderkey", "o_orderstatus")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) AND c_mktsegment NOT IN ('BUILDING')")
def anti_filter(spark, d):
    large = table(spark, d, "orders").where("o_totalprice > 400000")
    return table(spark, d, "customer").where(~C("c_mktsegment").isin("BUILDING")).join(large, C("c_custkey") == C("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean_value FROM events WHERE event_type = 'view' GROUP BY 1 HAVING count(*) >= 3 AND NOT (max(value) >= 99 AND count(*) >= 5)")
def sample_gates(spark, d):
    """Groups below a least sample, and those of a flagged kind, are left out."""
    g = table(spark, d, "events").where("event_type = 'view'").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.max("value").alias("top"))
    return g.where((C("n") >= 3) & ~((C("top") >= 99) & (C("n") >= 5))).select("user_id", "n", "mean_value")


@query("""
SELECT l_partkey, 'union' AS op FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' UNION SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')
UNION ALL SELECT l_partkey, 'intersect' FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')
UNION ALL SELECT l_partkey, 'except' FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')""")
def set_ops(spark, d):
    """One aggregation answers all three."""
    flags = table(spark, d, "lineitem").where(C("l_returnflag").isin("A", "R")).groupBy("l_partkey").agg(F.max(C("l_returnflag") == "A").alias("a"), F.max(C("l_returnflag") == "R").alias("r"))
    ops = F.filter(F.array(F.lit("union"), F.when(C("a") & C("r"), "intersect"), F.when(C("a") & ~C("r"), "except")), lambda x: x.isNotNull())
    return flags.select("l_partkey", F.explode(ops).alias("op"))


@query("""
WITH v AS (SELECT x, i FROM (VALUES (0.5, 1), (1.5, 2), (2.5, 3), (0.125, 4), (-2.5, 5)) t(x, i))
SELECT CAST(i AS INTEGER) AS i, CAST(round_even(x, 0) AS DOUBLE) AS whole, CAST(round_even(x, 2) AS DOUBLE) AS cents FROM v""")
def half_even_rounding(spark, d):
    v = spark.createDataFrame([(1, 0.5), (2, 1.5), (3, 2.5), (4, 0.125), (5, -2.5)], "i int, x double")
    return v.select("i", X.half_even(C("x"), 0).alias("whole"), X.half_even(C("x"), 2).alias("cents"))
