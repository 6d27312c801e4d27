"""Queries of line-ups in two sides, weighted edges, contrasts, window counters and text rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import windows as Wn
from ..operators import graph, intervals, joins, stats
from ..operators import text as T
from .registry import query, table
from .sequences import LOG_SQL, log_of, timed

C = F.col

WEIGHTED = """m AS (SELECT DISTINCT l_orderkey, l_partkey, CAST(o_totalprice AS DECIMAL(18, 2)) AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
e AS (SELECT x.l_partkey AS a, y.l_partkey AS b, count(*) AS shared, CAST(sum(x.v) AS DOUBLE) AS weight FROM m x JOIN m y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey GROUP BY 1, 2)"""


def weighted(spark, d):
    o = table(spark, d, "orders").select(C("o_orderkey").alias("l_orderkey"), C("o_totalprice").cast("decimal(18,2)").alias("v"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    tasks = joins.pair_tasks(lines, ["l_orderkey"])
    m = lines.repartition(tasks, "l_orderkey").join(o.repartition(tasks, "l_orderkey"), "l_orderkey")
    return graph.co_membership(m, ["l_orderkey"], "l_partkey", weight="v", tasks=tasks).withColumn("weight", C("weight").cast("double"))


@query(f"WITH {WEIGHTED} SELECT a, b, shared, weight FROM e")
def weighted_edges(spark, d):
    """Pairs of parts by shared orders and the orders' total value."""
    return weighted(spark, d)


@query(f"WITH {WEIGHTED} SELECT *, CAST(row_number() OVER (ORDER BY shared DESC, weight DESC, a, b) AS INTEGER) AS rank FROM e QUALIFY rank <= 100")
def edge_ranking(spark, d):
    return graph.ranked_edges(weighted(spark, d), ["shared", "weight"], 100)


@query("""
WITH m AS (SELECT DISTINCT l_orderkey, l_suppkey, CAST(o_totalprice AS DECIMAL(18, 2)) AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
f AS (SELECT l_orderkey, v FROM m WHERE l_suppkey = 1), t AS (SELECT count(*) AS n, sum(v) AS v FROM f), a AS (SELECT l_suppkey AS mate, count(*) AS n, sum(v) AS v FROM m WHERE l_suppkey <> 1 GROUP BY 1),
w AS (SELECT m.l_suppkey AS mate, count(*) AS n, sum(f.v) AS v FROM f JOIN m ON m.l_orderkey = f.l_orderkey AND m.l_suppkey <> 1 GROUP BY 1),
r AS (SELECT mate, w.n AS with_n, t.n - w.n AS focus_without_n, a.n - w.n AS mate_without_n, CAST(w.v AS DOUBLE) / w.n AS with_mean, CASE WHEN t.n > w.n THEN CAST(t.v - w.v AS DOUBLE) / (t.n - w.n) END AS focus_without_mean,
      CASE WHEN a.n > w.n THEN CAST(a.v - w.v AS DOUBLE) / (a.n - w.n) END AS mate_without_mean FROM w JOIN a USING (mate), t)
SELECT *, with_mean - focus_without_mean AS focus_diff, with_mean - mate_without_mean AS mate_diff FROM r""")
def contrast_both_ways(spark, d):
    """The focus's orders with and without each mate, and the mate's with and without the focus."""
    o = table(spark, d, "orders").select(C("o_orderkey").alias("l_orderkey"), C("o_totalprice").cast("decimal(18,2)").alias("v"))
    m = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct().join(o, "l_orderkey")
    return stats.contrasts(m, "l_orderkey", "l_suppkey", "v", 1)


MEASURES = ["price", "lines", "quantity", "discount", "tax", "returned", "late", "urgent"]


def _contrast_sql() -> str:
    sums = lambda p, t: ", ".join(f"sum({t}.{v}) AS {p}_{v}" for v in MEASURES)
    means = ", ".join(
        f"CAST(w_{v} AS DOUBLE) / with_n AS {v}_with, CASE WHEN n > with_n THEN CAST(t_{v} - w_{v} AS DOUBLE) / (n - with_n) END AS {v}_focus_without, CASE WHEN m > with_n THEN CAST(m_{v} - w_{v} AS DOUBLE) / (m - with_n) END AS {v}_mate_without" for v in MEASURES)
    return f"""
WITH o AS (SELECT l_orderkey, max(CAST(o_totalprice AS DECIMAL(18, 2))) AS price, count(*) AS lines, sum(CAST(l_quantity AS DECIMAL(18, 2))) AS quantity, sum(CAST(l_discount AS DECIMAL(18, 2))) AS discount, sum(CAST(l_tax AS DECIMAL(18, 2))) AS tax,
             count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_linestatus = 'O') AS late, max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS urgent FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1),
g AS (SELECT o.*, l_suppkey FROM o JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) USING (l_orderkey)), f AS (SELECT * FROM g WHERE l_suppkey = 1), t AS (SELECT count(*) AS n, {sums("t", "f")} FROM f),
a AS (SELECT l_suppkey AS mate, count(*) AS m, {sums("m", "g")} FROM g WHERE l_suppkey <> 1 GROUP BY 1), w AS (SELECT g.l_suppkey AS mate, count(*) AS with_n, {sums("w", "f")} FROM f JOIN g ON g.l_orderkey = f.l_orderkey AND g.l_suppkey <> 1 GROUP BY 1),
r AS (SELECT mate, with_n, n - with_n AS focus_without_n, m - with_n AS mate_without_n, {means} FROM w JOIN a USING (mate), t)
SELECT *, {", ".join(f"{v}_with - {v}_focus_without AS {v}_focus_diff, {v}_with - {v}_mate_without AS {v}_mate_diff" for v in MEASURES)} FROM r"""


@query(_contrast_sql())
def contrast_measures(spark, d):
    """Eight measures of the focus's orders with and without each mate, both ways, at once."""
    dec = lambda c: F.sum(C(c).cast("decimal(18,2)"))
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), C("o_orderkey") == C("l_orderkey"))
    o = lines.groupBy("l_orderkey").agg(
        F.max(C("o_totalprice").cast("decimal(18,2)")).alias("price"), F.count("*").alias("lines"), dec("l_quantity").alias("quantity"), dec("l_discount").alias("discount"), dec("l_tax").alias("tax"),
        F.count_if(C("l_returnflag") == "R").alias("returned"), F.count_if(C("l_linestatus") == "O").alias("late"), F.max(F.when(C("o_orderpriority") == "1-URGENT", 1).otherwise(0)).alias("urgent"))
    return stats.contrast_measures(table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct().join(o, "l_orderkey"), "l_orderkey", "l_suppkey", MEASURES, 1)


@query("""
WITH log AS (SELECT user_id // 20 AS game, CAST(event_id % 4 + 1 AS INTEGER) AS quarter, CASE WHEN user_id % 2 = 0 THEN 'home' ELSE 'away' END AS side, user_id AS id, event_type IN ('signup', 'error') AS is_sub, event_type = 'signup' AS enters,
             row_number() OVER (PARTITION BY user_id // 20, event_id % 4 ORDER BY ts, event_id) AS pos FROM events),
l AS (SELECT *, CAST((quarter - 1) * 720 + least(pos, 719) AS DOUBLE) AS t FROM log),
p AS (SELECT game, quarter, side, id, pos AS f, enters, lead(pos) OVER (PARTITION BY game, quarter, id ORDER BY pos) AS u FROM l WHERE is_sub),
o AS (SELECT l.game, l.quarter, l.pos, coalesce(string_agg(CAST(p.id AS VARCHAR), '|' ORDER BY p.id) FILTER (WHERE p.side = 'home'), '') AS home, coalesce(string_agg(CAST(p.id AS VARCHAR), '|' ORDER BY p.id) FILTER (WHERE p.side = 'away'), '') AS away,
      count(*) FILTER (WHERE p.side = 'home') AS n_home, count(*) FILTER (WHERE p.side = 'away') AS n_away, bool_and(p.id IS NULL OR p.id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS known
      FROM l LEFT JOIN p ON p.game = l.game AND p.quarter = l.quarter AND p.enters AND p.f < l.pos AND (p.u IS NULL OR p.u > l.pos) WHERE NOT l.is_sub GROUP BY ALL),
c AS (SELECT *, row_number() OVER w AS r, lag(home || '/' || away) OVER w AS prev FROM o WINDOW w AS (PARTITION BY game, quarter ORDER BY pos)),
i AS (SELECT *, sum(CASE WHEN r = 1 OR prev <> home || '/' || away THEN 1 ELSE 0 END) OVER (PARTITION BY game, quarter ORDER BY pos) AS stint FROM c),
g AS (SELECT game, quarter, stint, any_value(home) AS home, any_value(away) AS away, any_value(n_home) AS n_home, any_value(n_away) AS n_away, any_value(known) AS known, min(pos) AS first_pos FROM i GROUP BY 1, 2, 3),
s AS (SELECT *, CASE WHEN stint = 1 THEN (quarter - 1) * 720.0 ELSE (SELECT max(l.t) FROM l WHERE l.game = g.game AND l.quarter = g.quarter AND l.is_sub AND l.pos < g.first_pos) END AS start FROM g),
e AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY game, quarter ORDER BY stint), quarter * 720.0) AS end_, row_number() OVER (PARTITION BY game ORDER BY quarter, stint) AS no FROM s)
SELECT game || '_' || lpad(CAST(no AS VARCHAR), 3, '0') AS stint_id, game, quarter, CAST(start AS DOUBLE) AS start_s, CAST(end_ AS DOUBLE) AS end_s, CAST(end_ - start AS DOUBLE) AS duration_s, home AS home_ids, away AS away_ids,
       n_home = 2 AND n_away = 2 AND end_ - start > 0 AND known AS valid FROM e""")
def league_stints(spark, d):
    """Two-sided stints by quarter, valid with two known members a side and a positive duration."""
    e = timed(spark, d).select(F.floor(C("user_id") / 20).alias("game"), (C("event_id") % 4 + 1).cast("int").alias("quarter"), F.when(C("user_id") % 2 == 0, "home").otherwise("away").alias("side"), C("user_id").alias("id"), "event_type", "us", "event_id")
    e = e.withColumn("pos", Wn.sequence(["game", "quarter"], ["us", "event_id"]) + 1).withColumn("t", ((C("quarter") - 1) * 720 + F.least("pos", F.lit(719))).cast("double"))
    begin, end = ((C("quarter") - 1) * 720).cast("double"), X.period_end(C("quarter")).cast("double")
    s = intervals.two_sided_stints(e, "game", "quarter", "side", "id", C("event_type").isin("signup", "error"), C("event_type") == "signup", "pos", "t", begin, end)
    known = table(spark, d, "customer").where("c_acctbal > 0").select(C("c_custkey").alias("id"))
    ids = lambda c: F.array_join(C(c).cast("array<string>"), "|").alias(f"{c}_ids")
    return intervals.valid_stints(s, "stint_id", 2, known, "id").select("stint_id", "game", "quarter", C("start").alias("start_s"), C("end").alias("end_s"), C("duration").alias("duration_s"), ids("home"), ids("away"), "valid")


FINAL_SQL = f"""
WITH {LOG_SQL},
s AS (SELECT grp, entity, us // 21600000000 AS t, max(CASE WHEN enters THEN 1 ELSE 0 END) AS on_ FROM log WHERE is_sub GROUP BY ALL),
r AS (SELECT *, lead(t) OVER (PARTITION BY grp, entity ORDER BY t) AS until FROM s), z AS (SELECT grp, max(us // 21600000000) AS final FROM log GROUP BY 1),
x AS (SELECT grp, t AS start_t, coalesce(lead(t) OVER (PARTITION BY grp ORDER BY t), final) AS end_t FROM (SELECT DISTINCT grp, t FROM s) JOIN z USING (grp)),
u AS (SELECT x.grp, x.start_t, x.end_t, r.entity FROM x LEFT JOIN r ON r.grp = x.grp AND r.on_ = 1 AND r.t <= x.start_t AND (r.until IS NULL OR r.until > x.start_t))"""


def final(spark, d):
    log = log_of(spark, d).withColumn("t", F.floor(C("us") / 21_600_000_000).cast("long"))
    subs = log.where(C("event_type").isin("signup", "error"))
    return intervals.batch_lineups(subs, ["grp"], "entity", C("event_type") == "signup", "t", "pos", last=log.groupBy("grp").agg(F.max("t").alias("t")))


@query(f"{FINAL_SQL} SELECT grp, start_t, end_t, coalesce(string_agg(CAST(entity AS VARCHAR), '|' ORDER BY entity), '') AS lineup_ids FROM u GROUP BY 1, 2, 3")
def lineups_to_the_end(spark, d):
    """Line-ups by batches of equal time, the last one up to the final event."""
    return final(spark, d).select("grp", C("start_time").alias("start_t"), C("end_time").alias("end_t"), F.array_join(C("lineup").cast("array<string>"), "|").alias("lineup_ids"))


@query("""
WITH log AS (SELECT user_id // 20 AS game, CAST(event_id % 2 + 1 AS INTEGER) AS quarter, CASE WHEN user_id % 2 = 0 THEN 'home' ELSE 'away' END AS side, user_id AS id, event_type = 'signup' AS enters, epoch_us(ts) // 21600000000 AS t
             FROM events WHERE event_type IN ('signup', 'error')),
s AS (SELECT game, quarter, side, id, t, max(CASE WHEN enters THEN 1 ELSE 0 END) AS on_ FROM log GROUP BY ALL), r AS (SELECT *, lead(t) OVER (PARTITION BY game, quarter, id ORDER BY t) AS until FROM s),
x AS (SELECT game, quarter, t AS start_t, lead(t) OVER (PARTITION BY game, quarter ORDER BY t) AS end_t FROM (SELECT DISTINCT game, quarter, t FROM s)),
u AS (SELECT x.*, row_number() OVER (PARTITION BY game ORDER BY quarter, start_t) AS no FROM x WHERE end_t IS NOT NULL)
SELECT u.game || '_' || lpad(CAST(u.no AS VARCHAR), 3, '0') AS stint_id, u.start_t, u.end_t, coalesce(string_agg(CAST(r.id AS VARCHAR), '|' ORDER BY r.id) FILTER (WHERE r.side = 'home'), '') AS home_ids,
       coalesce(string_agg(CAST(r.id AS VARCHAR), '|' ORDER BY r.id) FILTER (WHERE r.side = 'away'), '') AS away_ids, count(*) FILTER (WHERE r.side = 'home') = 2 AND count(*) FILTER (WHERE r.side = 'away') = 2 AND u.end_t > u.start_t AS valid
FROM u LEFT JOIN r ON r.game = u.game AND r.quarter = u.quarter AND r.on_ = 1 AND r.t <= u.start_t AND (r.until IS NULL OR r.until > u.start_t) GROUP BY u.game, u.no, u.start_t, u.end_t""")
def batch_stints(spark, d):
    """Two-sided stints from substitutions batched by equal time, by quarter, valid with two members a side."""
    e = timed(spark, d).where(C("event_type").isin("signup", "error")).select(F.floor(C("user_id") / 20).alias("game"), (C("event_id") % 2 + 1).cast("int").alias("quarter"), "event_type", "event_id", F.floor(C("us") / 21_600_000_000).cast("long").alias("t"),
                                F.struct(F.when(C("user_id") % 2 == 0, "home").otherwise("away").alias("side"), C("user_id").alias("id")).alias("who"))
    s = intervals.batch_lineups(e, ["game", "quarter"], "who", C("event_type") == "signup", "t", "event_id")
    no = F.row_number().over(Wn.over(["game"], ["quarter", "start_time"]))
    s = s.select(F.format_string("%d_%03d", "game", no).alias("stint_id"), C("start_time").alias("start_t"), C("end_time").alias("end_t"), (C("end_time") - C("start_time")).alias("duration"), intervals.side_of("lineup", "home").alias("home"), intervals.side_of("lineup", "away").alias("away"))
    everyone = table(spark, d, "events").select(C("user_id").alias("id")).distinct()
    ids = lambda c: F.array_join(C(c).cast("array<string>"), "|").alias(f"{c}_ids")
    return intervals.valid_stints(s, "stint_id", 2, everyone, "id").select("stint_id", "start_t", "end_t", ids("home"), ids("away"), "valid")


@query("""
WITH e AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, count(*) AS n, CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS made, CAST(count(*) FILTER (WHERE event_type = 'purchase' AND before = 'click') AS BIGINT) AS linked,
       CASE WHEN count(*) FILTER (WHERE event_type = 'purchase') > 0 THEN count(*) FILTER (WHERE event_type = 'purchase' AND before = 'click') / count(*) FILTER (WHERE event_type = 'purchase') END AS linked_share,
       CAST(count(*) FILTER (WHERE event_type = 'purchase' AND value > 100) AS BIGINT) AS missing_xy, count(*) FILTER (WHERE event_type = 'signup') = count(*) FILTER (WHERE event_type = 'error') AS score_ok, count(DISTINCT event_type) AS kinds FROM e GROUP BY 1""")
def validation_table(spark, d):
    """Checks of each log: totals that agree, the share of made shots that are linked, those without a place, kinds seen."""
    e = table(spark, d, "events").withColumn("before", F.lag("event_type").over(Wn.over(["user_id"], ["ts", "event_id"])))
    made = C("event_type") == "purchase"
    c = stats.counters(e, ["user_id"], {"n": F.lit(True), "made": made, "linked": made & (C("before") == "click"), "missing_xy": made & (C("value") > 100), "ins": C("event_type") == "signup", "outs": C("event_type") == "error"})
    kinds = e.groupBy("user_id").agg(F.count_distinct("event_type").alias("kinds"))
    return c.join(kinds, "user_id").select("user_id", "n", "made", "linked", X.safe_div(C("linked"), C("made")).alias("linked_share"), "missing_xy", (C("ins") == C("outs")).alias("score_ok"), "kinds")


SAYS_SQL = """CASE event_type WHEN 'click' THEN CASE WHEN value >= 50 THEN 'two shot made' ELSE 'two shot missed' END WHEN 'purchase' THEN CASE WHEN value >= 20 THEN 'three shot made' ELSE 'three shot blocked, shot missed' END
  WHEN 'view' THEN 'assist to a three shot made' WHEN 'error' THEN CASE WHEN value >= 30 THEN 'turnover' ELSE 'free throw shot made' END ELSE 'sub turnover' END"""
KINDS_SQL = """CASE WHEN contains(says, 'sub') THEN NULL WHEN contains(says, 'assist') THEN 'ast' WHEN contains(says, 'block') THEN 'blk' WHEN contains(says, 'turnover') THEN 'tov'
  WHEN contains(says, 'free throw') THEN 'ft' WHEN contains(says, 'three') THEN 'p3' WHEN contains(says, 'two') THEN 'p2' END"""
COUNTS_SQL = "CAST(sum(CASE WHEN contains(says, 'made') AND kind IN ('ft', 'p2', 'p3') THEN CASE WHEN given > 0 THEN given WHEN kind = 'ft' THEN 1 WHEN kind = 'p3' THEN 3 ELSE 2 END ELSE 0 END) AS BIGINT) AS pts, " + ", ".join(
    [f"CAST(sum(CASE WHEN kind = '{k}' THEN 1 ELSE 0 END) AS BIGINT) AS {k}" for k in ("ast", "blk", "tov")]
    + [f"CAST(sum(CASE WHEN kind = '{k}' AND contains(says, 'made') THEN 1 ELSE 0 END) AS BIGINT) AS {k}_m, CAST(sum(CASE WHEN kind = '{k}' THEN 1 ELSE 0 END) AS BIGINT) AS {k}_a" for k in ("ft", "p3", "p2")])


def spoken(spark, d):
    v, kind = C("value"), C("event_type")
    says = F.when(kind == "click", F.when(v >= 50, "two shot made").otherwise("two shot missed")).when(kind == "purchase", F.when(v >= 20, "three shot made").otherwise("three shot blocked, shot missed"))
    says = says.when(kind == "view", "assist to a three shot made").when(kind == "error", F.when(v >= 30, "turnover").otherwise("free throw shot made")).otherwise("sub turnover")
    return timed(spark, d).select("user_id", "event_id", "us", says.alias("says"), (F.floor("value").cast("int") % 4).alias("given"))


def told(rows, keys):
    return T.classified(rows, keys, "says", "given", [(["assist"], "ast"), (["block"], "blk"), (["turnover"], "tov")], {"free throw": ("ft", 1), "three": ("p3", 3), "two": ("p2", 2)}, ["shot made"], ["shot missed"], ["sub"])


@query(f"""
WITH s AS (SELECT user_id, ts AS start_ts, event_id AS span_id, ts + INTERVAL 12 HOUR AS end_ts FROM events WHERE event_type = 'signup'), x AS (SELECT *, {SAYS_SQL} AS says, CAST(floor(value) AS INTEGER) % 4 AS given FROM events),
w AS (SELECT x.user_id, s.span_id, says, given, {KINDS_SQL} AS kind FROM x JOIN s ON x.user_id = s.user_id AND x.ts BETWEEN s.start_ts AND s.end_ts)
SELECT user_id, span_id, {COUNTS_SQL} FROM w GROUP BY 1, 2""")
def text_window_stats(spark, d):
    """Counters of what texts say within inclusive windows; the first rule that fits decides."""
    e = spoken(spark, d)
    spans = timed(spark, d).where("event_type = 'signup'").select("user_id", C("us").alias("start_us"), (C("us") + 12 * 3_600_000_000).alias("end_us"), C("event_id").alias("span_id"))
    return told(joins.within_intervals(e, spans, ["user_id"], "us", "start_us", "end_us", 12 * 3_600_000_000), ["user_id", "span_id"])


@query(f"""
{FINAL_SQL}, f AS (SELECT grp, min(entity) AS focus FROM log GROUP BY 1),
co AS (SELECT u.entity AS mate, CAST(sum(u.end_t - u.start_t) * 360 AS DOUBLE) AS minutes FROM u JOIN f ON f.grp = u.grp AND u.entity <> f.focus JOIN u y ON y.grp = u.grp AND y.start_t = u.start_t AND y.entity = f.focus GROUP BY 1),
sp AS (SELECT user_id, {SAYS_SQL} AS says, CAST(floor(value) AS INTEGER) % 4 AS given FROM events), k AS (SELECT *, {KINDS_SQL} AS kind FROM sp), t AS (SELECT user_id AS mate, {COUNTS_SQL} FROM k GROUP BY 1)
SELECT mate, CAST(minutes AS DOUBLE) AS minutes, t.* EXCLUDE (mate), {', '.join(f'round({c} / minutes * 36, 2) AS {c}_per' for c in ('pts', 'ast', 'blk', 'tov'))},
       {', '.join(f'CASE WHEN {c}_a > 0 THEN round({c}_m / {c}_a * 100, 1) ELSE CAST(0 AS DOUBLE) END AS {c}_pct' for c in ('p2', 'p3', 'ft'))}
FROM t JOIN co USING (mate) WHERE minutes > 0""")
def teammate_fit(spark, d):
    """Each mate's totals against its time on with the focus of its group; mates without such time are left out; by falling time."""
    focus = log_of(spark, d).groupBy("grp").agg(F.min("entity").alias("focus"))
    on = final(spark, d).join(focus, "grp").where(F.array_contains("lineup", C("focus"))).select("focus", (C("end_time") - C("start_time")).alias("span"), F.explode("lineup").alias("mate")).where("mate <> focus")
    minutes = on.groupBy("mate").agg((F.sum("span") * 360.0).alias("minutes"))
    totals = told(spoken(spark, d), ["user_id"]).withColumnRenamed("user_id", "mate").join(minutes, "mate")
    return stats.per_unit(totals, "minutes", ["pts", "ast", "blk", "tov"], {f"{k}_pct": (f"{k}_m", f"{k}_a") for k in ("p2", "p3", "ft")}).orderBy(F.desc("minutes"), "mate")


@query("""
SELECT event_id, 'Q' || (event_id % 5 + 1) || ' ' || CASE WHEN event_id % 9 = 0 THEN '00:00(end)' ELSE printf('%02d:%02d', event_id % 12, event_id % 60) END AS shown,
       CASE WHEN event_type <> 'error' THEN least(greatest(value, 10.0), 200.0) END AS held FROM events""")
def clock_and_clip(spark, d):
    """Display clocks with the period's end, and values held between bounds, null staying null."""
    e = table(spark, d, "events")
    clock = F.when(C("event_id") % 9 == 0, "--:--").otherwise(F.format_string("%02d:%02d", C("event_id") % 12, C("event_id") % 60))
    return e.select("event_id", X.display_clock(C("event_id") % 5 + 1, clock).alias("shown"), X.clipped(F.when(C("event_type") != "error", C("value")), 10.0, 200.0).alias("held"))


@query("""
WITH p AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'G' WHEN 1 THEN 'GAndF' WHEN 2 THEN 'FAndC' ELSE 'X' END AS pos FROM part)
SELECT p_partkey, CAST(contains(pos, 'G') AS INTEGER) AS g, CAST(contains(pos, 'F') AS INTEGER) AS f, CAST(contains(pos, 'C') AS INTEGER) AS c, CAST(CASE pos WHEN 'G' THEN 1.0 WHEN 'GAndF' THEN 1.5 WHEN 'FAndC' THEN 2.5 END AS DOUBLE) AS ordinal FROM p""")
def position_ordinals(spark, d):
    """A 0/1 column for each part of a compound, and the mean place of its parts."""
    kind = F.element_at(F.array(*map(F.lit, ("G", "GAndF", "FAndC", "X"))), (C("p_size") % 4 + 1).cast("int"))
    p = table(spark, d, "part").select("p_partkey", kind.alias("pos"))
    hot = X.multi_hot(C("pos"), "And", ["G", "F", "C"])
    return p.select("p_partkey", *(v.alias(k.lower()) for k, v in hot.items()), X.mean_ordinal(C("pos"), "And", ["G", "F", "C"]).cast("double").alias("ordinal"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag <> 'N' AND l_linenumber <> 1 AND l_quantity - 10 > 0")
def appearances(spark, d):
    """Rows on the sheet with minutes above zero, missing minutes counting as none."""
    minutes = F.when(C("l_linenumber") != 1, C("l_quantity") - 10)
    return table(spark, d, "lineitem").where(X.appeared(C("l_returnflag") != "N", minutes)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS short FROM customer")
def short_names(spark, d):
    """Names written with and without suffixes come back as the last word that is none."""
    suffix = F.element_at(F.array(F.lit(" Jr."), F.lit(" III"), F.lit("")), (C("c_custkey") % 3 + 1).cast("int"))
    name = F.when(C("c_custkey") % 7 == 0, "Sr.").otherwise(F.concat(F.lit("Lee van "), C("c_mktsegment"), suffix))
    return table(spark, d, "customer").select("c_custkey", X.short_name(name).alias("short"))


@query("SELECT user_id, CAST(count(*) FILTER (WHERE event_type <> 'error') AS BIGINT) AS kept, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS dropped FROM events GROUP BY 1")
def unknown_periods(spark, d):
    """Rows of unknown period leave; by user, how many stay and go."""
    e = table(spark, d, "events").withColumn("quarter", F.when(C("event_type") != "error", 1))
    return stats.without_nulls(e, "quarter", ["user_id"])[1]


@query("""
SELECT 'quantity_positive' AS "check", CAST(count(*) FILTER (WHERE NOT coalesce(l_quantity > 0, false)) AS BIGINT) AS n_bad, count(*) FILTER (WHERE NOT coalesce(l_quantity > 0, false)) = 0 AS ok FROM lineitem
UNION ALL SELECT 'first_line', CAST(count(*) FILTER (WHERE NOT coalesce(l_linenumber = 1, false)) AS BIGINT), count(*) FILTER (WHERE NOT coalesce(l_linenumber = 1, false)) = 0 FROM lineitem
UNION ALL SELECT 'tax_known', CAST(count(*) FILTER (WHERE l_tax IS NULL) AS BIGINT), count(*) FILTER (WHERE l_tax IS NULL) = 0 FROM lineitem""")
def data_asserts(spark, d):
    """Rules of a table and how many rows break each."""
    return stats.asserted(table(spark, d, "lineitem"), {"quantity_positive": C("l_quantity") > 0, "first_line": C("l_linenumber") == 1, "tax_known": C("l_tax").isNotNull()})


RECONCILE = "a AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1), b AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderstatus <> 'P'), j AS (SELECT coalesce(a.v, 0) - coalesce(b.v, 0) AS diff FROM a FULL JOIN b ON a.k = b.k)"


@query(f"WITH {RECONCILE} SELECT count(*) AS n, CAST(count(*) FILTER (WHERE abs(diff) <= 10000) AS BIGINT) AS within_10000, CAST(count(*) FILTER (WHERE abs(diff) <= 100000) AS BIGINT) AS within_100000, round(max(abs(diff)), 2) AS max_diff FROM j")
def reconcile_summary(spark, d):
    """How far two totals agree: rows within two bounds, and the largest difference."""
    a = table(spark, d, "lineitem").groupBy(C("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("v"))
    b = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(C("o_orderkey").alias("k"), C("o_totalprice").alias("v"))
    out = stats.reconciled_summary(stats.reconcile(a, b, ["k"], "v", "v"), [10_000, 100_000])
    return out.select("n", C("within_10000"), C("within_100000"), F.round("max_diff", 2).alias("max_diff"))


@query("SELECT l_orderkey, l_linenumber, o_totalprice FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def strict_lookup(spark, d):
    """A value that must be there: a missing key is an error."""
    o = table(spark, d, "orders").select(C("o_orderkey").alias("l_orderkey"), "o_totalprice")
    return joins.looked_up(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), o, ["l_orderkey"], "o_totalprice")


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'Unknown' ELSE printf('%02d/%02d/%02d', CASE WHEN month(o_orderdate) >= 10 THEN 25 ELSE 26 END, month(o_orderdate), day(o_orderdate)) END AS game_date FROM orders""")
def season_dates(spark, d):
    """Dates without a year, in a season that begins in October."""
    text = F.when(C("o_orderstatus") == "P", "no date").otherwise(F.concat(F.lit("game on "), F.month("o_orderdate").cast("string"), F.lit("/"), F.dayofmonth("o_orderdate").cast("string"), F.lit(" (三) 19:00")))
    return table(spark, d, "orders").select("o_orderkey", X.season_date(text).alias("game_date"))


MARKERS = {"第([0-9]+)節開始": "Q$1 start", "第([0-9]+)節結束": "Q$1 end"}
NAMES, PHRASES = {"er": "Ann", "ere": "Bo", "erer": "Cy"}, {"th": "TO", "the": "DE", "on": "AN"}


@query("""
WITH c AS (SELECT conv_id, turn, role, '第' || (turn % 4 + 1) || '節' || CASE WHEN role = 'user' THEN '開始' ELSE '結束' END || ' ' || text AS line FROM conversations),
m AS (SELECT conv_id, turn, role, regexp_replace(regexp_replace(line, '第([0-9]+)節開始', 'Q\\1 start', 'g'), '第([0-9]+)節結束', 'Q\\1 end', 'g') AS line FROM c),
n AS (SELECT conv_id, turn, role, replace(replace(replace(line, 'erer', 'Cy'), 'ere', 'Bo'), 'er', 'Ann') AS line FROM m)
SELECT conv_id, turn, role, trim(regexp_replace(replace(replace(replace(line, 'the', 'DE '), 'on', 'AN '), 'th', 'TO '), ' +', ' ', 'g'), ' ') AS line FROM n""")
def translate_lines(spark, d):
    """Period markers, then names, then phrases with a space after each, the longest first."""
    line = F.concat(F.lit("第"), (C("turn") % 4 + 1).cast("string"), F.lit("節"), F.when(C("role") == "user", "開始").otherwise("結束"), F.lit(" "), C("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", "role", T.translated(line, PHRASES, NAMES, MARKERS, " ").alias("line"))


LATIN, GREEK = "abcdefghijklmnopqrstuvwxyz", "αβγδεζηθικλμνξοπρστυφχψωϊϋ"


@query(f"""
WITH l AS (SELECT trim(unnest(string_split(translate(text, '{LATIN}', '{GREEK}'), chr(10))), ' ') AS line FROM documents WHERE text IS NOT NULL),
n AS (SELECT line, regexp_extract(line, '^([^ -]+)', 1) AS name FROM l WHERE contains(line, 'θε') OR contains(line, 'ινη'))
SELECT name, count(*) AS n_lines FROM n WHERE length(name) BETWEEN 2 AND 6 AND NOT regexp_matches(name, '[0-9a-zA-Z]') AND NOT starts_with(name, 'τθ') AND NOT starts_with(name, 'ον') AND NOT contains(line[1:6], 'ει') GROUP BY 1""")
def mined_players(spark, d):
    """Names before the first space or hyphen of lines with a keyword; teams' lines and words with Latin letters or digits are left out."""
    docs = table(spark, d, "documents").select(F.translate("text", LATIN, GREEK).alias("text"))
    return T.mined_names(docs, "text", ["θε", "ινη"], prefixes=("τθ", "ον"), mark="ει", banned="[0-9a-zA-Z]")


@query("""
WITH c AS (SELECT user_id, count(*) AS n, avg(value) AS v FROM events GROUP BY 1), t AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT 'map' AS figure, CAST(user_id AS VARCHAR) AS series, CAST(n AS DOUBLE) AS x, round(v, 6) AS y FROM c
UNION ALL SELECT 'bars', event_type, CAST(user_id AS DOUBLE), CAST(n AS DOUBLE) FROM t
UNION ALL SELECT 'table', event_type, CAST(count(*) AS DOUBLE), round(avg(value), 6) FROM events GROUP BY event_type""")
def figure_tables(spark, d):
    """What figures show, as rows: a scatter, bars by series, and a table."""
    e = table(spark, d, "events")
    scatter = e.groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("v")).select(F.lit("map").alias("figure"), C("user_id").cast("string").alias("series"), C("n").cast("double").alias("x"), F.round("v", 6).alias("y"))
    bars = e.groupBy("user_id", "event_type").count().select(F.lit("bars"), "event_type", C("user_id").cast("double"), C("count").cast("double"))
    rows = e.groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("v")).select(F.lit("table"), "event_type", C("n").cast("double"), F.round("v", 6))
    return scatter.unionAll(bars).unionAll(rows)
