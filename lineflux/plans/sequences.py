"""Queries of ordered-sequence operators: events by user are the log, ts its clock."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import windows as Wn
from ..operators import intervals, joins, scans
from .registry import query, table

KEY, ORDER = ["user_id"], ["ts", "event_id"]


@query("""
SELECT user_id, event_id, CAST(row_number() OVER w - 1 AS BIGINT) AS seq,
       printf('%d_%03d', user_id, row_number() OVER w - 1) AS seq_key
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def event_sequence(spark, d):
    e = table(spark, d, "events").withColumn("seq", Wn.sequence(KEY, ORDER))
    return e.select("user_id", "event_id", "seq", F.format_string("%d_%03d", "user_id", "seq").alias("seq_key"))


@query("""
WITH e AS (SELECT event_id, CAST(event_id % 6 + 1 AS INTEGER) AS q, (event_id * 7919) % (CASE WHEN event_id % 6 < 4 THEN 720 ELSE 300 END) * 1000 AS left_ms FROM events),
s AS (SELECT *, CASE WHEN q <= 4 THEN q * 720 ELSE 2880 + (q - 4) * 300 END AS period_end_s FROM e),
t AS (SELECT *, CAST(period_end_s - left_ms / 1000.0 AS DOUBLE) AS elapsed_s FROM s),
c AS (SELECT *, CAST(CAST(floor(elapsed_s / 720) AS INTEGER) + 1 AS INTEGER) AS q_back FROM t),
k AS (SELECT *, CAST(q_back * 720 - elapsed_s AS INTEGER) AS l FROM c)
SELECT event_id, q, elapsed_s, CAST(CASE WHEN q <= 4 THEN 720 ELSE 300 END AS INTEGER) AS period_s, CAST(period_end_s AS INTEGER) AS period_end_s, q_back, printf('%d:%02d', l // 60, l % 60) AS clock,
       CAST(CASE WHEN event_id % 9 = 0 THEN 0 ELSE l END AS INTEGER) AS clock_s
FROM k""")
def clock_elapsed(spark, d):
    q = F.col("q")
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 6 + 1).cast("int").alias("q"))
    e = e.withColumn("left_ms", (F.col("event_id") * 7919) % X.period_length(q) * 1000).withColumn("elapsed_s", X.elapsed(q, F.col("left_ms")))
    back, clock = X.clock_of(F.col("elapsed_s"))
    e = e.select("event_id", "q", "elapsed_s", X.period_length(q).alias("period_s"), X.period_end(q).alias("period_end_s"), back.alias("q_back"), clock.alias("clock"))
    shown = F.when(F.col("event_id") % 9 == 0, "--:--").otherwise(F.col("clock"))
    return e.withColumn("clock_s", X.clock_seconds(shown))


@query("""
WITH e AS (SELECT *, CASE WHEN event_type <> 'error' THEN value END AS known FROM events)
SELECT event_id, user_id, event_type = 'error' AS imputed,
       coalesce(last_value(known IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                first_value(known IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 720.0) AS filled
FROM e""")
def ffill_bfill(spark, d):
    known = F.when(F.col("event_type") != "error", F.col("value"))
    return table(spark, d, "events").withColumn("known", known).select("event_id", "user_id", (F.col("event_type") == "error").alias("imputed"), Wn.filled(F.col("known"), KEY, ORDER, F.lit(720.0)).alias("filled"))


@query("""
WITH e AS (SELECT *, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS p FROM events)
SELECT event_id, user_id, CAST(sum(p) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running_n,
       CAST(coalesce(sum(p) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prior_n
FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def running_and_prior_sum(spark, d):
    p = F.when(F.col("event_type") == "purchase", 1).otherwise(0).cast("long")
    e = table(spark, d, "events").withColumn("p", p)
    return e.select("event_id", "user_id", Wn.running(F.col("p"), KEY, ORDER).alias("running_n"), Wn.prior_sum(F.col("p"), KEY, ORDER).alias("prior_n"))


@query("""
WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate, CAST(o_totalprice AS DECIMAL(18, 2)) AS v FROM orders), a AS (SELECT CAST(sum(v) AS DOUBLE) / count(*) AS fill FROM o)
SELECT o_orderkey, o_custkey, CAST(row_number() OVER w - 1 AS BIGINT) AS orders_so_far,
       coalesce(CAST(sum(v) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE) / (row_number() OVER w - 1), fill) AS prior_mean
FROM o, a WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def expanding_prior_mean(spark, d):
    """Leak-free prior; the first row is filled with the overall mean. Exact sums of decimals, so both sides round alike."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    keys, order = ["o_custkey"], ["o_orderdate", "o_orderkey"]
    fill = o.agg((F.sum("v").cast("double") / F.count("*")).alias("fill"))
    so_far = Wn.sequence(keys, order)
    mean = X.safe_div(Wn.prior_sum(F.col("v"), keys, order).cast("double"), so_far)
    return o.crossJoin(F.broadcast(fill)).select("o_orderkey", "o_custkey", so_far.alias("orders_so_far"), F.coalesce(mean, "fill").alias("prior_mean"))  # one row


@query("""
WITH f AS (SELECT o_custkey, min(o_orderdate) AS first_date FROM orders GROUP BY o_custkey)
SELECT o_custkey, CAST((row_number() OVER (ORDER BY first_date, o_custkey) - 1) % 5 AS INTEGER) AS fold FROM f""")
def round_robin_folds(spark, d):
    """Folds by the order of first dates. Places come from counts by day and a window within each day, so no task orders all."""
    f = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_date"))
    f = f.withColumn("day", F.to_date("first_date"))
    days = f.groupBy("day").count()
    days = days.withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("day").rowsBetween(*Wn.BEFORE)), F.lit(0))).drop("count")
    within = F.row_number().over(Window.partitionBy("day").orderBy("first_date", "o_custkey")) - 1
    return f.join(days, "day").select("o_custkey", ((F.col("before") + within) % 5).cast("int").alias("fold"))


@query("""
SELECT p_partkey, p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS size_rank FROM part""")
def avg_rank(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_brand", Wn.average_rank(["p_brand"], F.col("p_size")).alias("size_rank"))


def timed(spark, d):
    return table(spark, d, "events").withColumn("us", X.micros(F.col("ts")))


@query("""
SELECT e.event_id, e.user_id, p.event_id AS purchase_id, coalesce(p.value, 0.0) AS purchase_value
FROM (SELECT * FROM events WHERE event_type = 'error') e
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def asof_last_purchase(spark, d):
    e = timed(spark, d)
    right = e.where("event_type = 'purchase'").select("user_id", "us", "event_id", F.col("event_id").alias("purchase_id"), F.col("value").alias("purchase_value"))
    left = e.where("event_type = 'error'").select("event_id", "user_id", "us")
    out = joins.asof(left, right, KEY, "us", ["event_id"], ["purchase_id", "purchase_value"])
    return out.select("event_id", "user_id", "purchase_id", F.coalesce("purchase_value", F.lit(0.0)).alias("purchase_value"))


@query("""
WITH s AS (SELECT user_id, ts AS start_ts, event_id AS span_id, ts + INTERVAL 12 HOUR AS end_ts FROM events WHERE event_type = 'signup')
SELECT e.event_id, e.user_id, s.span_id FROM (SELECT * FROM events WHERE event_type = 'click') e
ASOF JOIN s ON e.user_id = s.user_id AND e.ts >= s.start_ts WHERE e.ts <= s.end_ts""")
def asof_containment(spark, d):
    """A boundary event belongs to the later interval only."""
    e = timed(spark, d)
    spans = e.where("event_type = 'signup'").select("user_id", "us", "event_id", F.col("event_id").alias("span_id"), (F.col("us") + 12 * 3_600_000_000).alias("end_us"))
    out = joins.asof(e.where("event_type = 'click'").select("event_id", "user_id", "us"), spans, KEY, "us", ["event_id"], ["span_id", "end_us"])
    return out.where(F.col("us") <= F.col("end_us")).select("event_id", "user_id", "span_id")


@query("""
WITH s AS (SELECT user_id, ts AS start_ts, event_id AS span_id, ts + INTERVAL 12 HOUR AS end_ts FROM events WHERE event_type = 'signup')
SELECT e.event_id, e.user_id, s.span_id FROM events e JOIN s ON e.user_id = s.user_id AND e.ts BETWEEN s.start_ts AND s.end_ts""")
def interval_inclusive(spark, d):
    """Both ends count, so a boundary event can fall in two intervals."""
    e = timed(spark, d)
    spans = e.where("event_type = 'signup'").select("user_id", F.col("us").alias("start_us"), (F.col("us") + 12 * 3_600_000_000).alias("end_us"), F.col("event_id").alias("span_id"))
    return joins.within_intervals(e.select("event_id", "user_id", "us"), spans, KEY, "us", "start_us", "end_us", 12 * 3_600_000_000).select("event_id", "user_id", "span_id")


LOG_SQL = """
log AS (SELECT user_id // 20 AS grp, user_id AS entity, event_id, event_type, epoch_us(ts) AS us,
        event_type IN ('signup', 'error') AS is_sub, event_type = 'signup' AS enters,
        row_number() OVER (PARTITION BY user_id // 20 ORDER BY ts, event_id) AS pos FROM events)"""


def log_of(spark, d):
    """Users in groups of twenty, however many there are: a signup enters, an error leaves, other events are ordinary."""
    e = timed(spark, d).select(F.floor(F.col("user_id") / 20).alias("grp"), F.col("user_id").alias("entity"), "event_id", "event_type", "us")
    return e.withColumn("pos", Wn.sequence(["grp"], ["us", "event_id"]) + 1)


@query(f"""
WITH {LOG_SQL},
p AS (SELECT grp, entity, pos AS f, enters, lead(pos) OVER (PARTITION BY grp, entity ORDER BY pos) AS t FROM log WHERE is_sub),
o AS (SELECT l.grp, l.pos, l.us, coalesce(list_sort(list(DISTINCT p.entity) FILTER (WHERE p.entity IS NOT NULL)), []) AS lineup
      FROM log l LEFT JOIN p ON p.grp = l.grp AND p.enters AND p.f < l.pos AND (p.t IS NULL OR p.t > l.pos) WHERE NOT l.is_sub GROUP BY l.grp, l.pos, l.us),
c AS (SELECT *, array_to_string(lineup, '|') AS ids, lag(array_to_string(lineup, '|')) OVER (PARTITION BY grp ORDER BY pos) AS prev, row_number() OVER (PARTITION BY grp ORDER BY pos) AS r FROM o),
i AS (SELECT *, sum(CASE WHEN r = 1 OR prev <> ids THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY pos) AS stint FROM c),
g AS (SELECT grp, CAST(stint AS BIGINT) AS stint, any_value(ids) AS lineup_ids, min(pos) AS first_pos, count(*) AS n_rows, arg_min(us, pos) AS first_us FROM i GROUP BY grp, stint)
SELECT g.grp, g.stint, g.lineup_ids, g.first_pos, g.n_rows, coalesce((SELECT max(l.us) FROM log l WHERE l.grp = g.grp AND l.is_sub AND l.pos < g.first_pos), g.first_us) AS start_us FROM g""")
def presence_islands(spark, d):
    log = log_of(spark, d)
    out = intervals.record_lineups(log, ["grp"], "entity", F.col("event_type").isin("signup", "error"), F.col("event_type") == "signup", "pos", "us")
    return out.select("grp", "stint", F.array_join(F.col("lineup").cast("array<string>"), "|").alias("lineup_ids"), "first_pos", "n_rows", F.col("start_time").alias("start_us"))


@query(f"""
WITH {LOG_SQL},
s AS (SELECT grp, entity, us // 21600000000 AS t, max(CASE WHEN enters THEN 1 ELSE 0 END) AS on_ FROM log WHERE is_sub GROUP BY ALL),
r AS (SELECT *, lead(t) OVER (PARTITION BY grp, entity ORDER BY t) AS until FROM s),
x AS (SELECT grp, t AS start_t, lead(t) OVER (PARTITION BY grp ORDER BY t) AS end_t FROM (SELECT DISTINCT grp, t FROM s))
SELECT x.grp, x.start_t, x.end_t, CAST(count(r.entity) AS BIGINT) AS n_on, coalesce(string_agg(CAST(r.entity AS VARCHAR), '|' ORDER BY r.entity), '') AS lineup_ids
FROM x LEFT JOIN r ON r.grp = x.grp AND r.on_ = 1 AND r.t <= x.start_t AND (r.until IS NULL OR r.until > x.start_t) WHERE x.end_t IS NOT NULL GROUP BY x.grp, x.start_t, x.end_t""")
def batch_lineups(spark, d):
    log = log_of(spark, d).where(F.col("event_type").isin("signup", "error")).withColumn("t", F.floor(F.col("us") / 21_600_000_000).cast("long"))
    out = intervals.batch_lineups(log, ["grp"], "entity", F.col("event_type") == "signup", "t", "pos")
    return out.select("grp", F.col("start_time").alias("start_t"), F.col("end_time").alias("end_t"), F.size("lineup").cast("long").alias("n_on"), F.array_join(F.col("lineup").cast("array<string>"), "|").alias("lineup_ids"))


@query("""
WITH l AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, count(*) OVER (PARTITION BY user_id) AS last_pos FROM events),
r AS (SELECT *, lead(pos) OVER (PARTITION BY user_id ORDER BY pos) AS nxt, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS r FROM l WHERE event_type IN ('signup', 'error'))
SELECT user_id, pos AS from_pos, coalesce(nxt, last_pos) AS to_pos FROM r WHERE event_type = 'signup'
UNION ALL SELECT user_id, 0 AS from_pos, pos AS to_pos FROM r WHERE r = 1 AND event_type = 'error'""")
def single_presence(spark, d):
    e = table(spark, d, "events").withColumn("pos", Wn.sequence(KEY, ORDER) + 1)
    return intervals.single_presence(e, KEY, F.col("event_type") == "signup", F.col("event_type") == "error", "pos", 0, F.col("pos"))


BAND_SQL = """
s AS (SELECT user_id // 10 AS grp, user_id, event_id, event_type, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id // 10 ORDER BY ts, event_id) AS pos FROM events),
c AS (SELECT a.grp, a.event_id AS a_id, b.event_id AS b_id, a.pos AS a_pos, b.pos AS b_pos, abs(a.pos - b.pos) AS gap, abs(a.us - b.us) AS dt
      FROM s a JOIN s b ON a.grp = b.grp AND a.event_type = 'click' AND b.event_type = 'purchase' AND abs(a.pos - b.pos) <= 6 AND a.user_id <> b.user_id AND abs(a.us - b.us) <= 86400000000)"""


def band_candidates(spark, d):
    e = timed(spark, d).select(F.floor(F.col("user_id") / 10).alias("grp"), "user_id", "event_id", "event_type", "us")
    e = e.withColumn("pos", Wn.sequence(["grp"], ["us", "event_id"]) + 1)
    side = lambda kind, p: e.where(F.col("event_type") == kind).select("grp", F.col("event_id").alias(f"{p}_id"), F.col("user_id").alias(f"{p}_user"), F.col("us").alias(f"{p}_us"), F.col("pos").alias(f"{p}_pos"))
    c = joins.band(side("click", "a"), side("purchase", "b"), ["grp"], "a_pos", "b_pos", 6)
    c = c.withColumn("gap", F.abs(F.col("a_pos") - F.col("b_pos"))).withColumn("dt", F.abs(F.col("a_us") - F.col("b_us")))
    return c.where("a_user <> b_user and dt <= 86400000000")


@query(f"WITH {BAND_SQL} SELECT grp, a_id, b_id, gap, dt FROM c")
def band_match_candidates(spark, d):
    return band_candidates(spark, d).select("grp", "a_id", "b_id", "gap", "dt")


@query(f"""
WITH RECURSIVE {BAND_SQL}, o AS (SELECT grp, a_pos, b_pos, row_number() OVER (PARTITION BY grp ORDER BY gap, a_pos, b_pos) AS k FROM c),
g AS (SELECT DISTINCT grp, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS ua, CAST([] AS BIGINT[]) AS ub FROM o
      UNION ALL SELECT g.grp, o.k, CASE WHEN list_contains(ua, a_pos) OR list_contains(ub, b_pos) THEN ua ELSE list_append(ua, a_pos) END, CASE WHEN list_contains(ua, a_pos) OR list_contains(ub, b_pos) THEN ub ELSE list_append(ub, b_pos) END
      FROM g JOIN o ON o.grp = g.grp AND o.k = g.k + 1),
m AS (SELECT grp, unnest(ua) AS a_pos, unnest(ub) AS b_pos FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY k DESC) AS r FROM g) WHERE r = 1)
SELECT grp, a_pos, b_pos, abs(a_pos - b_pos) AS gap FROM m""")
def greedy_match(spark, d):
    """One-to-one by ascending (gap, a, b)."""
    m = scans.greedy_match(band_candidates(spark, d), ["grp"], "a_pos", "b_pos", "gap")
    return m.select("grp", "a_pos", "b_pos", "gap")


@query(f"WITH {BAND_SQL} SELECT grp, a_id, b_id, gap FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY gap, b_pos) AS r FROM c) WHERE r = 1")
def nearest_match(spark, d):
    return joins.nearest(band_candidates(spark, d), ["a_id"], F.col("gap"), ["b_pos"]).select("grp", "a_id", "b_id", "gap")


SALES_ORDER = ["sold_at", "sale_id", "arrived_at", "total", "status", "priority"]


@query("""
WITH s AS (SELECT *, CAST(total AS DECIMAL(18, 2)) AS t FROM sales)
SELECT sale_id, client_id, CAST(sum(t) OVER w AS DOUBLE) AS spent, max(t) OVER w AS highest, last_value(CASE WHEN status = 'done' THEN sale_id END IGNORE NULLS) OVER w AS last_done
FROM s WINDOW w AS (PARTITION BY client_id ORDER BY sold_at NULLS FIRST, sale_id NULLS FIRST, arrived_at NULLS FIRST, total NULLS FIRST, status NULLS FIRST, priority NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def client_running_totals(spark, d):
    """By client, of which one has a large share of all sales: spent so far, the highest sale and the last finished one."""
    s = table(spark, d, "sales").withColumn("t", F.col("total").cast("decimal(18,2)"))
    done = F.when(F.col("status") == "done", F.col("sale_id"))
    out = scans.scanned(s, ["client_id"], SALES_ORDER, sums={"spent": F.col("t")}, highs={"highest": F.col("t")}, lasts={"last_done": done})
    return out.select("sale_id", "client_id", F.col("spent").cast("double").alias("spent"), "highest", "last_done")


@query("""
WITH u AS (SELECT client_id, sold_at AS t, 0 AS side, sale_id, NULL AS click_id FROM sales WHERE client_id IS NOT NULL AND sale_id IS NOT NULL UNION ALL SELECT client_id, ts, 1, NULL, click_id FROM clicks WHERE client_id IS NOT NULL),
f AS (SELECT side, click_id, client_id, last_value(sale_id IGNORE NULLS) OVER (PARTITION BY client_id ORDER BY t NULLS FIRST, side, sale_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sale_id FROM u)
SELECT click_id, client_id, sale_id FROM f WHERE side = 1""")
def last_sale_before_click(spark, d):
    """The client's last sale at or before each click, spread over all tasks whatever one client holds."""
    clicks = table(spark, d, "clicks").where("client_id is not null").select("click_id", "client_id", F.col("ts").alias("t"))
    sales = table(spark, d, "sales").where("client_id is not null and sale_id is not null").select("client_id", F.col("sold_at").alias("t"), "sale_id")
    return scans.asof(clicks, sales, ["client_id"], "t", ["sale_id"], ["sale_id"]).select("click_id", "client_id", "sale_id")


@query("""
WITH s AS (SELECT client_id, CAST(total AS DOUBLE) AS t FROM sales WHERE total IS NOT NULL)
SELECT client_id, CAST(0.1 AS DOUBLE) AS share, round(quantile_cont(t, 0.1), 4) AS total FROM s GROUP BY 1
UNION ALL SELECT client_id, 0.5, round(quantile_cont(t, 0.5), 4) FROM s GROUP BY 1 UNION ALL SELECT client_id, 0.99, round(quantile_cont(t, 0.99), 4) FROM s GROUP BY 1""")
def client_percentiles(spark, d):
    """Exact percentiles of each client's sales."""
    return scans.percentiles(table(spark, d, "sales"), ["client_id"], "total", [0.1, 0.5, 0.99]).withColumn("total", F.round("total", 4))
