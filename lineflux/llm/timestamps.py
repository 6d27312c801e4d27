"""Mixed timestamps to UTC by a wall-time interval table.

Built-in expressions parse the texts. Each zone's timeline is split into normal, gap and overlap intervals of wall time with the offsets
before and after; a broadcast range join finds the interval of every wall time. Votes on the order of days and months are counted by source.
"""

from __future__ import annotations

import zoneinfo
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, ship, store, table

WS = r"[\x20\x09-\x0D]"
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
YEAR, TWO = "(20[0-9][0-9])", "([0-9][0-9])"
#: The five ways to write a date; groups 1-3, 4-6, 7-9, 10-12 and 13-15.
DATES = "|".join([f"{YEAR}-{TWO}-{TWO}", YEAR + TWO + TWO, rf"{TWO}[.]{TWO}[.]{YEAR}", rf"{TWO}\x20({'|'.join(MONTHS)})\x20{YEAR}", f"{TWO}/{TWO}/{YEAR}"])
#: Hour, minute, second, half of the day and offset: groups 16-20.
CLOCK = rf"(?:[T\x20]{TWO}:{TWO}(?::{TWO})?(?:\x20?([AP]M))?(?:\x20?(Z|[+-][0-9][0-9]:?[0-9][0-9]))?)?"
STAMP = rf"\A(?:{DATES}){CLOCK}\z"
#: The groups as columns; of a slashed date only `one` and `two`, which are day and month in some order.
PARTS = {"year": "$1$4$9$12$15", "month": "$2$5$8", "name": "$11", "day": "$3$6$7$10", "one": "$13", "two": "$14", "hour": "$16", "minute": "$17", "second": "$18", "half": "$19", "offset": "$20"}
FIRST_YEAR, LAST_YEAR = 2000, 2099
#: A source with more than this share of the undecided stamps is looked up in a broadcast, which so has 1 / share rows at most.
HOT_SHARE = 0.001


def parsed(stamps: DataFrame) -> DataFrame:
    """stamp_id, source, zone, epoch_us, and of other stamps wall_d and wall_m: seconds of wall time with the day or the month first (equal where
    only one order is written), null if impossible; shift: seconds of the written offset. What is bad has none of them."""
    known = F.col("zone").isin(sorted(zoneinfo.available_timezones()))
    d = stamps.select("stamp_id", "source", F.when(known, F.col("zone")).alias("zone"), F.regexp_replace("raw", rf"\A{WS}+|{WS}+\z", "").alias("t"))
    epoch = F.when(F.col("t").rlike(r"\A[0-9]{10}\z"), F.col("t").try_cast("long") * 1_000_000).when(F.col("t").rlike(r"\A[0-9]{13}\z"), F.col("t").try_cast("long") * 1000)
    parts = F.when(F.col("t").rlike(STAMP), F.split(F.regexp_replace("t", STAMP, "\t".join(PARTS.values())), "\t", -1))
    d = d.select("stamp_id", "source", "zone", epoch.alias("epoch_us"), parts.alias("p"))
    d = d.select("stamp_id", "source", "zone", "epoch_us", *(F.get("p", F.lit(i)).alias(k) for i, k in enumerate(PARTS)))
    c = F.col
    slashed = c("one") != ""
    number = F.lpad(((F.expr(f"instr('{''.join(MONTHS)}', name)") + 2) / 3).cast("int").cast("string"), 2, "0")
    d = d.withColumns({"slashed": slashed, "m": F.when(slashed, c("two")).when(c("name") != "", number).otherwise(c("month")), "d": F.when(slashed, c("one")).otherwise(c("day"))})
    whole = lambda k: c(k).try_cast("int")
    hour, minute, second = whole("hour"), whole("minute"), F.coalesce(whole("second"), F.lit(0))
    half = F.when(c("half") == "", F.when(hour <= 23, hour)).when(hour.between(1, 12), hour % 12 + F.when(c("half") == "PM", 12).otherwise(0))
    clock = F.when(c("hour") == "", 0).when((minute <= 59) & (second <= 59), half * 3600 + minute * 60 + second)
    ahead, past = F.substring("offset", 2, 2).try_cast("int"), F.substring("offset", -2, 2).try_cast("int")
    shift = F.when(c("offset") == "Z", 0).when((ahead <= 14) & (past <= 59), (ahead * 3600 + past * 60) * F.when(c("offset").startswith("-"), -1).otherwise(1))
    d = d.select("stamp_id", "source", "zone", "epoch_us", "year", "slashed", "m", "d", clock.alias("clock"), (c("offset") == "").alias("local"), shift.alias("shift"))
    day = lambda m, d: F.unix_date(F.concat_ws("-", "year", m, d).try_cast("date")).cast("long")
    d = d.withColumns({"day_d": day("m", "d"), "day_m": F.when(c("slashed"), day("d", "m"))})
    placed = F.when(F.when(c("local"), c("zone").isNotNull()).otherwise(c("shift").isNotNull()), c("clock"))
    d = d.withColumn("clock", placed)
    return d.select("stamp_id", "source", "zone", "epoch_us", c("year").try_cast("int").alias("year"), "shift", F.coalesce("slashed", F.lit(False)).alias("slashed"),
                    (c("day_d") * 86400 + c("clock")).alias("wall_d"), (F.when(c("slashed"), c("day_m")).otherwise(c("day_d")) * 86400 + c("clock")).alias("wall_m"))


def intervals_of(zone: str) -> list[tuple]:
    """(zone, start, end, before, after) of the years' wall times in seconds: before and after are the offsets on both sides of a gap or
    an overlap, and equal in a normal interval."""
    tz = zoneinfo.ZoneInfo(zone)
    at = lambda t: int(datetime.fromtimestamp(t, UTC).astimezone(tz).utcoffset() / timedelta(seconds=1))
    t, end = int(datetime(FIRST_YEAR - 1, 12, 28, tzinfo=UTC).timestamp()), int(datetime(LAST_YEAR + 1, 1, 4, tzinfo=UTC).timestamp())
    out, now = [], at(t)
    since = t + now
    while t < end:
        to = t + 43_200
        then = at(to)
        if then != now:
            low, high = t, to
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if at(middle) == now else (low, middle)
            then = at(high)
            first, last = high + min(now, then), high + max(now, then)
            out += [(zone, since, first, now, now), (zone, first, last, now, then)]
            since, now, to = last, then, high
        t = to
    return [*out, (zone, since, end + now, now, now)]


def wall_intervals(zones: DataFrame) -> DataFrame:
    """(wall_zone, wall_year, start, end, before, after) for the zones' names, an interval in each year that it touches.

    The time zone database bounds it: some 600 zones, and in each year a zone's few changes."""
    def made(frames):
        import pandas as pd

        for f in frames:
            yield pd.DataFrame([r for z in f["zone"] for r in intervals_of(z)], columns=["wall_zone", "start", "end", "before", "after"])

    ship(zones.sparkSession)
    year = lambda c: F.year(F.date_from_unix_date(F.floor(c / 86400).cast("int")))
    rows = zones.mapInPandas(made, "wall_zone string, start long, end long, before int, after int")
    return rows.withColumn("wall_year", F.explode(F.sequence(year(F.col("start")), year(F.col("end") - 1))))


def normalised(stamps: DataFrame, *, lead: float = 1) -> DataFrame:
    """stamp_id, utc_us, rule (bad, epoch, votes, default, plain) and ambiguous of every stamp (stamp_id, source, zone, raw).

    Rows map to rows: a null id is kept, equal rows give equal rows and vote each, a null source votes as one of its own, and an empty
    table gives no rows; other columns are ignored. A null or unknown zone makes a stamp without an offset bad; a text of any length is
    matched whole. lead: the side with more than so many times the other's votes wins.
    """
    p = store(parsed(stamps), "stamps")
    walls = wall_intervals(p.where("zone is not null and shift is null").select("zone").distinct())
    voter = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    p = p.withColumn("undecided", F.coalesce(F.col("slashed") & (F.col("wall_d") != F.col("wall_m")), F.lit(False))).withColumn("voter", F.when(F.col("slashed"), voter))
    only_d, only_m = F.col("wall_d").isNotNull() & F.col("wall_m").isNull(), F.col("wall_m").isNotNull() & F.col("wall_d").isNull()
    count = lambda c: F.sum(c.cast("long"))
    votes = store(p.where("slashed").groupBy("voter").agg(count(only_d).alias("for_d"), count(only_m).alias("for_m"), count(F.col("undecided")).alias("n")).where("n > 0"), "votes")
    total = votes.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > HOT_SHARE * total
    often, seldom = (votes.where(w).select(F.col("voter").alias("of"), "for_d", "for_m") for w in (hot, ~hot))
    # stamps of frequent sources stay where they are; those of the others, each a small share, meet their source's votes by shuffle
    p = p.join(few(often, int(1 / HOT_SHARE)), F.col("undecided") & (F.col("voter") == F.col("of")), "left").drop("of")
    met = F.col("undecided") & F.col("for_d").isNull()
    rest = p.where(met).drop("for_d", "for_m").join(seldom, F.col("voter") == F.col("of")).drop("of")
    p = p.where(~met).unionByName(rest)
    month_first, day_first = F.col("for_m") > lead * F.col("for_d"), F.col("for_d") > lead * F.col("for_m")
    wall = F.when(F.col("undecided") & month_first, F.col("wall_m")).otherwise(F.coalesce("wall_d", "wall_m"))
    rule = F.when(F.col("epoch_us").isNotNull(), "epoch").when(F.col("wall").isNull(), "bad").when(~F.col("undecided"), "plain").when(month_first | day_first, "votes").otherwise("default")
    p = p.withColumn("wall", wall).withColumn("rule", rule)
    p = p.withColumn("in_zone", F.when(F.col("shift").isNull() & F.col("wall").isNotNull(), F.col("zone")))
    meets = (F.col("in_zone") == F.col("wall_zone")) & (F.col("year") == F.col("wall_year")) & (F.col("wall") >= F.col("start")) & (F.col("wall") < F.col("end"))
    p = p.join(F.broadcast(walls), meets, "left")
    turn = F.coalesce(F.col("before") != F.col("after"), F.lit(False))
    utc = F.coalesce("epoch_us", (F.col("wall") - F.coalesce("shift", "after")) * 1_000_000)
    return p.select("stamp_id", utc.alias("utc_us"), "rule", (F.col("rule").isin("votes", "default") | turn).alias("ambiguous"))


def op11_timestamps(spark, sf_dir: str) -> DataFrame:
    return normalised(table(spark, sf_dir, "stamps"))


def _sql() -> str:
    two = "([0-9][0-9])"
    groups = ", ".join(f"'{k}'" for k in ("y1", "m1", "d1", "y2", "m2", "d2", "d3", "m3", "y3", "d4", "b4", "y4", "p", "q", "y5", "h", "mi", "s", "ap", "off"))
    pattern = rf"^(?:(20[0-9][0-9])-{two}-{two}|(20[0-9][0-9]){two}{two}|{two}[.]{two}[.](20[0-9][0-9])|{two} ({'|'.join(MONTHS)}) (20[0-9][0-9])|{two}/{two}/(20[0-9][0-9]))(?:[T ]{two}:{two}(?::{two})?(?: ?([AP]M))?(?: ?(Z|[+-][0-9][0-9]:?[0-9][0-9]))?)?$"
    return rf"""
WITH s AS (SELECT stamp_id, source, zone, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS t FROM stamps),
g AS (SELECT stamp_id, source, zone, t, regexp_extract(t, '{pattern}', [{groups}]) AS r, coalesce(regexp_matches(t, '{pattern}'), false) AS hit FROM s),
f AS (SELECT *, concat(r.y1, r.y2, r.y3, r.y4, r.y5) AS y, concat(r.m1, r.m2, r.m3, CASE WHEN r.b4 <> '' THEN printf('%02d', (instr('{"".join(MONTHS)}', r.b4) + 2) // 3) ELSE '' END) AS m, concat(r.d1, r.d2, r.d3, r.d4) AS d,
  try_cast(r.h AS INTEGER) AS h, try_cast(r.mi AS INTEGER) AS mi, coalesce(try_cast(r.s AS INTEGER), 0) AS sec FROM g),
c AS (SELECT *, r.p <> '' AS slashed,
  CASE WHEN r.p = '' THEN try_cast(concat(y, '-', m, '-', d) AS DATE) ELSE try_cast(concat(y, '-', r.q, '-', r.p) AS DATE) END AS by_d,
  CASE WHEN r.p = '' THEN try_cast(concat(y, '-', m, '-', d) AS DATE) ELSE try_cast(concat(y, '-', r.p, '-', r.q) AS DATE) END AS by_m,
  CASE WHEN h IS NULL THEN 0 WHEN mi > 59 OR sec > 59 THEN NULL WHEN r.ap = '' AND h <= 23 THEN h * 3600 + mi * 60 + sec WHEN r.ap <> '' AND h BETWEEN 1 AND 12 THEN (h % 12 + CASE r.ap WHEN 'PM' THEN 12 ELSE 0 END) * 3600 + mi * 60 + sec END AS clock,
  CASE WHEN r.off = 'Z' THEN 0 WHEN r.off <> '' AND CAST(r.off[2:3] AS INTEGER) <= 14 AND CAST(right(r.off, 2) AS INTEGER) <= 59 THEN CASE r.off[1] WHEN '-' THEN -1 ELSE 1 END * (CAST(r.off[2:3] AS INTEGER) * 3600 + CAST(right(r.off, 2) AS INTEGER) * 60) END AS shift FROM f WHERE hit),
w AS (SELECT *, CASE WHEN r.off = '' OR shift IS NOT NULL THEN epoch_us(CAST(by_d AS TIMESTAMP)) // 1000000 + clock END AS wall_d, CASE WHEN r.off = '' OR shift IS NOT NULL THEN epoch_us(CAST(by_m AS TIMESTAMP)) // 1000000 + clock END AS wall_m FROM c),
v AS (SELECT source, count(*) FILTER (WHERE wall_d IS NOT NULL AND wall_m IS NULL) AS for_d, count(*) FILTER (WHERE wall_m IS NOT NULL AND wall_d IS NULL) AS for_m FROM w WHERE slashed GROUP BY source),
k AS (SELECT w.*, v.for_d, v.for_m, slashed AND wall_d IS NOT NULL AND wall_m IS NOT NULL AND wall_d <> wall_m AS undecided FROM w LEFT JOIN v ON w.source IS NOT DISTINCT FROM v.source),
x AS (SELECT stamp_id, zone, shift, CASE WHEN coalesce(wall_d, wall_m) IS NULL THEN 'bad' WHEN NOT undecided THEN 'plain' WHEN for_d <> for_m THEN 'votes' ELSE 'default' END AS rule,
  CASE WHEN undecided AND for_m > for_d THEN wall_m ELSE coalesce(wall_d, wall_m) END AS wall FROM k),
o AS (SELECT *, epoch_us(timezone(zone, make_timestamptz((wall - 86400) * 1000000))) // 1000000 - wall + 86400 AS o1, epoch_us(timezone(zone, make_timestamptz((wall + 86400) * 1000000))) // 1000000 - wall - 86400 AS o2 FROM x WHERE wall IS NOT NULL AND shift IS NULL),
u AS (SELECT *, epoch_us(timezone(zone, make_timestamptz((wall - o1) * 1000000))) // 1000000 = wall AS is1, epoch_us(timezone(zone, make_timestamptz((wall - o2) * 1000000))) // 1000000 = wall AS is2 FROM o)
SELECT stamp_id, CASE length(t) WHEN 10 THEN CAST(t AS BIGINT) * 1000000 ELSE CAST(t AS BIGINT) * 1000 END AS utc_us, 'epoch' AS rule, false AS ambiguous FROM g WHERE NOT hit AND regexp_full_match(t, '[0-9]{{10}}|[0-9]{{13}}')
UNION ALL SELECT stamp_id, NULL, 'bad', false FROM g WHERE NOT hit AND NOT coalesce(regexp_full_match(t, '[0-9]{{10}}|[0-9]{{13}}'), false)
UNION ALL SELECT stamp_id, NULL, 'bad', false FROM x WHERE wall IS NULL
UNION ALL SELECT stamp_id, (wall - shift) * 1000000, rule, rule IN ('votes', 'default') FROM x WHERE wall IS NOT NULL AND shift IS NOT NULL
UNION ALL SELECT stamp_id, (wall - CASE WHEN is1 AND NOT is2 THEN o1 ELSE o2 END) * 1000000, rule, rule IN ('votes', 'default') OR is1 = is2 AND o1 <> o2 FROM u"""


#: Offsets from the other engine's own zones: a wall time is unique if only one of the offsets a day around it gives it back.
OP11_SQL = _sql()
