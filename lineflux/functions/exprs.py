"""Column expressions: clocks, geometry, safe ratios, maps and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of a regulation period and of an overtime period, regulation periods, end of regulation.
PERIOD_S, OVERTIME_S, PERIODS = 720, 300, 4
REGULATION_S = PERIOD_S * PERIODS

#: Fixed values of the court in millimetres.
COURT_LENGTH, COURT_WIDTH, BASKET_X, RIM_RADIUS = 28000.0, 15000.0, 1575.0, 1250.0
KEY_HALF_WIDTH, KEY_LENGTH, CORNER_LENGTH = 2450.0, 5800.0, 2990.0


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null unless b is above zero."""
    return F.when(b > 0, a / b)


def period_length(q: Column) -> Column:
    return F.when(q <= PERIODS, F.lit(PERIOD_S)).otherwise(F.lit(OVERTIME_S))


def period_end(q: Column) -> Column:
    """Elapsed seconds at the end of period q."""
    return F.when(q <= PERIODS, q * PERIOD_S).otherwise(REGULATION_S + (q - PERIODS) * OVERTIME_S)


def elapsed(q: Column, left_ms: Column) -> Column:
    """Elapsed seconds from the period and the milliseconds left in it."""
    return (period_end(q) - left_ms / 1000.0).cast("double")


def clock_of(seconds: Column) -> tuple[Column, Column]:
    """(quarter, 'm:ss' left) of elapsed seconds of regulation; a period's end is the next one's start."""
    q = F.floor(seconds / PERIOD_S) + 1
    left = (q * PERIOD_S - seconds).cast("int")
    return q.cast("int"), F.format_string("%d:%02d", F.floor(left / 60).cast("int"), left % 60)


def clock_seconds(text: Column) -> Column:
    """Seconds of 'mm:ss'; anything else is 0."""
    m, s = (F.regexp_extract(text, r"^([0-9]{1,2}):([0-9]{2})$", k).try_cast("int") for k in (1, 2))
    return F.coalesce(m * 60 + s, F.lit(0))


def shot_distance(x: Column, y: Column, left_basket: Column) -> Column:
    """Metres from the basket."""
    bx = F.when(left_basket, F.lit(BASKET_X)).otherwise(F.lit(COURT_LENGTH - BASKET_X))
    return F.hypot(x - bx, y - F.lit(COURT_WIDTH / 2)) / 1000.0


def shot_zone(three: Column, x: Column, y: Column, left_basket: Column) -> Column:
    """rim, paint, mid, c3 or ab3; null without coordinates."""
    along = F.when(left_basket, x).otherwise(F.lit(COURT_LENGTH) - x)
    off = F.abs(y - F.lit(COURT_WIDTH / 2))
    d = shot_distance(x, y, left_basket) * 1000.0
    return F.when(x.isNull() | y.isNull() | left_basket.isNull(), F.lit(None).cast("string")).when(
        three, F.when(along <= CORNER_LENGTH, "c3").otherwise("ab3")
    ).when(d <= RIM_RADIUS, "rim").when((along <= KEY_LENGTH) & (off <= KEY_HALF_WIDTH), "paint").otherwise("mid")


def mapped(key: Column, table: dict[str, str]) -> Column:
    """The table's value; null for other keys."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)


def multi_hot(text: Column, separator: str, values: list[str]) -> dict[str, Column]:
    """One 0/1 column for each value among the separated parts."""
    parts = F.split(text, separator)
    return {v: F.array_contains(parts, v).cast("int") for v in values}


def possessions(fga: Column, oreb: Column, tov: Column, fta: Column) -> Column:
    """Estimated possessions."""
    return fga - oreb + tov + F.lit(0.44) * fta


def short_name(name: Column) -> Column:
    """The last word that isn't a generational suffix."""
    words = F.filter(F.split(F.trim(name), r"\s+"), lambda w: ~F.upper(F.regexp_replace(w, r"\.", "")).isin("JR", "SR", "II", "III", "IV"))
    return F.when(F.size(words) > 0, F.element_at(words, -1))


def total_of(*columns: Column) -> Column:
    """Row-wise sum that skips nulls."""
    out = F.lit(0)
    for c in columns:
        out = out + F.coalesce(c, F.lit(0))
    return out


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def display_clock(quarter: Column, clock: Column) -> Column:
    """'Q2 03:15'; a clock without digits shows the period's end."""
    return F.concat(F.lit("Q"), quarter.cast("string"), F.lit(" "), F.when(clock == "--:--", F.lit("00:00(end)")).otherwise(clock))


def clipped(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """c held between bounds; null stays null."""
    out = c if low is None else F.greatest(c, F.lit(low))
    out = out if high is None else F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def mean_ordinal(text: Column, separator: str, values: list[str]) -> Column:
    """The mean place, from 1, of the separated parts that are among values; null if none is."""
    places = F.filter(F.transform(F.split(text, separator), lambda p: F.array_position(F.array(*map(F.lit, values)), p)), lambda x: x > 0)
    return F.when(F.size(places) > 0, F.aggregate(places, F.lit(0).cast("long"), lambda a, x: a + x) / F.size(places))


def season_date(text: Column, first_month: int = 10, first_year: int = 2025) -> Column:
    """'yy/mm/dd' of the first 'm/d(x)' in a text, the year by a season that begins in first_month; else 'Unknown'."""
    month, day = (F.regexp_extract(text, r"(\d{1,2})/(\d{1,2})\s*[（(].[）)]", k) for k in (1, 2))
    year = F.when(month.try_cast("int") >= first_month, first_year % 100).otherwise(first_year % 100 + 1)
    return F.when(month == "", "Unknown").otherwise(F.concat_ws("/", F.lpad(year.cast("string"), 2, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")))


def appeared(flag: Column, minutes: Column) -> Column:
    """On the sheet as playing, with minutes above zero; missing minutes are none."""
    return F.coalesce(flag, F.lit(False)) & (F.coalesce(minutes, F.lit(0)) > 0)
