"""Aggregates: counters, ratios of sums, shrinkage, contrasts, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import safe_div


def counters(df: DataFrame, keys: list[str], tests: dict[str, Column], weights: dict[str, Column] | None = None) -> DataFrame:
    """One pass: the number of rows that pass each test and sums of weights."""
    counted = [F.sum(F.when(t, 1).otherwise(0)).cast("long").alias(n) for n, t in tests.items()]
    summed = [F.coalesce(F.sum(w), F.lit(0.0)).alias(n) for n, w in (weights or {}).items()]
    return df.groupBy(*keys).agg(*counted, *summed)


def play_tests(kind: Column, outcome: Column, made: Column, assisted: Column, zone: Column, action: Column, zones: list[str], actions: list[str]) -> dict[str, Column]:
    """The counters of a play log by name: field goals by worth, made, assisted or not, by zone and by action; free throws, rebounds, assists,
    steals, blocks, turnovers and fouls. A condition that is null counts nothing."""
    shot, two = kind.isin("TwoPointer", "ThreePointer"), kind == "TwoPointer"
    of = {"FGA": shot, "2PA": two, "3PA": shot & ~two, "FGM": shot & made, "2PM": two & made, "3PM": shot & ~two & made, "FGM_assisted": shot & made & assisted, "FGM_unassisted": shot & made & ~assisted}
    for z in zones:
        of |= {f"{z}_FGA": shot & (zone == z), f"{z}_FGM": shot & made & (zone == z)}
    of |= {f"act_{a}_FGA": shot & (action == a) for a in actions}
    of |= {"FTA": kind == "FreeThrow", "FTM": (kind == "FreeThrow") & made, "OREB": (kind == "Rebound") & (outcome == "Offensive"), "DREB": (kind == "Rebound") & F.coalesce(outcome != "Offensive", F.lit(True))}
    return of | {n: kind == k for n, k in {"AST": "Assist", "STL": "Steal", "BLK": "Block", "TOV": "Turnover", "PF": "RosterFoul"}.items()}


def play_counters(log: DataFrame, keys: list[str], team: str, player: str, tests: dict[str, Column], points: Column) -> DataFrame:
    """(keys, team, player, counters, PTS, possessions): a row for each player, and one with a null player for each team, which also counts plays
    of no player. One pass: players first, and teams are sums of them; possessions are FGA - OREB + TOV + 0.44 FTA."""
    one = counters(log, [*keys, team, player], tests, {"PTS": points})
    names = [*tests, "PTS"]
    teams = one.groupBy(*keys, team).agg(*(F.sum(n).alias(n) for n in names)).select(*keys, team, F.lit(None).cast(one.schema[player].dataType).alias(player), *names)
    out = one.where(F.col(player).isNotNull()).unionByName(teams)
    return out.withColumn("possessions", F.col("FGA") - F.col("OREB") + F.col("TOV") + 0.44 * F.col("FTA"))


def shrunk(n: Column, d: Column, prior: Column, k: float) -> Column:
    """Empirical Bayes: k pseudo-trials at the prior."""
    return (n + k * prior) / (F.greatest(d, F.lit(0)) + k)


def with_prior(df: DataFrame, n: str, d: str, name: str, pool: Column | None = None) -> DataFrame:
    """df with the pooled ratio of sums (over rows in `pool`, default all). One row is broadcast."""
    keep = pool if pool is not None else F.lit(True)
    prior = df.agg(safe_div(F.sum(F.when(keep, F.col(n))), F.sum(F.when(keep, F.col(d)))).alias(name))
    return df.crossJoin(F.broadcast(prior))


def on_off(df: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """Per key the sums on, and off = total - on."""
    on = df.groupBy(key).agg(*(F.sum(m).alias(f"on_{m}") for m in measures))
    total = df.agg(*(F.sum(m).alias(f"all_{m}") for m in measures))
    out = on.crossJoin(F.broadcast(total))
    return out.select(key, *(F.col(f"on_{m}") for m in measures), *((F.col(f"all_{m}") - F.col(f"on_{m}")).alias(f"off_{m}") for m in measures))


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """Full outer comparison of two totals, missing as 0."""
    j = a.select(*keys, F.col(left).alias("left_value")).join(b.select(*keys, F.col(right).alias("right_value")), keys, "full_outer")
    j = j.withColumn("left_value", F.coalesce("left_value", F.lit(0.0))).withColumn("right_value", F.coalesce("right_value", F.lit(0.0)))
    return j.withColumn("diff", F.col("left_value") - F.col("right_value"))


def argmax(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """The value of most weight by key; ties go to the larger value."""
    return df.groupBy(*keys).agg(F.max(F.struct(weight, value)).alias("_m")).select(*keys, F.col(f"_m.{value}").alias(value), F.col(f"_m.{weight}").alias(weight))


def overlap(shared: Column, a: Column, b: Column) -> Column:
    return safe_div(shared, F.least(a, b))


def jaccard(shared: Column, a: Column, b: Column) -> Column:
    return safe_div(shared, a + b - shared)


def asserted(df: DataFrame, checks: dict[str, Column], fail: bool = False) -> DataFrame:
    """(check, n_bad, ok): rows that break each rule; a rule that is null is broken. With fail, a broken rule is an error."""
    bad = df.agg(*(F.sum(F.when(F.coalesce(c, F.lit(False)), 0).otherwise(1)).alias(n) for n, c in checks.items()))
    rows = bad.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.coalesce(F.col(n), F.lit(0)).cast("long").alias("n_bad")) for n in checks))).alias("r")).select("r.*")
    rows = rows.withColumn("ok", F.col("n_bad") == 0)
    return rows.where(F.assert_true(F.col("ok"), F.concat(F.lit("broken: "), F.col("check"))).isNull()) if fail else rows


def without_nulls(df: DataFrame, column: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows whose column is known, and by key how many were kept and dropped."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    known = F.col(column).isNotNull()
    return df.where(known), df.groupBy(*keys).agg(n(known).alias("kept"), n(~known).alias("dropped"))


def reconciled_summary(compared: DataFrame, within: list[float]) -> DataFrame:
    """One row of reconcile()'s rows: their number, how many differ by each bound at most, and the largest difference."""
    d = F.abs("diff")
    return compared.agg(F.count("*").alias("n"), *(F.sum((d <= w).cast("int")).cast("long").alias(f"within_{w:g}") for w in within), F.max(d).alias("max_diff"))


def contrasts(groups: DataFrame, group: str, member: str, value: str, focus, other: str = "mate") -> DataFrame:
    """For every mate of the focus, in both directions: mean value of the focus's groups with and without the mate, and of the mate's groups
    with and without the focus. Without is the total less with, so nothing is paired but the focus's own groups. Null where there is none."""
    own = groups.where(F.col(member) == focus).select(group, F.col(value).alias("_v"))
    total = own.agg(F.count("*").alias("n"), F.sum("_v").alias("v"))
    mates = groups.where(F.col(member) != focus)
    alone = mates.groupBy(F.col(member).alias(other)).agg(F.count("*").alias("mate_n"), F.sum(value).alias("mate_v"))
    both = own.join(mates.select(group, F.col(member).alias(other)), group).groupBy(other).agg(F.count("*").alias("with_n"), F.sum("_v").alias("with_v"))
    mean = lambda v, n: safe_div(v.cast("double"), n)
    c = F.col
    out = both.join(alone, other).crossJoin(F.broadcast(total))  # one row
    out = out.select(other, "with_n", (c("n") - c("with_n")).alias("focus_without_n"), (c("mate_n") - c("with_n")).alias("mate_without_n"), mean(c("with_v"), c("with_n")).alias("with_mean"),
                     mean(c("v") - c("with_v"), c("n") - c("with_n")).alias("focus_without_mean"), mean(c("mate_v") - c("with_v"), c("mate_n") - c("with_n")).alias("mate_without_mean"))
    return out.withColumn("focus_diff", c("with_mean") - c("focus_without_mean")).withColumn("mate_diff", c("with_mean") - c("mate_without_mean"))


def contrast_measures(groups: DataFrame, group: str, member: str, values: list[str], focus, other: str = "mate") -> DataFrame:
    """contrasts() of any number of measures in one pass: with_n, focus_without_n, mate_without_n, and of each measure its mean with, the focus's
    and the mate's without, and both differences (columns {measure}_with, _focus_without, _mate_without, _focus_diff, _mate_diff)."""
    c, own = F.col, groups.where(F.col(member) == focus).select(group, *values)
    total = own.agg(F.count("*").alias("_n"), *(F.sum(v).alias(f"_t_{v}") for v in values))
    mates = groups.where(F.col(member) != focus)
    alone = mates.groupBy(F.col(member).alias(other)).agg(F.count("*").alias("_m"), *(F.sum(v).alias(f"_m_{v}") for v in values))
    both = own.join(mates.select(group, F.col(member).alias(other)), group).groupBy(other).agg(F.count("*").alias("with_n"), *(F.sum(v).alias(f"_w_{v}") for v in values))
    out = both.join(alone, other).crossJoin(F.broadcast(total))  # one row
    n = {"with": c("with_n"), "focus_without": c("_n") - c("with_n"), "mate_without": c("_m") - c("with_n")}
    means = {}
    for v in values:
        w = c(f"_w_{v}")
        for name, x in (("with", w), ("focus_without", c(f"_t_{v}") - w), ("mate_without", c(f"_m_{v}") - w)):
            means[f"{v}_{name}"] = safe_div(x.cast("double"), n[name])
    out = out.select(other, *(x.alias(f"{k}_n") for k, x in n.items()), *(x.alias(k) for k, x in means.items()))
    return out.withColumns({f"{v}_{side}_diff": c(f"{v}_with") - c(f"{v}_{side}_without") for v in values for side in ("focus", "mate")})


def per_unit(totals: DataFrame, minutes: str, counters: list[str], rates: dict[str, tuple[str, str]], span: float = 36.0) -> DataFrame:
    """totals with each counter per `span` minutes and rates in percent (0 without attempts); rows without minutes are left out."""
    t = totals.where(F.col(minutes) > 0)
    per = {f"{k}_per": F.round(F.col(k) / F.col(minutes) * span, 2) for k in counters}
    pct = {n: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b) * 100, 1)).otherwise(F.lit(0.0)) for n, (a, b) in rates.items()}
    return t.withColumns(per | pct)
