"""Operators whose edge cases no table shows, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineflux.functions import exprs as X
from lineflux.operators import graph, intervals, joins, ml, stats
from lineflux.operators import text as T
from lineflux.sources import landing

C = F.col


@pytest.mark.parametrize("seed", range(3))
def test_two_sided_stints_equal_a_sequential_reading(spark, seed):
    rng = random.Random(seed)
    rows, pos = [], 0
    for q in (1, 2, 5):
        for _ in range(60):
            pos += 1
            side = rng.choice(["home", "away"])
            rows.append((7, q, side, f"{side[0]}{rng.randrange(4)}", rng.choice(["in", "out", "shot", "shot"]), pos, float(pos * 10)))
    begin = lambda q: (q - 1) * 720.0 if q <= 4 else 2880.0 + (q - 5) * 300
    end = lambda q: q * 720.0 if q <= 4 else 2880.0 + (q - 4) * 300
    want, no = [], 0
    for q in (1, 2, 5):
        on, cur, dirty, at = {"home": set(), "away": set()}, None, True, begin(q)
        for _, qq, side, who, what, _, t in rows:
            if qq != q:
                continue
            if what != "shot":
                (on[side].add if what == "in" else on[side].discard)(who)
                dirty, at = True, t
                continue
            if dirty:
                line = (sorted(on["home"]), sorted(on["away"]))
                if cur is None or line != cur[3]:
                    start = begin(q) if cur is None else at
                    if cur is not None:
                        want.append((*cur[:2], start, cur[3]))
                    no += 1
                    cur = (q, start, no, line)
                dirty = False
        if cur is not None:
            want.append((*cur[:2], end(q), cur[3]))
    log = spark.createDataFrame(rows, "g long, q int, side string, who string, what string, pos long, t double").repartition(3)
    period = C("q")
    base = F.when(period <= 4, (period - 1) * 720.0).otherwise(2880.0 + (period - 5) * 300)
    got = intervals.two_sided_stints(log, "g", "q", "side", "who", C("what") != "shot", C("what") == "in", "pos", "t", base, X.period_end(period).cast("double"))
    got = intervals.valid_stints(got, "stint_id", 2, spark.createDataFrame([(f"{s}{k}",) for s in "ha" for k in range(3)], "who string"), "who").orderBy("stint_no").collect()
    assert [(r.q, r.start, r.end, (r.home, r.away)) for r in got] == want
    assert [r.stint_id for r in got] == [f"7_{k + 1:03d}" for k in range(len(want))]
    known = {f"{s}{k}" for s in "ha" for k in range(3)}
    assert [r.valid for r in got] == [len(h) == len(a) == 2 and e > s and set(h) | set(a) <= known for _, s, e, (h, a) in want]


def test_pairs_of_a_large_group_are_whole(spark, monkeypatch):
    monkeypatch.setattr(joins, "PAIR_BLOCK", 5)
    m = spark.createDataFrame([(1, i, 2.5) for i in range(23)] + [(2, 5, 1.0), (2, 6, 1.0), (2, 6, 1.0), (3, 9, 1.0)], "g int, m int, w double")
    got = {(r.a, r.b): (r.shared, r.weight) for r in graph.co_membership(m, ["g"], "m", weight="w").collect()}
    assert len(got) == 23 * 22 // 2 and got[5, 6] == (2, 3.5) and got[0, 22] == (1, 2.5)
    assert joins.pairs_within(m, ["g"], "m", directed=True).count() == 23 * 22 + 2


@pytest.mark.parametrize("most", [1, 40, 100_000])
def test_greedy_by_order_and_by_rounds(spark, monkeypatch, most):
    monkeypatch.setattr(joins, "SEQUENTIAL", most)
    rng = random.Random(5)
    rows = sorted({(g, rng.randrange(30), rng.randrange(30)) for g in (1, 2) for _ in range(120)})
    rows = [(g, a, b, abs(a - b)) for g, a, b in rows]
    want = set()
    for g in (1, 2):
        ua, ub = set(), set()
        for _, a, b, c in sorted((r for r in rows if r[0] == g), key=lambda r: (r[3], r[1], r[2])):
            if a not in ua and b not in ub:
                ua.add(a), ub.add(b), want.add((g, a, b, c))
    got = joins.greedy_match(spark.createDataFrame(rows, "g int, a int, b int, cost int"), ["g"], "a", "b", "cost").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_numbers_in_order_without_one_task(spark):
    rows = [(random.Random(i).random(), i) for i in range(500)]
    got = joins.numbered(spark.createDataFrame(rows, "x double, i int").repartition(5), [C("x")]).collect()
    assert [r.i for r in sorted(got, key=lambda r: r.nr)] == [i for _, i in sorted(rows)] and {r.nr for r in got} == set(range(1, 501))


def test_missing_keys_and_broken_rules_are_errors(spark):
    rows, values = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, 5)], "k int, v int")
    assert {(r.k, r.v) for r in joins.looked_up(rows, values, ["k"], "v", F.lit(0)).collect()} == {(1, 5), (2, 0)}
    with pytest.raises(Exception, match="no value for"):
        joins.looked_up(rows, values, ["k"], "v").collect()
    assert stats.asserted(rows, {"small": C("k") < 3}, fail=True).count() == 1
    with pytest.raises(Exception, match="broken: small"):
        stats.asserted(rows, {"small": C("k") < 2}, fail=True).collect()
    assert [tuple(r) for r in stats.asserted(rows.where("k > 9"), {"small": C("k") < 2}).collect()] == [("small", 0, True)]


def test_left_text_before_its_clock(spark):
    page = "shot made\n+2\n01:19\n4 - 2\nfoul\n02:00\n2 - 2\nmiss"
    docs = spark.createDataFrame([(1, page)], "d int, text string")
    plain = {(r.body, r.elapsed_s) for r in T.parse_log(docs, "d", "text").collect()}
    assert plain == {("foul", 641), ("miss", 600)}
    first = {(r.body, r.elapsed_s, r.points) for r in T.parse_log(docs, "d", "text", left_first=True).collect()}
    assert ("shot made", 641, 2) in first and ("miss", 600, 0) in first


def test_translation_order_and_lines(spark):
    text = spark.createDataFrame([("ab abc x\nabc",)], "t string")
    got = text.select(T.by_line(C("t"), lambda l: T.translated(l, {"x": "y"}, {"ab": "1", "abc": "2"}, {"^a": "a"}, " ")).alias("t")).head().t
    assert got == "1 2 y\n2"


def test_dates_clocks_and_ordinals(spark):
    r = spark.createDataFrame([("on 10/5 (一)",), ("at 3/12（五）",), ("none",)], "t string").select(X.season_date(C("t")).alias("d")).collect()
    assert [x.d for x in r] == ["25/10/05", "26/03/12", "Unknown"]
    r = spark.range(1).select(X.display_clock(F.lit(4), F.lit("--:--")).alias("a"), X.display_clock(F.lit(1), F.lit("03:15")).alias("b"), X.clipped(F.lit(None).cast("double"), 0, 1).alias("c"), X.mean_ordinal(F.lit("CAndG"), "And", ["G", "F", "C"]).alias("m"), X.mean_ordinal(F.lit("Z"), "And", ["G"]).alias("z")).head()
    assert tuple(r) == ("Q4 00:00(end)", "Q1 03:15", None, 2.0, None)


def test_captures_back_off(spark):
    rows = [("a", 1, 200, "x"), ("a", 2, 500, "y"), ("a", 3, 200, ""), ("b", 1, 429, None), ("c", 1, 500, "z"), ("c", 2, 200, "w")]
    got = {r.k: (r.body, r.attempts, r.failures, r.wait_s) for r in landing.captures(spark.createDataFrame(rows, "k string, n int, status int, body string"), ["k"], "n", "status", "body").collect()}
    assert got == {"a": ("x", 3, 2, 2.0), "b": (None, 1, 1, 1.0), "c": ("w", 2, 0, 0.0)}


def test_effect_model_equals_plain_algebra(spark):
    rng = np.random.default_rng(2)
    n = 400
    g, p, c, w = rng.integers(0, 25, n), rng.integers(0, 2, n).astype(float), rng.normal(size=n), rng.uniform(0.5, 2, n)
    y = 3 * p - 2 * c + rng.normal(size=n)
    df = spark.createDataFrame([(int(a), float(b), float(d), float(e), float(f)) for a, b, d, e, f in zip(g, p, c, w, y)], "g int, p double, c double, w double, y double")

    def plain(rows, alpha):
        x = np.stack([100 * p[rows], c[rows] - np.average(c[rows], weights=w[rows])], 1)
        b = np.linalg.solve((x * w[rows, None]).T @ x + alpha * np.eye(2), (x * w[rows, None]).T @ y[rows])
        return b * [100, 1], np.average(c[rows], weights=w[rows])

    got = ml.centred_ridge(df, "y", ["p", "c"], "w", 5.0, ["p"])
    assert [got["p"], got["c"]] == pytest.approx(plain(np.arange(n), 5.0)[0].tolist())
    df = df.withColumn("fold", C("g") % 5)
    for alpha, error in ml.fold_errors(df, "fold", "y", ["p", "c"], "w", [0.1, 500.0], ["p"]).items():
        errors = []
        for k in range(5):
            b, m = plain(np.flatnonzero(g % 5 != k), alpha)
            at = np.flatnonzero(g % 5 == k)
            errors.append(np.average((y[at] - b[0] * p[at] - b[1] * (c[at] - m)) ** 2, weights=w[at]))
        assert error == pytest.approx(np.mean(errors))
    out = ml.ridge_effects(df.withColumn("q", F.lit(1.0) - C("p")), "g", "y", ["p", "q", "c"], "w", ["p", "q"], [0.1, 10.0], 5, 60)
    (name, value, low, high), _ = out["effects"]
    assert name == "p" and low < value < high and abs(value - 3) < 0.5
    assert out["differences"][0][2] == pytest.approx(out["effects"][0][1] - out["effects"][1][1]) and out["differences"][0][5] > 0.95


def test_effects_read_the_rows_once(spark):
    from pyspark.sql.types import DoubleType

    rng = np.random.default_rng(3)
    read = spark.sparkContext.accumulator(0)

    def seen(x):
        read.add(1)
        return x

    rows = [(int(g) if g else None, float(p), float(c), 1.0 + float(c)) for g, p, c in zip(rng.integers(0, 12, 240), rng.integers(0, 2, 240), rng.integers(0, 4, 240))]
    df = spark.createDataFrame(rows, "g int, p double, c double, w double").withColumn("q", 1.0 - C("p")).withColumn("y", F.udf(seen, DoubleType()).asNondeterministic()(2 * C("p") - C("c")))
    args = (["p", "q", "c"], "w")
    out = ml.ridge_effects(df, "g", "y", *args, ["p", "q"], [0.1, 10.0], 4, 20)
    assert read.value == len(rows)
    alpha, errors = ml.ridge_by_group(df, "g", "y", *args, [0.1, 10.0], 4, ["p", "q"])
    assert out["alpha"] == alpha and out["errors"] == pytest.approx(errors)
    assert [e[1] for e in out["effects"]] == pytest.approx([ml.centred_ridge(df, "y", *args, alpha, ["p", "q"])[n] for n in "pq"])


def test_contrasts_count_by_order(spark):
    rows = [(1, 1, 10.0), (1, 2, 10.0), (2, 1, 4.0), (3, 2, 6.0), (3, 3, 6.0)]
    got = {r.mate: r for r in stats.contrasts(spark.createDataFrame(rows, "g int, m int, v double"), "g", "m", "v", 1).collect()}
    assert set(got) == {2} and (got[2].with_mean, got[2].focus_without_mean, got[2].mate_without_mean, got[2].focus_diff, got[2].mate_diff) == (10.0, 4.0, 6.0, 6.0, 4.0)


def test_pairs_take_more_tasks_as_they_grow(spark, monkeypatch):
    monkeypatch.setattr(joins, "PAIR_BLOCK", 7)
    monkeypatch.setattr(joins, "TASK_PAIRS", 50)
    rng = random.Random(1)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([None, *range(40)])) for _ in range(300)] + [(5, 1), (5, 2)]
    m = spark.createDataFrame(rows, "g int, x int").withColumn("w", C("g") * 2)
    sets = {g: {x for h, x in rows if h == g and x is not None} for g in (1, 2, 3, 5)}
    want = {(g, a, b) for g, s in sets.items() for a in s for b in s if a != b}
    assert sorted(tuple(r) for r in joins.pairs_within(m, ["g"], "x", directed=True).collect()) == sorted(want)
    shared = {}
    for g, a, b in want:
        n, w = shared.get((a, b), (0, 0))
        shared[a, b] = n + 1, w + 2 * g
    got = graph.co_membership(m, ["g"], "x", "w", directed=True)
    assert {(r.a, r.b): (r.shared, r.weight) for r in got.collect()} == shared
    assert joins.pair_tasks(m, ["g"]) > 20
    spread = graph.co_membership(m, ["g"], "x", "w").groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) > 20  # the counts of pairs too, not only the pairs


def test_totals_and_negatives_take_the_edges_tasks(spark):
    from pathlib import Path

    from lineflux.plans import graphs

    d = "/root/testdata/sf0.001"
    if not Path(d).is_dir():
        pytest.skip("no test tables")
    assert graphs.totals(spark, d, 9).select(F.spark_partition_id()).distinct().count() > 4
    nodes = spark.createDataFrame([(1, i) for i in range(20)], "g int, n int")
    edges = spark.createDataFrame([(0, 1, 5)], "a int, b int, shared int")
    got = graph.sparse_negatives(nodes, edges, "g", "n", 4, 9)
    assert got.count() == 189 and got.select(F.spark_partition_id()).distinct().count() > 4
