"""Scans in parts, islands, percentiles, resamples and folds against plain windows and loops; hot keys spread over the parts."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lineflux.operators import joins, ml, scans

C = F.col


def rows(n=3000, seed=0):
    """Half of all rows have one key; ties in time, nulls in everything but the number."""
    rng = random.Random(seed)
    return [(rng.choice([1, 1, 1, 2, 3, None]), rng.randrange(400), i, rng.choice([None, *range(20)])) for i in range(n)]


@pytest.mark.parametrize("before", [False, True])
def test_scans_equal_windows(spark, before):
    df = spark.createDataFrame(rows(), "k int, t int, i int, v int").repartition(5)
    w = Window.partitionBy("k").orderBy("t", "i").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    want = df.withColumns({"s": F.sum("v").over(w), "l": F.last("v", True).over(w), "h": F.max("v").over(w)})
    got = scans.scanned(df, ["k"], ["t", "i"], sums={"s": C("v")}, lasts={"l": C("v")}, highs={"h": C("v")}, before=before, parts=13)
    assert got.columns == want.columns and sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_a_hot_key_fills_many_parts(spark):
    df = spark.createDataFrame([(1, i) for i in range(20_000)], "k int, t int")
    held = scans.dealt(df, ["k"], ["t"], 16).groupBy("_part").count().collect()
    assert len(held) >= 14 and max(r["count"] for r in held) < 4000


def test_asof_in_parts_equals_one_window(spark):
    rng = random.Random(3)
    left = spark.createDataFrame([(rng.choice([1, 1, 2]), rng.randrange(300), i) for i in range(800)], "k int, t int, id int")
    right = spark.createDataFrame([(rng.choice([1, 1, 3]), rng.randrange(300), i, i * 2) for i in range(500)], "k int, t int, o int, v int")
    args = (left, right, ["k"], "t", ["o"], ["v"])
    assert sorted(scans.asof(*args, parts=9).collect(), key=str) == sorted(joins.asof(*args).collect(), key=str)


def test_islands_join_touching_spans(spark):
    rng = random.Random(5)
    data = [(rng.choice("ab"), a := rng.randrange(3000), a + rng.randrange(5), i) for i in range(700)]
    got = {r.i: (r.g, r.island) for r in scans.islands(spark.createDataFrame(data, "g string, a int, b int, i int"), ["g"], "a", "b", ["i"], parts=7).collect()}
    for g in "ab":
        no, reach = 0, -1
        for _, a, b, i in sorted((x for x in data if x[0] == g), key=lambda x: x[1:]):
            no += a > reach
            reach = max(reach, b)
            assert got[i] == (g, no)


def plain_greedy(data):
    used_a, used_b, out = set(), set(), []
    for g, a, b, c in sorted(data, key=lambda x: (x[3], x[1], x[2])):
        if (g, a) not in used_a and (g, b) not in used_b:
            used_a.add((g, a))
            used_b.add((g, b))
            out.append((g, a, b, c))
    return sorted(out)


def test_greedy_by_islands_equals_a_plain_loop(spark):
    rng = random.Random(7)
    data = sorted({(g, a := rng.randrange(4000), b := max(0, a + rng.randint(-3, 3)), abs(a - b)) for g in (1, 1, 1, 2) for _ in range(1500)})
    got = scans.greedy_match(spark.createDataFrame(data, "g int, a int, b int, c int"), ["g"], "a", "b", "c", parts=8).collect()
    assert sorted(map(tuple, got)) == plain_greedy(data)


def test_a_group_of_a_million_candidates(spark):
    # chains of four positions with falling costs, far from each other
    k = C("id")
    one = spark.range(250_000).select(F.lit(1).alias("g"), F.explode(F.array(*(F.struct((k * 10 + a).alias("a"), (k * 10 + b).alias("b"), F.lit(c).alias("c")) for a, b, c in ((0, 1, 9), (2, 1, 8), (2, 3, 7), (4, 3, 6))))).alias("x")).select("g", "x.*")
    got = scans.greedy_match(one, ["g"], "a", "b", "c", parts=16)
    r = got.agg(F.count("*").alias("n"), F.sum("c").alias("c"), F.min(C("b") - C("a")).alias("d")).first()
    assert (r.n, r.c, r.d) == (500_000, 250_000 * 14, -1)


def test_percentiles_equal_numpy(spark):
    data = [(k, None if v is None else v * 1.5) for k, _, _, v in rows(2000, 1)] + [(9, 4.0), (8, None)]
    shares = [0.0, 0.025, 0.5, 0.9, 1.0]
    got = {(r.k, r.share): r.v for r in scans.percentiles(spark.createDataFrame(data, "k int, v double"), ["k"], "v", shares, parts=11).collect()}
    want = {(k, s): float(np.quantile([v for x, v in data if x == k and v is not None], s)) for k in (1, 2, 3, 9, None) for s in shares}
    assert got == pytest.approx(want)


def plain_folds(sizes, folds):
    load, out = [0] * folds, {}
    for g, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        f = load.index(min(load))
        load[f] += n
        out[g] = f
    return out


def test_dealing_equals_a_plain_loop_at_any_size():
    rng = random.Random(2)
    for trial in range(300):
        sizes = {i: rng.choice([1, 1, 2, 3, 7, rng.randint(1, 60)]) for i in range(rng.randint(1, 400))}
        folds = rng.randint(1, 7)
        histogram = [(s, sum(n == s for n in sizes.values())) for s in set(sizes.values())]
        got, order = {}, sorted(sizes.items(), key=lambda x: (-x[1], x[0]))
        for size, first, steps, cycle in ml.dealing(histogram, folds):
            for k, (g, _) in enumerate(x for x in order if x[1] == size):
                got[g] = steps[k] if k < len(steps) else cycle[(k - len(steps)) % folds]
            assert first == sum(n > size for n in sizes.values())
        assert got == plain_folds(sizes, folds), trial


def test_folds_of_a_hundred_thousand_groups(spark):
    groups = spark.range(100_000).select(C("id").alias("g"), F.explode(F.sequence(F.lit(0), (C("id") * 7919) % 5)).alias("x"))
    got = {r.g: r._fold for r in ml.group_folds(groups, "g", 5).collect()}
    assert got == plain_folds({g: g * 7919 % 5 + 1 for g in range(100_000)}, 5)


def test_resamples_equal_a_plain_loop(spark):
    rng = random.Random(8)
    data = [(rng.choice("xy"), rng.choice([None, *range(60)]), rng.random(), rng.random() + 1) for _ in range(900)]
    df = spark.createDataFrame(data, "side string, g int, n double, d double").repartition(4)
    got = ml.resampled(df, "g", {"n": C("n"), "d": C("d")}, {"ratio": lambda s: s["n"] / s["d"], "gap": lambda s: s["n"] - s["d"]}, 300, ["side"]).collect()
    assert len(got) == 4
    groups = sorted({str(g) if g is not None else "null" for _, g, _, _ in data})
    steps = ml.poisson_steps()
    for r in got:
        sums = {g: [sum(x[j] for x in data if x[0] == r.side and (str(x[1]) if x[1] is not None else "null") == g) for j in (2, 3)] for g in groups}
        f = (lambda n, d: n / d) if r.statistic == "ratio" else (lambda n, d: n - d)
        values = []
        for k in range(1, 301):
            a, b = ml.drawn(f"a{k}") + 1, ml.drawn(f"b{k}")
            times = {g: sum(((ml.drawn(g) * a + b) % ml.PRIME + 0.5) / ml.PRIME > c for c in steps) for g in groups}
            values.append(f(*(sum(times[g] * s[j] for g, s in sums.items()) for j in (0, 1))))
        assert r.value == pytest.approx(f(*(sum(s[j] for s in sums.values()) for j in (0, 1))))
        assert (r.low, r.high) == pytest.approx(tuple(np.quantile(values, [0.025, 0.975])))
        assert r.low < r.value < r.high
