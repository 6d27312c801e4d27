"""Small fixtures for the traps of the engine's own operators."""

import random

import pytest
from pyspark.sql import functions as F

from lineflux.functions import exprs as X
from lineflux.functions import windows as Wn
from lineflux.operators import graph, intervals, joins, ml, stats, text


def test_clock(spark):
    df = spark.createDataFrame([(1, 720_000), (4, 0), (5, 300_000), (6, 0)], "q int, ms long")
    assert [r[0] for r in df.select(X.elapsed(F.col("q"), F.col("ms"))).collect()] == [0.0, 2880.0, 2880.0, 3480.0]
    back = spark.createDataFrame([(0.0,), (720.0,), (755.0,)], "e double").select(*X.clock_of(F.col("e"))).collect()
    assert [tuple(r) for r in back] == [(1, "12:00"), (2, "12:00"), (2, "11:25")]
    text_ = spark.createDataFrame([("01:19",), ("--:--",), (None,)], "t string").select(X.clock_seconds(F.col("t"))).collect()
    assert [r[0] for r in text_] == [79, 0, 0]


def test_rounding_and_division(spark):
    r = spark.range(1).select(X.half_even(F.lit(2.5), 0), X.half_even(F.lit(0.125), 2), X.safe_div(F.lit(1.0), F.lit(0.0)), X.safe_div(F.lit(1.0), F.lit(None).cast("double"))).head()
    assert tuple(r) == (2.0, 0.12, None, None)


def test_short_name(spark):
    df = spark.createDataFrame([("Ann B. Lee Jr.",), ("Roe III",), ("",)], "n string")
    assert [r[0] for r in df.select(X.short_name(F.col("n"))).collect()] == ["Lee", "Roe", ""]


def test_fill(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, 5.0), (1, 3, None), (2, 1, None)], "k int, o int, v double")
    got = df.select("k", "o", Wn.filled(F.col("v"), ["k"], ["o"], F.lit(720.0)).alias("f")).orderBy("k", "o").collect()
    assert [r.f for r in got] == [5.0, 5.0, 5.0, 720.0]


def test_asof_includes_equal_times_and_takes_the_last(spark):
    left = spark.createDataFrame([(1, 10, "a"), (1, 4, "b")], "k int, t int, name string")
    right = spark.createDataFrame([(1, 10, 1, 7), (1, 10, 2, 8), (1, 11, 3, 9)], "k int, t int, o int, v int")
    got = {r.name: r.v for r in joins.asof(left, right, ["k"], "t", ["o"], ["v"]).collect()}
    assert got == {"a": 8, "b": None}


def test_interval_ends_count_twice(spark):
    points = spark.createDataFrame([(1, 10)], "k int, t int")
    spans = spark.createDataFrame([(1, 0, 10, "x"), (1, 10, 20, "y"), (1, 11, 20, "z")], "k int, s int, e int, n string")
    assert sorted(r.n for r in joins.within_intervals(points, spans, ["k"], "t", "s", "e", 7).collect()) == ["x", "y"]


@pytest.mark.parametrize("seed", range(3))
def test_greedy_rounds_equal_the_plain_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(g, a, b, rng.randint(0, 6)) for g in range(3) for a in range(6) for b in range(6) if rng.random() < 0.5]
    want = set()
    for g in range(3):
        used_a, used_b = set(), set()
        for _, a, b in sorted((c, a, b) for gg, a, b, c in rows if gg == g):
            if a not in used_a and b not in used_b:
                want.add((g, a, b))
                used_a.add(a)
                used_b.add(b)
    df = spark.createDataFrame(rows, "g int, a int, b int, c int")
    assert {(r.g, r.a, r.b) for r in joins.greedy_match(df, ["g"], "a", "b", "c").collect()} == want


@pytest.mark.parametrize("seed", range(4))
def test_lineups_equal_a_sequential_reading(spark, seed):
    rng = random.Random(seed)
    log, on, current, n, want = [], set(), None, 0, {}
    dirty_time = None
    for pos in range(80):
        kind = rng.choice(["in", "out", "x", "x"])
        who = rng.randint(0, 4)
        log.append((0, pos, pos * 2, who, kind))
        if kind == "x":
            if current != sorted(on):
                current, n = sorted(on), n + 1
                want[n] = [list(current), pos * 2 if dirty_time is None else dirty_time, 0]
            want[n][2] += 1
        else:
            (on.add if kind == "in" else on.discard)(who)
            dirty_time = pos * 2
    df = spark.createDataFrame(log, "g int, pos int, t int, who int, kind string")
    got = intervals.record_lineups(df, ["g"], "who", F.col("kind").isin("in", "out"), F.col("kind") == "in", "pos", "t")
    assert {r.stint: [r.lineup, r.start_time, r.n_rows] for r in got.collect()} == want


def test_batches_end_present_if_any_enters(spark):
    log = spark.createDataFrame([(0, 1, 0, "a", "in"), (0, 2, 5, "a", "out"), (0, 3, 5, "a", "in"), (0, 4, 9, "a", "out")], "g int, pos int, t int, who string, kind string")
    got = intervals.batch_lineups(log, ["g"], "who", F.col("kind") == "in", "t", "pos").orderBy("start_time").collect()
    assert [(r.start_time, r.end_time, r.lineup) for r in got] == [(0, 5, ["a"]), (5, 9, ["a"])]


def test_inclusive_threshold_is_edge_and_negative(spark):
    nodes = spark.createDataFrame([("t", "10"), ("t", "2"), ("t", "3")], "team string, id string")
    edges = spark.createDataFrame([("10", "2", 60)], "a string, b string, shared int")
    got = {(r.a, r.b): r.shared for r in graph.sparse_negatives(nodes, edges, "team", "id", 60).collect()}
    assert got == {("10", "2"): 60, ("10", "3"): 0, ("2", "3"): 0}


def test_shrunk_and_reconcile(spark):
    assert spark.range(1).select(stats.shrunk(F.lit(0.0), F.lit(-1.0), F.lit(0.4), 10.0)).head()[0] == pytest.approx(0.4)
    a = spark.createDataFrame([(1, 2.0)], "k int, v double")
    b = spark.createDataFrame([(2, 3.0)], "k int, v double")
    assert {r.k: r["diff"] for r in stats.reconcile(a, b, ["k"], "v", "v").collect()} == {1: 2.0, 2: -3.0}


def test_graphml_is_well_formed(spark):
    from xml.etree import ElementTree

    nodes = spark.createDataFrame([(1, 'A & "b"', 2.0), (2, "C<", None), (3, "unused", 1.0)], "id int, name string, x double")
    lines = graph.graphml_lines(nodes, spark.createDataFrame([(1, 2, 5)], "a int, b int, w int"), "id", True).orderBy("part", "id").collect()
    root = ElementTree.fromstring("\n".join(r.line for r in lines).encode())
    assert len([e for e in root.iter() if e.tag.endswith("node")]) == 2
    assert next(e for e in root.iter() if e.tag.endswith("graph")).get("edgedefault") == "directed"


def test_log_parsing(spark):
    log = "05:00\n10 - 8\nann made it\n+2\n\n--:--\nfoul\n+1\n12:00\nQ2 start\nsub"
    got = text.parse_log(spark.createDataFrame([(1, log)], "d int, t string"), "d", "t").orderBy("seq").collect()
    assert [(r.quarter, r.elapsed_s, r.body, r.delta, r.points) for r in got] == [(2, 720, "sub", None, 0), (2, 1440, "foul", 1, 0), (2, 1140, "ann made it", 2, 2)]


def test_prefix_lookup_takes_the_longest(spark):
    lines = spark.createDataFrame([(1, "ann lee scores"), (2, "annie"), (3, "ann")], "k int, t string")
    names = spark.createDataFrame([("ann",), ("ann lee",)], "name string")
    assert {r.k: r.name for r in text.prefix_lookup(lines, "k", "t", names, "name").collect()} == {1: "ann lee", 2: None, 3: "ann"}


def test_small_sample_methods():
    import numpy as np

    x = np.concatenate([np.random.default_rng(0).normal(c, 0.1, (20, 2)) for c in ((0, 0), (5, 5), (0, 5))])
    labels = ml.ward(x, 3)
    assert sorted(np.bincount(labels)) == [20, 20, 20]
    assert ml.silhouettes(x, labels).mean() > 0.9
    assert sorted(np.bincount(ml.gaussian_mixture(x, 3)[0])) == [20, 20, 20]


def test_stability_and_agreement(spark, tmp_path):
    import numpy as np

    from lineflux.plans import learning

    x = np.concatenate([np.random.default_rng(0).normal(c, 0.1, (20, 2)) for c in ((0, 0), (5, 5), (0, 5))])
    m = ml.small_kmeans(x, 3)
    assert sorted(np.bincount(m)) == [20, 20, 20] and ml.rand_index(m, ml.ward(x, 3)) == 1.0 and ml.subsample_stability(x, 3, 20) == 1.0
    assert ml.rand_index(np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])) == pytest.approx(-0.5)
    # labels differ in the last component only, in five pairs
    rows = [(i, [0.0] * 9 + [float(i % 10 // 2 * 5 + i % 2 * 0.1)], i % 10) for i in range(100)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.k: r for r in learning.cluster_methods(spark, str(tmp_path)).collect()}
    assert set(got) == set(range(2, 8)) and got[5].chosen and got[5].ari_ward == 1.0 and got[5].kmeans_silhouette > 0.9
    assert {r.a for r in learning.stability(spark, str(tmp_path)).collect()} == set(range(9))


def test_grouped_ridge_and_choice(spark):
    rng = random.Random(3)
    rows = [(g, x := rng.gauss(0, 1), z := rng.gauss(0, 1), 2 * x - z + rng.gauss(0, 0.1), 1.0) for g in range(12) for _ in range(9)]
    df = spark.createDataFrame(rows, "g int, x double, z double, y double, w double")
    best, error = ml.ridge_by_group(df, "g", "y", ["x", "z"], "w", [0.1, 1000.0], 4)
    assert best == 0.1 and error[0.1] < 0.05 < error[1000.0]
    assert ml.ridge(df, "y", ["x", "z"], "w", 0.01) == pytest.approx([2, -1], abs=0.05)
    assert ml.choose_k([{"k": 2, "s": 0.5, "b": 9.0}, {"k": 3, "s": 0.9, "b": 5.0}, {"k": 4, "s": 0.6, "b": 5.0}], ["s"], ["b"]) == 3


def test_grouped_ridge_keeps_small_groups(spark, monkeypatch):
    monkeypatch.setattr(ml, "SMALL", 5)
    rng = random.Random(4)
    rows = [(g, x := rng.gauss(0, 1), 2 * x, 1.0) for g in range(5) for _ in range(9)] + [(g, x := rng.gauss(0, 1), 2 * x + 10, 1.0) for g in [*range(5, 25), None]]
    df = spark.createDataFrame(rows, "g int, x double, y double, w double")
    assert ml.ridge_by_group(df, "g", "y", ["x"], "w", [0.1], 4)[1][0.1] > 10


def test_bundle_and_description(spark, tmp_path):
    from pyspark.ml import PipelineModel

    df = spark.createDataFrame([(float(i % 2) * 9 + 0.01 * i, float(i % 2) - 0.5) for i in range(40)], "a double, b double").withColumn("x", F.array("a", "b"))
    ml.save_bundle(df, "x", 1, 2, f"{tmp_path}/m")
    assert len(PipelineModel.load(f"{tmp_path}/m").stages) == 3
    got = ml.described_clusters(df.withColumn("c", (F.col("a") > 5).cast("int")), "c", ["b"]).orderBy("c").collect()
    assert [(r.high, r.low) for r in got] == [("", "b"), ("b", "")]


def test_a_dictionary_of_ten_thousand_entries(spark):
    from lineflux.operators import text as T

    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcde") for _ in range(n))
    entries = {word(rng.randint(2, 9)): word(rng.randint(0, 4)) + rng.choice(["", " "]) for _ in range(16_000)}
    assert len(entries) > 10_000
    lines = [None, "", "  ", *(" ".join(word(rng.randint(1, 12)) for _ in range(rng.randint(1, 9))) for _ in range(60))]
    table = spark.createDataFrame([*entries.items(), (None, "x"), ("", "y")], "k string, v string")
    order = T.entries(table, "k", "v")
    assert order == sorted(entries.items(), key=lambda x: (-len(x[0]), x[0]))
    got = T.translated_by(spark.createDataFrame(list(enumerate(lines)), "i int, line string"), "line", [order, [("zz", "q")]]).collect()
    for r in got:
        want = lines[r.i]
        if want is not None:
            for k, v in order:
                want = want.replace(k, v)
            want = " ".join(x for x in want.split(" ") if x)
        assert r.line == want


def test_translation_of_a_long_line_searches_it_once():
    from lineflux.operators import text as T

    ahocorasick = pytest.importorskip("ahocorasick")
    rng = random.Random(6)
    order = sorted({"".join(rng.choice("abcd ") for _ in range(rng.randint(1, 4))): rng.choice(["", "A", "ab", "c d"]) for _ in range(120)}.items(), key=lambda x: (-len(x[0]), x[0]))
    line = want = "".join(rng.choice("abcd Z]^") for _ in range(20_000))
    for k, v in order:
        want = want.replace(k, v)
    assert T.replacer(order)(line) == want
    finder = ahocorasick.Automaton()
    for i, (k, _) in enumerate(order):
        finder.add_word(k, i)
    finder.make_automaton()
    whole = []

    class Counted:
        def iter(self, text, start=0, end=None):
            whole.append((len(text) if end is None else end) - start)
            return finder.iter(text, start, len(text) if end is None else end)

    assert T.replace_in_order(line, Counted(), order, 4) == want
    assert sum(n == len(line) for n in whole) == 1 and sum(whole) < 20 * len(line)


def test_nearest_rows_equal_a_plain_loop(spark, monkeypatch):
    import math

    monkeypatch.setattr(ml, "QUERY_BLOCK", 16)
    monkeypatch.setattr(ml, "ROW_BLOCK", 40)
    monkeypatch.setattr(ml, "PAIRS_AT_ONCE", 100)
    rng = random.Random(7)
    nan, inf = math.nan, math.inf
    vectors = [[rng.choice([0.0, 1.0, 1e8]) + rng.choice([0.0, 1e-9 * rng.random()]) for _ in range(3)] for _ in range(60)] + [[1.0, 1.0, 1.0]] * 30
    vectors += [None, [1.0, None, 2.0], [1.0, 2.0], [1.0, 2.5], [], [nan, 1.0, 1.0], [inf, 1.0, 1.0], [-inf, 1.0, 1.0], [1e200, 0.0, 0.0], [-0.0, 0.0, 0.0]]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(3, [1.0, 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    rng.shuffle(rows)

    def distance(a, b):
        if a is None or b is None or len(a) != len(b) or None in a or None in b:
            return (2, 0.0)
        d = 0.0
        for x, y in zip(a, b):
            d += (x - y) * (x - y)
        return (1, 0.0) if math.isnan(d) else (0, math.sqrt(d))

    want = {}
    for q, a in rows:
        if q is not None and q % 2 == 0 or q == 93:
            want.setdefault(q, []).extend((*distance(a, b), i) for i, b in rows if i is not None and i != q)
    want = {(q, n): v for q, c in want.items() for n, v in enumerate(sorted(c)[:3], 1)}
    df = spark.createDataFrame(rows, "id int, x array<double>")
    got = ml.nearest_rows(df.where("id % 2 = 0 or id = 93"), df, "id", "x", 3, 2).collect()
    shown = lambda d: (2, 0.0) if d is None else (1, 0.0) if math.isnan(d) else (0, d)
    assert {(r.query, r["rank"]): (*shown(r.distance), r.id) for r in got} == want and len(got) == len(want)
