"""Queries of statistics and learning operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import ml
from .registry import query, table

C = F.col


def vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", C("embedding").cast("array<double>").alias("x"), "label")


@query("""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)
SELECT query, vec_id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM (
  SELECT a.vec_id AS query, b.vec_id, list_distance(a.x, b.x) AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.x, b.x), b.vec_id) AS rank FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) WHERE rank <= 3""")
def knn3(spark, d):
    """The three nearest rows of every fiftieth row."""
    e = vectors(spark, d)
    return ml.nearest_rows(e.where("vec_id % 50 = 0"), e, "vec_id", "x", 3, 16).withColumn("distance", F.round("distance", 6))


@query("""
WITH t AS (SELECT label AS a, vec_id % 3 AS b, count(*) AS n FROM embeddings GROUP BY 1, 2), s AS (SELECT sum(n * (n - 1) / 2.0) AS s, sum(n) AS n FROM t),
x AS (SELECT sum(m * (m - 1) / 2.0) AS ra FROM (SELECT sum(n) AS m FROM t GROUP BY a)), y AS (SELECT sum(m * (m - 1) / 2.0) AS rb FROM (SELECT sum(n) AS m FROM t GROUP BY b))
SELECT round((s - ra * rb / (n * (n - 1) / 2.0)) / ((ra + rb) / 2 - ra * rb / (n * (n - 1) / 2.0)), 10) AS ari FROM s, x, y""")
def adjusted_rand(spark, d):
    e = table(spark, d, "embeddings").withColumn("m", C("vec_id") % 3)
    return ml.adjusted_rand(e, "label", "m").select(F.round("ari", 10).alias("ari"))


@query("""
WITH s AS (SELECT sum(l_quantity * l_tax * l_tax) AS a, sum(l_quantity * l_tax * l_discount) AS b, sum(l_quantity * l_discount * l_discount) AS c, sum(l_quantity * l_tax * l_extendedprice) AS p, sum(l_quantity * l_discount * l_extendedprice) AS q FROM lineitem)
SELECT round(((c + 10) * p - b * q) / ((a + 10) * (c + 10) - b * b), 3) AS tax, round(((a + 10) * q - b * p) / ((a + 10) * (c + 10) - b * b), 3) AS discount FROM s""")
def ridge(spark, d):
    b = ml.ridge(table(spark, d, "lineitem"), "l_extendedprice", ["l_tax", "l_discount"], "l_quantity", 10.0)
    return spark.range(1).select(F.round(F.lit(b[0]), 3).alias("tax"), F.round(F.lit(b[1]), 3).alias("discount"))


REPLICATES = 2_000
STEPS = " + ".join(f"CASE WHEN u > {c!r} THEN 1 ELSE 0 END" for c in ml.poisson_steps())
DRAWS = f"""(SELECT *, {STEPS} AS k FROM (SELECT s.*, r, ((CAST('0x' || substr(md5(CAST(g AS VARCHAR)), 1, 7) AS BIGINT) * a + b) % {ml.PRIME} + 0.5) / {ml.PRIME} AS u FROM s,
  (SELECT r, CAST('0x' || substr(md5('a' || r), 1, 7) AS BIGINT) + 1 AS a, CAST('0x' || substr(md5('b' || r), 1, 7) AS BIGINT) AS b FROM range(1, {REPLICATES + 1}) t(r))))"""


@query(f"""
WITH s AS (SELECT o_custkey AS g, sum(l_extendedprice * l_discount) AS n, sum(l_extendedprice) AS d FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1),
v AS (SELECT r, sum(k * n) / sum(k * d) AS v FROM {DRAWS} GROUP BY r)
SELECT round((SELECT sum(n) / sum(d) FROM s), 8) AS value, round(quantile_cont(v, 0.025), 8) AS low, round(quantile_cont(v, 0.975), 8) AS high, avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END) AS p_above FROM v""")
def bootstrap(spark, d):
    """Ratio of sums with an interval from resampled customers."""
    o = table(spark, d, "orders").join(table(spark, d, "lineitem"), C("o_orderkey") == C("l_orderkey"))
    out = ml.group_bootstrap(o, "o_custkey", C("l_extendedprice") * C("l_discount"), C("l_extendedprice"), REPLICATES)
    return out.select(*(F.round(c, 8).alias(c) for c in ("value", "low", "high")), "p_above")


@query(f"""
WITH s AS (SELECT o_orderpriority AS pair, o_custkey AS g, sum(l_extendedprice * l_discount) AS n, sum(l_extendedprice) AS d, sum(l_quantity) AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2),
v AS (SELECT pair, r, sum(k * n) / nullif(sum(k * d), 0) AS v FROM {DRAWS} GROUP BY 1, 2), t AS (SELECT pair, sum(q) AS minutes, sum(n) / sum(d) AS value FROM s GROUP BY 1)
SELECT pair, minutes, round(100 * value, 6) AS rate, CASE WHEN minutes >= 20 THEN round(100 * (SELECT quantile_cont(v, 0.025) FROM v WHERE v.pair = t.pair), 6) END AS low,
       CASE WHEN minutes >= 20 THEN round(100 * (SELECT quantile_cont(v, 0.975) FROM v WHERE v.pair = t.pair), 6) END AS high FROM t""")
def pair_summary(spark, d):
    """A rate by group, with an interval from resampled customers where the group has enough, by falling volume."""
    o = table(spark, d, "orders").join(table(spark, d, "lineitem"), C("o_orderkey") == C("l_orderkey")).withColumnRenamed("o_orderpriority", "pair")
    rate = ml.group_bootstrap(o, "o_custkey", C("l_extendedprice") * C("l_discount"), C("l_extendedprice"), REPLICATES, keys=["pair"])
    enough = lambda c: F.when(C("minutes") >= 20, F.round(100 * C(c), 6)).alias(c)
    out = rate.join(o.groupBy("pair").agg(F.sum("l_quantity").alias("minutes")), "pair")
    return out.select("pair", "minutes", F.round(100 * C("value"), 6).alias("rate"), enough("low"), enough("high")).orderBy(F.desc("minutes"), "pair")


STATISTICS_SQL = f"""
WITH s AS (SELECT l_linestatus AS side, o_custkey AS g, sum(l_extendedprice * l_discount) AS n, sum(l_extendedprice) AS d, coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'R'), 0) AS qr, coalesce(sum(l_extendedprice) FILTER (WHERE l_returnflag = 'R'), 0) AS dr, sum(l_quantity) AS q, sum(l_tax) AS t, count(*) AS c
           FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2),
w AS (SELECT side, r, sum(k * n) AS n, sum(k * d) AS d, sum(k * qr) AS qr, sum(k * dr) AS dr, sum(k * q) AS q, sum(k * t) AS t, sum(k * c) AS c FROM {DRAWS} GROUP BY 1, 2 UNION ALL SELECT side, 0, sum(n), sum(d), sum(qr), sum(dr), sum(q), sum(t), sum(c) FROM s GROUP BY 1),
v AS (SELECT side, r, 'rate' AS statistic, n / nullif(d, 0) AS v FROM w UNION ALL SELECT side, r, 'difference', 1000 * (qr / nullif(dr, 0) - q / nullif(d, 0)) FROM w
      UNION ALL SELECT side, r, 'four_factors', 0.4 * n / nullif(d, 0) + 0.25 * qr / nullif(q, 0) + 0.2 * t / nullif(c, 0) + 0.15 * dr / nullif(d, 0) FROM w)
SELECT side, statistic, round(max(v) FILTER (WHERE r = 0), 7) AS value, round(quantile_cont(v, 0.025) FILTER (WHERE r > 0), 7) AS low, round(quantile_cont(v, 0.975) FILTER (WHERE r > 0), 7) AS high FROM v GROUP BY 1, 2"""


@query(STATISTICS_SQL)
def bootstrap_statistics(spark, d):
    """A ratio, a difference of ratios and a weighted sum of four factors by line status, with intervals from 2,000 resamples of customers."""
    o = table(spark, d, "orders").join(table(spark, d, "lineitem"), C("o_orderkey") == C("l_orderkey")).withColumnRenamed("l_linestatus", "side")
    back = C("l_returnflag") == "R"
    sums = {"n": C("l_extendedprice") * C("l_discount"), "d": C("l_extendedprice"), "qr": F.when(back, C("l_quantity")).otherwise(0), "dr": F.when(back, C("l_extendedprice")).otherwise(0), "q": C("l_quantity"), "t": C("l_tax"), "c": F.lit(1)}
    over = lambda a, b: a / F.nullif(b, F.lit(0.0))
    out = ml.resampled(o, "o_custkey", sums, {
        "rate": lambda s: over(s["n"], s["d"]), "difference": lambda s: 1000 * (over(s["qr"], s["dr"]) - over(s["q"], s["d"])),
        "four_factors": lambda s: 0.4 * over(s["n"], s["d"]) + 0.25 * over(s["qr"], s["q"]) + 0.2 * over(s["t"], s["c"]) + 0.15 * over(s["dr"], s["d"])}, REPLICATES, ["side"])
    return out.select("side", "statistic", *(F.round(c, 7).alias(c) for c in ("value", "low", "high")))


@query("""
WITH RECURSIVE s AS (SELECT o_custkey, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS k FROM orders GROUP BY 1),
r AS (SELECT CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS c, -1 AS fold
      UNION ALL SELECT k, CASE fold WHEN 0 THEN a + n ELSE a END, CASE fold WHEN 1 THEN b + n ELSE b END, CASE fold WHEN 2 THEN c + n ELSE c END, fold
      FROM (SELECT s.k, s.n, a, b, c, CASE WHEN a <= b AND a <= c THEN 0 WHEN b <= c THEN 1 ELSE 2 END AS fold FROM r JOIN s ON s.k = r.k + 1))
SELECT o_custkey, fold FROM r JOIN s USING (k)""")
def folds_by_size(spark, d):
    """Customers dealt to three folds, the one with most orders to the lightest."""
    return ml.group_folds(table(spark, d, "orders"), "o_custkey", 3).select("o_custkey", C("_fold").alias("fold"))


EFFECT = "x AS (SELECT o_custkey % 5 AS fold, CAST(l_returnflag = 'R' AS DOUBLE) AS p, l_discount * 100 AS c, l_extendedprice / 1000 AS y, l_quantity AS w FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
MOMENTS = "sum(w) AS s1, sum(w * p) AS sp, sum(w * c) AS sc, sum(w * y) AS sy, sum(w * p * p) AS spp, sum(w * p * c) AS spc, sum(w * c * c) AS scc, sum(w * p * y) AS spy, sum(w * c * y) AS scy, sum(w * y * y) AS syy"
#: The 2 × 2 system of a dummy times 100 and a control less its weighted mean m.
SYSTEM = "sc / s1 AS m, 10000 * spp + alpha AS a, 100 * (spc - sp * sc / s1) AS b, scc - sc * sc / s1 + alpha AS e, 100 * spy AS f, scy - sc * sy / s1 AS g"
SOLVED = "100 * (e * f - b * g) / (a * e - b * b) AS bp, (a * g - b * f) / (a * e - b * b) AS bc"


def effect_rows(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "lineitem"), C("o_orderkey") == C("l_orderkey"))
    return o.select("o_custkey", (C("o_custkey") % 5).alias("fold"), F.when(C("l_returnflag") == "R", 1.0).otherwise(0.0).alias("p"), (C("l_discount") * 100).alias("c"), (C("l_extendedprice") / 1000).alias("y"), C("l_quantity").alias("w"))


@query(f"""
WITH {EFFECT}, t AS (SELECT {MOMENTS}, CAST(30 AS DOUBLE) AS alpha FROM x), z AS (SELECT {SYSTEM} FROM t)
SELECT round(bp, 6) AS partner, round(bc, 6) AS control FROM (SELECT {SOLVED} FROM z)""")
def centred_ridge(spark, d):
    """A free dummy and a centred control, weighted, without intercept."""
    b = ml.centred_ridge(effect_rows(spark, d), "y", ["p", "c"], "w", 30.0, ["p"])
    return spark.range(1).select(F.round(F.lit(b["p"]), 6).alias("partner"), F.round(F.lit(b["c"]), 6).alias("control"))


@query(f"""
WITH {EFFECT}, k AS (SELECT fold, {MOMENTS} FROM x GROUP BY 1), t AS (SELECT {', '.join(f'sum({n}) AS {n}' for n in 's1 sp sc sy spp spc scc spy scy syy'.split())} FROM k),
n AS (SELECT alpha, k.fold, {', '.join(f't.{n} - k.{n} AS {n}' for n in 's1 sp sc sy spp spc scc spy scy syy'.split())} FROM k, t, (VALUES (CAST(1 AS DOUBLE)), (100), (10000)) v(alpha)),
z AS (SELECT alpha, fold, {SYSTEM} FROM n), b AS (SELECT alpha, fold, m, {SOLVED} FROM z),
r AS (SELECT alpha, (syy + bp * bp * spp + bc * bc * scc + 2 * bp * bc * spc + bc * m * bc * m * s1 - 2 * bp * spy - 2 * bc * scy + 2 * bc * m * sy - 2 * bc * m * (bp * sp + bc * sc)) / s1 AS err FROM b JOIN k USING (fold))
SELECT CAST(alpha AS DOUBLE) AS alpha, round(avg(err), 6) AS error FROM r GROUP BY 1""")
def ridge_fold_errors(spark, d):
    """Mean over folds of the weighted error of the centred ridge, by penalty; a fold's centres are those of its training rows."""
    e = ml.fold_errors(effect_rows(spark, d), "fold", "y", ["p", "c"], "w", [1.0, 100.0, 10000.0], ["p"])
    return spark.createDataFrame([(a, x) for a, x in e.items()], "alpha double, error double").withColumn("error", F.round("error", 6))


@query()
def ridge_effects(spark, d):
    """Effects of two free dummies under the best penalty, and their difference, with intervals."""
    rows = effect_rows(spark, d).withColumn("q", F.when(C("w") > 25, 1.0).otherwise(0.0))
    got = ml.ridge_effects(rows, "o_custkey", "y", ["p", "q", "c"], "w", ["p", "q"], [1.0, 100.0, 10000.0])
    out = [(f, None, value, low, high, None) for f, value, low, high in got["effects"]] + got["differences"]
    return spark.createDataFrame(out, "effect string, less string, value double, low double, high double, p_above double").withColumn("alpha", F.lit(got["alpha"]))


@query("""
WITH e AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings),
m AS (SELECT avg(a) AS a, avg(b) AS b, avg(c) AS c FROM e WHERE label = 1)
SELECT vec_id, round(sqrt((e.a - m.a) * (e.a - m.a) + (e.b - m.b) * (e.b - m.b) + (e.c - m.c) * (e.c - m.c)), 8) AS distance FROM e, m""")
def profile_distance(spark, d):
    """Distance on three axes from the mean profile of one label."""
    e = table(spark, d, "embeddings").select("vec_id", "label", *(C("embedding")[i].cast("double").alias(n) for i, n in enumerate("abc")))
    return ml.profile_distance(e, ["a", "b", "c"], C("label") == 1).select("vec_id", F.round("distance", 8).alias("distance"))


@query("""
WITH e AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS usage FROM embeddings WHERE label IS NOT NULL), m AS (SELECT label, avg(usage) AS u FROM e GROUP BY 1)
SELECT vec_id, CAST(n AS INTEGER) AS label FROM e JOIN (SELECT label, row_number() OVER (ORDER BY u DESC, label) - 1 AS n FROM m) USING (label)""")
def relabelled_clusters(spark, d):
    """Clusters numbered by falling mean of a usage column."""
    e = table(spark, d, "embeddings").where("label is not null").select("vec_id", "label", C("embedding")[0].cast("double").alias("usage"))
    return ml.relabelled(e, "label", "usage").select("vec_id", "label")


@query("""
WITH e AS (SELECT label, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings WHERE label IS NOT NULL), s AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM e),
z AS (SELECT label, avg((a - ma) / sa) AS a, avg((b - mb) / sb) AS b FROM e, s GROUP BY 1)
SELECT label, round(a, 8) AS a, round(b, 8) AS b, array_to_string(list_transform(list_reverse_sort(list_filter([{'z': a, 'name': 'a'}, {'z': b, 'name': 'b'}], lambda x: x.z > 0.05)), lambda x: x.name), ', ') AS high,
       array_to_string(list_transform(list_sort(list_filter([{'z': a, 'name': 'a'}, {'z': b, 'name': 'b'}], lambda x: x.z < -0.05)), lambda x: x.name), ', ') AS low FROM z""")
def cluster_profile(spark, d):
    """Means of standardised features by cluster, and what stands out, as text."""
    e = table(spark, d, "embeddings").where("label is not null").select("label", *(C("embedding")[i].cast("double").alias(n) for i, n in enumerate("ab")))
    s = e.agg(*(f(n).alias(f"{p}{n}") for n in "ab" for p, f in (("m", F.avg), ("s", F.stddev_pop))))
    z = e.crossJoin(F.broadcast(s)).select("label", *(((C(n) - C(f"m{n}")) / C(f"s{n}")).alias(n) for n in "ab"))  # one row
    return ml.described_clusters(z, "label", ["a", "b"], 0.05).select("label", F.round("a", 8).alias("a"), F.round("b", 8).alias("b"), "high", "low")


@query("""
WITH e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), s AS (SELECT i, avg(v) AS m, stddev_pop(v) AS sd FROM e GROUP BY 1)
SELECT vec_id, round(sum((v - m) / sd), 5) AS total, round(max((v - m) / sd), 5) AS most FROM e JOIN s USING (i) GROUP BY 1""")
def standard_scores(spark, d):
    """Vectors standardised by population deviation, shown by the sum and the largest of their components."""
    z = ml.standardised(vectors(spark, d), "x")
    return z.select("vec_id", F.round(F.aggregate("x", F.lit(0.0), lambda a, x: a + x), 5).alias("total"), F.round(F.array_max("x"), 5).alias("most"))


@query()
def pca(spark, d):
    out, shares, _ = ml.pca(vectors(spark, d), "x")
    return out.select("vec_id", "pc", F.lit(len(shares)).alias("n_components"))


@query()
def kmeans(spark, d):
    """Clusters with soft membership; clusters are numbered by falling mean of the first feature."""
    e = ml.standardised(vectors(spark, d), "x")
    out, centres, cost = ml.kmeans(e, "x", 5, 3)
    order = np.argsort(-np.array([c[0] for c in centres]), kind="stable")
    number = F.element_at(F.array(*(F.lit(int(np.flatnonzero(order == i)[0])) for i in range(len(centres)))), C("cluster") + 1)
    scale = cost / (e.count() * len(centres[0]))
    return out.select("vec_id", number.alias("cluster"), ml.soft_membership(C("x"), [centres[i] for i in order], scale).alias("membership"))


def prototypes(spark, d):
    """Mean vector of each label, all components: the small sample that linkage and mixtures are for."""
    e = vectors(spark, d).where("label is not null").select(C("label").cast("long").alias("grp"), F.posexplode("x").alias("i", "v"))
    m = e.groupBy("grp", "i").agg(F.avg("v").alias("v"))
    return m.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("s")).select("grp", C("s.v").alias("x"))


@query()
def cluster_methods(spark, d):
    """Ward, a diagonal mixture and k-means on one small sample, for k = 2 to 7: silhouettes, BIC, stability over subsamples,
    agreement, and the k that the ranks choose among 4 to 6 without clusters of one."""
    ids, x = ml.matrix(prototypes(spark, d), "grp", "x")
    rows = []
    for k in range(2, min(8, len(ids))):
        w, m = ml.ward(x, k), ml.small_kmeans(x, k)
        g, bic = ml.gaussian_mixture(x, k)
        silhouette = {f"{n}_silhouette": float(ml.silhouettes(x, label).mean()) for n, label in (("ward", w), ("mixture", g), ("kmeans", m))}
        rows.append({"k": k, "bic": float(bic), **silhouette, "stability": ml.subsample_stability(x, k), "ari_ward": ml.rand_index(m, w), "ari_mixture": ml.rand_index(m, g), "least_size": int(np.bincount(m, minlength=k).min())})
    able = [r for r in rows if 4 <= r["k"] <= 6 and r["least_size"] >= 2]
    best = ml.choose_k(able, ["kmeans_silhouette", "stability", "ari_mixture"], []) if able else None
    out = "k int, ward_silhouette double, bic double, mixture_silhouette double, kmeans_silhouette double, stability double, ari_ward double, ari_mixture double, least_size int"
    names = [c.split()[0] for c in out.split(", ")]
    return spark.createDataFrame([(*(r[n] for n in names), r["k"] == best) for r in rows], out + ", chosen boolean")


@query()
def stability(spark, d):
    """Co-clustering frequency of pairs over 200 subsamples of 80 %, by k-means."""
    ids, x = ml.matrix(prototypes(spark, d), "grp", "x")
    rng, n = np.random.default_rng(43), len(ids)
    same, both = np.zeros((n, n)), np.zeros((n, n))
    for i in range(200):
        pick = np.sort(rng.choice(n, int(0.8 * n), replace=False))
        label = ml.small_kmeans(x[pick], 4, 10, i)
        both[np.ix_(pick, pick)] += 1
        same[np.ix_(pick, pick)] += label[:, None] == label
    share = np.divide(same, both, out=np.zeros_like(same), where=both > 0)
    return spark.createDataFrame([(int(ids[i]), int(ids[j]), float(share[i, j])) for i in range(n) for j in range(i + 1, n)], "a long, b long, share double")


@query("""
WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings), s AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, corr(a, b) AS r FROM e),
z AS (SELECT vec_id, (a - ma) / sa AS a, (b - mb) / sb * CASE WHEN r < 0 THEN -1 ELSE 1 END AS b, r FROM e, s)
SELECT vec_id, round((a + b) * (a + b) / 2, 6) AS first_sq, round((a - b) * (a - b) / 2, 6) AS second_sq, round((1 + abs(r)) / 2, 8) AS first_share, round((1 + abs(r)) / 2 + (1 - abs(r)) / 2, 8) AS both_share FROM z""")
def components_of_two(spark, d):
    """Two standardised columns: their components are known, with the shares they explain; squares leave signs out."""
    e = table(spark, d, "embeddings").select("vec_id", F.slice(C("embedding").cast("array<double>"), 1, 2).alias("x"))
    out, shares, _ = ml.pca(ml.standardised(e, "x"), "x", 1.0)
    square = lambda i: F.round(C("pc")[i] * C("pc")[i], 6)
    return out.select("vec_id", square(0).alias("first_sq"), square(1).alias("second_sq"), F.round(F.lit(shares[0]), 8).alias("first_share"), F.round(F.lit(sum(shares)), 8).alias("both_share"))


@query("SELECT n_nationkey, CAST(n_nationkey % 3 AS INTEGER) AS kmeans, CAST(n_nationkey % 3 AS INTEGER) AS ward, CAST(n_nationkey % 3 AS INTEGER) AS mixture, CAST(n_nationkey % 3 AS INTEGER) AS small FROM nation")
def separated_clusters(spark, d):
    """Three far groups: k-means, Ward's linkage, a mixture and the small-sample k-means must all find them; numbered by place."""
    e = table(spark, d, "nation").select("n_nationkey", F.array((C("n_nationkey") % 3) * 100.0 + C("n_regionkey"), C("n_regionkey") * 1.0).alias("x"))
    found, centres, _ = ml.kmeans(e, "x", 3, 5)
    ids, x = ml.matrix(e, "n_nationkey", "x")
    place = lambda label: np.argsort(np.argsort([x[label == k, 0].mean() for k in range(3)]))[label]
    small = [place(label) for label in (ml.ward(x, 3), ml.gaussian_mixture(x, 3)[0], ml.small_kmeans(x, 3))]
    rows = spark.createDataFrame([(int(i), *(int(s[k]) for s in small)) for k, i in enumerate(ids)], "n_nationkey int, ward int, mixture int, small int")
    number = np.argsort(np.argsort([c[0] for c in centres]))
    return found.select("n_nationkey", F.element_at(F.array(*(F.lit(int(i)) for i in number)), C("cluster") + 1).alias("kmeans")).join(rows, "n_nationkey")


@query("""
WITH e AS (SELECT n_nationkey AS k, n_nationkey * 1.0 AS a, n_regionkey * 2.0 AS b, n_regionkey % 3 AS g FROM nation),
p AS (SELECT x.k, x.g, y.g AS h, sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b)) AS d, x.k = y.k AS own FROM e x, e y),
m AS (SELECT k, g, h, sum(d) AS total, count(*) AS n FROM p GROUP BY 1, 2, 3),
s AS (SELECT k, max(CASE WHEN g = h THEN CASE WHEN n > 1 THEN total / (n - 1) ELSE 0 END END) AS a, min(CASE WHEN g <> h THEN total / n END) AS b, max(CASE WHEN g = h THEN n END) AS size FROM m GROUP BY 1)
SELECT k AS n_nationkey, CAST(round(CASE WHEN size > 1 THEN (b - a) / greatest(a, b) ELSE 0 END, 8) AS DOUBLE) AS silhouette FROM s""")
def silhouette_scores(spark, d):
    """How much nearer each row of a small sample is to its own group than to the next one."""
    e = table(spark, d, "nation").select("n_nationkey", F.array(C("n_nationkey") * 1.0, C("n_regionkey") * 2.0, (C("n_regionkey") % 3) * 1.0).alias("x"))
    ids, x = ml.matrix(e, "n_nationkey", "x")
    s = ml.silhouettes(x[:, :2], x[:, 2].astype(int))
    return spark.createDataFrame([(int(i), round(float(v), 8)) for i, v in zip(ids, s)], "n_nationkey int, silhouette double")


@query("""
WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings),
w AS (SELECT vec_id, exp(-(a * a + b * b) / 0.1) AS p, exp(-((a - 0.1) * (a - 0.1) + (b + 0.1) * (b + 0.1)) / 0.1) AS q, exp(-((a + 0.2) * (a + 0.2) + (b - 0.2) * (b - 0.2)) / 0.1) AS r FROM e)
SELECT vec_id, round(p / (p + q + r), 8) AS p, round(q / (p + q + r), 8) AS q, round(r / (p + q + r), 8) AS r FROM w""")
def membership_shares(spark, d):
    """Soft membership in three given centres."""
    e = table(spark, d, "embeddings").select("vec_id", F.slice(C("embedding").cast("array<double>"), 1, 2).alias("x"))
    m = ml.soft_membership(C("x"), [[0.0, 0.0], [0.1, -0.1], [-0.2, 0.2]], 0.05)
    return e.select("vec_id", m.alias("m")).select("vec_id", *(F.round(C("m")[i], 8).alias(n) for i, n in enumerate("pqr")))
