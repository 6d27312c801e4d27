"""Standardising, PCA, clustering, ridge, bootstrap and cluster comparison."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .joins import checkpointed, numbered

#: Rows that may be collected for methods on small samples (linkage, mixtures, silhouettes).
SMALL = 20_000


def matrix(df: DataFrame, key: str, features: str) -> tuple[list, np.ndarray]:
    """A small sample on the driver; its size is checked."""
    rows = df.select(key, features).orderBy(key).limit(SMALL + 1).collect()
    if len(rows) > SMALL:
        raise ValueError(f"more than {SMALL} rows: this method is for small samples")
    return [r[0] for r in rows], np.array([r[1] for r in rows], float).reshape(len(rows), -1)


def standardised(df: DataFrame, features: str) -> DataFrame:
    """features less their mean over their population deviation (1 where that is 0), in one pass and one broadcast row."""
    v = df.withColumn("_v", array_to_vector(F.col(features).cast("array<double>")))
    s = v.agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("_v")).alias("s"))
    s = s.select(vector_to_array("s.mean").alias("_m"), F.transform(vector_to_array("s.variance"), lambda x: F.sqrt(x * (F.col("s.count") - 1) / F.col("s.count"))).alias("_sd"))
    out = df.crossJoin(F.broadcast(s))
    z = F.transform(F.arrays_zip(F.col(features).alias("x"), F.col("_m").alias("m"), F.col("_sd").alias("sd")), lambda t: (t["x"] - t["m"]) / F.when(t["sd"] > 0, t["sd"]).otherwise(1.0))
    return out.withColumn(features, z).drop("_m", "_sd")


def pca(df: DataFrame, features: str, share: float = 0.8) -> tuple[DataFrame, list[float], np.ndarray]:
    """df with `pc` (scores on the components that explain `share`), the explained shares and the components.

    The covariance is summed in the cluster; only its p × p matrix comes to the driver. Signs: the largest loading is positive.
    """
    from pyspark.ml.stat import Correlation

    v = df.select(array_to_vector(F.col(features).cast("array<double>")).alias("v"))
    r = Correlation.corr(v, "v").head()[0].toArray()
    sd = np.sqrt(np.array(v.select(Summarizer.variance(F.col("v"))).head()[0]))
    mean = np.array(v.select(Summarizer.mean(F.col("v"))).head()[0])
    values, vectors = np.linalg.eigh(np.nan_to_num(r) * np.outer(sd, sd))
    values, vectors = values[::-1], vectors[:, ::-1]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(values))])
    shares = values / values.sum()
    k = int(np.searchsorted(np.cumsum(shares), share - 1e-12) + 1)
    parts = [F.aggregate(F.zip_with(F.col(features).cast("array<double>"), F.array(*(F.lit(float(x)) for x in vectors[:, j])), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x) - float(mean @ vectors[:, j]) for j in range(k)]
    return df.withColumn("pc", F.array(*parts)), shares[:k].tolist(), vectors[:, :k]


def kmeans(df: DataFrame, features: str, k: int, starts: int = 5, seed: int = 42):
    """The best of several starts by cost: (df with cluster, centres, cost)."""
    v = df.withColumn("_v", array_to_vector(F.col(features).cast("array<double>")))
    models = [KMeans(k=k, seed=seed + i, featuresCol="_v", predictionCol="cluster").fit(v) for i in range(starts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(v).drop("_v"), best.clusterCenters(), best.summary.trainingCost


def soft_membership(features: Column, centres, scale: float) -> Column:
    """softmax(-d² / 2 scale) over the centres, the largest term subtracted first."""
    d = F.array(*(F.aggregate(F.zip_with(features, F.array(*(F.lit(float(x)) for x in c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x) for c in centres))
    e = F.transform(d, lambda x: F.exp((F.array_min(d) - x) / (2 * scale)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def gaussian_mixture(x: np.ndarray, k: int, starts: int = 20, reg: float = 1e-3, seed: int = 42, steps: int = 200):
    """Diagonal mixture by EM on a small sample: (labels, BIC) of the likeliest start."""
    best = None
    n, p = x.shape
    for s in range(starts):
        rng = np.random.default_rng(seed + s)
        mean, var, w, last = x[rng.choice(n, k, replace=False)], np.tile(x.var(0) + reg, (k, 1)), np.full(k, 1 / k), -np.inf
        for _ in range(steps):
            log = np.log(w) - 0.5 * (np.log(2 * np.pi * var).sum(1) + (((x[:, None] - mean) ** 2) / var).sum(2))
            top = log.max(1, keepdims=True)
            total = top[:, 0] + np.log(np.exp(log - top).sum(1))
            r = np.exp(log - total[:, None])
            if total.mean() - last < 1e-3:
                break
            last = total.mean()
            mass = r.sum(0) + 1e-10
            w, mean = mass / n, r.T @ x / mass[:, None]
            var = np.maximum(r.T @ (x * x) / mass[:, None] - mean**2, 0) + reg
        bic = -2 * total.sum() + (k - 1 + 2 * k * p) * np.log(n)
        if best is None or total.sum() > best[2]:
            best = (r.argmax(1), bic, total.sum())
    return best[0], best[1]


def ward(x: np.ndarray, k: int) -> np.ndarray:
    """Labels of Ward's linkage cut at k clusters, on a small sample (nearest pairs by the Lance-Williams update)."""
    n = len(x)
    d = ((x[:, None] - x) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    size, label, alive = np.ones(n), np.arange(n), np.ones(n, bool)
    for _ in range(n - k):
        i, j = np.unravel_index(np.argmin(np.where(alive[:, None] & alive, d, np.inf)), d.shape)
        new = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * d[i, j]) / (size[i] + size[j] + size)
        d[i], d[:, i] = new, new
        d[i, i] = np.inf
        size[i] += size[j]
        alive[j] = False
        label[label == j] = i
    return np.unique(label, return_inverse=True)[1]


def small_kmeans(x: np.ndarray, k: int, starts: int = 50, seed: int = 42, steps: int = 300) -> np.ndarray:
    """Labels of Lloyd's iterations on a small sample, seeded by distance: the start of least cost."""
    best = None
    rng = np.random.default_rng(seed)
    for _ in range(starts):
        c = x[rng.integers(len(x))][None]
        while len(c) < k:
            d = ((x[:, None] - c) ** 2).sum(2).min(1)
            c = np.vstack([c, x[rng.choice(len(x), p=d / d.sum() if d.sum() > 0 else None)]])
        label = None
        for _ in range(steps):
            d = ((x[:, None] - c) ** 2).sum(2)
            now = d.argmin(1)
            if label is not None and (now == label).all():
                break
            label = now
            c = np.array([x[label == j].mean(0) if (label == j).any() else c[j] for j in range(k)])
        cost = d.min(1).sum()
        if best is None or cost < best[0]:
            best = (cost, label)
    return best[1]


def rand_index(a: np.ndarray, b: np.ndarray) -> float:
    """The adjusted Rand index of two labellings of a small sample; 1 where both are trivial alike."""
    t = np.zeros((a.max() + 1, b.max() + 1))
    np.add.at(t, (a, b), 1)
    pairs = lambda c: (c * (c - 1) / 2).sum()
    rows, cols = pairs(t.sum(1)), pairs(t.sum(0))
    expected = rows * cols / max(len(a) * (len(a) - 1) / 2, 1)
    top = (rows + cols) / 2 - expected
    return float((pairs(t) - expected) / top) if top else 1.0


def subsample_stability(x: np.ndarray, k: int, replicates: int = 200, share: float = 0.8, seed: int = 42) -> float:
    """Mean adjusted Rand index between k-means on the whole sample and on subsamples of it."""
    rng, full = np.random.default_rng(seed), small_kmeans(x, k)
    picks = [rng.choice(len(x), int(share * len(x)), replace=False) for _ in range(replicates)]
    return float(np.mean([rand_index(full[p], small_kmeans(x[p], k, 10, seed + i)) for i, p in enumerate(picks)]))


def silhouettes(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Euclidean silhouettes, 0 in clusters of one; distances by blocks of rows."""
    names, at = np.unique(labels, return_inverse=True)
    one = np.eye(len(names))[at]
    size, out = one.sum(0), np.zeros(len(x))
    for i in range(0, len(x), 1024):
        d = np.sqrt(np.maximum(((x[i : i + 1024, None] - x) ** 2).sum(2), 0)) if x.shape[1] * len(x) < 1 << 16 else np.sqrt(np.maximum((x[i : i + 1024] ** 2).sum(1)[:, None] + (x**2).sum(1) - 2 * x[i : i + 1024] @ x.T, 0))
        total = d @ one
        own = at[i : i + 1024]
        rows = np.arange(len(own))
        a = total[rows, own] / np.maximum(size[own] - 1, 1)
        b = total / size
        b[rows, own] = np.inf
        b = b.min(1)
        out[i : i + 1024] = np.where(size[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0)
    return out


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the adjusted Rand index of two labellings, from their contingency counts."""
    pairs = lambda c: c * (c - 1) / 2.0
    t = df.groupBy(a, b).agg(F.count("*").alias("n"))
    both = t.agg(F.sum(pairs(F.col("n"))).alias("s"), F.sum("n").alias("n"))
    rows = t.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("ra"))
    cols = t.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("rb"))
    one = both.crossJoin(rows).crossJoin(cols)  # single rows
    expected = F.col("ra") * F.col("rb") / pairs(F.col("n"))
    return one.select(((F.col("s") - expected) / ((F.col("ra") + F.col("rb")) / 2 - expected)).alias("ari"))


def ridge(df: DataFrame, y: str, xs: list[str], w: str, alpha: float, free: float = 1.0) -> list[float]:
    """Weighted ridge without intercept from its normal equations, one aggregation: (X'WX + alpha I) b = X'Wy."""
    p = len(xs)
    sums = [F.sum(F.col(w) * F.col(xs[i]) * F.col(xs[j])).alias(f"a{i}_{j}") for i in range(p) for j in range(i, p)] + [F.sum(F.col(w) * F.col(x) * F.col(y)).alias(f"b{i}") for i, x in enumerate(xs)]
    r = df.agg(*sums).head()
    a = np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)], float)
    return np.linalg.solve(a + alpha * free * np.eye(p), np.array([r[f"b{i}"] for i in range(p)], float)).tolist()


def multiplicity(key: Column, replicate: Column, seed: int = 0) -> Column:
    """How often a resample takes a group: Poisson(1) from md5 of replicate, group and seed, so reruns agree."""
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", replicate.cast("string"), key.cast("string"), F.lit(str(seed)))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return reduce(lambda a, c: a + (u > c).cast("int"), poisson_steps(), F.lit(0))


def poisson_steps(most: int = 12) -> list[float]:
    """P(X <= k) of Poisson(1) for k below `most`."""
    term, total, out = np.exp(-1.0), 0.0, []
    for k in range(most):
        total += term
        out.append(float(total))
        term /= k + 1
    return out


#: The prime of the hash that draws resamples: 2^31 - 1.
PRIME = 2_147_483_647


def drawn(name: str) -> int:
    """28 bits of a name's md5."""
    return int(hashlib.md5(name.encode()).hexdigest()[:7], 16)


def resampled(df: DataFrame, group: str, sums: dict[str, Column], statistics: dict[str, Callable], replicates: int, keys: list[str] | None = None, levels: tuple[float, float] = (0.025, 0.975)) -> DataFrame:
    """(keys, statistic, value, low, high, p_above): statistics of sums, their intervals when whole groups are resampled, and the share of
    replicates above 0.

    statistics: name to a function of {sum's name: column}. A replicate takes a group Poisson(1) times; its draw is (a_r h + b_r) mod PRIME with
    md5 bits of the group and the replicate, so reruns agree and any two groups' draws are independent. A task works out the weighted sums of
    all replicates for its groups at once and sends one row a replicate, none for each group; a null group is one too."""
    ship(df.sparkSession)
    keys = keys or []
    h = F.conv(F.substring(F.md5(F.coalesce(F.col(group).cast("string"), F.lit("null"))), 1, 7), 16, 10).cast("long")
    g = df.groupBy(*keys, group).agg(*(F.sum(c).cast("double").alias(n) for n, c in sums.items())).fillna(0.0, list(sums))
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("_"))
    slim = g.select(key.alias("key"), h.alias("h"), F.array(*sums).alias("x"))
    kind = slim.schema["key"].dataType.simpleString()
    names, steps = list(sums), poisson_steps()

    def weighted(batches):
        import pyarrow as pa

        a = np.array([drawn(f"a{r}") + 1 for r in range(1, replicates + 1)], np.int64)
        b = np.array([drawn(f"b{r}") for r in range(1, replicates + 1)], np.int64)
        bounds = np.array(steps)
        for batch in batches:
            codes = batch.column(0).to_pylist()
            x = batch.column(2).flatten().to_numpy().reshape(len(codes), -1)
            hs = batch.column(1).to_numpy()
            of = {}
            for i, k in enumerate(codes):
                of.setdefault(tuple(k.values()), []).append(i)
            for rows in of.values():
                total = np.zeros((replicates, len(names)))
                for i in range(0, len(rows), 512):
                    some = rows[i : i + 512]
                    u = ((hs[some][:, None] * a + b) % PRIME + 0.5) / PRIME
                    total += np.searchsorted(bounds, u).T @ x[some]
                yield pa.RecordBatch.from_arrays([pa.array([codes[rows[0]]] * replicates, batch.schema.field(0).type), pa.array(np.arange(replicates), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["key", "r", "x"])

    each = slim.mapInArrow(weighted, f"key {kind}, r int, x array<double>").groupBy("key", "r").agg(*(F.sum(F.get("x", F.lit(i))).alias(n) for i, n in enumerate(names)))
    of = {n: F.col(n) for n in names}
    rows = lambda d: d.select("key", F.explode(F.array(*(F.struct(F.lit(n).alias("statistic"), f(of).cast("double").alias("v")) for n, f in statistics.items()))).alias("s")).select("key", "s.*")
    point = rows(g.groupBy(key.alias("key")).agg(*(F.sum(n).alias(n) for n in names))).withColumnRenamed("v", "value")
    spread = rows(each).groupBy("key", "statistic").agg(F.percentile("v", F.array(*map(F.lit, levels))).alias("q"), F.avg((F.col("v") > 0).cast("double")).alias("p_above"))
    out = point.join(spread, ["key", "statistic"])
    return out.select(*(F.col(f"key.{k}").alias(k) for k in keys), "statistic", "value", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"), "p_above")


def group_bootstrap(df: DataFrame, group: str, num: Column, den: Column, replicates: int, keys: list[str] | None = None) -> DataFrame:
    """By key (one row without): the ratio of sums, its 95 % interval under resampling of groups, and the share of replicates above 0."""
    ratio = {"ratio": lambda s: s["n"] / F.nullif(s["d"], F.lit(0.0))}
    return resampled(df, group, {"n": num, "d": den}, ratio, replicates, keys).drop("statistic")


class Moments:
    """Weighted cross-products of columns and an outcome; they add up over rows, so folds and resamples are sums of groups' moments."""

    def __init__(self, xs: list[str], y: str, w: str):
        self.cols, self.w, self.p = [*xs, y], w, len(xs)
        one = self.cols + [None]
        self.pairs = [(i, j) for i in range(len(one)) for j in range(i, len(one))]

    def sums(self, times: Column | None = None) -> list[Column]:
        pick = lambda i: F.lit(1.0) if i == len(self.cols) else F.col(self.cols[i])
        w = F.col(self.w) if times is None else F.col(self.w) * times
        return [F.sum(w * pick(i) * pick(j)).alias(f"m{i}_{j}") for i, j in self.pairs]

    def again(self, times: Column) -> list[Column]:
        """Sums of stored moments, each times a multiplicity."""
        return [F.sum(times * F.col(f"m{i}_{j}")).alias(f"m{i}_{j}") for i, j in self.pairs]

    def read(self, row) -> np.ndarray:
        """The symmetric matrix over columns, outcome and one."""
        m = np.zeros((self.p + 2, self.p + 2))
        for i, j in self.pairs:
            m[i, j] = m[j, i] = float(row[f"m{i}_{j}"] or 0.0)
        return m

    def fit(self, m: np.ndarray, alpha: float, free: list[int], scale: float = 100.0) -> tuple[np.ndarray, np.ndarray]:
        """(coefficients, centres) of the weighted ridge without intercept. Columns in `free` are dummies: not centred, and scaled so that the
        penalty hardly holds them; the others are centred by their weighted means. The outcome is as it is."""
        p, one = self.p, self.p + 1
        mean = np.array([0.0 if i in free else m[i, one] / m[one, one] for i in range(p)])
        size = np.array([scale if i in free else 1.0 for i in range(p)])
        xx = m[:p, :p] - np.outer(mean, m[:p, one]) - np.outer(m[:p, one], mean) + np.outer(mean, mean) * m[one, one]
        xy = m[:p, p] - mean * m[p, one]
        b = np.linalg.solve(xx * np.outer(size, size) + alpha * np.eye(p), xy * size) * size
        return b, mean

    def error(self, m: np.ndarray, b: np.ndarray, mean: np.ndarray) -> float:
        """Weighted mean squared error of y against b (x - mean)."""
        p, one = self.p, self.p + 1
        shift = float(b @ mean)
        total = m[p, p] + b @ m[:p, :p] @ b + shift**2 * m[one, one] - 2 * b @ m[:p, p] + 2 * shift * m[p, one] - 2 * shift * (b @ m[:p, one])
        return float(total / m[one, one])


def centred_ridge(df: DataFrame, y: str, xs: list[str], w: str, alpha: float, free: list[str]) -> dict[str, float]:
    """Coefficients of Moments.fit, one aggregation."""
    mo = Moments(xs, y, w)
    b, _ = mo.fit(mo.read(df.agg(*mo.sums()).head()), alpha, [xs.index(f) for f in free])
    return dict(zip(xs, b.tolist()))


def fold_errors(df: DataFrame, fold: str, y: str, xs: list[str], w: str, alphas: list[float], free: list[str] | None = None) -> dict[float, float]:
    """Mean over folds of the weighted squared error on a fold under the fit of the others, by alpha. Rows of no fold take no part."""
    mo = Moments(xs, y, w)
    at = [xs.index(f) for f in free or []]
    return errors_of(mo, [mo.read(r) for r in df.where(F.col(fold).isNotNull()).groupBy(fold).agg(*mo.sums()).orderBy(fold).collect()], alphas, at)


def errors_of(mo: Moments, folds: list[np.ndarray], alphas: list[float], free: list[int]) -> dict[float, float]:
    """fold_errors() from the folds' moments."""
    return {a: float(np.mean([mo.error(m, *mo.fit(sum(folds) - m, a, free)) for m in folds])) for a in alphas}


def ridge_effects(df: DataFrame, group: str, y: str, xs: list[str], w: str, free: list[str], alphas: list[float], folds: int = 5, replicates: int = 200, seed: int = 0) -> dict:
    """Effects of the free dummies and of their differences, with 95 % intervals under resampling of groups; the penalty by folds of whole groups.

    Moments by group are summed once and stored; folds, all rows and replicates are sums of them, so the rows are read once."""
    mo, at = Moments(xs, y, w), [xs.index(f) for f in free]
    by = checkpointed(df.groupBy(group).agg(*mo.sums(), F.count("*").alias("_n")))
    dealt = group_folds(by, group, folds, "_n").withColumnRenamed(group, "_of")
    ms = by.join(dealt, F.col(group).eqNullSafe(F.col("_of")), "left").groupBy("_fold").agg(*mo.again(F.lit(1.0))).orderBy("_fold").collect()  # a row per fold
    ms = [mo.read(r) for r in ms]
    errors = errors_of(mo, ms, alphas, at)
    alpha = min(errors, key=lambda a: (errors[a], a))
    b, _ = mo.fit(sum(ms), alpha, at)
    reps = by.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("k", multiplicity(F.col(group), F.col("r"), seed))
    reps = reps.groupBy("r").agg(*mo.again(F.col("k"))).orderBy("r").collect()  # a row per replicate
    boot = np.array([mo.fit(mo.read(r), alpha, at)[0] for r in reps])
    span = lambda v: [float(x) for x in np.quantile(v, [0.025, 0.975])]
    effects = [(f, float(b[i]), *span(boot[:, i])) for f, i in zip(free, at)]
    diffs = [(f, g, float(b[i] - b[j]), *span(boot[:, i] - boot[:, j]), float((boot[:, i] > boot[:, j]).mean())) for n, (f, i) in enumerate(zip(free, at)) for g, j in list(zip(free, at))[n + 1 :]]
    return {"alpha": alpha, "errors": errors, "effects": effects, "differences": diffs}


#: Queries and rows, about, that one task compares, and pairs that it holds at once.
QUERY_BLOCK, ROW_BLOCK, PAIRS_AT_ONCE = 8_192, 16_384, 1 << 21


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows in pairs, summed in the order of the features."""
    total = np.zeros(len(q))
    for j in range(q.shape[1]):
        d = q[:, j] - x[:, j]
        total += d * d
    return np.sqrt(total)


def near_pairs(q: np.ndarray, q_key: np.ndarray, x: np.ndarray, x_key: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the k nearest rows of each query; ties go to the earlier row, which must have the lesser key. Rows of a query's
    own key don't count.

    Distances by a product are off by rounding only. They leave out what is farther than the k nearest by more than that can be; the rest is worked
    out in full. So are rows that are too large for products or not finite."""
    if not len(q) or not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    # of equal rows only the first k of each of the first k + 1 keys can be among the nearest
    if len(x) > k + 1:
        same = np.unique(np.ascontiguousarray(x + 0.0).view(np.dtype((np.void, 8 * x.shape[1])))[:, 0], return_inverse=True)[1].ravel() if x.shape[1] else np.zeros(len(x), np.int64)
        order = np.argsort(same, kind="stable")
        s, c = same[order], x_key[order]
        at = np.arange(len(x))
        group = np.r_[True, s[1:] != s[:-1]]
        key = group | np.r_[True, c[1:] != c[:-1]]
        nth_key = np.cumsum(key) - np.maximum.accumulate(np.where(group, np.cumsum(key), 0))
        nth = at - np.maximum.accumulate(np.where(key, at, 0))
        rows = np.sort(order[(nth_key <= k) & (nth < k)])
    else:
        rows = np.arange(len(x))
    x, x_key = x[rows], x_key[rows]
    with np.errstate(all="ignore"):
        q_size, x_size = (q * q).sum(1), (x * x).sum(1)
        q_fine, x_fine = q_size < 1e300, x_size < 1e300  # not so if it is NaN
        x_plain, x_odd = np.flatnonzero(x_fine), np.flatnonzero(~x_fine)
        off = 8.0 * (x.shape[1] + 8) * np.finfo(float).eps
        found = []
        step = max(PAIRS_AT_ONCE // len(x), 1)
        for i in range(0, len(q), step):
            some = np.arange(i, min(i + step, len(q)))
            fine, odd = some[q_fine[some]], some[~q_fine[some]]
            pairs = [(np.repeat(odd, len(x)), np.tile(np.arange(len(x)), len(odd))), (np.repeat(fine, len(x_odd)), np.tile(x_odd, len(fine)))]
            if len(fine) and len(x_plain):
                near = q[fine] @ x[x_plain].T
                near *= -2.0
                size = q_size[fine][:, None] + x_size[x_plain]
                near += size
                size *= off
                size += 1e-300  # squares below the least double
                least = near - size
                near += size
                near[q_key[fine][:, None] == x_key[x_plain]] = np.inf
                bound = np.partition(near, k - 1, 1)[:, k - 1] if len(x_plain) > k else np.full(len(fine), np.inf)
                a, b = np.nonzero(least <= bound[:, None])
                pairs.append((fine[a], x_plain[b]))
            a, b = (np.concatenate(c) for c in zip(*pairs))
            other = q_key[a] != x_key[b]
            a, b = a[other], b[other]
            d = np.concatenate([distances(q[a[j : j + 65_536]], x[b[j : j + 65_536]]) for j in range(0, len(a), 65_536)] or [np.zeros(0)])
            order = np.lexsort((b, d, a))
            a, b, d = a[order], b[order], d[order]
            first = np.r_[True, a[1:] != a[:-1]] if len(a) else np.zeros(0, bool)
            nth = np.arange(len(a)) - np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))
            found.append((a[nth < k], rows[b[nth < k]], d[nth < k]))
    return tuple(np.concatenate(c) for c in zip(*found))


def nearest_rows(queries: DataFrame, rows: DataFrame, key: str, features: str, k: int, blocks: int) -> DataFrame:
    """(query, key, distance, rank): the k nearest other rows by Euclidean distance, ties by key. Where one side is null, holds a null or
    has another length, the distance is null and comes last.

    Every query meets every row. Both are dealt into blocks (of rows, so many at least), and two blocks meet in a task that keeps its k best of
    each query, so that neither memory nor what is kept grows with the tables."""
    ship(queries.sparkSession)
    x = F.col(features).cast("array<double>")
    size = F.when(x.isNotNull() & F.forall(x, lambda v: v.isNotNull()), F.size(x)).otherwise(-1)
    q, r = queries.where(F.col(key).isNotNull()).select(F.col(key).alias("query"), x.alias("q"), size.alias("size")), rows.where(F.col(key).isNotNull()).select(key, x.alias("x"), size.alias("size"))
    n_q, n_r = -(-q.count() // QUERY_BLOCK) or 1, max(blocks, -(-r.count() // ROW_BLOCK))
    q = q.select("*", F.pmod(F.xxhash64("query"), F.lit(n_q)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_r - 1))).alias("rb"))
    r = r.select("*", F.pmod(F.xxhash64(key), F.lit(n_r)).cast("int").alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb"))
    kind = r.schema[key].dataType
    n = max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_q * n_r)

    def nearest_of_block(left, right):
        import pyarrow as pa
        import pyarrow.compute as pc

        right = right.sort_by(key)
        keys, names = right[key].combine_chunks(), left["query"].combine_chunks()
        codes = keys.dictionary_encode()
        x_key, q_key = codes.indices.to_numpy(zero_copy_only=False), pc.index_in(names, value_set=codes.dictionary).fill_null(-1).to_numpy(zero_copy_only=False)
        x_size, q_size = right["size"].to_numpy(), left["size"].to_numpy()

        def features_of(table, column, at, width):
            some = table[column].take(pa.array(at)).combine_chunks()
            return some.flatten().to_numpy(zero_copy_only=False).reshape(len(at), width)

        a, b, d = [], [], []
        for width in np.unique(q_size):
            of_q, of_x = np.flatnonzero(q_size == width), np.flatnonzero(x_size == width) if width >= 0 else np.zeros(0, np.int64)
            i, j, e = near_pairs(features_of(left, "q", of_q, width), q_key[of_q], features_of(right, "x", of_x, width), x_key[of_x], k) if len(of_x) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            a.append(of_q[i])
            b.append(of_x[j])
            d.append(pa.array(e))
            unknown = np.flatnonzero(x_size != width) if width >= 0 else np.arange(len(x_size))
            for m in np.flatnonzero(np.bincount(i, minlength=len(of_q)) < k) if len(unknown) else ():
                fill = []
                for row in unknown:
                    if len(fill) == k:
                        break
                    if x_key[row] != q_key[of_q[m]]:
                        fill.append(row)
                a.append(np.full(len(fill), of_q[m]))
                b.append(np.array(fill, np.int64))
                d.append(pa.nulls(len(fill), pa.float64()))
        a, b = np.concatenate(a or [np.zeros(0, np.int64)]), np.concatenate(b or [np.zeros(0, np.int64)])
        return pa.table({"query": names.take(pa.array(a)), key: keys.take(pa.array(b)), "distance": pa.chunked_array(d, pa.float64())})

    cell = ["qb", "rb"]
    sides = q.repartition(n, *cell).groupBy(*cell).cogroup(r.repartition(n, *cell).groupBy(*cell))
    best = sides.applyInArrow(nearest_of_block, f"query {kind.simpleString()}, `{key}` {kind.simpleString()}, distance double")
    w = Window.partitionBy("query").orderBy(F.col("distance").asc_nulls_last(), key)
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dealing(histogram: list[tuple[int, int]], folds: int) -> list[tuple[int, int, list[int], list[int]]]:
    """(size, first, steps, cycle) for a histogram of group sizes, largest first: `first` groups are larger; the groups of a size go to the folds
    in steps, then to those in cycle over and over. Each group goes to the lightest fold, the first of equals.

    Once the folds are less than a group's size apart, each takes one in turn, so equal groups need no step of their own."""
    load, first, out = [0] * folds, 0, []
    for size, n in sorted(histogram, reverse=True):
        steps, left = [], n
        while left and max(load) - min(load) >= size:
            f = load.index(min(load))
            load[f] += size
            steps.append(f)
            left -= 1
        cycle = sorted(range(folds), key=lambda f: (load[f], f))
        for k, f in enumerate(cycle):
            load[f] += (left // folds + (k < left % folds)) * size
        out.append((size, first, steps, cycle))
        first += n
    return out


def group_folds(df: DataFrame, group: str, folds: int, size: str | None = None) -> DataFrame:
    """(group, fold): whole groups of df's rows, from the largest to the lightest fold, equal sizes by group; a null group is one too. A column
    of sizes counts in place of the rows.

    The driver sees the histogram of sizes only: different sizes of N rows number less than the root of 2 N. Groups are numbered by range."""
    sizes = df.groupBy(group).agg((F.sum(size) if size else F.count("*")).alias("_size"))
    sizes = numbered(sizes, [F.desc("_size"), F.col(group)], "_nr")
    plan = dealing([(r["_size"], r["n"]) for r in sizes.groupBy("_size").agg(F.count("*").alias("n")).collect()], folds)
    rows = df.sparkSession.createDataFrame(plan, "_size long, _first long, _steps array<int>, _cycle array<int>")
    at = F.col("_nr") - F.col("_first") - 1
    fold = F.coalesce(F.get("_steps", at.cast("int")), F.get("_cycle", ((at - F.size("_steps")) % folds).cast("int")))
    return sizes.join(rows, "_size").select(group, fold.alias("_fold"))


def ridge_by_group(df: DataFrame, group: str, y: str, xs: list[str], w: str, alphas: list[float], folds: int = 5, free: list[str] | None = None) -> tuple[float, dict[float, float]]:
    """(best alpha, error by alpha) by folds of whole groups, errors as fold_errors() has them: weighted within a fold, then averaged.

    Folds are dealt by size whatever the number of groups; a null group is one too.
    """
    dealt = group_folds(df, group, folds)
    rows = df.join(dealt.withColumnRenamed(group, "_of"), F.col(group).eqNullSafe(F.col("_of")), "left").drop("_of")
    error = fold_errors(rows, "_fold", y, xs, w, alphas, free)
    return min(error, key=lambda a: (error[a], a)), error


def choose_k(rows: list[dict], best_high: list[str], best_low: list[str]) -> int:
    """The k with the least sum of average ranks over the criteria; ties go to the smaller k."""
    score = {r["k"]: 0.0 for r in rows}
    for name, sign in [(n, -1) for n in best_high] + [(n, 1) for n in best_low]:
        v = [sign * r[name] for r in rows]
        for r, x in zip(rows, v):
            score[r["k"]] += sum(o < x for o in v) + (sum(o == x for o in v) + 1) / 2
    return min(score, key=lambda k: (score[k], k))


def described_clusters(df: DataFrame, cluster: str, features: list[str], least: float = 0.3, most: int = 2) -> DataFrame:
    """Mean of each standardised feature by cluster, and its strongest features above and below `least` as text."""
    means = df.groupBy(cluster).agg(*(F.avg(f).alias(f) for f in features))
    pairs = F.array(*(F.struct(F.col(f).alias("z"), F.lit(f).alias("name")) for f in features))
    high = F.slice(F.sort_array(F.filter(pairs, lambda x: x["z"] > least), False), 1, most)
    low = F.slice(F.sort_array(F.filter(pairs, lambda x: x["z"] < -least)), 1, most)
    return means.withColumn("high", F.array_join(high["name"], ", ")).withColumn("low", F.array_join(low["name"], ", "))


def save_bundle(df: DataFrame, features: str, k_parts: int, k: int, path: str, seed: int = 42):
    """Fit and write scaler, PCA and k-means as one pipeline model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler

    steps = [StandardScaler(inputCol="_v", outputCol="_z", withMean=True), PCA(k=k_parts, inputCol="_z", outputCol="_p"), KMeans(k=k, seed=seed, featuresCol="_p", predictionCol="cluster")]
    model = Pipeline(stages=steps).fit(df.withColumn("_v", array_to_vector(F.col(features).cast("array<double>"))))
    model.write().overwrite().save(path)
    return model


def profile_distance(df: DataFrame, axes: list[str], focus: Column) -> DataFrame:
    """df with its Euclidean distance from the mean of the focus rows on the axes. One row is broadcast."""
    centre = df.where(focus).agg(*(F.avg(a).alias(f"_{a}") for a in axes))
    square = reduce(lambda x, y: x + y, ((F.col(a) - F.col(f"_{a}")) * (F.col(a) - F.col(f"_{a}")) for a in axes))
    return df.crossJoin(F.broadcast(centre)).withColumn("distance", F.sqrt(square)).drop(*(f"_{a}" for a in axes))


def relabelled(df: DataFrame, cluster: str, by: str) -> DataFrame:
    """Clusters numbered from 0 by falling mean of a column, ties by their old number; numbered by range, however many there are."""
    means = df.groupBy(cluster).agg(F.avg(by).alias("_mean"))
    number = numbered(means, [F.desc("_mean"), F.col(cluster)], "_number").select(cluster, (F.col("_number") - 1).cast("int").alias("_number"))
    return df.join(number, cluster).withColumn(cluster, F.col("_number")).drop("_number")