"""Toxicity severity by cumulative-link (proportional odds) regression on sparse text features.

One weight vector is shared by ordered thresholds: P(grade >= k) = sigmoid(score - cut_k). The expected severity is the sum
of those probabilities. Features are the presence of lower-cased words and of word beginnings, chosen by chi-square.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, store, table

#: Labelled rows that the classifier is fitted on, chosen by a hash of their id.
LABELLED_ROWS = 20_000
#: Features kept at most, and documents that a feature needs at least.
FEATURES, LEAST_DOCS = 8_192, 5
#: Least chi-square (one degree of freedom) of a feature: chance alone reaches it once in about 10^7 features.
LEAST_CHI = 28.0
WORD = re.compile(r"\w+")
BEGINNINGS = (4, 5)
#: Entries of a worker's cache of word scores.
CACHE = 400_000


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in BEGINNINGS if len(word) > k)]


@dataclass
class Model:
    weights: dict[str, float]
    cuts: list[float]

    def probabilities(self, score: float) -> list[float]:
        return [1 / (1 + np.exp(-np.clip(score - c, -500, 500))) for c in self.cuts]


class Scores(dict):
    """Scores of words under a model, worked out when missing; emptied when full."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE:
            self.clear()
        got = self[word] = sum(self.weights.get(f, 0.0) for f in features_of(word))
        return got


def fit_cumulative(rows: list[np.ndarray], grades: np.ndarray, n_features: int, *, l2: float = 1e-5, steps: int = 600, rate: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered cuts by Adam on the penalised likelihood. rows: each row's feature indices (with repeats)."""
    top = int(grades.max()) if len(grades) else 0
    if top == 0:
        return np.zeros(n_features), np.array([np.inf])
    at = np.concatenate(rows) if rows else np.zeros(0, int)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    share = np.array([(grades >= k).mean() for k in range(1, top + 1)])
    cut0 = -np.log(np.clip(share, 1e-6, 1 - 1e-6) / (1 - np.clip(share, 1e-6, 1 - 1e-6)))
    gaps = np.maximum(np.diff(cut0), 1e-3)
    p = np.concatenate([np.zeros(n_features), [cut0[0]], np.log(gaps)])
    m, v = np.zeros_like(p), np.zeros_like(p)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    n = len(grades)
    for t in range(1, steps + 1):
        w, first, step = p[:n_features], p[n_features], np.exp(p[n_features + 1 :])
        cuts = np.concatenate([[first], first + np.cumsum(step)])
        score = np.bincount(of, w[at], n)
        # P(grade = g) = F(g) - F(g + 1), F(0) = 1, F(top + 1) = 0
        low = np.where(grades > 0, sig(score - cuts[np.maximum(grades - 1, 0)]), 1.0)
        high = np.where(grades < top, sig(score - cuts[np.minimum(grades, top - 1)]), 0.0)
        prob = np.maximum(low - high, 1e-12)
        d_low, d_high = low * (1 - low), high * (1 - high)
        d_score = -(d_low - d_high) / prob / n
        d_cut = np.zeros(top)
        np.add.at(d_cut, np.maximum(grades - 1, 0)[grades > 0], (d_low / prob / n)[grades > 0])
        np.add.at(d_cut, np.minimum(grades, top - 1)[grades < top], -(d_high / prob / n)[grades < top])
        g = np.concatenate([np.bincount(at, d_score[of], n_features) + l2 * w, [d_cut.sum()], [d_cut[k + 1 :].sum() * step[k] for k in range(top - 1)]])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    step = np.exp(p[n_features + 1 :])
    return p[:n_features], np.concatenate([[p[n_features]], p[n_features] + np.cumsum(step)])


def grade_of(quality: Column, toxic: Column) -> Column:
    """0 clean, 1 toxic, 2 toxic and of bad quality."""
    return F.when(F.coalesce(toxic, F.lit(0)) <= 0, 0).when(quality == 0, 2).otherwise(1)


def fit(docs: DataFrame, grades: DataFrame, *, most: int = LABELLED_ROWS) -> Model:
    """Fit on `most` rows of grades (doc_id, grade) that have a document. Without a graded document, nothing is toxic.

    Rows of one doc_id count once, with the highest grade; null ids and grades are left out.
    """
    ship(docs.sparkSession)
    picked = grades.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # most ids of 12 bytes: a proven bound
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").where(F.col("text").isNotNull()).select("text", "grade")
    # copies count once: a feature needs different documents
    sample = store(sample.groupBy(F.sha2("text", 256)).agg(F.first("text").alias("text"), F.max("grade").alias("grade")).select("text", "grade"), "labelled")

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            all_, bad = Counter(), Counter()
            for t, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = {f for w in set(WORD.findall(t.lower())) for f in features_of(w)}
                all_.update(found)
                if g:
                    bad.update(found)
            f = list(all_)
            yield pa.RecordBatch.from_pydict({"feature": pa.array(f, pa.string()), "n": pa.array([all_[x] for x in f], pa.int64()), "bad": pa.array([bad[x] for x in f], pa.int64())})

    n, n_bad = sample.agg(F.count("*"), F.coalesce(F.sum((F.col("grade") > 0).cast("int")), F.lit(0))).first()
    if not n_bad or n_bad == n:
        return Model({}, [float("inf") if not n_bad else float("-inf")])
    counted = sample.mapInArrow(count, "feature string, n long, bad long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).where(F.col("n") >= LEAST_DOCS)
    off = F.col("bad") - F.col("n") * (n_bad / n)
    rate = n_bad / n
    chi = off * off / (F.col("n") * rate * (1 - rate) * (1 - F.col("n") / float(n + 1)))
    chosen = [r[0] for r in counted.where(chi >= LEAST_CHI).orderBy(chi.desc(), "feature").limit(FEATURES).collect()]
    index = {f: i for i, f in enumerate(chosen)}
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def rows(batches):
        import pyarrow as pa

        at = shared.value
        for batch in batches:
            found = [[at[f] for w in set(WORD.findall(t.lower())) for f in features_of(w) if f in at] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([np.array(x, np.int32).tobytes() for x in found], pa.binary()), batch.column(1)], ["at", "grade"])

    got = sample.mapInArrow(rows, "at binary, grade int").collect()
    w, cuts = fit_cumulative([np.frombuffer(bytes(r[0]), np.int32) for r in got], np.array([r[1] for r in got]), len(chosen))
    return Model({f: float(x) for f, x in zip(chosen, w) if abs(x) > 1e-6}, [float(c) for c in cuts])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs' columns plus severity (expected grade), p_toxic (P(grade >= 1)) and toxic (p_toxic >= 0.5) of every whole text.

    A null or empty text has the score 0. Rows map to rows, so ties and repeated rows score alike and an empty table gives no
    rows. Columns of docs with the new names are replaced.
    """
    ship(docs.sparkSession)
    new = ("severity", "p_toxic", "toxic")
    docs = docs.select(*(c for c in docs.columns if c not in new))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        import pyarrow as pa

        m = shared.value
        seen = Scores(m.weights)
        for batch in batches:
            p = [m.probabilities(sum(map(seen.__getitem__, sorted(set(WORD.findall((x.as_py() or "").lower())))))) for x in batch.column("text")]
            extra = [pa.array([sum(x) for x in p], pa.float64()), pa.array([x[0] for x in p], pa.float64()), pa.array([x[0] >= 0.5 for x in p], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, *new])

    from pyspark.sql.types import BooleanType, DoubleType, StructType

    schema = StructType(list(docs.schema.fields)).add("severity", DoubleType()).add("p_toxic", DoubleType()).add("toxic", BooleanType())
    return docs.mapInArrow(rows, schema)


def grades_table(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", grade_of(F.col("quality"), F.col("toxic")).alias("grade"))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs, grades_table(table(spark, sf_dir, "labels")))).drop("text")


def pipeline_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not toxic, as they came.

    Null and empty texts and null ids stay (without a feature nothing is toxic while most labelled rows are clean); repeated rows stay or go
    together; without labels nothing goes; an empty table gives no rows; columns of any name are kept."""
    model = fit(docs, grades_table(table(spark, sf_dir, "labels")))
    put = {c: c for c in docs.columns}
    for c in ("severity", "p_toxic", "toxic"):
        while c in put and put[c] in docs.columns:
            put[c] += "_"
    found = score(docs.select(*(F.col(f"`{c}`").alias(n) for c, n in put.items())), model).where("not toxic")
    return found.select(*(F.col(f"`{n}`").alias(c) for c, n in put.items()))
