"""Rows of one id with different texts, very long texts, and hostile archives."""

import gzip
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineflux.llm import bwt, minhash, repeats, suffix_tree, warc


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))


A, B = words(1, 60), words(2, 60)
KIND = "doc_id long, text string"


def test_words_of_other_texts_of_an_id_stay(spark):
    rows = [(1, A), (2, A), (2, B), (3, B + " end"), (3, "short"), (3, None), (None, A)]
    got = {(r.doc_id, r.kept): r.n_removed for r in suffix_tree.dedup_windows(spark.createDataFrame(rows, KIND)).collect()}
    assert got == {(1, A): 0, (2, ""): 60, (2, B): 0, (3, "end"): 60, (3, "short"): 0, (3, ""): 0, (None, A): 0}


def test_bytes_of_other_texts_of_an_id_stay(spark):
    rows = [(1, A), (2, A), (2, B), (3, B + " end"), (3, "short"), (3, "short"), (None, A)]
    got = sorted((r.doc_id or 0, r.n_removed, bytes(r.kept).decode()) for r in bwt.dedup_strings(spark.createDataFrame(rows, KIND)).collect())
    assert got == sorted([(1, 0, A), (2, len(A), ""), (2, 0, B), (3, len(B), " end"), (3, 0, "short"), (3, 0, "short"), (0, 0, A)])


def test_components_of_other_texts_of_an_id(spark):
    rows = [(5, A), (7, A), (7, B), (7, B), (9, B), (9, words(3, 60)), (8, "few"), (None, B)]
    found = minhash.near_duplicates(spark.createDataFrame(rows, KIND)).collect()
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in found)
    assert got == sorted([(5, 5, True), (7, 5, False), (7, 7, True), (7, 7, True), (9, 7, False), (9, 9, True), (8, 8, True), (0, 0, True)])
    kept = minhash.pipeline_stage(spark, spark.createDataFrame(rows, KIND), "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(5, A), (7, B), (7, B), (9, words(3, 60)), (8, "few"), (0, B)])


@pytest.mark.parametrize("length", [13, 100])
def test_stretches_hold_each_window_once(length, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 64)
    for n in (0, 1, length - 1, length, 63 + length, 64 + length, 65 + length, 1000):
        x = np.arange(n, dtype=np.uint64)
        got = [at + k for at, s, first in repeats.stretches_of(x, np.array([0, n]), length) for k in range(first[1] - length + 1) if (s[k : k + length] == x[at + k : at + k + length]).all()]
        assert got == list(range(max(0, n - length + 1)))


def test_long_texts_in_stretches(spark, monkeypatch):
    # the worker sees the module's own value, so the text is longer than that
    long = words(4, repeats.CHUNK // 5)
    rows = [(1, long[1000:2000] + " x"), (2, long), (3, words(6, 20) + long[-5000:])]
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in bwt.dedup_strings(spark.createDataFrame(rows, KIND)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {1: (0, sha(rows[0][1])), 2: (1000, sha(long[:1000] + long[2000:])), 3: (5000, sha(words(6, 20)))}


def test_windows_of_hot_keys_travel_without_their_bytes(spark):
    # so many surroundings of one passage that its first and last keys are hot
    shared = words(7, 40)
    rows = [(k, f"{words(100 + k, 20)} {shared} {words(9000 + k, 20)}") for k in range(2 * repeats.HOT)]
    rows += [rows[5], (3 * repeats.HOT, shared)]
    docs = spark.createDataFrame(rows, KIND).select("doc_id", F.col("text").cast("binary").alias("text")).repartition(2)
    found = repeats.candidates(docs, bwt.symbolize, bwt.LENGTH, bwt.GRAM, within_doc=True, deciding=True, context=bwt.CONTEXT)
    hot = {r.key for r in found.where(F.col("kind") == repeats.HOT_KEY).collect()}
    asked = found.where(F.col("kind") == repeats.REQUEST).collect()
    got = bwt.segment_texts(docs.join(repeats.asked(found), "doc_id").select("doc_id", "text", "spans")).collect()
    assert hot and sum(len(r.text) for r in got if r.text) <= 2 * sum(r.n + bwt.LENGTH - 1 for r in asked if r.key not in hot)
    assert {(r.doc_id, r.at + k) for r in got if r.text is None for k in range(r.n)} == {(r.doc_id, r.at + k) for r in asked if r.key in hot for k in range(r.n)}
    seen, want = set(), {}
    for i, t in sorted(dict(rows).items()):
        cut = np.zeros(len(t), bool)
        for k in range(len(t) - 99):
            cut[k : k + 100] |= t[k : k + 100] in seen
            seen.add(t[k : k + 100])
        want[i] = (int(cut.sum()), hashlib.sha256(bytes(b for b, c in zip(t.encode(), cut) if not c)).hexdigest())
    result = bwt.dedup_strings(docs).collect()
    assert len(result) == len(rows) and all((r.n_removed, r.kept_sha256) == want[r.doc_id] for r in result)


def test_windows_come_in_runs():
    doc, at = np.array([2, 1, 1, 1, 1, 2]), np.array([4, 7, 5, 6, 9, 5])
    assert [tuple(map(int, x)) for x in zip(*bwt.runs(doc, at))] == [(1, 5, 3), (1, 9, 1), (2, 4, 2)]
    n = 3 * bwt.RUN
    d, a, m = bwt.runs(np.zeros(n, int), np.arange(n) + 5)
    assert m.sum() == n and m.max() <= bwt.RUN and (a[1:] == a[:-1] + m[:-1]).all()
    assert [len(x) for x in bwt.runs(np.zeros(0, int), np.zeros(0, int))] == [0, 0, 0]


RECORD = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"


def test_members_nested_deeply_are_gaps():
    data = RECORD
    for _ in range(1500):
        data = gzip.compress(data, 1, mtime=0)
    found = list(warc.salvage(data + RECORD))
    assert [f.fault is None for f in found] == [False, True] and found[0].end == len(data) == found[1].first


def test_members_of_too_many_bytes_are_gaps():
    bomb = gzip.compress(RECORD + b"\0" * 50_000_000, 9, mtime=0)
    found = list(warc.salvage(bomb + gzip.compress(RECORD, mtime=0), 0, 1 << 20))
    assert [f.fault for f in found] == [None, "gzip member of too many bytes", None]
    assert len(warc.inflate(memoryview(bomb), 0, 1 << 20)[0]) <= (1 << 20) + 64


def test_members_within_members_are_read():
    once = gzip.compress(gzip.compress(RECORD, mtime=0), mtime=0)
    assert [f.fault for f in warc.salvage(once)] == [None]
