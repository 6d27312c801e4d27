"""Candidates for repeated windows, shared by the substring operators.

A text is a sequence of symbols (bytes or words). Of each window of `length` symbols the least hash of its grams is the key, so
equal windows have equal keys. Consecutive windows with one key form a segment; segments with equal hashes are one class.
Windows whose key occurs once in all documents repeat nothing and are left out; the other segments are requested for the operator's
own method. With `deciding`, the first segment of a class stands for its copies, told by the hashes of key and segment (128 bits,
under a secret of the run), and only keys with several classes (or a segment that may repeat itself) are requested.

Records travel as packed arrays, one row for each task and bucket of keys. Copies within one batch are not sent again, so a key
that all documents share sends one record per batch and class. A key with many classes (a common passage in ever new
surroundings) is hot: its windows are to be compared one by one instead of by segment.
"""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_view, chunks, few, mix64, powers, ship, sliding_min, store

#: Classes of a key in a batch or bucket from which it is hot.
HOT = 256
#: Buckets of keys for each shuffle partition at least, and bytes of text whose records fill a bucket.
BUCKETS_PER_PARTITION, BUCKET_BYTES = 16, 32 << 20
#: Bytes of texts, and symbols of one longer text, whose segments are worked out at once (about 100 bytes of memory each).
CHUNK = 1 << 19
#: Hot keys (8 bytes each) that are broadcast.
FEW_HOT = 1_000_000
FIELDS = [("key", "<u8"), ("seg", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("n", "u1"), ("flag", "u1")]
MULTI, HOT_MARK, SHARED = 1, 2, 4
#: Kinds of rows that candidates() returns: windows that only repeat earlier ones, requested segments, and hot keys.
REPEAT, REQUEST, HOT_KEY = 0, 1, 2


def segments(symbols: np.ndarray, first: np.ndarray, length: int, gram: int, context: int) -> dict[str, np.ndarray]:
    """The fields of the segments of rows of symbol hashes, and their rows. first: where each row begins, and the end; a symbol's
    hash covers `context` symbols from its place on. A segment has as many windows at most as a gram lasts; only periodic texts reach it."""
    total, longest = len(symbols), length - gram + 1
    none = {k: np.zeros(0, np.int64) for k in ("row", "at", "n", "key", "seg", "multi")}
    if total < length:
        return none
    power, back = powers(total + 1)
    span = gram - context + 1
    sums = np.zeros(total + 1, np.uint64)
    np.cumsum(symbols * power[:total], out=sums[1:])
    grams = mix64((sums[span:] - sums[: total + 1 - span]) * back[: total + 1 - span])
    least = sliding_min(grams, length - gram + 1)
    count = np.maximum(np.diff(first) - length + 1, 0)
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = np.repeat(first[:-1], count) + within
    if not len(start):
        return none
    value = least[start]
    new = np.ones(len(start), bool)
    new[1:] = (value[1:] != value[:-1]) | (within[1:] == 0)
    head = np.flatnonzero(new)
    run = np.diff(np.append(head, len(start)))
    pieces = -(-run // longest)
    step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    head = np.repeat(head, pieces) + step * longest
    n = np.minimum(np.repeat(run, pieces) - step * longest, longest)
    s = start[head]
    e = s + n + length - context  # after the last symbol whose context ends within the segment
    key = value[head]
    seg = mix64((sums[e] - sums[s]) * back[s] + n.astype(np.uint64))
    # a segment can only repeat itself if its least gram occurs in it twice
    rows_of = np.searchsorted(first, s, side="right") - 1
    width = n + length - gram
    flat = np.repeat(s, width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
    equal = (grams[flat] == np.repeat(key, width)).astype(np.int64)
    multi = np.add.reduceat(equal, np.cumsum(width) - width) > 1
    return {"row": rows_of, "at": s - first[rows_of], "n": n, "key": mix64(key), "seg": seg, "multi": multi}


def stretches_of(symbols: np.ndarray, first: np.ndarray, length: int):
    """(place, symbols, first): the rows as they are, or one long row cut into stretches that overlap, so that each window is in one."""
    if len(first) > 2 or len(symbols) <= CHUNK + length:
        yield 0, symbols, first
        return
    for at in range(0, len(symbols) - length + 1, CHUNK):
        stretch = symbols[at : at + CHUNK + length - 1]
        yield at, stretch, np.array([0, len(stretch)], first.dtype)


def classes_of(r: np.ndarray, within_doc: bool) -> tuple[np.ndarray, ...]:
    """Sorted records; which of them only repeat the first of their class; and of each one's key the number of classes (above HOT where
    marked as hot) and whether different documents (within_doc: places) share it.

    within_doc: a window may repeat one of its own document; otherwise only one of a smaller document."""
    r = r[np.lexsort((r["at"], r["doc"], r["seg"], r["key"]))]
    if not len(r):
        return r, np.zeros(0, bool), np.zeros(0, int), np.zeros(0, bool)
    new_key = np.ones(len(r), bool)
    new_key[1:] = r["key"][1:] != r["key"][:-1]
    new = new_key.copy()
    new[1:] |= r["seg"][1:] != r["seg"][:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))
    # equal records come of repeated rows of one document
    copy = ((r["doc"] != r["doc"][head]) | (r["at"] != r["at"][head])) if within_doc else r["doc"] > r["doc"][head]
    of = np.cumsum(new_key) - 1
    per_key = lambda x: np.bincount(of, x, of[-1] + 1)[of]
    lead = np.maximum.accumulate(np.where(new_key, np.arange(len(r)), 0))
    other = (r["doc"] != r["doc"][lead]) | (within_doc & (r["at"] != r["at"][lead]))
    shared = per_key(other | ((r["flag"] & SHARED) > 0)) > 0
    return r, copy, np.where(per_key(r["flag"] & HOT_MARK) > 0, HOT + 1, per_key(new).astype(int)), shared


OUT = "kind int, doc_id long, at int, n int, key long"


def candidates(docs: DataFrame, symbolize, length: int, gram: int, *, within_doc: bool, deciding: bool, context: int = 1) -> DataFrame:
    """(kind, doc_id, at, n, key): windows [at, at + n) that only repeat earlier ones, segments whose texts are needed, and hot keys.

    docs: doc_id (no nulls), text (binary). symbolize(data, offsets, secret): symbol hashes and each row's first symbol."""
    ship(docs.sparkSession)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(BUCKETS_PER_PARTITION * partitions, -(-size // BUCKET_BYTES))
    partitions = max(partitions, buckets // BUCKETS_PER_PARTITION)
    secret = int.from_bytes(os.urandom(8), "little")
    record = np.dtype(FIELDS)
    names = [x.split()[0] for x in OUT.split(", ")]

    def scan(batches):
        import pyarrow as pa

        schema = pa.schema([("bucket", pa.int32()), ("records", pa.binary()), ("known", pa.binary())])
        for batch in batches:
            data, offsets = binary_view(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            made = []
            for i, j in chunks(offsets, CHUNK):
                symbols, first = symbolize(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], np.uint64(secret))
                for at, stretch, ends in stretches_of(symbols, first, length):
                    got = segments(stretch, ends, length, gram, context)
                    r = np.zeros(len(got["row"]), record)
                    r["doc"], r["flag"] = ids[i:j][got["row"]], got["multi"] * MULTI
                    for f in record.names:
                        if f not in ("doc", "flag"):
                            r[f] = got[f]
                    r["at"] += np.uint32(at)
                    made.append(r)
            r, copy, classes, shared = classes_of(np.concatenate(made) if made else np.zeros(0, record), within_doc)
            hot = classes > HOT
            lead = np.ones(len(r), bool)
            lead[1:] = r["key"][1:] != r["key"][:-1]
            # what is settled here: copies of a class, and the segments of a hot key
            known = copy | (hot & ~lead)
            kept = r[known].copy()
            kept["flag"] = np.where(copy[known] & deciding, REPEAT, REQUEST)
            send = r[~known].copy()
            send["flag"] |= (hot[~known] * HOT_MARK + shared[~known] * SHARED).astype("u1")
            send = send[np.lexsort((send["at"], send["doc"]))]
            b = (send["key"] % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(b, kind="stable")
            b, send = b[order], send[order]
            cuts = np.flatnonzero(np.diff(b)) + 1
            parts = np.split(send, cuts) if len(send) else []
            blobs = [b"".join(np.ascontiguousarray(p[f]).tobytes() for f in record.names) for p in parts]
            heads = [int(x[0]) for x in np.split(b, cuts)] if len(send) else []
            yield pa.RecordBatch.from_arrays([pa.array([*heads, None], pa.int32()), pa.array([*blobs, None], pa.binary()), pa.array([*[None] * len(heads), kept.tobytes()], pa.binary())], schema=schema)

    def reduce_(batches):
        import pyarrow as pa

        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]

        def emit(r, kind):
            cols = [kind.astype(np.int32), np.ascontiguousarray(r["doc"]), r["at"].astype(np.int32), r["n"].astype(np.int32), np.ascontiguousarray(r["key"]).view(np.int64)]
            for k in range(0, len(r), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 50_000], t) for c, t in zip(cols, kinds)], names)

        held, now = [], None

        def finish():
            r, copy, classes, shared = classes_of(np.concatenate(held), within_doc)
            ask = ~copy & ((classes > 1) | ((r["flag"] & MULTI) > 0)) if deciding else shared | (classes > HOT)
            out = ask | copy
            yield from emit(r[out], np.where(ask, REQUEST, REPEAT)[out])
            head = np.ones(len(r), bool)
            head[1:] = r["key"][1:] != r["key"][:-1]
            head &= classes > HOT
            yield from emit(r[head], np.full(int(head.sum()), HOT_KEY))

        for batch in batches:
            for bucket, blob, known in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if bucket is None:
                    r = np.frombuffer(known.as_py(), record)
                    yield from emit(r, r["flag"])
                    continue
                if bucket != now and held:
                    yield from finish()
                    held.clear()
                now = bucket
                blob = blob.as_py()
                k, at = len(blob) // record.itemsize, 0
                r = np.zeros(k, record)
                for f in record.names:
                    width = record[f].itemsize * k
                    r[f] = np.frombuffer(blob, record[f], k, at)
                    at += width
                held.append(r)
        if held:
            yield from finish()

    scanned = docs.mapInArrow(scan, "bucket int, records binary, known binary")
    spread = F.when(F.col("bucket").isNull(), F.pmod(F.xxhash64("known"), F.lit(1 << 20))).otherwise(F.col("bucket")).cast("int")
    dealt = scanned.withColumn("part", spread).repartition(partitions, "part").sortWithinPartitions("bucket").select("bucket", "records", "known")
    return store(dealt.mapInArrow(reduce_, OUT), "segments")


def asked(found: DataFrame) -> DataFrame:
    """doc_id and its requested segments (at, n, key, hot)."""
    hot = few(store(found.where(F.col("kind") == HOT_KEY).select("key").distinct(), "hot"), FEW_HOT)
    wanted = found.where(F.col("kind") == REQUEST).join(hot.withColumn("hot", F.lit(True)), "key", "left")
    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("at", "n", "key", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("spans"))
    return store(lists, "asked")


def gathered(found: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, spans: the packed starts and lengths (in windows) of the windows to remove. spans: doc_id, at, n."""
    all_ = found.where(F.col("kind") == REPEAT).select("doc_id", "at", "n").unionAll(spans.select("doc_id", "at", "n"))
    return all_.groupBy("doc_id").agg(F.collect_list(F.col("at").cast("long") * 65536 + F.col("n")).alias("spans"))


def covered(spans: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n symbols the windows cover; spans as gathered() packs them."""
    edge = np.zeros(n + 1, np.int64)
    at, windows = spans >> 16, spans & 65535
    np.add.at(edge, at, 1)
    np.add.at(edge, np.minimum(at + windows + length - 1, n), -1)
    return np.cumsum(edge[:-1]) > 0
