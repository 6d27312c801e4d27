"""Removal of repeated byte strings by column-wise construction of a collection's suffix order.

repeats.py finds the segments whose strings may repeat elsewhere in other surroundings. The segments of a bundle are one
collection. Round by round one more symbol of every segment, from its last to its first, is inserted: a stable sort of the
order so far by its Burrows-Wheeler transform is the order of the next round. In the last order, neighbours with a common prefix
of LENGTH bytes are repeats. A bundle is bounded, so its columns stay in memory.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import identified, mix64, powers, release_shuffles, store, table
from .repeats import asked, candidates, covered, gathered

LENGTH, GRAM = 100, 40
#: Bytes of a collection from which the next key begins another one: its columns then stay in a core's cache.
COLLECTION = 1 << 17
#: A byte that no UTF-8 text holds.
END = 255
#: Bytes that one symbol's hash covers.
CONTEXT = 8
#: Bytes of hot keys' segments whose windows a task tells apart at once.
HELD = 1 << 20
#: No run of windows goes over a multiple of this.
RUN = 1 << 15


def symbolize(data: np.ndarray, offsets: np.ndarray, secret: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """A hash of the CONTEXT bytes from each byte on."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return mix64(np.ndarray((len(data),), "<u8", padded, 0, (1,)) ^ secret), offsets


def suffix_order(data: np.ndarray, base: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Where in data the collection's suffixes start, in sorted order. String s is data[base[s] : base[s] + size[s]], with the largest
    symbol, which strings don't hold, before it and after the last one.

    The symbols before the suffixes so far are the transform. Sorting the order by it, equal symbols in place, inserts the next
    symbol of every string that has one left; the empty suffixes come first, by string."""
    none = np.iinfo(data.dtype).max
    ends = (base + size).astype(np.int32)
    order = ends
    for _ in range(int(size.max()) if len(size) else 0):
        before = order - 1
        bwt = data[before]
        by = np.argsort(bwt, kind="stable")
        order = np.concatenate([ends, before[by[: len(bwt) - np.count_nonzero(bwt == none)]]])
    return order


def in_pairs(data: np.ndarray, base: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each string as two strings of pairs of bytes, from its first and from its second byte, so that half the rounds insert all
    suffixes: the pairs, the strings' bases and sizes, and the byte at which each pair starts."""
    pair = data[:-1].astype(np.uint16) * np.uint16(256) + data[1:]
    begin = np.concatenate([base, base + 1])
    count = np.concatenate([(size + 1) // 2, size // 2])
    base2 = np.cumsum(count + 1) - count
    at = np.repeat(begin - 2 * base2, count + 1) + 2 * (1 + np.arange(int((count + 1).sum())))
    at = np.concatenate([[0], at])
    out = np.full(len(at), np.iinfo(np.uint16).max, np.uint16)
    inside = np.ones(len(at), bool)
    inside[0] = False
    inside[base2 + count] = False
    out[inside] = pair[at[inside]]
    return out, base2, count, at


def repeats_of(strings: list[bytes], doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, start) of strings of LENGTH bytes that also start earlier in the collection. at: a segment's place in doc."""
    end = bytes([END])
    data = np.frombuffer(end + end.join(strings) + end, np.uint8)
    size = np.array([len(s) for s in strings])
    base = np.cumsum(size + 1) - size
    pairs, base2, count, byte = in_pairs(data, base, size)
    place = suffix_order(pairs, base2, count)
    place = byte[place[len(count) :]]  # without the empty suffixes
    string = np.searchsorted(base, place, side="right") - 1
    start = place - base[string]
    whole = size[string] - start >= LENGTH
    string, start, place = string[whole], start[whole], place[whole]
    # which suffixes share LENGTH bytes with the one before: eight bytes at a time, only where all were equal so far
    blocks = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    same = np.arange(1, len(place))
    for k in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        same = same[blocks[place[same] + k] == blocks[place[same - 1] + k]]
    common = np.zeros(len(place), bool)
    common[same] = True
    node = np.cumsum(~common) - 1
    d, a = doc[string], at[string] + start
    by = np.lexsort((a, d, node))
    head = np.ones(len(by), bool)
    head[1:] = node[by][1:] != node[by][:-1]
    first = by[np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))]
    again = (d[by] != d[first]) | (a[by] != a[first])
    return d[by][again], a[by][again]


def runs(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, at, n): the windows as runs of n that start one after another."""
    by = np.lexsort((at, doc))
    doc, at = doc[by], at[by]
    head = np.ones(len(by), bool)
    head[1:] = (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1) | (at[1:] // RUN != at[:-1] // RUN)
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(by)) - 1 if len(by) else first
    return doc[first], at[first], at[last] - at[first] + 1


def repeated(key: np.ndarray, h: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted windows, which are the first of their key and hash, and which repeat that one from another place (equal records come of
    repeated rows of one document)."""
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (h[1:] != h[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return new, (doc != doc[head]) | (at != at[head])


def windows_of(pieces: list[tuple], secrets: list[int]) -> tuple[np.ndarray, ...]:
    """(key, h, document, at) of each window of the segments (document, at, bytes), sorted. key and h are hashes of its bytes."""
    doc, at = (np.array(c, np.int64) for c in list(zip(*pieces))[:2])
    size = np.array([len(p[2]) for p in pieces])
    n = size - LENGTH + 1
    data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
    power, back = powers(len(data) + 1)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    s = np.repeat(np.cumsum(size) - size, n) + within
    hashes = []
    for secret in secrets:
        symbols, _ = symbolize(data, size, np.uint64(secret))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(symbols * power[: len(data)], out=sums[1:])
        hashes.append(mix64((sums[s + LENGTH - CONTEXT + 1] - sums[s]) * back[s]).view(np.int64))
    key, h = hashes
    doc, at = np.repeat(doc, n), np.repeat(at, n) + within
    by = np.lexsort((at, doc, h, key))
    return key[by], h[by], doc[by], at[by]


def segment_texts(texts: DataFrame) -> DataFrame:
    """(key, doc_id, at, n, h, text): the requested segments; of hot keys the windows, one by one and without their bytes, told by two hashes,
    key and h (128 bits under secrets of the run, as classes of segments are).

    Of equal windows that the task holds at once only the earliest is dealt out; the others only repeat it (key, h and text null), in runs of
    n, so a string that all documents share is dealt out a few times a task."""
    names, kinds = ["key", "doc_id", "at", "n", "h", "text"], ["int64", "int64", "int32", "int32", "int64", "binary"]
    secrets = [int.from_bytes(os.urandom(8), "little") for _ in range(2)]

    def rows(batches):
        import pyarrow as pa

        types = [getattr(pa, k)() for k in kinds]

        def made(*columns):
            n = len(columns[1])
            return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else pa.array(c).cast(t) if isinstance(c, np.ndarray) else pa.array(c, t) for c, t in zip(columns, types)], names)

        def hot(pieces):
            key, h, doc, at = windows_of(pieces, secrets)
            new, copy = repeated(key, h, doc, at)
            yield made(key[new], doc[new], at[new], np.ones(int(new.sum()), np.int32), h[new], None)
            yield made(None, *runs(doc[copy], at[copy]), None, None)

        pieces, held = [], 0
        for batch in batches:
            out = []
            for doc, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                text, values = text.as_py(), spans.values
                for a, m, k, is_hot in {*zip(*(values.field(c).to_pylist() for c in ("at", "n", "key", "hot")))}:
                    piece = text[a : a + m + LENGTH - 1]
                    if not is_hot:
                        out.append((k, doc, a, m, None, piece))
                        if len(out) > 20_000:
                            yield made(*zip(*out))
                            out = []
                        continue
                    pieces.append((doc, a, piece))
                    held += len(piece)
                    if held > HELD:
                        yield from hot(pieces)
                        pieces, held = [], 0
            if out:
                yield made(*zip(*out))
        if pieces:
            yield from hot(pieces)

    return texts.mapInArrow(rows, "key long, doc_id long, at int, n int, h long, text binary")


def repeated_strings(segments: DataFrame) -> DataFrame:
    """(doc_id, at, n): windows to remove."""
    # equal segments meet first, so that only the earliest goes into a collection, and equal windows of hot keys, which need none
    n = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = F.when(F.col("text").isNotNull(), F.xxhash64("key")).when(F.col("key").isNotNull(), F.xxhash64("key", "h")).otherwise(F.xxhash64("doc_id", "at"))
    dealt = segments.withColumn("part", F.pmod(spread, F.lit(1 << 20)).cast("int")).repartition(n, "part").sortWithinPartitions("key", "h", "text", "doc_id", "at").drop("part")

    def build(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def made(doc, at, n):
            return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(at, pa.int32()), pa.array(n, pa.int32())], ["doc_id", "at", "n"])

        def collection(held):
            return made(*runs(*repeats_of([h[2] for h in held], np.array([h[0] for h in held]), np.array([h[1] for h in held]))))

        held, total, last, copies, lead = [], 0, (None, None, None, None), [], None
        for batch in batches:
            plain, known = batch.column(5).is_valid(), batch.column(0).is_null()
            if known.true_count:
                yield batch.filter(known).select(["doc_id", "at", "n"])
            hot = batch.filter(pc.invert(pc.or_(plain, known)))
            if len(hot):
                now = [hot.column(c).to_numpy() for c in (0, 4, 1, 2)]
                # what the batches before ended with may go on
                key, h, doc, at = [np.append(x, y) for x, y in zip(lead, now)] if lead else now
                new, copy = repeated(key, h, doc, at)
                yield made(*runs(doc[copy], at[copy]))
                first = np.flatnonzero(new)[-1]
                lead = [x[first : first + 1] for x in (key, h, doc, at)]
            batch = batch.filter(plain)
            for key, doc, at, n, text in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 3, 5))):
                if key == last[0] and text == last[1]:
                    if (doc, at) != last[2:]:
                        copies.append((doc, at, n))
                    if len(copies) > 50_000:
                        yield made(*zip(*copies))
                        copies = []
                    continue
                # a collection ends between keys; equal strings have equal keys
                if total > COLLECTION and key != last[0]:
                    yield collection(held)
                    held, total = [], 0
                last = (key, text, doc, at)
                held.append((doc, at, text))
                total += len(text)
        if held:
            yield collection(held)
        if copies:
            yield made(*zip(*copies))

    return dealt.mapInArrow(build, "doc_id long, at int, n int")


def dedup_strings(docs: DataFrame, texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that are left; null without texts).

    Bytes covered by a string of LENGTH bytes that also starts earlier (smaller doc_id, or the same document and an earlier start) are
    removed; strings are judged on the input and never cross documents. Null and empty texts have no bytes. A row without
    doc_id is left as it is and takes nothing from others; equal rows count as one document and give equal rows; different
    texts of one doc_id are documents of their own, ordered by a hash of the text. Other columns are ignored.
    """
    docs, _ = identified(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")))
    found = candidates(docs.where("doc_id is not null").select("doc_id", "text"), symbolize, LENGTH, GRAM, within_doc=True, deciding=True, context=CONTEXT)
    release_shuffles(docs.sparkSession)
    lists = asked(found)
    release_shuffles(docs.sparkSession)
    extra = store(repeated_strings(segment_texts(docs.join(lists, "doc_id").select("doc_id", "text", "spans"))), "strings")
    release_shuffles(docs.sparkSession)
    return finished(docs.join(gathered(found, extra), "doc_id", "left").select(F.col("own").alias("doc_id"), "text", "spans"), texts)


def finished(docs: DataFrame, texts: bool) -> DataFrame:
    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            n, gone, runs, digest, kept = [], [], [], [], []
            for t, spans in zip(batch.column(1), batch.column(2)):
                text, spans = t.as_py() or b"", spans.as_py()
                left, cut = text, np.zeros(0, bool)
                if spans:
                    cut = covered(np.array(spans, np.int64), LENGTH, len(text))
                    left = np.frombuffer(text, np.uint8)[~cut].tobytes()
                n.append(len(text))
                gone.append(int(cut.sum()))
                runs.append(int(cut[:1].sum() + (cut[1:] & ~cut[:-1]).sum()))
                digest.append(hashlib.sha256(left).hexdigest())
                kept.append(left if texts else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (n, gone, runs)), pa.array(digest, pa.string()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return docs.mapInArrow(rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op8_suffix_array(spark, sf_dir: str) -> DataFrame:
    return dedup_strings(table(spark, sf_dir, "documents"), texts=False).drop("kept")
