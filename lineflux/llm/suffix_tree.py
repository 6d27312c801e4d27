"""Removal of repeated word windows by prefix-partitioned suffix trees.

Of each window the suffix that begins at its least gram (repeats.py) is sampled; the gram is that suffix's prefix and decides its
group. Where one gram has too many different surroundings its windows are grouped by their whole first WINDOW words instead, the
longest prefix that matters. Groups are put together until a task's memory-sized share is full, and a share becomes one
generalised suffix tree over the segments' words: sorted suffixes, their common prefixes, and internal nodes with depths. Whatever
lies below a node of WINDOW words or more repeats; the node's smallest document keeps its words. Words are compared, never hashes:
hashes only choose what comes together.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, identified, letters, mix64, release_shuffles, space_bytes, store, table
from .repeats import asked, candidates, covered, gathered

WINDOW, GRAM = 13, 5
#: Words of a subtree's segments from which the next group begins another one.
SUBTREE = 1 << 18
#: Bytes of segments that are compared with each other before they are dealt out.
BATCH = 6 << 20
_LETTERS, _SPACES = letters(False), space_bytes()


def symbolize(data: np.ndarray, offsets: np.ndarray, secret: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    w = Words(data, offsets, _SPACES, _LETTERS)
    return mix64(w.hash ^ secret), w.first


class SuffixTree:
    """The generalised suffix tree of sequences of symbol numbers, as far as nodes of `least` symbols or more: where (sequence, offset)
    each suffix below such a node starts, in sorted order, and common[i], the symbols that suffix i shares with the one before.

    Ranks of the suffixes' first 3, 6, 12, ... symbols come by doubling, a sequence's end before any symbol; a rank is the place of the
    first suffix that starts alike, so only places that others share are ranked again, and the last ranks are the order of whole
    suffixes."""

    def __init__(self, sequences: list[list[int]], least: int):
        size = np.array([len(s) for s in sequences], np.int64)
        first = np.cumsum(size) - size
        n, longest = int(size.sum()), int(size.max()) if len(size) else 0
        of = np.repeat(np.arange(len(size)), size)
        left = first[of] + size[of] - np.arange(n)  # symbols up to the sequence's end
        symbol = np.fromiter(chain.from_iterable(sequences), np.int64, n) + 1
        ahead = lambda x, i, k, none: np.where(left[i] > k, x[np.minimum(i + k, max(n - 1, 0))], none)
        levels, k, live = [(1, symbol)], 3, np.arange(n)
        if n:
            most = int(symbol.max()) + 1
            rank = np.zeros(n, np.int64)
            live, rank[:] = self._ranked(live, np.zeros(n, np.int64), (symbol * most + ahead(symbol, live, 1, 0)) * most + ahead(symbol, live, 2, 0))
            levels.append((3, rank))
        while k < longest:
            keys = ahead(rank, live, k, -1)
            rank = rank.copy()
            some = live
            live, rank[some] = self._ranked(live, rank[live], rank[live] * (n + 1) + keys + 1)
            k *= 2
            levels.append((k, rank))
        at = np.flatnonzero(left >= least)
        at = at[np.argsort(rank[at], kind="stable")] if n else at
        common = np.zeros(len(at), np.int64)
        a, b = at[:-1].copy(), at[1:].copy()
        most_common = np.minimum(left[a], left[b])
        for k, rank in [*levels[::-1], levels[0]]:
            fits = np.flatnonzero(common[1:] + k <= most_common)
            fits = fits[rank[a[fits]] == rank[b[fits]]]
            common[1 + fits] += k
            a[fits] = np.minimum(a[fits] + k, n - 1)
            b[fits] = np.minimum(b[fits] + k, n - 1)
        # suffixes alone above the depth are no part of a node
        deep = common >= least
        near = deep.copy()
        near[:-1] |= deep[1:]
        self.common, at = common[near], at[near]
        self.sequence = of[at]
        self.offset = at - first[self.sequence]

    @staticmethod
    def _ranked(live: np.ndarray, bucket: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The live places whose key another has, and the new rank of each live place. bucket: the ranks so far, which keys refine."""
        order = np.argsort(key, kind="stable")
        sorted_key, sorted_bucket = key[order], bucket[order]
        place = np.arange(len(live))
        new = np.ones(len(live), bool)
        new[1:] = sorted_key[1:] != sorted_key[:-1]
        fresh = np.ones(len(live), bool)
        fresh[1:] = sorted_bucket[1:] != sorted_bucket[:-1]
        start = np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(fresh, place, 0))
        alone = new.copy()
        alone[:-1] &= new[1:]
        rank, tied = np.empty(len(live), np.int64), np.empty(len(live), bool)
        rank[order], tied[order] = sorted_bucket + start, ~alone
        return live[tied], rank

    def nodes(self, depth: int) -> np.ndarray:
        """The number of the topmost node of `depth` symbols or more above each suffix."""
        return np.cumsum(self.common < depth) - (1 if len(self.common) else 0)

    def maximal(self, depth: int) -> list[tuple[int, int, int]]:
        """(depth, first, last) of every internal node of `depth` or more: its suffixes [first, last) share that many symbols, not more."""
        out, stack = [], []
        for i, d in enumerate([*self.common.tolist()[1:], 0], 1):
            begin = i - 1
            while stack and stack[-1][0] > d:
                top, begin = stack.pop()
                if top >= depth:
                    out.append((top, begin, i))
            if not stack or stack[-1][0] < d:
                stack.append((d, begin))
        return out


def stretches(texts: DataFrame) -> DataFrame:
    """(key, doc_id, at, n, text): the requested segments' words, or single windows of hot keys with keys of their own.

    Equal segments of one batch are compared here: those of its smallest document stand for them, and the others repeat it (text null). So a
    passage that all documents share gives a row per batch."""
    names, kinds = ["key", "doc_id", "at", "n", "text"], ["int64", "int64", "int32", "int32", "binary"]

    def rows(batches):
        import pyarrow as pa

        types = [getattr(pa, k)() for k in kinds]

        def made(by_text):
            out = []
            for s, found in by_text.items():
                own = found[0][3]
                if own is None:
                    own = int.from_bytes(hashlib.blake2b(s, digest_size=8).digest(), "little", signed=True)
                if len(found) == 1:
                    out.append((own, *found[0][:3], s))
                    continue
                least = min(found)[0]
                out += [(own, doc, at, n, s if doc == least else None) for doc, at, n, _ in found]
            for i in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 20_000]), types)], names)

        by_text: dict[bytes, list] = {}
        size = 0
        for batch in batches:
            for doc, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                words = text.as_py().split()
                values = spans.values
                at, n, key, hot = (values.field(k).to_pylist() for k in ("at", "n", "key", "hot"))
                places = {(a + i, 1, None) for a, m, h in zip(at, n, hot) if h for i in range(m)} | {(a, m, k) for a, m, k, h in zip(at, n, key, hot) if not h}
                for a, m, k in places:
                    s = b" ".join(words[a : a + m + WINDOW - 1])
                    size += len(s)
                    if s in by_text:
                        by_text[s].append((doc, a, m, k))
                    else:
                        by_text[s] = [(doc, a, m, k)]
                if size > BATCH:
                    yield from made(by_text)
                    by_text, size = {}, 0
        yield from made(by_text)

    return texts.mapInArrow(rows, "key long, doc_id long, at int, n int, text binary")


def repeats_of(rows: list[tuple[int, int, int, bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, windows) of what repeats below the nodes of the tree over rows (document, start, windows, text, key).

    A string alone in its group is a leaf of many documents and needs no tree."""
    strings: dict[bytes, int] = {}
    of = np.array([strings.setdefault(r[3], len(strings)) for r in rows])
    doc, at, n, key = (np.array([r[k] for r in rows], np.int64) for k in (0, 1, 2, 4))
    windows, group = np.zeros(len(strings), np.int64), np.zeros(len(strings), np.int64)
    windows[of], group[of] = n, key
    _, inverse, count = np.unique(group, return_inverse=True, return_counts=True)
    several = np.flatnonzero(count[inverse] > 1)
    texts, numbers = list(strings), {}
    number = numbers.setdefault
    tree = SuffixTree([[number(w, len(numbers)) for w in texts[i].split(b" ")] for i in several.tolist()], WINDOW)
    base = np.cumsum(windows) - windows
    # a string is a node over its own occurrences; nodes over several strings have smaller documents still
    own = np.full(len(strings), np.iinfo(np.int64).max)
    np.minimum.at(own, of, doc)
    least = np.repeat(own, windows)
    if len(tree.common):
        node, string = tree.nodes(WINDOW), several[tree.sequence]
        best = np.full(node[-1] + 1, np.iinfo(np.int64).max)
        np.minimum.at(best, node, own[string])
        least[base[string] + tree.offset] = best[node]
    row = np.repeat(np.arange(len(rows)), n)
    within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    gone = least[base[of[row]] + within] < doc[row]
    begin, end = gone.copy(), gone.copy()
    begin[1:] &= ~(gone[:-1] & (row[1:] == row[:-1]))
    end[:-1] &= ~(gone[1:] & (row[1:] == row[:-1]))
    begin, end = np.flatnonzero(begin), np.flatnonzero(end)
    return doc[row[begin]], at[row[begin]] + within[begin], end - begin + 1


def repeated_windows(segments: DataFrame) -> DataFrame:
    """(doc_id, at, n): windows to remove, from one tree for each share of the groups. Rows without text are such windows already."""

    def trees(batches):
        import pyarrow as pa

        def out(doc, at, n):
            return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(at, pa.int32()), pa.array(n, pa.int32())], ["doc_id", "at", "n"])

        held, size, now, last = [], 0, None, (None, None)
        for batch in batches:
            copies = []
            for key, doc, at, n, text in zip(*(batch.column(c).to_pylist() for c in range(5))):
                if text is None:
                    copies.append((doc, at, n))
                    continue
                if key != now:
                    if size > SUBTREE:
                        yield out(*repeats_of(held))
                        held, size = [], 0
                    now, last = key, (None, None)
                if text == last[0] and doc > last[1]:  # rows come by text and document, so one string over and over needs no room
                    copies.append((doc, at, n))
                    continue
                if text != last[0]:
                    last = (text, doc)
                held.append((doc, at, n, text, key))
                size += n + WINDOW
            if copies:
                yield out(*zip(*copies))
        if held:
            yield out(*repeats_of(held))

    n = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = F.when(F.col("text").isNotNull(), F.col("key")).otherwise(F.xxhash64("doc_id", "at"))
    dealt = segments.withColumn("part", F.pmod(F.xxhash64(spread), F.lit(1 << 20)).cast("int")).repartition(n, "part").sortWithinPartitions("key", "text", "doc_id")
    return dealt.drop("part").mapInArrow(trees, "doc_id long, at int, n int")


def dedup_windows(docs: DataFrame, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the text that is left, words joined by one space; null without texts).

    Words covered by a window of WINDOW words that also starts in a document with a smaller doc_id are removed; windows are judged on the
    input. Null and empty texts have no words. A row without doc_id is left as it is and takes nothing from others; equal rows
    count as one document and give equal rows; texts shorter than a window keep all words; different texts of one doc_id are
    documents of their own, ordered by a hash of the text. Other columns are ignored.
    """
    docs, _ = identified(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")))
    found = candidates(docs.where("doc_id is not null").select("doc_id", "text"), symbolize, WINDOW, GRAM, within_doc=False, deciding=False)
    release_shuffles(docs.sparkSession)
    lists = asked(found)
    release_shuffles(docs.sparkSession)
    extra = store(repeated_windows(stretches(docs.join(lists, "doc_id").select("doc_id", "text", "spans"))), "windows")
    release_shuffles(docs.sparkSession)
    return finished(docs.join(gathered(found, extra), "doc_id", "left").select(F.col("own").alias("doc_id"), "text", "spans"), texts)


def finished(docs: DataFrame, texts: bool) -> DataFrame:
    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            n, gone, digest, kept = [], [], [], []
            for t, spans in zip(batch.column(1), batch.column(2)):
                words = (t.as_py() or b"").split()
                spans = spans.as_py()
                cut = covered(np.array(spans, np.int64), WINDOW, len(words)) if spans else np.zeros(len(words), bool)
                left = b" ".join(w for w, c in zip(words, cut.tolist()) if not c)
                n.append(len(words))
                gone.append(int(cut.sum()))
                digest.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode() if texts else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return docs.mapInArrow(rows, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def op5_suffix_trees(spark, sf_dir: str) -> DataFrame:
    return dedup_windows(table(spark, sf_dir, "documents"), texts=False).drop("kept")
