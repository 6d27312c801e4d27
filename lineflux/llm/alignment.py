"""Cross-tokenizer alignment by an event sweep.

Each text is encoded by two tokenizers. A token ends at a byte offset: the ends of both sides are events, which travel as runs of one
side's tokens, are dealt by document and sorted by offset, and stream through a machine that keeps only the tokens since the last
offset where both sides ended. Such offsets cut the tokens into groups; between any two ends one token of each side overlap: a link.

How often an id pair is linked is counted over the corpus. A part of the documents meets the counts of the pairs that it holds, so
neither all links nor all counts go through one place.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache
from operator import itemgetter

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import input_bytes, ship, store, table

A_MODEL, B_MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"
MARK = "▁"
#: Tokens of a run, links of a row, and characters that are encoded at once.
RUN, LINKS, STRETCH = 1024, 2048, 1 << 16
#: Entries of a worker's cache of encoded stretches between spaces, and the longest of them.
CACHE, LONGEST_CACHED = 300_000, 64
#: Bytes of input to a part, at least; the session's shuffle partitions are the least number of parts.
PART_BYTES = 64 << 20
#: The planner's size of rows that it knows nothing about is beyond this.
UNKNOWN = 1 << 60
#: Links that are counted at once in a task.
COUNTED = 4 << 20
#: Both engines cut a text before a space that follows something else than white space, unless it is the last character.
CUT = re.compile(r"(?<=\S) (?=[\s\S])")
WIDE = re.compile(r"\s ")

#: Fixed: how a byte-level vocabulary of this kind cuts texts into words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters beyond Latin.
OTHER = re.compile("[^\0-\u024f]")


def byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: itself where it shows, else the next one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}


class Encoders:
    """Both tokenizers, and the bytes of their tokens. A text is encoded stretch by stretch between spaces; of() gives the same ids as whole
    texts do, since no token of either side crosses a cut. That is checked for B's vocabulary; A's words begin at such spaces.

    Where A's merges are in the order of its ids, a faster library with the same ranks encodes texts of the scripts that both libraries'
    character classes agree on."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_letters()
        names = [self.a.id_to_token(i) for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(letters[c] for c in x) if all(c in letters for c in x) else x.encode() for x in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << 16:
            raise ValueError("vocabularies of over 65,536 entries do not fit the runs")
        self.lengths = tuple(np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.cuts = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.ranked = self.ranks(a_path)
        self.cache: dict[str, tuple[bytes, bytes]] = {}

    def ranks(self, path: str):
        import tiktoken

        with open(path) as f:
            spec = json.load(f)
        ids, merges = spec["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        order = [ids["".join(m)] for m in merges]
        if order != list(range(order[0], order[0] + len(order))) or not (spec["pre_tokenizer"] or {}).get("use_regex"):
            return None
        special = {x["id"] for x in spec["added_tokens"]}
        return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks={x: i for i, x in enumerate(self.a_bytes) if i not in special}, special_tokens={})

    def ids(self, text: str) -> tuple[list[int], list[int]]:
        """Of a text after a space."""
        fast = self.ranked and not OTHER.search(text)
        return self.ranked.encode_ordinary(" " + text) if fast else self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)

    def encoded(self, stretches: list[str]) -> list[tuple[bytes, bytes, bool]]:
        """Of each stretch, after a space: the ids of both sides as 16-bit numbers, and whether both give its bytes back."""
        if len(stretches) > 1:
            # all at once where each ends in something else than white space: then their places in the ids follow from their bytes
            text = " ".join(stretches)
            sides, want = self.ids(text), (" " + text).encode()
            ends = np.cumsum([len(s.encode()) + 1 for s in stretches])
            cut = []
            for ids, bytes_, size in zip(sides, (self.a_bytes, self.b_bytes), self.lengths):
                if b"".join([bytes_[i] for i in ids]) != want:
                    break
                ids = np.array(ids, np.int64)
                at, data = 2 * (np.searchsorted(np.cumsum(size[ids]), ends) + 1), ids.astype(np.uint16).tobytes()
                cut.append([data[i:j] for i, j in zip([0, *at.tolist()], at.tolist())])
            else:
                return [(x, y, True) for x, y in zip(*cut)]
            return [self.encoded([s])[0] for s in stretches]
        (x, y), want = self.ids(stretches[0]), (" " + stretches[0]).encode()
        good = b"".join([self.a_bytes[i] for i in x]) == want and b"".join([self.b_bytes[i] for i in y]) == want
        return [(np.array(x, np.uint16).tobytes(), np.array(y, np.uint16).tobytes(), good)]

    def learned(self, words: list[str]) -> tuple[dict, bool]:
        """The ids of both sides by word, and whether all give their bytes back; only such words are kept for later."""
        ends = [w and not w[-1].isspace() for w in words]
        fresh, good = {}, True
        for some in ([w for w, e in zip(words, ends) if e], *([w] for w, e in zip(words, ends) if not e)):
            for w, (a, b, fine) in zip(some, self.encoded(some) if some else ()):
                fresh[w] = a, b
                good &= fine
        if good:
            if len(self.cache) + len(fresh) > CACHE:
                self.cache.clear()
            self.cache.update({w: f for w, f in fresh.items() if len(w) <= LONGEST_CACHED})
        return fresh, good

    def of(self, text: str):
        """(ids of A, ids of B, good) of the text's stretches, in order. A text whose bytes don't come back has a stretch that isn't good."""
        if not self.cuts or "\0" in text:
            a, b, good = self.encoded([text])[0]
            yield np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint16), good
            return
        at = 0
        while at < len(text):
            cut = CUT.search(text, at + STRETCH)
            to = cut.start() if cut else len(text)
            stretch = text[at:to]
            words = CUT.split(stretch) if stretch[0] == " " or stretch[-1] == " " or WIDE.search(stretch) else stretch.split(" ")
            found, good = list(map(self.cache.get, words)), True
            if None in found:
                fresh, good = self.learned(list({w for w, f in zip(words, found) if f is None}))
                found = [f or fresh[w] for w, f in zip(words, found)]
            yield *(np.frombuffer(b"".join(map(itemgetter(side), found)), np.uint16) for side in (0, 1)), good
            at = to + 1


@lru_cache(1)
def encoders(a_path: str, b_path: str) -> tuple[Encoders, tuple[np.ndarray, np.ndarray]]:
    """The encoders and their tokens' lengths, once for each worker."""
    e = Encoders(a_path, b_path)
    return e, e.lengths


@lru_cache(1)
def written() -> list[bytes]:
    """Each id as text after a comma, a bar and a semicolon."""
    return [mark + b"%d" % i for mark in (b",", b"|", b";") for i in range(1 << 16)]


def runs_of(e: Encoders, lengths: tuple[np.ndarray, np.ndarray], text: str):
    """(side, at, ids) of the text's runs, then (-1, -1, ids) with a byte that tells whether the text has tokens at all."""
    at, good = [0, 0], bool(text)
    held: list[list[np.ndarray]] = [[], []]
    for a, b, fine in e.of(text) if text else ():
        good &= fine
        if not good:
            break
        for side, ids in ((0, a), (1, b)):
            held[side].append(ids)
            ids = np.concatenate(held[side])
            full = len(ids) // RUN * RUN
            for k in range(0, full, RUN):
                yield side, at[side], ids[k : k + RUN].tobytes()
                at[side] += int(lengths[side][ids[k : k + RUN]].sum())
            held[side] = [ids[full:]]
    for side in (0, 1):
        if good and held[side] and len(held[side][0]):
            yield side, at[side], held[side][0].tobytes()
    yield -1, -1, b"\1" if good else b"\0"


class Sweep:
    """One document's machine: tokens since the last common end, counts so far, and the running hash of the groups.

    What it keeps is bounded by a few runs and the open group."""

    def __init__(self, lengths, keep_groups: bool):
        self.lengths, self.written, self.keep = lengths, written(), keep_groups
        self.ids = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.ends = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.n, self.groups, self.links, self.due = [0, 0], 0, 0, 4 * RUN
        self.hash = hashlib.sha256()

    def push(self, side: int, at: int, ids: np.ndarray):
        """A run; what has been decided meanwhile as (pairs, groups)."""
        ids = ids.astype(np.int64)
        self.ids[side] = np.concatenate([self.ids[side], ids])
        self.ends[side] = np.concatenate([self.ends[side], at + np.cumsum(self.lengths[side][ids])])
        self.n[side] += len(ids)
        if len(self.ids[0]) + len(self.ids[1]) >= self.due:
            yield from self.advance(at)
            self.due = max(4 * RUN, 2 * (len(self.ids[0]) + len(self.ids[1])))

    def advance(self, known: int | None = None):
        """Settle the groups that end up to `known`: later runs begin there or after."""
        a, b = self.ends
        common = np.intersect1d(a, b, assume_unique=True)
        if known is not None:
            common = common[common <= known]
        if not len(common):
            return
        ka, kb = np.searchsorted(a, common[-1], "right"), np.searchsorted(b, common[-1], "right")
        a, b, ia, ib = a[:ka], b[:kb], self.ids[0][:ka], self.ids[1][:kb]
        ends = np.union1d(a, b)
        pairs = ia[np.searchsorted(a, ends)] << 16 | ib[np.searchsorted(b, ends)]
        place = np.concatenate([2 * np.searchsorted(common, a), 2 * np.searchsorted(common, b) + 1])
        order = np.argsort(place, kind="stable")
        place, ids = place[order], np.concatenate([ia, ib])[order]
        # before a token: a comma in its list, a bar between the lists, a semicolon between groups
        step = np.diff(place, prepend=-1)
        mark = np.where(step == 0, 0, np.where(place % 2 == 1, 1, 2)) << 16
        data = b"".join([self.written[i] for i in (mark | ids).tolist()])
        data = data if self.groups else data[1:]
        self.hash.update(data)
        self.groups += len(common)
        self.links += len(pairs)
        self.ids, self.ends = [self.ids[0][ka:], self.ids[1][kb:]], [self.ends[0][ka:], self.ends[1][kb:]]
        for k in range(0, len(pairs), LINKS):
            yield pairs[k : k + LINKS].astype(np.uint32).tobytes(), data.decode() if self.keep and not k else None


SWEPT = "part int, row_id long, doc_id {}, seq long, pairs binary, groups string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def swept(docs: DataFrame, a_path: str, b_path: str, *, keep_groups: bool = False) -> DataFrame:
    """The sweep's rows, several for a long document: (part, row_id, doc_id, seq) with links as packed id pairs (A's id in the upper 16
    bits) and, on request, the groups settled with them as text; a document's last row has its counts and the hash of its groups.

    A row of docs (doc_id, text) is one document, repeated or not. Null and empty texts, and texts whose bytes do not come back from
    both sides, have no tokens: zeros, and '' as the hash. An empty table gives no rows; other columns are ignored."""
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    size = input_bytes(docs)
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES) if size < UNKNOWN else 1)
    ids = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text")

    def events(batches):
        import pyarrow as pa

        e, lengths = encoders(a_path, b_path)
        names, kinds = ["row_id", "doc_id", "side", "at", "ids"], None
        for batch in batches:
            kinds = [batch.schema.field(0).type, batch.schema.field(1).type, pa.int32(), pa.int64(), pa.binary()]
            rows, held = [], 0
            for row_id, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                for side, at, run in runs_of(e, lengths, text.as_py()):
                    rows.append((row_id, doc_id, side, at, run))
                    held += len(run)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def machine(batches):
        import pyarrow as pa

        _, lengths = encoders(a_path, b_path)
        part = TaskContext.get().partitionId()
        out, held, now, doc, sweep, seq = [], 0, None, None, None, 0
        kinds = None

        def flushed():
            nonlocal out, held
            rows, out, held = out, [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["part", "row_id", "doc_id", "seq", "pairs", "groups", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])

        def put(settled):
            nonlocal seq, held
            for pairs, groups in settled:
                out.append((part, now, doc, seq, pairs, groups, None, None, None, None, None))
                seq, held = seq + 1, held + len(pairs) + len(groups or "")

        def closed():
            nonlocal out, held
            if now is None:
                return
            if sweep is None:
                out.append((part, now, doc, 0, None, None, 0, 0, 0, 0, ""))
                return
            put(sweep.advance())
            last = out.pop() if out and out[-1][1] == now else (part, now, doc, seq, None, None)
            out.append((*last[:6], *sweep.n, sweep.groups, sweep.links, sweep.hash.hexdigest()))

        for batch in batches:
            if kinds is None:
                kinds = [pa.int32(), pa.int64(), batch.schema.field(1).type, pa.int64(), pa.binary(), pa.string(), *[pa.int64()] * 4, pa.string()]
            for row_id, doc_id, side, at, run in zip(*(c.to_pylist() for c in batch.columns)):
                if side < 0:  # sorts first
                    closed()
                    now, doc, seq, sweep = row_id, doc_id, 0, Sweep(lengths, keep_groups) if run == b"\1" else None
                elif sweep is not None:
                    put(sweep.push(side, at, np.frombuffer(run, np.uint16)))
                if held > 4 << 20 and len(out) > 1:
                    last = out.pop()
                    yield flushed()
                    out.append(last)
        closed()
        if out:
            yield flushed()

    runs = ids.mapInArrow(events, f"row_id long, doc_id {kind}, side int, at long, ids binary")
    return runs.repartition(n, "row_id").sortWithinPartitions("row_id", "at", "side").mapInArrow(machine, SWEPT.format(kind))


def pair_counts(rows: DataFrame) -> DataFrame:
    """(part, pair, n): the links of the stored sweep rows by part and id pair, combined in each task."""
    def counted(batches):
        import pyarrow as pa

        def combined():
            for part, arrays in held.items():
                pair, n = np.unique(np.concatenate(arrays), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), part, np.int32)), pa.array(pair.astype(np.int64)), pa.array(n.astype(np.int64))], ["part", "pair", "n"])

        held, size = {}, 0
        for batch in batches:
            for part, pairs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(part, []).append(np.frombuffer(pairs, np.uint32))
                size += len(pairs) // 4
            if size > COUNTED:
                yield from combined()
                held, size = {}, 0
        yield from combined()

    return rows.where("pairs is not null").select("part", "pairs").mapInArrow(counted, "part int, pair long, n long")


def totals(counts: DataFrame) -> DataFrame:
    """(pair, count, parts): a row for each id pair with its corpus-wide count and the parts that hold it, so counts go back to the parts
    without a join of the parts' rows."""
    return counts.groupBy("pair").agg(F.sum("n").alias("count"), F.collect_set("part").alias("parts"))


def scored(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """(row_id, n_best, count_sum) of stored sweep rows. Links of a part meet the corpus-wide counts of its own pairs."""
    total = totals(counts)
    best = total.groupBy(F.col("pair").bitwiseAND(0xFFFF).alias("b")).agg(F.max("count").alias("top"))  # as many rows as B has entries, at most
    known = total.join(F.broadcast(best), F.col("pair").bitwiseAND(0xFFFF) == F.col("b")).select("parts", "pair", "count", (F.col("count") == F.col("top")).alias("best"))
    known = known.withColumn("part", F.explode("parts")).select("part", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("row_id"), "pair", "count", "best", F.lit(None).cast("binary").alias("pairs"))
    nil = lambda t: F.lit(None).cast(t)
    links = rows.where("pairs is not null").select("part", F.lit(1).alias("kind"), "row_id", nil("long").alias("pair"), nil("long").alias("count"), nil("boolean").alias("best"), "pairs")

    def looked_up(batches):
        import pyarrow as pa

        part, found, table_ = None, [], None
        for batch in batches:
            parts, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(parts, prepend=parts[0]) != 0) | (np.diff(kinds, prepend=kinds[0]) != 0)) if len(parts) else []
            out = []
            for i, j in zip([0, *cuts], [*cuts, len(parts)]):
                if i == j:
                    continue
                if parts[i] != part:
                    part, found, table_ = parts[i], [], None
                rows_ = batch.slice(i, j - i)
                if kinds[i] == 0:
                    found.append(tuple(rows_.column(k).to_numpy(zero_copy_only=False) for k in (3, 4, 5)))
                    continue
                if table_ is None:
                    pair, count, top = (np.concatenate([f[k] for f in found]) for k in range(3))
                    order = np.argsort(pair)
                    table_, found = (pair[order].astype(np.uint32), count[order].astype(np.int64), top[order].astype(bool)), []
                for row_id, pairs in zip(rows_.column(2).to_pylist(), rows_.column(6).to_pylist()):
                    at = np.searchsorted(table_[0], np.frombuffer(pairs, np.uint32))
                    out.append((row_id, int(table_[2][at].sum()), int(table_[1][at].sum())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["row_id", "n_best", "count_sum"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(n, (rows.agg(F.max("part")).first()[0] or 0) + 1)
    dealt = known.unionAll(links).repartitionById(n, F.col("part")).sortWithinPartitions("part", "kind")
    return dealt.mapInArrow(looked_up, "row_id long, n_best long, count_sum long")


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document, as swept() states its cases. n_best: links
    whose pair is the most frequent one of its B id, ties included; count_sum: the pairs' corpus-wide counts, summed over the links."""
    rows = store(swept(docs, a_path, b_path), "swept")
    parts = scored(rows, store(pair_counts(rows), "pairs"))
    last = rows.where("groups_sha256 is not null").select("row_id", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    both = last.unionByName(parts, allowMissingColumns=True)
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    per = both.groupBy("row_id").agg(F.max("doc_id").alias("doc_id"), *(F.max(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links")), zero("n_best"), zero("count_sum"), F.max("groups_sha256").alias("groups_sha256"))
    return per.drop("row_id")


def groups_and_links(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, seq, groups, links): a document's groups as text, stretch by stretch, and its links (a, b), in order."""
    rows = swept(docs, a_path, b_path, keep_groups=True)

    def unpacked(batches):
        import pyarrow as pa

        for batch in batches:
            pairs = [np.frombuffer(p, np.uint32) if p else np.zeros(0, np.uint32) for p in batch.column(3).to_pylist()]
            links = pa.array([[{"a": int(x) >> 16, "b": int(x) & 0xFFFF} for x in p] for p in pairs], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), links], ["doc_id", "seq", "groups", "links"])

    return rows.select("doc_id", "seq", "groups", "pairs").mapInArrow(unpacked, f"doc_id {dict(docs.dtypes)['doc_id']}, seq long, groups string, links array<struct<a:int,b:int>>")


def op12_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return aligned(table(spark, sf_dir, "documents"), public_tokenizers.path(A_MODEL), public_tokenizers.path(B_MODEL))
