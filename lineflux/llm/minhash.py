"""Near-duplicates of documents by b-bit MinHash.

Bands of full minima give candidates. The low bits of all minima are packed into a signature, and documents of one band are
compared by bit counts of their signatures, with a collision-corrected cut, before any text moves: with the band's smallest document
first, then what that leaves with all. The texts of documents that pass come together by group and every link is confirmed on full
shingle sets; components are those of confirmed links only. Documents with equal words are one class and are compared once. A
document is compared only with documents that no link joins to it yet, so a group of copies costs a comparison per copy and not per pair.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, binary_view, chunks, components, few, identified, letters, mix64, ship, space_bytes, store, table

SHINGLE = 5
#: At similarity s a pair of one band in BANDS passes with 1 - (1 - s^ROWS)^BANDS: all but 1e-10 at 0.85, 5e-8 at 0.8.
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
BITS = 4
#: Chance that the signatures of a pair at the threshold agree in fewer places than the cut asks for.
MISSED = 1e-9
#: Bytes and documents of a block of texts, and signatures of a block. A task holds two blocks at most.
BLOCK, BLOCK_ROWS, SIGNATURES = 4 << 20, 1024, 4096
FEW_KEYS = 400_000

_rng = np.random.default_rng(64)
_MUL = _rng.integers(1, 1 << 63, (HASHES, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, (HASHES, 1), dtype=np.uint64)
_GRAM = np.random.default_rng(5).integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LETTERS, _SPACES = letters(True), space_bytes()
_LOW = np.uint64(int("1" * 16, 16))


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Each row's sorted distinct shingle hashes; a row of fewer words has its whole sequence as one, without words none."""
    out = []
    for i, j in chunks(offsets):
        w = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], _SPACES, _LETTERS)
        n = len(w.hash) - SHINGLE + 1
        grams = np.zeros(max(n, 0), np.uint64)
        for k in range(SHINGLE if n > 0 else 0):
            grams += w.hash[k : k + n] * _GRAM[k]
        grams = mix64(grams)
        for a, b in zip(w.first[:-1], w.first[1:]):
            if b - a >= SHINGLE:
                out.append(np.unique(grams[a : b - SHINGLE + 1]))
            elif b > a:  # sequences of one length are told apart from shingles by it
                short = (w.hash[a:b] * _GRAM[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                out.append(mix64(np.array([short], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def minima(s: np.ndarray) -> np.ndarray:
    """The least value of each of HASHES hash functions over a set that is not empty."""
    low = None
    for at in range(0, len(s), 4096):
        x = s[at : at + 4096] * _MUL + _ADD
        x ^= x >> np.uint64(32)
        now = (x * np.uint64(0xD6E8FEB86659FD93)).min(axis=1)
        low = now if low is None else np.minimum(low, now)
    return low


def packed(low: np.ndarray) -> np.ndarray:
    """The low BITS bits of the minima, 16 to a word."""
    part = (low >> np.uint64(20)) & np.uint64(15)
    return (part.reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64)


def least_agreement(num: int, den: int) -> int:
    """The places in which signatures must agree: of pairs at num / den, at most MISSED agree in fewer. Low bits agree by chance in
    2^-BITS of the places where the minima differ."""
    chance = 2.0**-BITS
    p = chance + (1 - chance) * num / den
    total, k = 0.0, 0
    while k < HASHES:
        total += comb(HASHES, k) * p**k * (1 - p) ** (HASHES - k)
        if total > MISSED:
            break
        k += 1
    return k


def agreement(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """In how many places packed signatures agree."""
    x = one ^ many
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return HASHES - np.bitwise_count(x & _LOW).sum(axis=-1).astype(int)


def estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity estimates of a packed signature with others: the share of equal groups of bits, less chance collisions."""
    chance = 2.0**-BITS
    return (agreement(one, many) / HASHES - chance) / (1 - chance)


def agreement_of(a: Column, b: Column) -> Column:
    """agreement() of two arrays of longs."""

    def differ(k: int) -> Column:
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        return F.bit_count(x.bitwiseAND(F.lit(int(_LOW))))

    total = differ(0)
    for k in range(1, HASHES * BITS // 64):
        total = total + differ(k)
    return HASHES - total


def band_keys(low: np.ndarray) -> np.ndarray:
    x = low.reshape(BANDS, ROWS)
    h = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + x[:, k])
    return h


def plain_words(text: bytes) -> list[bytes]:
    """Lower-cased words: bytes know only ASCII letters, and as separators space and 0x09-0x0D."""
    return text.lower().split()


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), words (digest of the words), sig (packed low bits) and bands (keys), the last two null for an empty set."""

    def rows(batches):
        import pyarrow as pa

        kinds = [("doc_id", None), ("n", pa.int64()), ("words", pa.binary()), ("sig", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))]
        for batch in batches:
            n, digests, sigs, keys = [], [], [], []
            for s, text in zip(shingle_sets(*binary_view(batch.column(1))), batch.column(1)):
                low = minima(s) if len(s) else None
                n.append(len(s))
                digests.append(hashlib.blake2b(b" ".join(plain_words(text.as_py() or b"")), digest_size=16).digest())
                sigs.append(packed(low).view(np.int64) if len(s) else None)
                keys.append(band_keys(low).view(np.int64) if len(s) else None)
            columns = [pa.array(c, k) for c, (_, k) in zip((n, digests, sigs, keys), kinds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [k for k, _ in kinds])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(rows, "doc_id long, n long, words binary, sig array<long>, bands array<long>")


class Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.root(j)] = self.root(i)

    def roots(self) -> np.ndarray:
        r = self.up
        while True:
            s = r[r]
            if (s == r).all():
                self.up = s
                return s
            r = s


def alike(sig: np.ndarray, first: np.ndarray, second: np.ndarray, least: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs between first and second whose signatures agree in `least` places."""
    f, edges = Forest(len(sig)), []
    for i in first:
        roots = f.roots()
        rest = second[roots[second] != roots[i]]
        for j in rest[agreement(sig[i], sig[rest]) >= least] if len(rest) else ():
            if f.root(i) != f.root(j):
                edges.append((i, j))
                f.join(i, j)
    return edges


def full_set(text: bytes) -> set[bytes]:
    w = plain_words(text)
    return {b" ".join(w[k : k + SHINGLE]) for k in range(max(1, len(w) - SHINGLE + 1))} if w else set()


def linked(texts: list[bytes], sets: list[np.ndarray], sig: np.ndarray, first: np.ndarray, second: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between first and second (indices into sets): den * intersection >= num * union, by set
    sizes, signatures and hashes first, and confirmed on the shingles themselves."""
    least = least_agreement(num, den)
    size = np.array([len(s) for s in sets])
    f, edges = Forest(len(sets)), []
    for i in first:
        roots = f.roots()
        rest = second[roots[second] != roots[i]]
        if not len(rest):
            continue
        low, high = np.minimum(size[rest], size[i]), np.maximum(size[rest], size[i])
        rest = rest[den * low >= num * high]
        rest = rest[agreement(sig[i], sig[rest]) >= least]
        own = None
        for j in rest:
            if f.root(i) == f.root(j):
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if den * both < num * (size[i] + size[j] - both):
                continue
            own = full_set(texts[i]) if own is None else own
            other = full_set(texts[j])
            both = len(own & other)
            if den * both >= num * (len(own) + len(other) - both):
                edges.append((i, j))
                f.join(i, j)
    return edges


def compared(groups: DataFrame, carried: list[str], compare) -> DataFrame:
    """(a, b) links of compare(rows of a part, first, second), which join what all links of the part would.

    groups: bundle, part (what is compared with itself or across), role, doc_id and the carried columns. In a part without role 2 all
    documents are compared with each other; otherwise role 1 with role 2."""

    def work(t):
        import pyarrow as pa

        t = t.combine_chunks()
        part, role, ids = (t.column(k).to_numpy() for k in ("part", "role", "doc_id"))
        column = {k: t.column(k).combine_chunks() for k in carried}
        column = {k: c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for k, c in column.items()}
        a, b = [], []
        order = np.lexsort((ids, part))
        for rows in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            two = np.flatnonzero(role[rows] == 2)
            one = np.flatnonzero(role[rows] < 2)
            for i, j in compare({k: c.take(pa.array(rows)) for k, c in column.items()}, one, two if len(two) else np.arange(len(rows))) if len(one) else ():
                a.append(ids[rows[i]])
                b.append(ids[rows[j]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return groups.select("bundle", "part", "role", "doc_id", *carried).groupBy("bundle").applyInArrow(work, "a long, b long")


def signatures_of(column) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1).view(np.uint64)


def candidate_groups(reps: DataFrame, least: int) -> DataFrame:
    """(doc_id, grp): documents that chains of band pairs with agreeing signatures join. reps: rep, sig, bands."""
    spark = reps.sparkSession
    slim = store(reps.select("rep", F.explode("bands").alias("key")).distinct(), "bands")
    shared = slim.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    sigs = reps.select("rep", "sig").dropDuplicates(["rep"])
    members = store(slim.join(shared, "key").join(sigs, "rep"), "members")
    lead = members.groupBy("key").agg(F.min(F.struct("rep", "sig")).alias("lead"))
    star = members.join(lead, "key").where(F.col("rep") != F.col("lead.rep")).withColumn("alike", agreement_of(F.col("sig"), F.col("lead.sig")) >= least)
    star = store(star.select("key", "m", "rep", "sig", F.col("lead.rep").alias("low"), "alike"), "star")
    edges = star.where("alike").select(F.col("rep").alias("a"), F.col("low").alias("b")).distinct()

    # what the smallest document of a band leaves, against all others of the band
    left = star.where("not alike and m > 2").select("key", "m", "rep", "sig")
    counts = store(left.groupBy("key").agg(F.count("*").alias("l")), "left")
    total = counts.agg(F.coalesce(F.sum("l"), F.lit(0))).first()[0]
    if total:
        bundles = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // SIGNATURES)
        blocks, parts = F.ceil(F.col("m") / SIGNATURES).cast("int"), F.ceil(F.col("l") / SIGNATURES).cast("int")
        deal = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        one = left.join(counts, "key").select("key", "rep", "sig", F.lit(1).alias("role"), deal(parts).alias("p"), each(blocks).alias("block"))
        two = star.where("m > 2").join(counts, "key").select("key", "rep", "sig", F.lit(2).alias("role"), deal(blocks).alias("block"), each(parts).alias("p"))
        both = one.unionByName(two).withColumn("part", F.xxhash64("key", "block", "p"))
        both = both.select(F.pmod("part", F.lit(bundles)).alias("bundle"), "part", "role", F.col("rep").alias("doc_id"), "sig")
        more = compared(both, ["sig"], lambda c, one, two: alike(signatures_of(c["sig"]), one, two, least))
        edges = edges.unionAll(store(more, "alike"))
    return store(components(edges).withColumnRenamed("component", "grp").withColumnRenamed("id", "doc_id"), "groups")


def near_duplicates(docs: DataFrame, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept.

    Documents with intersection / union of their sets >= num / den are linked. A document without words links with nothing.
    Equal rows of one doc_id count as one document; different texts of one doc_id are documents of their own, of which the one with the
    smaller hash comes first, so only one of a component is kept. A row without doc_id has no component and is kept. Empty tables give no
    rows; other columns are ignored.
    """
    known, renumbered = identified(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")))
    out = grouped(known.select("doc_id", "text"), num, den)
    if not renumbered:
        return out
    owns = known.where("doc_id is not null").select("doc_id", "own").distinct()
    out = out.join(owns, "doc_id", "left").join(owns.select(F.col("doc_id").alias("component_id"), F.col("own").alias("component")), "component_id", "left")
    return out.select(F.col("own").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


def grouped(docs: DataFrame, num: int, den: int) -> DataFrame:
    """near_duplicates() of docs whose ids tell documents."""
    ship(docs.sparkSession)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    all_ = store(sketches(docs), "sketches")
    real = all_.where("doc_id is not null and n > 0")
    classes = store(real.groupBy("words").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    # a class' copies have equal sketches, so its smallest document stands for all
    first = store(real.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").withColumnRenamed("doc_id", "rep"), "first")
    groups = candidate_groups(first, least_agreement(num, den))

    def confirm(columns, one, two):
        texts = [x.as_py() or b"" for x in columns["text"]]
        return linked(texts, shingle_sets(*binary_view(columns["text"])), signatures_of(columns["sig"]), one, two, num, den)

    cand = docs.join(few(groups, FEW_KEYS), "doc_id").join(first.select(F.col("rep").alias("doc_id"), "sig").dropDuplicates(["doc_id"]), "doc_id")
    cand = store(cand.select("doc_id", "grp", "sig", F.col("text").cast("binary").alias("text")).dropDuplicates(["doc_id"]).withColumn("bytes", F.octet_length("text").cast("long")), "candidates")
    sizes = store(cand.groupBy("grp").agg(F.sum("bytes").alias("total"), F.count("*").alias("docs")), "sizes")
    total = sizes.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    bundles = max(partitions, int(total // BLOCK) * 2 + 1)
    blocks = F.greatest(F.ceil(F.col("total") / BLOCK), F.ceil(F.col("docs") / BLOCK_ROWS)).cast("int")
    hot = few(store(sizes.withColumn("blocks", blocks).where("blocks > 1").select("grp", "blocks"), "hot"), FEW_KEYS)
    plain = cand.join(hot, "grp", "left_anti")
    links = store(compared(plain.select(F.pmod(F.xxhash64("grp"), F.lit(bundles)).alias("bundle"), F.col("grp").alias("part"), F.lit(1).alias("role"), "doc_id", "sig", "text"), ["sig", "text"], confirm), "links")

    # groups of several blocks: every block is compared with the group's first document, then what that leaves with all
    if not hot.isEmpty():
        parted = store(cand.join(hot, "grp").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")), "blocks")
        cols = ["doc_id", "sig", "text"]
        centre = parted.where("doc_id = grp").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        name = F.xxhash64("grp", "block")
        stars = centre.select(name.alias("bundle"), name.alias("part"), F.lit(1).alias("role"), *cols).unionByName(
            parted.where("doc_id <> grp").select(name.alias("bundle"), name.alias("part"), F.lit(2).alias("role"), *cols))
        stars = store(compared(stars, ["sig", "text"], confirm), "stars")
        left = store(parted.where("doc_id <> grp").join(few(stars.select(F.col("b").alias("doc_id")), FEW_KEYS), "doc_id", "left_anti"), "left")
        parts = left.groupBy("grp").agg(F.greatest(F.ceil(F.sum("bytes") / BLOCK), F.ceil(F.count("*") / BLOCK_ROWS)).cast("int").alias("parts"))
        parts = few(store(parts, "parts"), FEW_KEYS)
        name = F.xxhash64("grp", "block", "p")
        one = left.join(parts, "grp").withColumn("p", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")).drop("block").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        two = parted.join(parts, "grp").withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        cross = one.select(name.alias("bundle"), name.alias("part"), F.lit(1).alias("role"), *cols).unionByName(
            two.select(name.alias("bundle"), name.alias("part"), F.lit(2).alias("role"), *cols))
        links = links.unionAll(stars).unionAll(store(compared(cross, ["sig", "text"], confirm), "cross"))

    joined = store(components(links).withColumnRenamed("id", "rep"), "joined")
    of_class = classes.join(few(joined, FEW_KEYS), "rep", "left").where("copies > 1 or component is not null")
    of_class = store(of_class.select("words", F.coalesce("component", "rep").alias("component")), "members")
    out = all_.select("doc_id", "n", "words").join(few(of_class, FEW_KEYS // 4), "words", "left")
    empty = (F.col("n") == 0) | F.col("component").isNull()
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.when(empty, F.col("doc_id")).otherwise(F.col("component"))).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op10_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def pipeline_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more): the one of the least id, as it came.

    Documents without words and rows without an id stay; equal rows stay or go together, different texts of one id are judged apart."""
    known, renumbered = identified(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")))
    gone = store(grouped(known.select("doc_id", "text"), 80, 100).where("not kept").select(F.col("doc_id").alias("gone_id")).distinct(), "gone")
    if not renumbered:
        gone = few(gone, FEW_KEYS)
        return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
    told = lambda c: F.xxhash64(F.sha2(c.cast("binary"), 256))
    gone = known.join(gone, F.col("doc_id") == F.col("gone_id"), "left_semi").select(F.col("own").alias("gone_id"), told(F.col("text")).alias("gone_text")).distinct()
    return docs.join(gone, (docs["doc_id"] == gone["gone_id"]) & (told(docs["text"]) == gone["gone_text"]), "left_anti")
