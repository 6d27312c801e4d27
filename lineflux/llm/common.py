"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import gc
import hashlib
import tempfile
import time
import uuid

import numpy as np
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import numbered
from ..shipping import ship

#: The separators of whole-text words: space and 0x09-0x0D.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none (tests)."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lineflux-"))
    return sc._jsc.sc().getCheckpointDir().get()


_stored: list = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _stored:
        atexit.register(_clear)
    _stored.append((spark, path))
    return path


def _clear() -> None:
    for spark, path in _stored:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except (Py4JError, OSError, AttributeError):  # the session has ended before the interpreter
            return


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that ended in a stored table. Its cleaner waits for a collection, and what refers to a
    finished job goes only with a second one."""
    gc.collect()
    for _ in range(3):
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def store(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back."""
    path = fresh_path(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


#: Bytes of a broadcast table, as text, unless a caller states another bound.
FEW_BYTES = 64 << 20


def few(df: DataFrame, most: int, most_bytes: int = FEW_BYTES) -> DataFrame:
    """df (stored, or cheap to work out again), marked for broadcast if its checked rows and bytes allow; otherwise it is joined by
    shuffle, with the same rows."""
    if df.count() > most:
        return df
    size = df.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= most_bytes else df


def input_bytes(df: DataFrame) -> int:
    """The planner's estimate of df's size, from its files where it is a table."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def identified(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs (doc_id long, text binary) as own (the id), doc_id and text, where doc_id tells documents, and whether that is another number.

    It is the id itself unless rows of one id have different texts. Then documents are numbered by (id, hash of the text), so that each text
    is a document of its own, one of a smaller id still has a smaller number, and of one id's texts that of the smaller hash comes first."""
    h = F.sha2("text", 256)
    d = docs.select(F.col("doc_id").alias("own"), "doc_id", "text")
    told = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b"), F.max(F.col("text").isNull()).alias("c"), F.min(F.col("text").isNull()).alias("d"))
    if told.where("a <> b or c <> d").isEmpty():
        return d, False
    d = d.withColumn("h", F.coalesce(h, F.lit("")))
    numbers = numbered(d.where("own is not null").select("own", "h").distinct(), [F.col("own"), F.col("h")], "number")
    numbers = store(numbers.select(F.col("own").alias("o"), F.col("h").alias("k"), F.col("number").cast("long").alias("doc_id")), "numbers")
    return store(d.drop("doc_id").join(numbers, (F.col("own") == F.col("o")) & (F.col("h") == F.col("k")), "left").select("own", "doc_id", "text"), "identified"), True


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; texts of one byte a character take the faster built-in."""
    plain = F.octet_length(c) == F.length(c)
    return F.when(plain, F.lower(c)).otherwise(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 40) -> DataFrame:
    """(id, component): the smallest id that each endpoint of the undirected edges reaches.

    Alternates large-star and small-star rounds; every round is a groupBy and a join on slim rows, stored in the
    shared folder. The stars end when no edge changes. An id without edges is not returned.
    """
    e = store(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "cc")
    last = None
    for _ in range(most_rounds):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.unionAll(low.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = store(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), "cc")
        now = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id").unionAll(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def binary_view(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of an Arrow string or binary array, nulls as empty, without copying."""
    import pyarrow as pa

    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind, len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = 1 << 20):
    """(first, last) rows so that each stretch has about `most` bytes, one row at least."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


class Words:
    """Word boundaries and 64-bit word hashes of a stretch of rows.

    data and offsets as binary_view gives them. is_sep: 256 booleans; letter: 256 bytes, equal for bytes that count as the same
    letter. start, end: byte positions of words; row: each word's row; first: the index of each row's first word, n + 1 entries.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_sep: np.ndarray, letter: np.ndarray):
        n = len(data)
        word = ~is_sep[data]
        begin = word.copy()
        if n:
            begin[1:] &= ~word[:-1]
            cuts = offsets[:-1][offsets[:-1] < n]
            begin[cuts] = word[cuts]
            stop = word.copy()
            stop[:-1] &= ~word[1:]
            ends = offsets[1:][offsets[1:] > 0] - 1
            stop[ends] = word[ends]
            self.start, self.end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, offsets)
        self.hash = string_hashes(letter[data], self.start, self.end)


#: Strings longer than this are hashed one by one.
LONG_STRING = 256
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def string_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start : end], eight bytes at a time, each block scrambled before it is chained, so that no
    regular pattern of letters cancels out."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    blocks = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    left = end - start
    h = mix64(left.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    live, at = np.arange(len(start)), start
    for i in np.flatnonzero(left > LONG_STRING).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    left = np.where(left > LONG_STRING, 0, left)
    while True:
        more = left > 0
        live, at, left = live[more], at[more], left[more]
        if not len(live):
            return h
        x = blocks[at] & _MASKS[np.minimum(left, 8)]
        h[live] = mix64(mix64(x + np.uint64(0x9E3779B97F4A7C15)) ^ (h[live] * np.uint64(0xD6E8FEB86659FD93)))
        at, left = at + 8, left - 8


_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """The powers of an odd base and of its inverse modulo 2^64, grown by doubling and kept in the worker."""
    for k, base in enumerate((_BASE, _BACK)):
        while len(_powers[k]) < n:
            step = np.uint64(pow(base, len(_powers[k]), 1 << 64))
            _powers[k] = np.concatenate([_powers[k], _powers[k] * step])
    return _powers


def letters(lower: bool) -> np.ndarray:
    """Each byte as itself; A-Z as a-z if lower."""
    t = np.arange(256, dtype=np.uint8)
    if lower:
        t[65:91] = t[97:123]
    return t


def space_bytes() -> np.ndarray:
    s = np.zeros(256, bool)
    s[[0x20, *range(0x09, 0x0E)]] = True
    return s


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i : i + w]) for each i up to len(x) - w."""
    if len(x) < w:
        return x[:0]
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out
