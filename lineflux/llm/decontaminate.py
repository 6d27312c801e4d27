"""Benchmark decontamination by winnowing, with DataFrame operations only.

Of each window of WINDOW words the least hash of its GRAM-word grams is the fingerprint, so two equal windows have the same
one. One scan tokenises the documents and gives their word counts and the fingerprints that items share; texts are read again only
for documents with such a fingerprint, where hits are extended to whole windows whose words are compared.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, few, store, table

#: Words of lower-cased texts: all but the excluded ASCII. The possessive positive class is the fast form in Java.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]++"
WINDOW = 13
#: Words of a gram. A window holds WINDOW - GRAM + 1 grams.
GRAM = 8
#: Tables of up to so many rows are broadcast, if their bytes allow too: windows, fingerprints, and document keys. Larger ones are
#: joined by shuffle, with the same rows.
FEW_WINDOWS, FEW_KEYS = 100_000, 400_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def let(x: Column, f) -> Column:
    """f(x) with x worked out once, however often f names it."""
    return F.transform(F.array(x), f)[0]


def shifted(x: Column, by: int, f) -> Column:
    """f(x[i], x[i + by]) for every i that has both."""

    def zipped(x: Column) -> Column:
        n = F.greatest(F.size(x) - by, F.lit(0))
        return F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, F.lit(1 + by), n), f)

    return let(x, zipped)


def gram_hashes(hashed: Column, size: int) -> Column:
    """For each run of `size` words, in order, one hash of their hashes."""
    have = 1
    while have < size:
        step = min(have, size - have)
        hashed = shifted(hashed, step, lambda a, b: F.xxhash64(a, b))
        have += step
    return hashed


def fingerprints(hashed: Column, window: int = WINDOW, gram: int = GRAM) -> Column:
    """For each window of hashed words, in order, the least hash of its grams."""
    fp, have, want = gram_hashes(hashed, gram), 1, window - gram + 1
    while have < want:
        step = min(have, want - have)
        fp = shifted(fp, step, lambda a, b: F.least(a, b))
        have += step
    return fp


def hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def windows_at(words: Column, n: Column, size: int) -> Column:
    """Every window of `size` words, joined by spaces."""
    return F.when(n >= size, F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(size)), " ")))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs' columns without the text, plus n_words, n_hit, n_items, items_sha256 and contaminated.

    A word is hit inside any occurrence of a window of an item; an item with fewer words than a window is one window of its
    own length. Null and empty texts have no words and no hits; items without words or without an id never match; repeated
    items and rows change nothing but the rows returned; an empty table on either side gives no hits or no rows. Columns of docs
    with the new names are replaced; any other name may occur.
    """
    new = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    own = [F.col(f"`{c}`") for c in docs.columns if c not in (*new, "text")]
    key = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    docs = docs.select(F.struct(*own).alias("own"), key.alias("key"), "text")
    bench = store(items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("words")).withColumn("n", F.size("words")).where("n > 0"), "items")
    wins = bench.select("item", F.explode(F.when(F.col("n") < window, F.array(F.array_join("words", " "))).otherwise(windows_at(F.col("words"), F.col("n"), window))).alias("w"), F.least("n", F.lit(window)).alias("len"))
    wins = store(wins.groupBy("len", "w").agg(F.array_sort(F.collect_set("item")).alias("items")), "windows")
    short = sorted(r[0] for r in wins.where(F.col("len") < window).select("len").distinct().collect())  # below `window` lengths at most

    def tagged(hashed: Column, n: int) -> Column:
        return F.transform(hashed, lambda f: F.xxhash64(f, F.lit(n)))

    def prints_of(hashed: Column) -> dict[int, Column]:
        """By length: fingerprints of whole windows, and tagged hashes of shorter ones, in order."""
        return {window: fingerprints(hashed, window, gram)} | {n: tagged(gram_hashes(hashed, n), n) for n in short}

    def placed(hashed: Column) -> Column:
        return F.concat(*(F.transform(x, lambda f, i: F.struct(f.alias("fp"), i.alias("at"))) for x in prints_of(hashed).values()))

    ends = [bench.where((F.col("n") >= window) if n == window else (F.col("n") == n)).select(F.explode(x).alias("fp"), F.lit(n).alias("len")) for n, x in prints_of(hashes(F.col("words"))).items()]
    prints = few(store(reduce(DataFrame.unionAll, ends).distinct(), "prints"), FEW_KEYS)
    codes = few(prints.select("fp").distinct().withColumn("shared", F.lit(True)), FEW_KEYS)

    # one scan: a row for each document (fp null), and one for each of its fingerprints that an item shares
    scan = docs.select("own", "key", words(F.col("text")).alias("words"))
    scan = scan.select("own", "key", F.size("words").cast("long").alias("n_words"), let(hashes(F.col("words")), lambda h: F.array_distinct(F.concat(*prints_of(h).values()))).alias("prints"))
    none = F.array(F.lit(None).cast("long"))
    scan = scan.select("own", "key", "n_words", F.explode(F.concat(none, "prints")).alias("fp")).withColumn("own", F.when(F.col("fp").isNull(), F.col("own")))
    scan = scan.join(codes, "fp", "left").where("fp is null or shared")
    scan = store(scan.select("own", "key", "n_words", F.col("fp").isNotNull().alias("shared")), "scan")
    keys = store(scan.where("shared").select("key").distinct(), "candidates")

    # texts of candidates only from here on
    near = docs.select("key", "text").join(few(keys, FEW_KEYS), "key", "left_semi").select("key", words(F.col("text")).alias("words"))
    at = near.select("key", "words", F.explode(placed(hashes(F.col("words")))).alias("p")).select("key", "words", "p.*").join(prints, "fp")
    spans = at.select("key", "at", "len", F.array_join(F.slice("words", F.col("at") + 1, F.col("len")), " ").alias("w"))
    spans = store(spans.join(few(wins, FEW_WINDOWS), ["len", "w"]).select("key", "at", (F.col("at") + F.col("len")).alias("end"), "items"), "hits")

    in_doc = Window.partitionBy("key").orderBy("at", "end").rowsBetween(Window.unboundedPreceding, -1)
    added = F.col("end") - F.greatest("at", F.coalesce(F.max("end").over(in_doc), F.lit(0)))
    hit = spans.select("key", "at", "end").distinct().select("key", F.greatest(added, F.lit(0)).alias("more")).groupBy("key").agg(F.sum("more").cast("long").alias("n_hit"))
    which = spans.select("key", F.explode("items").alias("item")).distinct().groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    result = store(hit.join(which, "key").select("key", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")), "contaminated")

    out = scan.where("not shared").select("own", "key", "n_words").join(few(result, FEW_KEYS), "key", "left")
    zero = F.lit(0).cast("long")
    out = out.select("own.*", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def pipeline_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not contaminated, as they came. Null and empty texts and null ids stay; of rows with one id only those
    with a contaminated text go; an empty benchmark removes nothing."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    found = contamination(keyed, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    bad = store(found.where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("hash").alias("bad_hash")).distinct(), "bad")
    bad = few(bad, FEW_KEYS)
    same = docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["bad_hash"])
    return docs.join(bad, same, "left_anti")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), iw AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[s : s + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS s FROM i WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)
), h AS (
  SELECT dw.doc_id, dw.s, dw.n, iw.item FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g
), c AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM h)) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""
