"""Quality rules by distribution divergence, with DataFrame operations only.

A document's shares of character classes and of its language's commonest words are compared with the language's reference, the mean
shares of its sound documents, by the Jensen-Shannon distance (base 2: 0 equal, 1 disjoint). Short documents and thin references are
not judged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import few, store, table

WS = r"\x20\x09-\x0D"
SYMBOLS = r"[#*$%&|<>]"
#: Common words of a language: so many, by the number of documents that hold them.
COMMON = 10
#: A document is sound below neither bound.
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
#: Documents with fewer words than this are not judged by their words, nor any by a reference of fewer documents.
LEAST_JUDGED, LEAST_REFERENCE = 100, 20
#: Distances from which a document is rejected.
MOST_CLASSES, MOST_COMMON = 0.3, 0.25
FEW_LANGUAGES = 10_000
PPM = 1_000_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), rf"[{WS}]+"), "")


def common_words(docs: DataFrame, most: int = COMMON) -> DataFrame:
    """(lang, common, longest): each language's commonest words of all, ties by code point, and the characters of the longest of them. All words
    are counted; of each task's counts of a language only the leading ones are sent on."""
    seen = docs.select("lang", F.explode(F.array_distinct(words_of(F.col("text")))).alias("word")).groupBy("lang", "word").count()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))
    top = seen.withColumn("rank", rank).where(F.col("rank") <= most)
    return top.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("common"), F.max(F.length("word")).alias("longest"))


def gone(text: Column, pattern: str) -> Column:
    """How many characters the pattern takes away."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def repeated_words(triples: str) -> Column:
    """Words in three-word windows that come twice; triples: a sorted array of (a, b, c, i), i the place, c null at the text's end."""
    same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
    twice = F.filter(triples, lambda x, k: same(x, F.get(triples, k + 1)) | same(x, F.get(triples, k - 1)))
    return F.sort_array(F.transform(twice, lambda x: x["i"]))


def features(docs: DataFrame, common: DataFrame) -> DataFrame:
    """docs (doc_id, lang, text) as doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes and words (counts)."""
    t = F.coalesce("text", F.lit(""))
    d = docs.join(few(common, FEW_LANGUAGES), docs["lang"].eqNullSafe(common["lang"]), "left").select("doc_id", docs["lang"], t.alias("text"), "common", "longest", words_of(F.col("text")).alias("w"))
    n = F.size("w")
    later = lambda k: F.slice("w", k, F.greatest(n, F.lit(1)))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(rf"[^{WS}]"))
    d = d.select(
        "doc_id", "lang", "common", n.cast("long").alias("n_words"), F.length("text").alias("n_chars"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.sort_array(F.arrays_zip(F.col("w").alias("a"), later(2).alias("b"), later(3).alias("c"), F.sequence(F.lit(1), F.greatest(n, F.lit(1))).alias("i"))).alias("triples"),
        # no longer word is a common one
        F.filter("w", lambda x: F.length(x) <= F.col("longest")).alias("short"), lines.alias("lines"),
        # little is left of prose: its capitals, digits, points and marks
        F.regexp_replace("text", rf"[\p{{Ll}}{WS}]++", "").alias("rest"))
    d = d.select("doc_id", "lang", "common", "n_words", "n_chars", "word_chars", "short", "rest", repeated_words("triples").alias("at"), F.size("lines").alias("n_lines"), F.size(F.array_distinct("lines")).alias("n_different"))
    covered = F.aggregate(F.transform("at", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("at", k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    upper, digits, symbols = gone(F.col("rest"), r"\p{Lu}++"), gone(F.col("rest"), "[0-9]++"), gone(F.col("rest"), SYMBOLS + "++")
    d = d.select("doc_id", "lang", "common", "short", "n_words", "word_chars", "n_chars", F.length("rest").cast("long").alias("n_rest"), upper.alias("upper"), digits.alias("digits"), symbols.alias("n_symbols"),
                 (F.col("n_lines") - F.col("n_different")).cast("long").alias("n_dup_lines"), covered.cast("long").alias("n_repeat_words"))
    classes = F.array(F.col("word_chars") - F.col("n_rest"), F.col("n_chars") - F.col("word_chars"), "upper", "digits", "n_symbols", F.col("n_rest") - F.col("upper") - F.col("digits") - F.col("n_symbols"))
    counts = F.transform("common", lambda c: (F.size("short") - F.size(F.array_remove(F.col("short"), c))).cast("long"))
    return d.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", classes.alias("classes"), F.coalesce(counts, F.array().cast("array<long>")).alias("words"))


def total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)


def distance(p: Column, q: Column) -> Column:
    """The Jensen-Shannon distance of two arrays of shares, each in millionths; null without either."""
    def part(x, y):
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    each = F.zip_with(p, q, lambda x, y: part(x / PPM, y / PPM) + part(y / PPM, x / PPM))
    return F.when(p.isNotNull() & q.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / 2)))


def references(sound: DataFrame) -> DataFrame:
    """(ref_lang, ref_classes, ref_words): the mean shares of a language's documents, sums of whole millionths, which no order changes."""
    mean = lambda c, size: F.array(*(F.floor(F.coalesce(F.sum(F.get(c, F.lit(i))), F.lit(0)) / F.count("*")) for i in range(size)))
    r = sound.groupBy(F.col("lang").alias("ref_lang")).agg(F.count("*").alias("n_sound"), mean("classes", 6).alias("ref_classes"), mean("words", COMMON + 1).alias("ref_words"))
    return store(r.where(F.col("n_sound") >= LEAST_REFERENCE).drop("n_sound"), "reference")


def compared(f: DataFrame, reference: DataFrame, most_classes: float, most_common: float) -> DataFrame:
    """f with class_distance, word_distance and far; a language with fewer than COMMON common words has a shorter histogram."""
    f = f.join(few(reference, FEW_LANGUAGES), F.col("lang").eqNullSafe(F.col("ref_lang")), "left").withColumns({
        "class_distance": F.when(F.col("n_words") >= LEAST_WORDS, distance(F.col("classes"), F.col("ref_classes"))),
        "word_distance": F.when(F.col("n_words") >= LEAST_JUDGED, distance(F.col("words"), F.slice("ref_words", 1, F.size("words"))))})
    far = F.coalesce(F.col("class_distance") >= most_classes, F.lit(False)) | F.coalesce(F.col("word_distance") >= most_common, F.lit(False))
    return f.withColumn("far", far).drop("ref_lang", "ref_classes", "ref_words")


def judged(docs: DataFrame, *, most_classes: float = MOST_CLASSES, most_common: float = MOST_COMMON) -> DataFrame:
    """doc_id, lang, the base measures, base_failed, class_distance, word_distance and kept of every whole text of docs (doc_id, text, lang).

    base_failed: under 50 words, or over half of them in repeated windows. A distance is null where it isn't judged: a document of under
    100 words (words only), or a language of under 20 documents that are sound and as long. References are means over documents, so
    neither long texts nor one text's repetitions lead them, and are taken again without the documents that are far from the first ones.
    A null or empty text has no words and fails; a null language is one of its own; equal rows give equal rows; an empty table gives no
    rows; other columns are ignored.
    """
    docs = docs.select("doc_id", "lang", "text")
    f = store(features(docs, store(common_words(docs), "common")), "features")
    words = F.concat("words", F.array(F.col("n_words") - total(F.col("words"))))
    share = lambda c: F.transform(c, lambda x: F.floor(x * PPM / F.greatest(total(c), F.lit(1))))
    f = f.withColumns({"base_failed": (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")), "words": words})
    f = f.withColumns({"classes": share(F.col("classes")), "words": share(F.col("words"))})
    sound = f.where(~F.col("base_failed") & (F.col("n_words") >= LEAST_JUDGED))
    near = compared(sound, references(sound), most_classes, most_common).where("not far")
    f = compared(f, references(near), most_classes, most_common)
    return f.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", (~F.col("base_failed") & ~F.col("far")).alias("kept"))


def op13_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).drop("lang")
