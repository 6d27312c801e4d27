"""Personal data by base patterns and by bootstrapped contextual extraction, with DataFrame operations only.

The valid matches of the base patterns are seeds, and so are long hexadecimal strings (keys and tokens: kind secret, which no base
column counts). Seeds induce lexical patterns: the words before and after them, both, their shape, and their shape after a word. A
graph joins patterns with the identifier-like tokens that they fit, and scores pass between both sides for some rounds. Tokens
that trusted patterns vouch for are added as spans of the seeds' kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import few, store, table

KINDS = ("email", "ip", "card", "phone")
#: Kinds of all seeds: a secret is a span that the method adds, never a base one.
ALL_KINDS = (*KINDS, "secret")
#: Equal to the plain forms, but without repeated attempts inside a run of characters and without backtracking.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,128}+(?![0-9A-Za-z])",
}
#: A text without these has no match of the kind.
QUICK = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "secret": "[0-9A-Fa-f]{32}"}
WS = r"\x20\x09-\x0D"
#: A token with a digit or an at sign, from its first character on.
IDENTIFIER = rf"(?<![^{WS}])[^{WS}0-9@]*+[0-9@][^{WS}]*+"
ROUNDS = 3
#: A pattern counts from so many different seed tokens, and is trusted from this share of seeds among its tokens.
LEAST_SEEDS, TRUST = 5, 0.9
FEW_ROWS = 400_000


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def digit(i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + digit(i)) % 10 == 0


def valid(kind: Column, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    n = F.length(digits)
    part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return (
        F.when(kind == KINDS.index("ip"), hit.rlike(rf"^{part}(?:\.{part}){{3}}$"))
        .when(kind == KINDS.index("card"), F.when(n.between(13, 19), luhn(digits)).otherwise(F.lit(False)))
        .when(kind == KINDS.index("phone"), n.between(9, 15))
        .otherwise(F.lit(True))
    )


HIT = "struct<kind:int,gap:int,hit:string,left:string,right:string>"


def matches(text: Column, regex: str, tag: Column, left=None, right=None) -> Column:
    """An array of HIT: each match with the number of code points since the last one, and what left and right make of the
    texts around it. Those texts give the positions, which regular expression functions do not return."""
    none = lambda gap: F.lit("")
    hits = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    between = F.split(text, regex, -1)

    def made(x: Column) -> Column:
        return F.transform(x["hits"], lambda h, i: F.struct(tag.alias("kind"), F.length(F.get(x["gaps"], i)).alias("gap"), h.alias("hit"), (left or none)(F.get(x["gaps"], i)).alias("left"), (right or none)(F.get(x["gaps"], i + 1)).alias("right")))

    return F.transform(F.array(F.struct(hits.alias("hits"), between.alias("gaps"))), made)[0].cast(f"array<{HIT}>")


def keyed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with _key, which tells rows by id and text."""
    return docs.withColumn("_key", F.struct("doc_id", F.xxhash64("text").alias("h")))


def located(docs: DataFrame) -> DataFrame:
    """(_key, kind, start, end, hit, left, right) of base matches, valid ones only, and of identifier-like tokens (kind -1)."""
    t = F.col("text")
    none = F.array().cast(f"array<{HIT}>")
    last_words = lambda g: F.lower(F.regexp_extract(g, rf"((?:[^{WS}]+[{WS}]+)?[^{WS}]+)[{WS}]*$", 1))
    next_word = lambda g: F.lower(F.regexp_extract(g, rf"^[{WS}]*([^{WS}]+)", 1))
    found = [F.when(t.rlike(QUICK[k]), matches(t, BASE[k], F.lit(i))).otherwise(none) for i, k in enumerate(ALL_KINDS)]
    found.append(matches(t, IDENTIFIER, F.lit(-1), last_words, next_word))
    rows = docs.where(t.rlike("[0-9@]")).select("_key", F.monotonically_increasing_id().alias("_row"), F.concat(*found).alias("m"))
    rows = rows.select("_key", "_row", F.posexplode("m").alias("at", "m")).select("_key", "_row", "at", "m.*")
    before = Window.partitionBy("_key", "_row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.length("hit")).over(before)).withColumn("start", F.col("end") - F.length("hit"))
    return rows.where((F.col("kind") < 0) | valid(F.col("kind"), F.col("hit"))).select("_key", "kind", "start", "end", "hit", "left", "right").distinct()


def shape(hit: Column) -> Column:
    """Digits as 9, runs of letters as a."""
    return F.regexp_replace(F.regexp_replace(hit, r"\p{L}+", "a"), "[0-9]", "9")


def patterns_of(left: Column, right: Column, hit: Column) -> Column:
    """The patterns of a token: one and two words before it, the word after it, both, its shape, and its shape after a word. Words
    need a letter; shapes need five characters that are no letters, so that years or versions alone never make one."""
    word, form = F.element_at(F.split(left, rf"[{WS}]+"), -1), shape(hit)
    named = lambda c: c.rlike(r"\p{L}")
    strong = F.length(F.regexp_replace(form, "a", "")) >= 5
    one = lambda mark, test, *parts: F.when(test, F.concat_ws("\t", F.lit(mark), *parts))
    return F.array_distinct(F.array_compact(F.array(
        one("l1", named(word), word), one("l2", named(left), left), one("r1", named(right), right), one("lr", named(word) & named(right), word, right),
        one("s", strong, form), one("ls", named(word), word, form))))


def graph(tokens: DataFrame) -> DataFrame:
    """(pattern, instance, seed): different instances of each pattern that has LEAST_SEEDS seeds; others can never be trusted."""
    edges = tokens.select(F.explode("patterns").alias("pattern"), "instance", "seed").groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    alive = store(edges.groupBy("pattern").agg(F.count("seed").alias("seeds")).where(F.col("seeds") >= LEAST_SEEDS).select("pattern"), "alive")
    return store(edges.join(few(alive, FEW_ROWS), "pattern"), "edges")


def trusted(edges: DataFrame, rounds: int = ROUNDS, least: float = TRUST) -> DataFrame:
    """(pattern, kind, trust) of patterns of `least` or more.

    A pattern's trust in a kind is the sum of its instances' scores over their number and one more; an instance that is no seed
    scores 1 - the product of (1 - trust) over its patterns; a seed scores 1 for its kind."""
    fixed = edges.where("seed is not null").select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("s")).distinct()
    sizes = store(edges.groupBy("pattern").agg(F.count("*").alias("n")), "sizes")
    score, trust = fixed, None
    for _ in range(rounds):
        kinds = edges.select("pattern", "instance").join(score, "instance").groupBy("pattern", "kind").agg(F.sum("s").alias("s"))
        trust = store(kinds.join(few(sizes, FEW_ROWS), "pattern").select("pattern", "kind", (F.col("s") / (F.col("n") + 1.0)).alias("trust")), "trust")
        fresh = edges.where("seed is null").select("pattern", "instance").join(few(trust, FEW_ROWS), "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least("trust", F.lit(0.999)))))).alias("s"))
        score = store(fixed.unionAll(fresh), "score")
    return trust.where(F.col("trust") >= least)


def instances(found: DataFrame) -> DataFrame:
    """(_key, start, end, instance, seed, patterns) of identifier-like tokens. One on a base span stands for the whole match (numbers by
    their digits), whose kind is its seed; the words around its token are its patterns."""
    # the furthest end of the base spans that begin before a token's end tells whether they meet
    base = found.where("kind >= 0").select("_key", F.col("start").alias("pos"), F.lit(0).alias("side"), F.struct(F.col("end").alias("to"), "kind", "hit").alias("b"), F.lit(None).cast("struct<start:long,end:long,hit:string,left:string,right:string>").alias("t"))
    tokens = found.where("kind < 0").select("_key", F.col("end").alias("pos"), F.lit(-1).alias("side"), F.lit(None).cast(base.schema["b"].dataType).alias("b"), F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "hit", "left", "right").alias("t"))
    sweep = Window.partitionBy("_key").orderBy("pos", "side").rowsBetween(Window.unboundedPreceding, 0)
    tokens = base.unionAll(tokens).withColumn("b", F.max("b").over(sweep)).where("t is not null")
    word = F.regexp_replace(F.lower("t.hit"), r"^[^\p{L}\p{N}+]+|[^\p{L}\p{N}]+$", "")
    spaced = F.col("b.kind").isin(KINDS.index("card"), KINDS.index("phone"))
    whole = F.when(spaced, F.regexp_replace("b.hit", "[^+0-9]", "")).otherwise(F.lower("b.hit"))
    on_base = F.coalesce(F.col("b.to") > F.col("t.start"), F.lit(False))
    tokens = tokens.select("_key", F.col("t.start").alias("start"), F.col("t.end").alias("end"), F.when(on_base, whole).otherwise(word).alias("instance"), F.when(on_base, F.col("b.kind")).alias("seed"),
                           patterns_of(F.col("t.left"), F.col("t.right"), F.when(on_base, F.lower("b.hit")).otherwise(word)).alias("patterns"))
    return tokens.where("instance <> ''")


def discovered(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(_key, kind, start, end): tokens off the base spans that trusted patterns vouch for, and the secrets among the seeds."""
    tokens = store(instances(found), "tokens")
    best = trusted(graph(tokens), rounds)
    got = tokens.where("seed is null").select("_key", "start", "end", F.explode("patterns").alias("pattern")).join(few(best, FEW_ROWS), "pattern")
    got = got.groupBy("_key", "start", "end").agg(F.max(F.struct("trust", "kind")).alias("best")).select("_key", F.col("best.kind").alias("kind"), "start", "end")
    secrets = found.where(F.col("kind") == ALL_KINDS.index("secret")).select("_key", "kind", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    return got.unionAll(secrets)


def spans_of(docs: DataFrame) -> DataFrame:
    """(_key, kind, start, end, base): base spans (base true) and added ones. Code points, end exclusive."""
    found = store(located(docs), "located")
    base = found.where(F.col("kind").between(0, len(KINDS) - 1)).select("_key", "kind", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.lit(True).alias("base"))
    return store(base.unionAll(discovered(found).select("_key", "kind", "start", "end", F.lit(False).alias("base"))), "spans")


def written(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in ALL_KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def extract(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of every whole text.

    A null or empty text has no spans; a null doc_id is kept; equal rows give equal rows; an empty table gives no rows; further
    columns are ignored. Spans of different kinds may overlap. Kinds in spans: the base ones, then secret.
    """
    docs = keyed(docs.select("doc_id", "text"))
    one = F.struct("kind", "start", "end")
    per = spans_of(docs).groupBy("_key").agg(
        *(F.count(F.when(F.col("base") & (F.col("kind") == i), 1)).alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.sha2(written(F.collect_list(F.when(F.col("base"), one))), 256).alias("base_sha256"),
        written(F.collect_list(one)).alias("spans"),
        F.count(F.when(~F.col("base"), 1)).alias("n_added"),
    )
    out = docs.select("doc_id", "_key").join(per, "_key", "left")
    zero = {f"n_{k}": F.coalesce(f"n_{k}", F.lit(0).cast("long")) for k in (*KINDS, "added")}
    return out.withColumns(zero | {"base_sha256": F.coalesce("base_sha256", F.sha2(F.lit(""), 256)), "spans": F.coalesce("spans", F.lit(""))}).drop("_key")


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets, and n_chars, where docs have it, of the new text.

    Overlapping spans become one, of the first kind listed. Null and empty texts and texts without spans stay as they are, null ids
    and repeated rows too; an empty table gives no rows; columns of any name are kept."""
    spans = spans_of(keyed(docs.select("doc_id", "text"))).select("_key", "kind", "start", "end").distinct()
    order = Window.partitionBy("_key").orderBy("start", "end", "kind")
    spans = spans.withColumn("new", (F.col("start") >= F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("int"))
    spans = spans.withColumn("island", F.sum("new").over(order)).groupBy("_key", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("kind").alias("kind"))
    lists = store(spans.groupBy(F.col("_key.doc_id").alias("id"), F.col("_key.h").alias("h")).agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("spans")), "islands")
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in ALL_KINDS))
    text = F.col("row.text")
    prior = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.element_at("spans", F.greatest(i, F.lit(1)).cast("int"))["end"]).cast("int")
    parts = F.transform("spans", lambda s, i: F.concat(F.substring(text, prior(i) + 1, s["start"].cast("int") - prior(i)), F.element_at(names, s["kind"] + 1)))
    tail = F.substring(text, F.element_at("spans", -1)["end"].cast("int") + 1, F.length(text))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("row.text") == F.col("h"))
    out = rows.join(few(lists, FEW_ROWS), same, "left").withColumn("clean", F.when(F.col("spans").isNotNull(), F.concat(F.array_join(parts, ""), tail)).otherwise(text))
    changed = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("spans").isNotNull(), F.length("clean").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("row.n_chars"))
    return out.select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def op2_pii(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "documents"))


def pipeline_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and secrets redacted and n_chars to match; everything else as redact() states."""
    return redact(docs)
